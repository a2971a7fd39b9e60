"""Column functions for text: cleaning, first-only replacement, statement fingerprints, JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a fingerprint is called when a statement's body was cut off and no sibling has it.
NO_BODY = "(sp_executesql — sql body not captured by dmv)"
#: Leading parameter list of a prepared statement; possessive, so that its length doesn't cost stack.
PARAM_HEADER = r"^\(@p[\d?](?:[^)(]++|\([^)]*+\))*+\)\s*"
QUOTED = r"'[^']*'"
#: A number that stands alone, with ASCII word boundaries.
NUMBER = r"(?<![0-9A-Za-z_])\d+\.?\d*(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
SPACES = r"\s+"


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean(c: Column) -> Column:
    """Trimmed, runs of white space as one blank, numbered parameters as ``@P?``."""
    return F.regexp_replace(strip(F.regexp_replace(c, r"(?U)\s+", " ")), r"@P\d+", "@P?")


def replace_first(c: Column, pattern: str, by: str) -> Column:
    """Replaces the first match only; ``by`` is literal text, and the pattern matches no empty text."""
    return F.array_join(F.split(c, pattern, 2), by)


def replace_in(c: Column, pattern: str, by: str, every: bool) -> Column:
    return F.regexp_replace(c, pattern, by) if every else replace_first(c, pattern, by)


def without_header(c: Column) -> Column:
    """Lower case, without a leading parameter list."""
    return F.regexp_replace(F.lower(c), PARAM_HEADER, "")


def fingerprint_body(c: Column, replace_all: bool = False) -> Column:
    """Shape of a statement, 300 characters at most. By default only the first literal, number and run of blanks fold."""
    return folded(without_header(c), replace_all)


def folded(body: Column, replace_all: bool = False) -> Column:
    """The fingerprint of a text that has lost its header."""
    for pattern, by in ((QUOTED, "?"), (NUMBER, "?"), (SPACES, " ")):
        body = replace_in(body, pattern, by, replace_all)
    return F.substring(body, 1, 300)


def has_body(body: Column) -> Column:
    return (F.length(F.trim(body)) >= 5) & ~body.like("(@p%")


def first_given(*columns: Column) -> Column:
    """The first that isn't null, cleaned of outer white space; empty if none is given."""
    return strip(F.coalesce(*columns, F.lit("")))


def blank_to_null(c: Column) -> Column:
    return F.when(strip(c) != "", c)


def json_text(fields: dict[str, Column], flags: dict[str, Column] | None = None) -> Column:
    """A JSON object as text with ``", "`` and ``": "`` between its parts, non-ASCII kept.

    Blank fields and false flags are left out, in the order given; null where nothing is left.
    """
    flags = flags or {}
    parts = []
    for key, value in fields.items():
        if key in flags:
            parts.append(F.when(flags[key], F.lit(f'"{key}": true')))
            continue
        one = F.to_json(F.struct(value.alias("v")))
        parts.append(F.when(value != "", F.concat(F.lit(f'"{key}": '), F.substr(one, F.lit(6), F.length(one) - 6))))
    joined = F.concat_ws(", ", *parts)
    return F.when(joined != "", F.concat(F.lit("{"), joined, F.lit("}")))


def like_text(c: Column, needle: str) -> Column:
    """Substring test of the lists: ASCII case is ignored, % and _ act as wildcards."""
    return c.ilike(f"%{needle}%")


def search_text(needle: str) -> str:
    """What the list search looks for: blanks folded and numbered parameters generalised."""
    import re

    return re.sub(r"@P\d+", "@P?", re.sub(r"\s+", " ", needle.strip()))


def parameter_count(fingerprint: Column) -> Column:
    """How many parameters a fingerprint's leading list declares; 0 without a closed list."""
    block = F.regexp_extract(fingerprint, r"^\(@p\?(?:[^)(]++|\([^)]*+\))*+\)", 0)
    return F.regexp_count(block, F.lit(r"@p\?")).cast("int")


def readable(fingerprint: Column) -> Column:
    """A fingerprint without its leading parameter list, from the first statement keyword after a bracket on."""
    body = F.regexp_extract(fingerprint, r"(?s)\)\s*((?:select|insert|update|delete|exec|with|begin|declare|create|merge).*)\z", 1)
    return F.when(fingerprint.startswith("(@p?") & (body != ""), F.trim(body)).otherwise(fingerprint)
