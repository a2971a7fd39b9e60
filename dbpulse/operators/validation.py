"""Checks of an incident file before it is taken in."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS, SAMPLE_CHARS = 50, 500
# Columns that a file of each category must have, and those that may hold a deadlock's text.
REQUIRED = {
    "slow_query_sql": ["host", "db_name", "query_final"],
    "blocker": ["host", "database_name", "query_text"],
    "deadlock": [],
    "slow_query_mongo": ["host", "_raw"],
}
DEADLOCK_TEXTS = ["_raw", "all_query", "clean_query", "query_text", "statement", "sql_text"]


#: What a finding says, by its code; errors refuse the file.
ERROR, WARNING = "error", "warning"
SAYS = {
    "kind": "The file's name doesn't say what it holds.",
    "rows": "The file has no rows.",
    "columns": "Missing columns: {subject}",
    "text": "No column holds the text of a deadlock.",
    "host": "There is no host column; hosts will be empty.",
    "layout": "Deadlock layout: {subject}.",
    "nulls": "Column {subject} is null in {share:.1%} of rows.",
    "environment": "The file's name tells no environment.",
}
LAYOUTS = {"legacy": "one row per event, occurrences from count", "raw": "one row per process of each graph", "summarised": "rows are taken as they are"}


class Finding(NamedTuple):
    level: str
    code: str
    subject: str = ""
    share: float = 0.0

    @property
    def text(self) -> str:
        return SAYS[self.code].format(subject=LAYOUTS.get(self.subject, self.subject), share=self.share)


@dataclass(frozen=True)
class Report:
    """The findings about a file, its number of rows, null shares of its required columns, and its first rows."""

    findings: list[Finding]
    row_count: int = 0
    null_rates: dict[str, float] = field(default_factory=dict)
    sample_rows: list[dict] = field(default_factory=list)

    def texts(self, level: str) -> list[str]:
        return [f.text for f in self.findings if f.level == level]

    errors = property(lambda self: self.texts(ERROR))
    warnings = property(lambda self: self.texts(WARNING))
    is_valid = property(lambda self: not self.errors)


def null_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the share of nulls in each column, rounded to 4 digits."""
    return df.agg(*[F.round(F.avg(F.col(f"`{c}`").isNull().cast("int")), 4).alias(c) for c in columns])


def sample(df: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> DataFrame:
    """The first rows, long texts cut with a mark."""
    cut = lambda c: F.when(F.length(c) > chars, F.concat(F.substring(c, 1, chars), F.lit("…[truncated]"))).otherwise(c)
    return df.limit(rows).select(*[cut(F.col(f"`{c}`")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes])


def own_columns(df: DataFrame) -> list[str]:
    """The file's columns, without what reading adds."""
    return [c for c in df.columns if c not in ("file_name", "seq", "__malformed")]


def facts(df: DataFrame, category: str) -> DataFrame:
    """One row: the number of rows, and the share of nulls in each required column that is there."""
    present = [c for c in REQUIRED.get(category, []) if c in own_columns(df)]
    return df.agg(F.count("*").alias("__rows"), *[F.avg(F.col(f"`{c}`").isNull().cast("int")).alias(c) for c in present])


def facts_of_files(df: DataFrame, category: str) -> dict[str, dict]:
    """The facts by file name, in one aggregate; files without rows aren't there."""
    present = [c for c in REQUIRED.get(category, []) if c in own_columns(df)]
    broken = F.count_if("__malformed") if "__malformed" in df.columns else F.lit(0)
    rows = df.groupBy("file_name").agg(F.count("*").alias("__rows"), broken.alias("__malformed"), *[F.avg(F.col(f"`{c}`").isNull().cast("int")).alias(c) for c in present])
    return {r.file_name: {k: v for k, v in r.asDict().items() if k != "file_name"} for r in rows.collect()}  # a row for each file


def findings(columns: list[str], seen: dict, category: str, environment: str) -> list[Finding]:
    """The findings that a file's columns, facts and name give. Each rule is (holds, finding); the first three end the matter."""
    if category not in REQUIRED:
        return [Finding(ERROR, "kind")]
    if not seen["__rows"]:
        return [Finding(ERROR, "rows")]
    have, graph = set(columns), category == "deadlock"
    missing = [c for c in REQUIRED[category] if c not in have]
    layout = "legacy" if have & {"clean_query", "all_query"} else "raw" if "_raw" in have else "summarised"
    rules = [
        (bool(missing), Finding(ERROR, "columns", ", ".join(missing))),
        (graph and not have & set(DEADLOCK_TEXTS), Finding(ERROR, "text")),
        (graph and "host" not in have, Finding(WARNING, "host")),
        (graph, Finding(WARNING, "layout", layout)),
        *[(seen[c] > 0.5, Finding(WARNING, "nulls", c, float(seen[c]))) for c in REQUIRED[category] if c in have],
        (environment == "unknown", Finding(WARNING, "environment")),
    ]
    return [finding for holds, finding in rules if holds]


def validate(df: DataFrame, category: str, environment: str) -> Report:
    """Everything there is to say about a file before it is taken in; one aggregate and a few sample rows."""
    columns = own_columns(df)
    seen = facts(df, category).first().asDict() if category in REQUIRED else {"__rows": 0}
    rows = sample(df.select(*[F.col(f"`{c}`") for c in columns])).collect() if seen["__rows"] else []
    return report(columns, seen, category, environment, [r.asDict() for r in rows])


def report(columns: list[str], seen: dict, category: str, environment: str, rows: list[dict]) -> Report:
    shares = {c: round(float(seen[c]), 4) for c in seen if not c.startswith("__") and seen[c] is not None}
    return Report(findings(columns, seen, category, environment), seen["__rows"], shares, rows)
