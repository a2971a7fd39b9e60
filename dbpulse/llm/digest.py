"""Exact fingerprints of documents in canonical form.

The canonical form is NFKC, case-folded, NFKC again, with every run of white space
of any kind as one blank and none at the ends. Its fingerprint is a 128-bit xxh3
digest. Within a bucket of equal digests canonical texts are compared by their bytes,
as keys of an aggregate that combines before it shuffles; a bucket with several texts
numbers them. So equal fingerprints mean equal canonical texts, even of texts that
somebody made to collide.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from unicodedata import normalize

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if, cut, ship
from .dealing import bounds, part_of

PER_PART = 4_096  # documents that are read in order by one task, about
BROADCAST_ROWS = 500_000  # ids of 8 bytes, sent to every executor at most; beyond, the join shuffles


def canonical(text: str) -> bytes:
    return " ".join(normalize("NFKC", normalize("NFKC", text).casefold()).split()).encode()


def digest(form: bytes, bits: int = 128) -> str:
    """Hexadecimal digest of a canonical form; fewer bits serve to test what happens when digests collide."""
    return f"{xxhash.xxh3_128_intdigest(form) >> 128 - bits:0{bits // 4}x}"


def _forms(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = [canonical(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([digest(f, bits) for f in forms]), pa.array(forms, pa.binary())], names=["doc_id", "digest", "form"])

    return run


def confirmed(printed: DataFrame, docs: DataFrame, bits: int = 128) -> DataFrame:
    """``printed`` (doc_id, digest, ...) with ``fingerprint`` and ``group_id``, by comparing the canonical texts in equal buckets.

    Only texts whose digest another row shares are read again. The group is the smallest id with the same canonical
    text. Where a digest stands for several texts, these are numbered by their bytes, and the number joins the
    fingerprint. Rows without an id get the fingerprint of their bucket's first text and no group.
    """
    # a written table, so that adaptive execution can split the joins of a bucket with very many rows
    buckets = cut(printed.groupBy("digest").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("n")), "buckets")
    shared = cut(printed.where("doc_id is not null").join(buckets.where("n > 1").select("digest"), "digest", "left_semi").select("doc_id").distinct(), "shared")
    ids = broadcast_if(shared, shared.count(), BROADCAST_ROWS)
    texts = docs.where("doc_id is not null").join(ids, "doc_id", "left_semi").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    forms = texts.mapInArrow(_forms(bits), "doc_id long, digest string, form binary")
    distinct = forms.groupBy("digest", "form").agg(F.min("doc_id").alias("group_id"))
    several = cut(distinct.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest"), "several")
    first = printed.join(buckets.select("digest", "group_id"), "digest", "left").withColumn("group_id", F.when(F.col("doc_id").isNotNull(), F.col("group_id")))
    if not (n := several.count()):
        return first.withColumn("fingerprint", F.col("digest"))
    # canonical texts that share a digest: as many as somebody made
    own = forms.join(broadcast_if(several, n, BROADCAST_ROWS), "digest", "left_semi")
    rank = F.row_number().over(Window.partitionBy("digest").orderBy("form")) - 1
    numbered = own.groupBy("digest", "form").agg(F.min("doc_id").alias("least")).withColumn("rank", rank)
    placed = own.join(numbered, ["digest", "form"]).select("doc_id", "digest", "rank", "least").distinct()
    both = first.join(placed, ["doc_id", "digest"], "left")
    name = F.when(F.coalesce("rank", F.lit(0)) > 0, F.concat_ws("-", "digest", F.col("rank").cast("string"))).otherwise(F.col("digest"))
    return both.withColumn("group_id", F.coalesce("least", "group_id")).withColumn("fingerprint", name).drop("rank", "least")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 128) -> DataFrame:
    """(doc_id, n_chars, fingerprint, group_id) of every row: equal fingerprints are equal canonical texts.

    Null counts as empty; empty and blank texts are equal. A row without an id has a fingerprint and no group. Rows may
    repeat ids; their group is that of their own text. Other columns are not read.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [digest(canonical(t.as_py()), bits) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(marks, pa.string())], names=["doc_id", "n_chars", "digest"])

    text = F.coalesce("text", F.lit(""))
    printed = cut(rows.select("doc_id", text.alias("text"), F.length(text).cast("long").alias("n_chars")).mapInArrow(run, "doc_id long, n_chars long, digest string"), "printed")
    return confirmed(printed, rows, bits).select("doc_id", "n_chars", "fingerprint", "group_id")


_EDITS = "doc_id long, n_chars long, edited_sha256 string, digest string, edited_fingerprint string, near_edited double, near_next double"


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by part and order, each with the one after it; a part's last row is the one that begins the next part."""
    part, held = None, None
    for batch in batches:
        out: list[tuple] = []
        for to, own, doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
            if to != part:
                part, held = to, None
            if not own and held is None:
                continue
            text = value.as_py()
            form = canonical(text)
            mark = digest(form)
            if held is not None:
                old_id, old_text, old_form, old_mark = held
                half = len(old_text) // 2
                edited = old_text[: len(old_text) - half] + text[:half]
                new_form = canonical(edited)
                new_mark = digest(new_form)
                same = lambda a, b, x, y: float(a == b and x == y)  # noqa: E731  digests, then bytes
                out.append((old_id, len(old_text), sha256(edited.encode()).hexdigest(), old_mark, new_mark, same(old_mark, new_mark, old_form, new_form), same(old_mark, mark, old_form, form)))
            held = (doc_id, text, form, mark) if own else None
        names = [c.split()[0] for c in _EDITS.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [[]] * len(kinds), kinds, strict=True)], names=names)


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, group_id) of every row.

    A row's edited text is its own with the last half replaced by as much of the next row's, by ascending id; the last
    row's next is the first. Rows that repeat an id follow one another by a hash of their texts, in one part, which is
    read as a stream. A row without an id has no place in the order: what tells of edits is null. Likeness is 1 for
    equal canonical texts and otherwise 0, as an exact fingerprint tells no more; it is decided by bytes. The edited
    text's fingerprint is its digest. Null texts count as empty.

    Texts are shuffled once, by ranges of ids; the row that begins a part also goes to the part before it.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    named = rows.where("doc_id is not null")
    cuts = bounds(named, "doc_id", PER_PART)
    n = max(1, len(cuts))
    place = F.struct(F.col("at.part").alias("to"), F.lit(True).alias("own"))
    ahead = F.struct(F.pmod(F.col("at.part") - 1, F.lit(n)).cast("int").alias("to"), F.lit(False).alias("own"))
    dealt = named.withColumn("at", part_of(F.col("doc_id"), cuts)).select("doc_id", "text", F.explode(F.when(F.col("at.first"), F.array(place, ahead)).otherwise(F.array(place))).alias("x"))
    dealt = dealt.select("x.to", "x.own", "doc_id", "text").repartition("to").sortWithinPartitions("to", F.desc("own"), "doc_id", F.xxhash64("text"))
    edited = dealt.mapInArrow(_edits, _EDITS)
    unnamed = fingerprints(rows.where("doc_id is null")).select("doc_id", "n_chars", F.lit(None).cast("string").alias("edited_sha256"), F.col("fingerprint").alias("digest"), F.lit(None).cast("string").alias("edited_fingerprint"), F.lit(None).cast("double").alias("near_edited"), F.lit(None).cast("double").alias("near_next"))
    printed = cut(edited.union(unnamed), "edits")
    out = confirmed(printed, rows)
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "group_id")
