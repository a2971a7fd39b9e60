"""Which files of a table can hold a piece of text: an index of three-byte pieces."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import like_text
from .store import Store


FILE_ROWS = 1_000_000  # of the index


def grams(text: str) -> list[int]:
    """The different three-byte pieces of a text in UTF-8, as numbers."""
    raw = np.frombuffer(text.encode(), np.uint8).astype(np.int32)
    return np.unique(raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]).tolist() if len(raw) > 2 else []


def needed(needle: str) -> list[int]:
    """The pieces that every match of a lower-case pattern holds; % and _ stand for anything. Empty if the pattern is too short to tell."""
    return sorted({g for part in re.split("[%_]", needle) for g in grams(part)})


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, gram) of what a batch of texts holds, each once per batch and file."""
    for batch in batches:
        held: dict[str, set[int]] = {}
        for path, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            held.setdefault(path, set()).update(grams(text.as_py() or ""))
        paths = [p for p, s in held.items() for _ in s]
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array([g for s in held.values() for g in s], pa.int32())], names=["path", "gram"])


class TextIndex:
    """(path, gram) pairs of a table's files, kept as a table of the same store.

    Data files never change, so only files that the index hasn't met are read by ``refresh``, and pairs of files that are no longer
    in the table do no harm. A search reads the pairs of its own pieces, then the files that hold all of
    them, and tests every row of these; a search for less than three bytes reads all files.
    """

    def __init__(self, store: Store, table: str, column: str):
        self.store, self.table, self.column = store, table, column
        self.name = f"index_{table}_{column}"
        store.define(self.name, "path string, gram int", "path", ["path"], FILE_ROWS)

    def refresh(self) -> int:
        """Takes in the files that are new; returns how many."""
        known = {r.path for r in self.store.read(self.name).where("gram = -1").select("path").collect()}  # a row for each file
        version = self.store.version(self.table)
        new = [f for f in version.all_files() if f["path"] not in known]
        if not new:
            return 0
        rows = self.store.files_frame(self.table, version, new)
        pairs = rows.select("path", F.lower(self.column).alias("text")).mapInArrow(_pairs, "path string, gram int").distinct()
        seen = self.store.spark.createDataFrame([(f["path"], -1) for f in new], "path string, gram int")
        self.store.rewrite(self.name, pairs.unionByName(seen), lambda old, fresh: old.unionByName(fresh), tries=4)
        return len(new)

    def files(self, needle: str) -> tuple[list[dict], int]:
        """(files that can hold a match, number of all files)."""
        every = self.store.version(self.table).all_files()
        low = self.store.spark.range(1).select(F.lower(F.lit(needle)).alias("n")).first().n
        wanted = needed(low)
        if not wanted:
            return every, len(every)
        pairs = self.store.read(self.name)
        whole = pairs.where(F.col("gram").isin(wanted)).distinct().groupBy("path").agg(F.count("*").alias("n")).where(F.col("n") == len(wanted))
        full = {r.path for r in whole.collect()}  # a row for each file
        known = {r.path for r in pairs.where("gram = -1").select("path").collect()}
        return [f for f in every if f["path"] in full or f["path"] not in known], len(every)

    def search(self, needle: str) -> DataFrame:
        """The rows whose text holds the needle, as the lists' search finds them: case is ignored, % and _ stand for anything."""
        kept, _ = self.files(needle)
        rows = self.store.files_frame(self.table, self.store.version(self.table), kept).drop("path") if kept else self.store.read(self.table).limit(0)
        return rows.where(like_text(F.col(self.column), needle))
