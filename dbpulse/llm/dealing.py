"""Dealing rows by ranges of a key, with bounds that are keys of real rows."""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_sample


def bounds(rows: DataFrame, key: str, per_part: int, most_parts: int = 32_768, oversample: int = 8) -> list:
    """Ascending keys at which parts of about ``per_part`` rows begin; the first is the smallest of all. Empty without rows.

    The driver gets ``oversample * most_parts`` keys at most. Parts beyond ``most_parts`` become larger, so whoever
    reads a part reads it as a stream.
    """
    total = rows.agg(F.count(key).alias("n"), F.min(key).alias("least")).first()
    if not total.n:
        return []
    parts = max(1, min(most_parts, -(-total.n // per_part)))
    plain = lambda v: bytes(v) if isinstance(v, bytearray) else v
    sample = sorted({plain(r[0]) for r in hash_sample(rows.select(key).where(F.col(key).isNotNull()), key, oversample * parts, total.n).collect()})
    return sorted({plain(total.least), *(sample[k * len(sample) // parts] for k in range(1, parts))})


def part_of(key: Column, cuts: list, kind: str = "long") -> Column:
    """(part, first): the part that a key falls into, and whether it is the key at which the part begins."""

    @F.pandas_udf("part int, first boolean")
    def place(keys: pd.Series) -> pd.DataFrame:
        at = [bisect_right(cuts, k) - 1 for k in keys]
        return pd.DataFrame({"part": pd.Series(at, dtype="int32"), "first": [cuts[p] == k for p, k in zip(at, keys, strict=True)]})

    return place(key.cast(kind))
