"""Roll-ups that are kept, and advanced by what changed in their table since."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.changes import added_up, rolled, signed
from ..sources.store import Store

DIMENSIONS = ["environment", "type", "source", "host", "db_name", "month_year"]


class Rollup:
    """Rows and occurrences of a table by some columns, as a table of the same store.

    ``advance`` reads only the files in which two versions of the table differ, and writes only the buckets of the
    groups that changed. The version it has come to is the token of its last write: an advance that is repeated, or made
    by two at once, counts nothing twice.
    """

    def __init__(self, store: Store, table: str = "raw_query", keys: list[str] = DIMENSIONS):
        self.store, self.table, self.keys = store, table, list(keys)
        self.name = f"rollup_{table}_" + "_".join(keys)
        kinds = {f.name: f.dataType.simpleString() for f in store.schema(table).fields}
        store.define(self.name, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", row_count long, total_occurrences long, group_key string", "group_key")

    def _group_key(self) -> Column:
        return F.md5(F.to_json(F.struct(*self.keys)).cast("binary"))  # nulls are left out, so they differ from empty texts

    def at(self) -> int:
        """The version of the table that the roll-up tells of; 0 for none."""
        return max((int(t) for t in self.store.tokens(self.name)), default=0)

    def advance(self) -> int:
        """Brings the roll-up to the table's newest version, and returns that."""
        since, now = self.at(), self.store.version(self.table).number
        if since == now:
            return now
        if since not in self.store.numbers(self.table):  # the first time, or the version it tells of is gone
            rows = self.store.read_version(self.table, now).withColumn("sign", F.lit(1))
            self.store.write(self.name, rolled(rows, self.keys).withColumn("group_key", self._group_key()), str(now))
            return now
        feed = self.store.changes(self.table, since, now)
        delta = rolled(signed(feed), self.keys).where("row_count <> 0 or total_occurrences <> 0").withColumn("group_key", self._group_key())
        self.store.rewrite(self.name, delta, lambda old, new: added_up(old.unionByName(new), [*self.keys, "group_key"]), str(now))
        return now

    def read(self, keys: list[str] | None = None) -> DataFrame:
        """The groups, or coarser ones."""
        return added_up(self.store.read(self.name), self.keys if keys is None else keys)
