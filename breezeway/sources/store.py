"""Readings stored as parts, one folder a date.

Rows are clustered by date and sorted by entity and time inside a file, so a time filter
skips directories and an entity filter skips row groups; entities do not become
directories, their number is not bounded. Each append is a part of its own; deletes write
the dates anew that they touch. Both count once the manifest names them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from breezeway.operators import dedup
from breezeway.operators.series import Series
from breezeway.session import discard, materialise
from breezeway.sources.manifest import PartTable, Version, versions


@dataclass(frozen=True)
class ReadingStore:
    spark: SparkSession
    root: str
    schema: T.StructType
    series: Series = Series()

    @property
    def table(self) -> PartTable:
        s = self.series
        return PartTable(self.spark, self.root, self.schema, "date", F.to_date(s.ts), (*s.key, *s.order))

    def versions(self) -> list[int]:
        return versions(self.spark, self.root)

    def read(self, version: int | None = None) -> DataFrame:
        """The newest version, or an older one, with its ``date`` column."""
        return self.table.read(version)

    def append(self, df: DataFrame) -> Version:
        return self.table.append(df)

    def append_stamped(self, df: DataFrame, batch: int, at: Column | None = None,
                       order: list[str] | None = None) -> DataFrame:
        """Append with the write time and fresh ids; returns the ids.

        An id is the batch number and the exact place of the row in the batch (up to 2**44
        rows, 2**19 batches): rows are written once, counted per partition, and a
        partition starts after the rows of those before it.
        """
        at = F.current_timestamp() if at is None else at
        placed = (df.sortWithinPartitions(*order) if order else df).withColumn("_at", F.monotonically_increasing_id())
        written = materialise(placed, "unstamped")
        placed = written.withColumn("_part", F.shiftright("_at", 33))
        parts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
        earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        starts = parts.select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start"))
        place = F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
        stamped = placed.join(F.broadcast(starts), "_part").withColumn(self.series.ts, at).withColumn(
            self.series.seq, F.lit(batch << 44) + place)
        stamped = materialise(stamped.select(*self.schema.names), "stamped")
        discard(written)
        self.append(stamped)
        return stamped.select(self.series.seq)

    def replace(self, df: DataFrame) -> Version:
        """Make ``df`` the next version; readers of older ones are not disturbed."""
        return self.table.replace(df)

    def delete_ids(self, ids: DataFrame) -> Version:
        """Remove rows by id; only the dates that hold one are written anew."""
        wanted, seq = ids.select(self.series.seq), self.series.seq
        return self.table.change(
            lambda rows: rows.join(wanted, seq, "left_semi"), lambda rows: dedup.delete_ids(rows, wanted, seq))

    def delete_where(self, condition: Column) -> Version:
        """Remove rows for which ``condition`` is true; only their dates are written anew."""
        gone = F.coalesce(condition, F.lit(False))
        return self.table.change(lambda rows: rows.where(gone), lambda rows: rows.where(~gone))

    def delete_all(self) -> Version:
        """Remove all rows; nothing is read or written but the manifest."""
        return self.table.commit(lambda base: ({}, {}))

    def vacuum(self, keep: int = 1) -> list[int]:
        """Remove older versions and unused parts; only while nobody writes."""
        return self.table.vacuum(keep)
