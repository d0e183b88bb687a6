"""Pages far into an ordered table: ranges of the order are written as partitions once, and a page reads only those that hold it.

``offset`` sends all rows before a page through one task. Here the ranges' counts, one number each, tell where a page begins, and at
most the ranges that it spans are read and sorted.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltmarsh.sources.shared import shared_dir

#: Ranges that a table is written in.
RANGES = 64


@dataclass
class Ranged:
    """A table in ranges of its order: where it lies, its schema's source, the order, and how many rows each range has."""

    rows: DataFrame
    order: tuple[str, ...]
    counts: list[int]

    @property
    def total(self) -> int:
        return sum(self.counts)

    def ranges_of(self, page: int, size: int) -> tuple[list[int], int]:
        """The ranges that a page spans, and how many of their rows stand before it."""
        ends = list(accumulate(self.counts))
        first, last = size * (page - 1), min(size * page, self.total)
        held = [k for k, end in enumerate(ends) if end > first and end - self.counts[k] < last]
        return held, first - (ends[held[0]] - self.counts[held[0]]) if held else 0

    def page(self, page: int, size: int = 50) -> DataFrame:
        """The rows of a page (from 1), in order; none beyond the last."""
        held, skip = self.ranges_of(page, size)
        own = self.rows.filter(F.col("_range").isin(held)) if held else self.rows.limit(0)
        return own.orderBy(*(F.col(c).asc_nulls_first() for c in self.order)).offset(skip).limit(size).drop("_range")


def ranged(rows: DataFrame, order: tuple[str, ...], ranges: int = RANGES) -> Ranged:
    """Write the rows in ranges of their order, nulls first. Rows that tie in the whole order share a range; their own order is left open."""
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/ranged-{uuid.uuid4().hex}"
    dealt = rows.repartitionByRange(ranges, *(F.col(c).asc_nulls_first() for c in order)).withColumn("_range", F.spark_partition_id())
    dealt.write.partitionBy("_range").parquet(path)
    table = spark.read.schema(dealt.schema).parquet(path)
    found = {r["_range"]: r["count"] for r in table.groupBy("_range").count().collect()}  # one row for each range
    return Ranged(table, order, [found.get(k, 0) for k in range(max(found, default=-1) + 1)])
