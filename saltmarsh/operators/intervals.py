"""What held on a date: histories as validity intervals, and a join of dates with the intervals that hold them.

An interval of up to 2^k days touches two blocks of 2^k days at most, and a date lies in one block of each size. So dates meet intervals by equality
of size and block: two rows for each interval, one for each date and size, however long anything was valid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Blocks of 1 to 2^SIZES days; a last interval without an end has none of these and meets all dates from its beginning in blocks of twice as many.
SIZES = 22
_OPEN = 1 << SIZES


def days(at: Column) -> Column:
    return F.datediff(at.cast("date"), F.lit("1970-01-01").cast("date"))


def validity(rows: DataFrame, key: str, at: str, order: tuple[str, ...] = ()) -> DataFrame:
    """The rows with valid_from and valid_to (dates, the latter exclusive and null for what still holds). Of a key's rows of one day the last in order counts."""
    day = F.col(at).cast("date")
    per_day = W.partitionBy(key, day).orderBy(*(F.desc(c) for c in (at, *order)))
    last = rows.withColumn("_n", F.row_number().over(per_day)).filter("_n = 1").drop("_n").withColumn("valid_from", day)
    return last.withColumn("valid_to", F.lead("valid_from").over(W.partitionBy(key).orderBy("valid_from")))


def as_of(intervals: DataFrame, dates: DataFrame) -> DataFrame:
    """For every date (column ``date``) the rows whose interval holds it: valid_from <= date < valid_to."""
    begin = days(F.col("valid_from"))
    end = F.when(F.col("valid_to").isNull(), begin + _OPEN).otherwise(days(F.col("valid_to")))
    sized = intervals.withColumns({"_a": begin, "_b": end}).filter("_b > _a").withColumn("_size", F.ceil(F.log2(F.col("_b") - F.col("_a"))).cast("int"))
    block = lambda day: F.floor(day / F.pow(F.lit(2.0), "_size")).cast("long")
    touched = sized.withColumn("_block", F.explode(F.array_distinct(F.array(block(F.col("_a")), block(F.col("_b") - 1)))))
    asked = dates.select("date").distinct().withColumn("_day", days(F.col("date"))).withColumn("_size", F.explode(F.sequence(F.lit(0), F.lit(SIZES)))).withColumn("_block", block(F.col("_day")))
    met = asked.join(touched, ["_size", "_block"]).filter("_a <= _day and _day < _b")
    return met.select("date", *intervals.columns)
