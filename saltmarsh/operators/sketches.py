"""Statistics of many days from sketches kept for each snapshot day: a day is sketched once, and any range of days is a merge.

Counts and sums are exact. Distinct ids are HyperLogLog sketches of 2^LG_K registers, whose error is about 1.04 / sqrt(2^LG_K) (1.6 %);
values are KLL sketches with K, whose ranks are off by about 1.7 % at most (99 % of the time). Both merge in any order and grouping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K, K = 12, 200
#: Three standard errors of a distinct count, as a share of it; a bound for a quantile's rank.
DISTINCT_ERROR, RANK_ERROR = 3 * 1.04 / 2 ** (LG_K / 2), 0.03


def daily(rows: DataFrame, at: str, key: str, value: str) -> DataFrame:
    """day, n, total, ids, amounts: what is kept for each day. Null keys and values are in no sketch."""
    return rows.groupBy(F.col(at).cast("date").alias("day")).agg(
        F.count("*").alias("n"), F.sum(value).alias("total"), F.hll_sketch_agg(F.col(key), F.lit(LG_K)).alias("ids"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(K)).alias("amounts"),
    )


def merged(days: DataFrame, period: Column) -> DataFrame:
    """period, n, total, ids, amounts over all days of each period."""
    return days.groupBy(period.alias("period")).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.hll_union_agg("ids").alias("ids"), F.kll_merge_agg_double("amounts").alias("amounts"))


def distinct(sketch: str = "ids") -> Column:
    return F.hll_sketch_estimate(sketch)


def quantile(share: float, sketch: str = "amounts") -> Column:
    return F.kll_sketch_get_quantile_double(F.col(sketch), F.lit(share))
