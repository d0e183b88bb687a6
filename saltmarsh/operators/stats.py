"""Statistics, differences and dedup of listings in columns of any names. No statistic needs all values in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def median(rows: DataFrame, column: str, error: float | None = None) -> float | None:
    """The median of the values that aren't null; with ``error`` a value whose rank is off by that share of the rows at most.

    The exact one is looked for between two approximate quantiles around it, so that only a small share of the rows is ordered.
    """
    some = rows.select(F.col(column).cast("double").alias("v")).filter("v is not null")
    if error is not None:
        return next(iter(some.approxQuantile("v", [0.5], error)), None)
    bounds = some.approxQuantile("v", [0.495, 0.505], 0.002)
    if not bounds:
        return None
    low, high = bounds
    n, below = some.agg(F.count("*"), F.count_if(F.col("v") < low)).first()
    first, last = (n - 1) // 2 - below, n // 2 - below
    inside = [r.v for r in some.filter(F.col("v").between(low, high)).orderBy("v").offset(first).limit(last - first + 1).collect()]  # two at most
    return sum(inside) / len(inside)


def distinct_count(rows: DataFrame, column: str) -> DataFrame:
    """One row: how many different values there are, counted value by value in many tasks."""
    return rows.select(column).filter(F.col(column).isNotNull()).distinct().agg(F.count("*").alias(column))


def snapshot_stats(rows: DataFrame, price: str, broker: str, state: str, error: float | None = None) -> DataFrame:
    """One row of a snapshot's statistics; nulls don't count."""
    plain = rows.agg(F.count("*").alias("listings"), F.count(price).alias("with_price"), F.avg(price).alias("mean_price"), F.min(price).alias("min_price"), F.max(price).alias("max_price"))
    brokers, states = distinct_count(rows, broker).toDF("brokers"), distinct_count(rows, state).toDF("states")
    return plain.crossJoin(brokers).crossJoin(states).withColumn("median_price", F.lit(median(rows, price, error)).cast("double"))  # one row each


def top(rows: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The most frequent values, nulls left out; ties by value."""
    return rows.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(n)


def truthy(column: str) -> Column:
    """How many values are neither null nor 0."""
    return F.count_if(F.coalesce(F.col(column), F.lit(0)) != 0)


def facets(rows: DataFrame, *columns: str) -> DataFrame:
    """The different values, without null and empty ones."""
    for c in columns:
        rows = rows.filter(F.coalesce(F.col(c), F.lit("")) != "")
    return rows.select(*columns).distinct()


def header(rows: DataFrame, broker: str, state: str, at: str) -> DataFrame:
    brokers, states = distinct_count(rows, broker).toDF("brokers"), distinct_count(rows.filter(F.coalesce(F.col(state), F.lit("")) != ""), state).toDF("states")
    return rows.agg(F.count("*").alias("total"), F.max(at).alias("latest")).crossJoin(brokers).crossJoin(states)  # one row each


def seen_span(rows: DataFrame, key: str, at: str) -> DataFrame:
    return rows.groupBy(key).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.count("*").alias("n"))


def unseen(rows: DataFrame, seen: DataFrame, *keys: str) -> DataFrame:
    """The different keys of rows that were not seen before."""
    return rows.select(*keys).distinct().join(seen.select(*keys), list(keys), "left_anti")


def diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """key, change: added, removed, changed or same, for each key of two snapshots."""
    a, b = old.select(key, F.col(value).alias("a"), F.lit(True).alias("had")), new.select(key, F.col(value).alias("b"), F.lit(True).alias("has"))
    change = F.when(F.col("had").isNull(), "added").when(F.col("has").isNull(), "removed").when(F.col("a") != F.col("b"), "changed").otherwise("same")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def history(rows: DataFrame, key: str, order: tuple[str, ...], fields: dict[str, str]) -> DataFrame:
    """A row for each change of a field (name in the history: column): old and new value as text. One sort serves all fields."""
    each = W.partitionBy(key).orderBy(*order)
    pairs = F.array(*(F.struct(F.lit(name).alias("field"), F.lag(c).over(each).cast("string").alias("old_value"), F.col(c).cast("string").alias("new_value")) for name, c in fields.items()))
    changed = rows.select(key, *order, pairs.alias("_p")).select(key, *order, F.explode("_p").alias("p")).select(key, *order, "p.*")
    return changed.filter(F.col("old_value").isNotNull() & (F.col("old_value") != F.col("new_value")))


def gaps(rows: DataFrame, key: str, order: tuple[str, ...], number: Column, least: int = 2) -> DataFrame:
    """Observations ``least`` numbers or more after the one before: key, order columns, gap."""
    with_gap = rows.withColumn("_n", number).withColumn("gap", (F.col("_n") - F.lag("_n").over(W.partitionBy(key).orderBy("_n", *order))).cast("long"))
    return with_gap.filter(F.col("gap") >= least).select(key, *order, "gap")
