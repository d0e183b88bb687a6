"""Groups of linked rows: connected components by alternating stars, so that a chain of n rows takes about log n rounds.

Every round is a written table, and nothing but its number of edges and a sum of their hashes comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from saltmarsh.operators import cells
from saltmarsh.operators.similar import linked_listings
from saltmarsh.sources.shared import written


def components(edges: DataFrame) -> DataFrame:
    """id, group: for every row that has a link (a, b) the smallest row that links lead to, itself included. Rows linked with themselves alone have none."""
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct()
    e, before = written(e, "links"), None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = written(both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(small.union(low.withColumnRenamed("m", "v")).distinct(), "small")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("u").alias("id"), F.col("v").alias("group")).union(e.select("v").distinct().select(F.col("v").alias("id"), F.col("v").alias("group")))
        before = now


def duplicate_groups(listings: DataFrame, least: float = 0.85) -> DataFrame:
    """id, rep, group, size: listings (id, title, state, price, cash_flow) that are equal to others or linked with them by a score
    above ``least``, at once or through others. ``rep`` is the smallest id of the equal ones, which alone is compared; ``group`` the smallest id of all. Rows alone are left out.

    Where a score above ``least`` needs both amounts near, cells of listings are linked instead of listings."""
    classed = listings.withColumn("rep", F.min("id").over(W.partitionBy("title", "state", "price", "cash_flow")))
    if cells.fit(least):
        own = written(cells.cells(listings), "cells")
        linked = components(cells.links(listings, own, least)).select(F.col("id").alias("cell"), "group")
        known = own.join(linked, "cell", "left").select(*cells.KEY, F.coalesce("group", "cell").alias("group"))
        return _sized(cells.banded(classed).join(known, list(cells.KEY), "left").select("id", "rep", F.coalesce("group", "rep").alias("group")))
    pairs = linked_listings(classed.filter("id = rep").select(*listings.columns), least).select("a", "b")
    linked = components(pairs).select(F.col("id").alias("rep"), "group")
    return _sized(classed.select("id", "rep").join(linked, "rep", "left").select("id", "rep", F.coalesce("group", "rep").alias("group")))


def _sized(found: DataFrame) -> DataFrame:
    """id, rep, group, size of the groups with more than one row."""
    sizes = found.groupBy("group").agg(F.count("*").alias("size")).filter("size > 1")
    return found.join(sizes, "group").select("id", "rep", "group", "size")
