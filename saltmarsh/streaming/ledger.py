"""The ledger as a stream: each batch of observations is folded into first seen, last seen and last value, and its changes are kept.

A batch writes the states of its own listings and the changes that it brought, both under its number, so a batch that is run
again replaces itself. Every COMPACT batches the states so far are merged into one table, and later merges start from it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saltmarsh.sources.shared import shared_dir

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
COMPACT = 8


def fold(rows: DataFrame) -> DataFrame:
    """listing_id, first_seen, last_seen, n, last_value of observations (listing_id, ts, seq, value)."""
    return rows.groupBy("listing_id").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("n"), F.max_by("value", F.struct("ts", "seq")).alias("last_value"), F.max(F.struct("ts", "seq")).alias("mark"))


def merge(states: DataFrame) -> DataFrame:
    """One state of each listing from several partial ones, in any order."""
    return states.groupBy("listing_id").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("n").alias("n"), F.max_by("last_value", "mark").alias("last_value"), F.max("mark").alias("mark"))


def states_upto(spark: SparkSession, to: str, number: int) -> DataFrame | None:
    """Partial states of all batches up to ``number``: the latest merged table, and the batches after it; None before the first."""
    if number < 0:
        return None
    base = (number + 1) // COMPACT * COMPACT - 1  # the last batch that is in a merged table
    parts = [f"{to}/states/batch={k}" for k in range(base + 1, number + 1)]
    paths = ([f"{to}/merged/upto={base}"] if base >= 0 else []) + parts
    return spark.read.parquet(*paths)


def changes(before: DataFrame | None, states: DataFrame) -> DataFrame:
    """listing_id, ts, old_value, new_value of listings that are new (no old value) or whose last value is another now."""
    old = (before if before is not None else states.limit(0)).select("listing_id", F.col("last_value").alias("old_value"), F.col("mark").alias("old_mark"))
    both = states.join(old, "listing_id", "left").filter(F.col("old_mark").isNull() | ((F.col("mark") > F.col("old_mark")) & ~F.col("last_value").eqNullSafe(F.col("old_value"))))
    return both.select("listing_id", F.col("last_seen").alias("ts"), "old_value", F.col("last_value").alias("new_value"))


def run(spark: SparkSession, source: str, to: str, files: int = 4) -> DataFrame:
    """Fold all files of ``source`` that are new since the last run, and give the merged states; changes are in ``to``/changes."""
    events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(source)
    rows = events.select(F.col("user_id").alias("listing_id"), "ts", F.col("event_id").alias("seq"), "value")

    def write(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        fold(batch).write.mode("overwrite").parquet(f"{to}/states/batch={number}")
        states, before = session.read.parquet(f"{to}/states/batch={number}"), states_upto(session, to, number - 1)
        changes(merge(before) if before is not None else None, states).write.mode("overwrite").parquet(f"{to}/changes/batch={number}")
        if (number + 1) % COMPACT == 0:
            merge(states.unionByName(before) if before is not None else states).write.mode("overwrite").parquet(f"{to}/merged/upto={number}")

    rows.writeStream.foreachBatch(write).option("checkpointLocation", f"{to}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(f"{to}/states").agg(F.max("batch")).first()[0]
    return merge(states_upto(spark, to, int(last)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, f"{sf_dir}/events.parque[t]", f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}").drop("mark")
