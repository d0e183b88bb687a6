"""Ids seen across runs: each listing comes out once, however often later runs bring it again, in state that a watermark bounds.

An id is remembered until the watermark (the greatest time seen, less the delay) passes its own time plus the delay; an observation that
is older than the watermark is late and dropped. State therefore holds the ids of the last ``delay`` only. Each run takes
the files that are new in the source folder and goes on from the checkpoint.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from saltmarsh.sources.shared import shared_dir

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
DELAY = "90 days"


def new_ids(rows: DataFrame, delay: str = DELAY) -> DataFrame:
    """Of a stream of rows (listing_id, ts) the first of each id within the delay."""
    return rows.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["listing_id"])


def run(spark: SparkSession, source: str, to: str, delay: str = DELAY, files: int = 4, schema: str = SCHEMA) -> DataFrame:
    """Append the ids of all files that are new since the last run to ``to``/ids, and give all rows there."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    rows = new_ids(stream.selectExpr("user_id as listing_id", "cast(ts as timestamp) as ts", "event_id"), delay)
    rows.writeStream.format("parquet").option("path", f"{to}/ids").option("checkpointLocation", f"{to}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{to}/ids")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every listing of the events once: the delay is longer than the table's time."""
    return run(spark, f"{sf_dir}/events.parque[t]", f"{shared_dir(spark)}/seen-{uuid.uuid4().hex}", "36500 days").select("listing_id")
