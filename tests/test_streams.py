"""Streams over files that come in runs: repeated and late ids, restarts, timers against a batch replay."""

import datetime
import random

from pyspark.sql import functions as F

from saltmarsh.operators import rules
from saltmarsh.streaming import seen, timers

T0 = datetime.datetime(2026, 1, 1)


def put(spark, folder, rows):
    """Rows (user_id, day, value) as one more file."""
    data = [(k, T0 + datetime.timedelta(days=day), u, "view", value, "") for k, (u, day, value) in enumerate(rows)]
    spark.createDataFrame(data, seen.SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_seen_ids(spark, tmp_path):
    source, to = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    ids = lambda df: sorted(r.listing_id for r in df.collect())
    put(spark, source, [(1, 0, 1.0), (2, 1, 1.0), (1, 2, 1.0), (1, 2, 1.0)])
    assert ids(seen.run(spark, source, to, "10 days")) == [1, 2]
    put(spark, source, [(2, 3, 1.0), (3, 30, 1.0)])  # 2 is known from the run before; the watermark goes to day 20
    assert ids(seen.run(spark, source, to, "10 days")) == [1, 2, 3]
    put(spark, source, [(4, 5, 1.0), (3, 31, 1.0), (1, 32, 1.0)])  # 4 is late, 3 is known, 1 was forgotten on day 10
    assert ids(seen.run(spark, source, to, "10 days")) == [1, 1, 2, 3]
    assert ids(seen.run(spark, source, to, "10 days")) == [1, 1, 2, 3]  # nothing new


def test_timers(spark, tmp_path):
    rng = random.Random(6)
    rows = sorted(((rng.randrange(12), round(rng.uniform(0, 900), 3), float(rng.randrange(3))) for _ in range(300)), key=lambda r: r[1])
    rows += [(99, 900.0, 1.0)]
    source, to = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    days = {"stale": 90, "removed": 30}
    told = None
    for part in (rows[:90], rows[90:91], rows[91:200], rows[200:]):
        put(spark, source, part)
        told = timers.run(spark, source, to, "1 day", forget=100_000, **days)
    got = sorted((r.listing_id, r.at, r.event) for r in told.collect())
    own = spark.createDataFrame([(u, T0 + datetime.timedelta(days=d), v, k) for k, (u, d, v) in enumerate(rows)], "listing_id long, ts timestamp, value double, seq long")
    timed = own.withColumn("at", F.unix_millis("ts"))
    upto = timed.agg(F.max("at")).first()[0] - timers.DAY
    assert got == sorted((r.listing_id, r.at, r.event) for r in timers.replayed(timed, upto, **days).collect())
    # The listings that are stale at the watermark, by the rule for one row, are those whose last change told so.
    last = timed.filter(F.col("at") <= upto)
    order = F.struct("at", "seq")
    was = last.withColumn("old", F.lag("value").over(timers.W.partitionBy("listing_id").orderBy("at", "seq")))
    changed = was.filter(~F.col("value").eqNullSafe(F.col("old"))).groupBy("listing_id").agg(F.max("ts").alias("changed"))
    stale = {r.listing_id for r in changed.filter(rules.stale(F.lit("active"), F.col("changed"), F.timestamp_millis(F.lit(upto)))).collect()}
    after = {r.listing_id: r.at for r in changed.select("listing_id", F.unix_millis("changed").alias("at")).collect()}
    assert {u for u, at, e in got if e == "stale" and at >= after[u]} == stale and order is not None


def test_timers_late_and_forgotten(spark, tmp_path):
    source, to = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    put(spark, source, [(1, 0, 1.0), (2, 0, 1.0)])
    put(spark, source, [(2, 200, 1.0)])
    days = {"stale": 90, "removed": 30, "forget": 50}
    timers.run(spark, source, to, "1 day", files=1, **days)
    put(spark, source, [(1, 3, 2.0), (2, 201, 5.0)])  # listing 1 is late: dropped
    put(spark, source, [(1, 202, 2.0)])  # and it was forgotten: a new listing, not a relisted one
    got = sorted(((r["at"] - timers.DAY * 20454) // timers.DAY, r.listing_id, r.event) for r in timers.run(spark, source, to, "1 day", files=1, **days).collect())
    assert got == [(30, 1, "removed"), (30, 2, "removed"), (90, 1, "stale"), (90, 2, "stale"), (200, 2, "relisted")]
