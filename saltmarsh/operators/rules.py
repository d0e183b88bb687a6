"""Rules of the ledger: histories of observations, presence by successful runs, confidence, flags, filters, roll-ups.

Observations are rows of any columns; each function names those that it reads. Every window is partitioned by listing or broker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from saltmarsh.functions import places
from saltmarsh.operators import cells
from saltmarsh.operators.similar import linked_listings

#: The changes of status that are legal.
LEGAL = (("active", "removed"), ("active", "sold"), ("active", "pending"), ("removed", "active"), ("removed", "relisted"))
#: Hosts that gather other brokers' listings.
AGGREGATORS = ("bizbuysell.com", "bizquest.com", "businessbroker.net")
#: Weights of the confidence score; ratios of price to revenue that are normal are our own choice.
WEIGHTS = {"url": 0.30, "price": 0.15, "place": 0.15, "financials": 0.20, "verified": 0.10, "recent": 0.10}
NORMAL_RATIO = (0.1, 10.0)
#: Codes of countries by the names that listings use.
COUNTRIES = {"UNITED STATES": "US", "UNITED STATES OF AMERICA": "US", "USA": "US", "CANADA": "CA", "MEXICO": "MX", "UNITED KINGDOM": "GB", "AUSTRALIA": "AU"}


def in_order(key: str, order: tuple[str, ...]) -> W:
    return W.partitionBy(key).orderBy(*order)


def price_changes(rows: DataFrame, key: str, order: tuple[str, ...], price: str) -> DataFrame:
    """Observations whose price isn't the one before: with old_price, new_price, pct. The first one is no change."""
    with_old = rows.withColumn("old_price", F.lag(price).over(in_order(key, order)))
    changed = with_old.filter(F.col("old_price").isNotNull() & (F.col("old_price") != F.col(price)))
    return changed.select(key, *(c for c in order if c != key), "old_price", F.col(price).alias("new_price"), F.round(100 * (F.col(price) - F.col("old_price")) / F.col("old_price"), 4).alias("pct"))


def price_dropped(key: str, order: tuple[str, ...], price: str, share: float = 0.5) -> Column:
    """Whether an observation's price is under ``share`` of the highest before it."""
    before = F.max(price).over(in_order(key, order).rowsBetween(W.unboundedPreceding, -1))
    return F.coalesce(F.col(price) < share * before, F.lit(False))


def status_changes(rows: DataFrame, key: str, order: tuple[str, ...], status: str) -> DataFrame:
    """Each change of status, and whether it is legal; illegal ones belong to a reject table."""
    with_old = rows.withColumn("from_status", F.lag(status).over(in_order(key, order)))
    changed = with_old.filter(F.col("from_status") != F.col(status))
    edge = F.concat_ws(">", "from_status", status)
    return changed.select(key, *(c for c in order if c != key), "from_status", F.col(status).alias("to_status"), edge.isin(*(f"{a}>{b}" for a, b in LEGAL)).alias("legal"))


def presence(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """listing_id, snapshot_no, event: ``removed`` in the first of a broker's successful runs that lacks the listing, ``relisted``
    in the first that has it again. Runs that failed say nothing, so they remove nothing.

    ``rows``: listing_id, broker_id, snapshot_no of what was seen; ``runs``: broker_id, snapshot_no, ok.
    """
    good = runs.filter("ok").select("broker_id", "snapshot_no").distinct().withColumn("run", F.row_number().over(in_order("broker_id", ("snapshot_no",))))
    seen = rows.select("listing_id", "broker_id", "snapshot_no").distinct().join(good, ["broker_id", "snapshot_no"])
    each = W.partitionBy("broker_id", "listing_id").orderBy("run")
    gaps = seen.withColumns({"next": F.lead("run").over(each), "before": F.lag("run").over(each)})
    last = good.groupBy("broker_id").agg(F.max("run").alias("last"))
    lost = gaps.join(last, "broker_id").filter(F.coalesce("next", F.col("last") + 1) > F.col("run") + 1).select("listing_id", "broker_id", (F.col("run") + 1).alias("run"))
    removed = lost.join(good, ["broker_id", "run"]).select("listing_id", "snapshot_no", F.lit("removed").alias("event"))
    back = gaps.filter(F.col("before") < F.col("run") - 1).select("listing_id", "snapshot_no", F.lit("relisted").alias("event"))
    return removed.union(back)


def stale(status: Column, last_change: Column, as_of: Column, days: int = 90) -> Column:
    """Still active, though nothing has changed for so many days."""
    return F.coalesce((status == "active") & (F.datediff(as_of, last_change) >= days), F.lit(False))


def cadence(last_change: Column, as_of: Column, days: int = 30) -> Column:
    return F.when(F.datediff(as_of, last_change) > days, "weekly").otherwise("daily")


def confidence(url_ok: Column, price: Column, place: Column, financials: Column, verified: Column, last_seen: Column, as_of: Column) -> Column:
    """The sum of the weights that apply: whether the url answers and the broker is verified, and what is known and since when."""
    truths = {"url": url_ok, "price": price.isNotNull(), "place": place.isNotNull(), "financials": financials.isNotNull(), "verified": verified, "recent": F.datediff(as_of, last_seen) < 7}
    return F.round(sum((F.when(truths[k], w).otherwise(0.0) for k, w in WEIGHTS.items()), F.lit(0.0)), 2)


def flags(dropped: Column, relisted: Column, is_stale: Column, duplicate: Column, http_status: Column, price: Column, revenue: Column) -> Column:
    """The names of all warnings that apply, in order."""
    ratio = price / F.nullif(revenue, F.lit(0).cast("double"))
    suspicious = (ratio < NORMAL_RATIO[0]) | (ratio > NORMAL_RATIO[1])
    marks = {"duplicate_suspected": duplicate, "price_drop_50": dropped, "price_suspicious": suspicious, "relist_detected": relisted, "source_404": http_status == 404, "stale_90": is_stale}
    return F.array_compact(F.array(*(F.when(when, F.lit(name)) for name, when in marks.items())))


def country_code(text: Column) -> Column:
    """Two letters stay; names become codes; others null."""
    up = F.upper(F.trim(text))
    names = F.create_map(*(F.lit(x) for pair in COUNTRIES.items() for x in pair))
    return F.when(F.length(up) == 2, up).otherwise(F.try_element_at(names, up))


def location_hidden(text: Column) -> Column:
    return F.coalesce(F.lower(text).contains("confidential"), F.lit(False))


def is_range(price_text: Column) -> Column:
    """Whether a price text has a lower and an upper bound; the price functions take the lower one."""
    return F.coalesce(price_text.rlike(r"\d\s*[kKmM]?\s*(-|to)\s*\$?\d"), F.lit(False))


def missing_field(title: Column, broker: Column, status: Column) -> Column:
    """The first required field that is null or empty; null if all are there."""
    lacks = lambda c: F.coalesce(c, F.lit("")) == ""
    return F.when(lacks(title), "title").when(lacks(broker), "broker").when(lacks(status), "status")


def is_aggregator(url: Column) -> Column:
    """By the last two labels of the url's host."""
    return F.coalesce(places.found(F.lower(places.domain(url)), r"([^.]+\.[^.:]+)(?::\d+)?$", 1).isin(*AGGREGATORS), F.lit(False))


def verified_sources(rows: DataFrame, url: str, http_status: str, title: str, broker: str, status: str) -> DataFrame:
    """Rows that a primary website gave, whose url answers and whose required fields are there."""
    answers = F.col(http_status).between(200, 299)
    return rows.filter(~is_aggregator(F.col(url)) & answers & missing_field(F.col(title), F.col(broker), F.col(status)).isNull())


def included_brokers(rows: DataFrame, broker: str, name: str, status: str, least: int = 5) -> DataFrame:
    """Brokers that can be named and have ``least`` active listings."""
    counted = rows.filter(F.coalesce(F.col(name), F.lit("")) != "").groupBy(broker, name).agg(F.count_if(F.col(status) == "active").alias("active"))
    return counted.filter(F.col("active") >= least)


def unknown_brokers(requested: DataFrame, available: DataFrame) -> DataFrame:
    """Those requested that there aren't."""
    return requested.subtract(available)


def since(rows: DataFrame, at: str, as_of: str, days: int | None = None, everything: bool = False) -> DataFrame:
    """Rows of the last ``days`` days before ``as_of`` (ISO text); without days those of its day; or all."""
    if everything:
        return rows
    now = F.lit(as_of).cast("timestamp_ntz")
    start = F.date_trunc("day", now.cast("timestamp")).cast("timestamp_ntz") if days is None else now - F.expr(f"interval {int(days)} days")
    return rows.filter(F.col(at) >= start)


def aliases(rows: DataFrame, broker: str, content: str, url: str, first_seen: str) -> DataFrame:
    """One row for each content of a broker: the oldest url, and all its others in order."""
    kept = rows.groupBy(broker, content).agg(F.min(F.struct(first_seen, url)).alias("_o"), F.sort_array(F.collect_set(url)).alias("_u"))
    return kept.select(broker, content, F.col(f"_o.{url}").alias("canonical_url"), F.array_except("_u", F.array(f"_o.{url}")).alias("aliases"))


def by_vertical(rows: DataFrame, vertical: str) -> DataFrame:
    return rows.groupBy(F.coalesce(F.col(vertical), F.lit("other")).alias("vertical")).agg(F.count("*").alias("n"))


def pattern_stats(cache: DataFrame) -> DataFrame:
    """Numbers of domains, successes and listings of a cache (name, success_count, total_listings). The domains themselves are the cache's rows."""
    return cache.agg(F.count("*").alias("total_patterns"), F.coalesce(F.sum("success_count"), F.lit(0)).alias("total_scrapes"), F.coalesce(F.sum("total_listings"), F.lit(0)).alias("total_listings"))


def broker_records(rows: DataFrame, broker: str, name: str) -> DataFrame:
    """Broker records from listings (url, status, state, vertical, at): counts, times, and the states and verticals covered."""
    return rows.groupBy(broker, name).agg(
        F.count_if(F.col("status") == "active").alias("active_listings"), F.countDistinct("url").alias("total_observed"), F.min("at").alias("first_seen"), F.max("at").alias("last_scraped"),
        F.sort_array(F.collect_set("state")).alias("coverage_states"), F.sort_array(F.collect_set("vertical")).alias("verticals"),
    )


def explore(rows: DataFrame, at: str, order: tuple[str, ...], page: int = 1, size: int = 50, **equal: str | None) -> DataFrame:
    """A page of the rows that equal what is asked for (None: anything), oldest first, those without a time before all."""
    for name, value in equal.items():
        rows = rows.filter(F.col(name) == value) if value is not None else rows
    return rows.orderBy(F.col(at).asc_nulls_first(), *order).offset(size * (page - 1)).limit(size)


def learned(successes: DataFrame, name: str, signature: str, listings: str, at: str) -> DataFrame:
    """The pattern cache that a log of successes (one row for each page set that gave listings) adds up to, by domain."""
    return successes.groupBy(F.col(name).alias("name")).agg(F.max_by(signature, at).alias("pattern"), F.count("*").alias("success_count"), F.sum(listings).alias("total_listings"), F.min(at).alias("first_seen"), F.max(at).alias("last_used"))


def run_totals(results: DataFrame) -> DataFrame:
    """One row: brokers of a run, how many succeeded and failed, and the listings of those that succeeded."""
    ok = F.col("status") == "success"
    return results.agg(F.count("*").alias("total_brokers"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed"), F.coalesce(F.sum(F.when(ok, F.col("listings_count"))), F.lit(0)).alias("total_listings"))


def suspected_duplicates(listings: DataFrame, least: float = 0.85) -> DataFrame:
    """id, twins: listings (id, broker, title, state, price, cash_flow) that are very similar to others of other brokers. They are flagged
    and never merged. Above 0.8 two listings have a state in common and are near in both amounts, so links are counted without their pairs."""
    if cells.fit(least):
        return cells.twins(listings, least)
    pairs = linked_listings(listings, least)
    brokers = listings.select("id", "broker")
    across = pairs.join(brokers.toDF("a", "x"), "a").join(brokers.toDF("b", "y"), "b").filter("x != y")
    return across.select("a").union(across.select("b")).groupBy(F.col("a").alias("id")).agg(F.count("*").alias("twins"))
