"""Parquet tables, and the listing views that are derived from them inside each query."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from saltmarsh.functions import places
from saltmarsh.functions.classify import is_business
from saltmarsh.functions.money import scaled_money
from saltmarsh.functions.shown import resolved
from saltmarsh.sources.workbooks import Workbooks

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(c: Column) -> Column:
    return F.format_number(c, 2)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing observations: one for each line item, with a url of broker and part and a text that holds its figures."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size", "p_retailprice", "p_brand")
    item = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    cities = F.when(F.col("p_size") % 3 == 0, "New York").when(F.col("p_size") % 3 == 1, "Austin").otherwise("dallas")
    states = F.when(F.col("p_size") % 4 == 0, "TX").when(F.col("p_size") % 4 == 1, "NY").when(F.col("p_size") % 4 == 2, "Tx").otherwise("CA")
    text = F.concat(
        F.lit("Profitable "), "p_name", F.lit(" shop. Asking Price $"), money(F.col("l_extendedprice")), F.lit(" deposit $"), money(F.col("p_retailprice")), F.lit(". Cash flow: $"), money(F.col("l_quantity") * 900),
        F.lit(" Gross sales $"), money(F.col("l_extendedprice") * 2), F.lit(". Located in "), cities, F.lit(", "), states, F.lit(" area"),
    )
    return item.select(
        "l_orderkey", "l_linenumber", F.col("l_suppkey").alias("broker_id"), F.col("l_partkey").alias("part_id"), "p_name", "p_type", "p_brand", "l_extendedprice", "l_quantity",
        F.concat(F.lit("https://b"), F.col("l_suppkey").cast("string"), F.lit(".example/"), F.col("l_partkey").cast("string")).alias("url"), text.alias("text"),
    )


#: The same view for the oracle.
OBSERVATIONS_SQL = """obs as (select l_orderkey, l_linenumber, l_suppkey as broker_id, l_partkey as part_id, p_name, p_type, p_brand, l_extendedprice, l_quantity,
  concat('https://b', l_suppkey, '.example/', l_partkey) as url,
  concat('Profitable ', p_name, ' shop. Asking Price $', format('{:,.2f}', l_extendedprice), ' deposit $', format('{:,.2f}', p_retailprice), '. Cash flow: $', format('{:,.2f}', l_quantity * 900),
    ' Gross sales $', format('{:,.2f}', l_extendedprice * 2), '. Located in ', case p_size % 3 when 0 then 'New York' when 1 then 'Austin' else 'dallas' end, ', ', case p_size % 4 when 0 then 'TX' when 1 then 'NY' when 2 then 'Tx' else 'CA' end, ' area') as text
  from lineitem join part on l_partkey = p_partkey)"""


def brokers_csv(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Brokers (id, name, url) from a CSV file whose columns go by several names; rows without a url are dropped."""
    raw = spark.read.option("header", True).csv(path)
    lower = {c.lower(): c for c in reversed(raw.columns)}

    def pick(*names: str) -> Column | None:
        return next((F.col(f"`{lower[n]}`") for n in names if n in lower), None)

    url = pick("listing_url", "listings_url", "active lisitng url", "url", "companyurl")
    if url is None:
        raise ValueError(f"no url column among {raw.columns}")
    order = pick("activelistingscount", "leaderboard_score")
    none = F.lit(None).cast("string")
    out = raw.select((pick("account", "id", "broker_id") if pick("account", "id", "broker_id") is not None else none).alias("id"), (pick("companyname", "broker_name", "name") if pick("companyname", "broker_name", "name") is not None else none).alias("name"), url.alias("url"), (order if order is not None else none).try_cast("double").alias("_order"))
    out = out.filter(F.col("url").isNotNull() & (F.col("url") != "")).orderBy(F.col("_order").desc_nulls_last(), "id")
    return (out.limit(limit) if limit else out).drop("_order")


def run_listings(spark: SparkSession, path: str) -> DataFrame:
    """Listings of a run envelope's successful brokers, each with its broker's attributes."""
    run = spark.read.option("multiLine", True).json(path)
    brokers = run.select("run_id", F.explode("brokers").alias("b")).filter("b.status = 'success'")
    return brokers.select("run_id", "b.broker_id", "b.broker_name", F.explode("b.listings").alias("listing")).select("run_id", "broker_id", "broker_name", "listing.*")


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """The rows with their number from 0, in the order of their partitions: only the partitions' counts are put in one order."""
    at = rows.withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    before = F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = at.groupBy("_p").agg(F.count("*").alias("_n")).select("_p", before.alias("_o"))  # a row for each partition
    return at.join(F.broadcast(starts), "_p").withColumn(name, F.col("_o") + F.col("_i")).drop("_p", "_i", "_o")


def plain_brokers_csv(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Brokers (id, name, url, expected_listings) by the shorter list of url columns; the row's number stands in for an id."""
    raw = numbered(spark.read.option("header", True).csv(path), "_row")
    url = next((c for c in ("listings_url", "active lisitng url", "url", "companyurl") if c in raw.columns), None)
    if url is None:
        raise ValueError(f"no url column among {raw.columns}")
    count = F.col("activeListingsCount").try_cast("double") if "activeListingsCount" in raw.columns else F.lit(None).cast("double")
    name = next((F.col(c) for c in ("companyname", "broker_name", "name") if c in raw.columns), F.lit(None))
    own = F.col("account") if "account" in raw.columns else F.col("_row")
    out = raw.select(own.cast("string").alias("id"), F.coalesce(name.cast("string"), F.lit("Unknown")).alias("name"), F.col(f"`{url}`").alias("url"), count.cast("bigint").alias("expected_listings"))
    out = out.filter("url is not null and url != ''").orderBy(F.desc_nulls_last("expected_listings"), "id")
    return out.limit(limit) if limit else out


def stored_brokers(brokers: DataFrame, limit: int | None = None) -> DataFrame:
    """account, name, url of a stored table's brokers that have both an account and a url, best score first. The limit always binds."""
    out = brokers.filter("url is not null and url != '' and account is not null").orderBy(F.desc_nulls_last("leaderboard_score"), "account").select("account", "name", "url")
    return out.limit(limit) if limit else out


def json_listings(spark: SparkSession, path: str) -> DataFrame:
    """Listings of a JSON document: of its ``listings``, of a bare array, or of one object."""
    found = spark.read.option("multiLine", True).json(path)
    return found.select(F.explode("listings").alias("listing")).select("listing.*") if "listings" in found.columns else found


def pattern_cache(spark: SparkSession, path: str) -> DataFrame:
    """name, pattern, success_count, total_listings, first_seen, last_used from a JSON map of domains; unreadable text gives no rows."""
    entry = "map<string, struct<pattern: string, success_count: bigint, total_listings: bigint, first_seen: string, last_used: string>>"
    text = spark.read.option("wholetext", True).text(path)
    return text.select(F.explode(F.from_json("value", entry))).select(F.col("key").alias("name"), "value.*")


def count_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that aren't blank, without the header."""
    return spark.read.text(path).filter(F.trim("value") != "").agg(F.greatest(F.count("*") - 1, F.lit(0)).alias("brokers"))


def listing_links(pages: DataFrame, mark: str = "/buy-a-business/") -> DataFrame:
    """Distinct urls that stored pages (url, html) link to and that have ``mark`` in their link."""
    links = F.regexp_extract_all("html", F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"']*)"""), F.lit(1))
    found = pages.select("url", F.explode(links).alias("link")).filter(F.col("link").contains(mark))
    return found.select(resolved("url", "link").alias("url")).distinct()


def downloaded_listings(spark: SparkSession, path: str, url: str) -> DataFrame:
    """Listings of a downloaded CSV whose columns go by any names: title, price, place are the first value of those columns whose
    names hold certain words. Rows that aren't businesses are dropped."""
    raw = spark.read.option("header", True).option("multiLine", True).csv(path)
    named = lambda *words: [F.col(f"`{c}`") for c in raw.columns if any(w in c.lower() for w in words)]
    first = lambda columns: F.coalesce(*columns, F.lit(None).cast("string"))
    rows = numbered(raw, "_row")
    text = F.concat_ws(" | ", *(F.concat(F.lit(f"{c}: "), F.col(f"`{c}`")) for c in raw.columns))
    title, price, at = first(named("name", "title", "business", "description")), first(named("price", "asking", "value")), first(named("location", "city", "state", "area"))
    out = rows.select(
        places.or_else(title, F.concat(F.lit("Business Listing "), (F.col("_row") + 1).cast("string"))).alias("title"), scaled_money(price).alias("price"), price.alias("price_text"), at.alias("location"), places.city(at).alias("city"),
        places.state(at).alias("state"), F.left(text, F.lit(500)).alias("description"), F.concat(F.lit(f"{url}#row"), F.col("_row").cast("string")).alias("url"), text.alias("text"),
    )
    return out.filter(is_business(F.lower("text")))


def workbook_listings(spark: SparkSession, path: str, url: str) -> DataFrame:
    """Listings of the first sheet of each workbook of a folder, by the same rules as those of a downloaded CSV; the first row
    with a cell names the columns, rows are numbered from the one after it. ``url`` is the folder's, to which the file's name is added.
    Columns without a name and rows that couldn't be read are left out (``spark.read.format("workbooks")`` shows their errors)."""
    spark.dataSource.register(Workbooks)
    cells = spark.read.format("workbooks").option("path", path).load().filter("error is null").drop("error")
    top = cells.groupBy("path").agg(F.min_by(F.struct("row", "cells"), "row").alias("top"))  # a row for each file
    both = cells.join(top, "path").filter("row > top.row")
    names = F.map_from_entries("top.cells")
    held = F.filter(F.transform("cells", lambda c: F.struct(F.try_element_at(names, c.col).alias("name"), c.value.alias("value"))), lambda c: c["name"].isNotNull())
    rows = both.withColumn("held", held).withColumn("_row", F.col("row") - F.col("top.row") - 1)
    text = F.concat_ws(" | ", F.transform("held", lambda c: F.concat(c["name"], F.lit(": "), c["value"])))

    def first(*words: str) -> Column:
        fits = lambda c: F.lower(c["name"]).rlike("|".join(words))
        return F.try_element_at(F.filter("held", fits), F.lit(1)).value

    rows = rows.withColumns({"text": text, "own": first("name", "title", "business", "description"), "price_text": first("price", "asking", "value"), "location": first("location", "city", "state", "area")})
    file = F.concat(F.lit(url.rstrip("/") + "/"), F.element_at(F.split("path", "/"), -1))
    out = rows.select(
        places.or_else(F.col("own"), F.concat(F.lit("Business Listing "), (F.col("_row") + 1).cast("string"))).alias("title"), scaled_money(F.col("price_text")).alias("price"), "price_text", "location",
        places.city(F.col("location")).alias("city"), places.state(F.col("location")).alias("state"), F.left("text", F.lit(500)).alias("description"), F.concat(file, F.lit("#row"), F.col("_row").cast("string")).alias("url"), "text",
    )
    return out.filter(is_business(F.lower("text")))
