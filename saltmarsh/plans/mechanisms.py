"""Registered queries of chains, machines, groups and indexes, each with SQL written by hand for another engine."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saltmarsh.functions import classify, places
from saltmarsh.operators import editdist, far, groups, intervals, keywords, paging, sketches, states
from saltmarsh.sources import sinks, tables, workbooks
from saltmarsh.sources.shared import shared_dir
from saltmarsh.sources.tables import money, table
from saltmarsh.streaming import seen, timers

_found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        _found[name] = f
        if sql:
            _sql[name] = sql
        return f

    return add


# The page loop ------------------------------------------------------------------------------------------------------

#: Stored pages are result pages of seven sites, in the order of their ids; those with six list items have so many listings,
#: others none, and some have no pattern.
_SITES = """p as (select page_id // 7 as k, concat('https://s', page_id % 7, '.example/list?page=', page_id // 7) as url, concat('https://s', page_id % 7, '.example/list?page=', page_id // 7 + 1) as next,
    case when page_id % 41 = 7 then null when len(regexp_extract_all(html, '<li>')) >= 6 then len(regexp_extract_all(html, '<li>')) else 0 end as found from pages)"""


def _result_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = F.regexp_count("html", F.lit("<li>"))
    url = F.concat(F.lit("https://s"), (F.col("page_id") % 7).cast("string"), F.lit(".example/list?page="), F.expr("page_id div 7").cast("string"))
    found = F.when(F.col("page_id") % 41 == 7, None).when(items >= 6, items).otherwise(0)
    return table(spark, sf_dir, "pages").select(F.expr("page_id div 7").alias("k"), url.alias("url"), found.alias("found")).withColumn("next", places.next_page(F.col("url")))


@_query(
    "paged_listings",
    f"""with recursive {_SITES},
  w as (select url as start, 1 as page_no, url, found, case when found = 0 then 1 else 0 end as empties from p where k % 5 = 1 and found is not null
        union all
        select w.start, w.page_no + 1, p.url, p.found, case when p.found = 0 then w.empties + 1 else 0 end from w join p old on old.url = w.url join p on p.url = old.next
        where w.page_no < 100 and w.empties < 3 and p.found is not null)
select start, page_no, url, found from w where empties < 3""",
)
def paged_listings(spark, sf_dir):
    pages = _result_pages(spark, sf_dir)
    return paging.paged(pages, pages.filter("k % 5 = 1"))


# The status machine -------------------------------------------------------------------------------------------------

_LIFE = "case o_orderkey % 8 when 0 then 'removed' when 1 then 'sold' when 2 then 'pending' when 3 then 'relisted' else 'active' end"
_EDGES = "(('active', 'removed'), ('active', 'sold'), ('active', 'pending'), ('removed', 'active'), ('removed', 'relisted'))"
_MACHINE = f"""with recursive o as (select o_custkey, o_orderdate, o_orderkey, status, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as rn from (select *, {_LIFE} as status from orders) x),
  w as (select o_custkey, o_orderdate, o_orderkey, status, rn, cast(null as varchar) as from_status, status as state from o where rn = 1
        union all
        select o.o_custkey, o.o_orderdate, o.o_orderkey, o.status, o.rn, w.state, case when (w.state, o.status) in {_EDGES} then o.status else w.state end from w join o on o.o_custkey = w.o_custkey and o.rn = w.rn + 1),
  j as (select *, case when from_status is null then 'first' when from_status = status then 'same' when state = status then 'legal' else 'illegal' end as kind from w)"""


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumn("status", F.expr(_LIFE))
    return states.histories(rows, "o_custkey", ("o_orderdate", "o_orderkey"), "status", F.year("o_orderdate"))


@_query("ledger_states", f"{_MACHINE} select o_custkey, o_orderdate, o_orderkey, from_status, state, kind from j where kind <> 'illegal'")
def ledger_states(spark, sf_dir):
    return states.split(_judged(spark, sf_dir))[0].drop("status")


@_query("status_rejects", f"{_MACHINE} select o_custkey, o_orderdate, o_orderkey, from_status, status from j where kind = 'illegal'")
def status_rejects(spark, sf_dir):
    return states.split(_judged(spark, sf_dir))[1].select("o_custkey", "o_orderdate", "o_orderkey", "from_status", "status")


# Groups, intervals, buckets -----------------------------------------------------------------------------------------

_SCORE = (
    "round(0.4 * (1 - levenshtein(a.title, b.title) / cast(greatest(length(a.title), length(b.title), 1) as double)) + 0.2"
    " + 0.2 * cast(abs(a.price - b.price) <= 0.2 * greatest(a.price, b.price) as int) + 0.2 * cast(abs(a.cash_flow - b.cash_flow) <= 0.25 * greatest(a.cash_flow, b.cash_flow) as int), 6)"
)


@_query(
    "duplicate_groups",
    f"""with recursive p as (select p_partkey as id, p_name as title, p_brand as state, p_retailprice as price, p_size as cash_flow, min(p_partkey) over (partition by p_name, p_brand, p_retailprice, p_size) as rep from part),
  c as (select * from p where id = rep),
  h as (select a.id as a, b.id as b from c a join c b on a.state = b.state and a.id < b.id where {_SCORE} > 0.85),
  l as (select a, b from h union select b, a from h),
  r as (select id, id as g from c union select l.b, r.g from r join l on r.id = l.a),
  m as (select id as rep, min(g) as g from r group by id),
  f as (select p.id, p.rep, m.g, count(*) over (partition by m.g) as size from p join m on p.rep = m.rep)
select id, rep, g as "group", size from f where size > 1""",
)
def duplicate_groups(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return groups.duplicate_groups(part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("state"), F.col("p_retailprice").alias("price"), F.col("p_size").alias("cash_flow")))


@_query(
    "ledger_as_of",
    """with d as (select distinct cast(date_trunc('quarter', o_orderdate) as date) as date from orders union select max(cast(o_orderdate as date)) + 40 from orders),
  o as (select *, cast(o_orderdate as date) as day from orders)
select d.date, o_custkey, o_orderkey, o_orderstatus, o_totalprice, day as valid_from
from d join o on day <= d.date qualify row_number() over (partition by d.date, o_custkey order by day desc, o_orderdate desc, o_orderkey desc) = 1""",
)
def ledger_as_of(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    quarters = orders.select(F.date_trunc("quarter", F.col("o_orderdate")).cast("date").alias("date"))
    after = orders.agg(F.date_add(F.max("o_orderdate").cast("date"), 40).alias("date"))
    held = intervals.as_of(intervals.validity(orders, "o_custkey", "o_orderdate", ("o_orderkey",)), quarters.union(after))
    return held.select("date", "o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice", "valid_from")


@_query("bucketed_upsert", "select o_custkey, o_orderkey, o_totalprice from orders qualify row_number() over (partition by o_custkey order by o_orderdate >= timestamp '1995-01-01' desc, o_orderdate desc, o_orderkey desc) = 1")
def bucketed_upsert(spark, sf_dir):
    """The orders before 1995 and those after it, folded into one table as two batches."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    new, to = F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp_ntz"), f"{shared_dir(spark)}/orders-{uuid.uuid4().hex}"
    for batch in (orders.filter(~new), orders.filter(new)):
        sinks.upsert_buckets(batch, to, "o_custkey", F.struct("o_orderdate", "o_orderkey").desc(), 16)
    return spark.read.schema(orders.schema).parquet(to).select("o_custkey", "o_orderkey", "o_totalprice")


_HEADED = "select coalesce(regexp_extract(html, '<html lang=\"([a-z]+)\"', 1), '') as block, trim(regexp_replace(lower(regexp_extract(html, '<title>([^<]*)', 1)), '[^a-z]+', ' ', 'g')) as text from pages"


@_query(
    "near_titles",
    f"with t as (select distinct block, text from ({_HEADED}) x where text <> ''), d as (select a.block, a.text as a, b.text as b, levenshtein(a.text, b.text) as distance from t a join t b on a.block = b.block and a.text < b.text)"
    " select block, a, b, cast(distance as int) as distance from d where distance < 0.2 * greatest(length(a), length(b)) - 1e-9",
)
def near_titles(spark, sf_dir):
    """Titles of all stored pages that differ in less than a fifth of the longer one, by the page's language."""
    text = F.trim(F.regexp_replace(F.lower(F.regexp_extract("html", "<title>([^<]*)", 1)), "[^a-z]+", " "))
    titles = table(spark, sf_dir, "pages").select(F.coalesce(F.regexp_extract("html", '<html lang="([a-z]+)"', 1), F.lit("")).alias("block"), text.alias("text"))
    return editdist.near_texts(titles, 0.8)


# Vocabularies as tables ---------------------------------------------------------------------------------------------

_SOLD = "concat(text, case doc_id % 6 when 0 then ' Lawn care, irrigation and HVAC' when 1 then ' heating, furnace' when 2 then ' Vending route; cafe' when 3 then ' janitorial and carpet cleaning' else '' end)"
_N = {name: " + ".join(f"cast(contains(low, '{w}') as int)" for w in words) for name, words in classify.SCORED.items()}


@_query(
    "keyword_verticals",
    f"""with t as (select doc_id, lower({_SOLD}) as low from documents), n as (select doc_id, low, {", ".join(f"{x} as n_{name}" for name, x in _N.items())} from t),
  m as (select *, greatest({", ".join(f"n_{name}" for name in _N)}) as score from n)
select doc_id, case {" ".join(f"when n_{name} = score then '{name}'" for name in _N)} end as vertical, cast(score as bigint) as score,
  case {" ".join(f"when {' or '.join(f"contains(low, '{w}')" for w in words)} then '{name}'" for name, words in classify.BUSINESS.items())} end as business from m where score > 0""",
)
def keyword_verticals(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(_SOLD).alias("text"))
    scored = keywords.best(keywords.hits(docs, keywords.vocabulary(spark, classify.SCORED), "doc_id", "text"), "doc_id").withColumnRenamed("class", "vertical")
    kinds = keywords.first(keywords.hits(docs, keywords.vocabulary(spark, classify.BUSINESS), "doc_id", "text"), "doc_id").withColumnRenamed("class", "business")
    return scored.join(kinds, "doc_id", "left").select("doc_id", "vertical", "score", "business")


# Workbooks ----------------------------------------------------------------------------------------------------------

_AT = "case p_size % 3 when 0 then 'New York, NY' when 1 then 'Austin, TX' end"


@_query(
    "workbook_listings",
    f"""with p as (select *, {_AT} as place, concat('$', format('{{:,.2f}}', p_retailprice)) as price_text from part)
select p_name as title, round(p_retailprice, 2) as price, price_text, place as location, split_part(place, ', ', 1) as city, split_part(place, ', ', 2) as state,
  concat('Part: ', p_partkey, ' | Business Name: ', p_name, ' | Size: ', p_size, ' | Asking: ', price_text, case when place is null then '' else concat(' | City: ', place) end) as description from p""",
)
def workbook_listings(spark, sf_dir):
    """All parts as rows of workbook files, read back as downloaded listings."""
    price, to = F.concat(F.lit("$"), money(F.col("p_retailprice"))), f"{shared_dir(spark)}/workbooks-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("Part"), F.col("p_name").alias("Business Name"), F.col("p_size").alias("Size"), price.alias("Asking"), F.expr(_AT).alias("City"))
    workbooks.write(rows, to)
    return tables.workbook_listings(spark, to, "https://files.example").select("title", "price", "price_text", "location", "city", "state", "description")


# Sketches -----------------------------------------------------------------------------------------------------------


@_query(
    "sketched_quarters",
    "select cast(date_trunc('quarter', o_orderdate) as date) as period, count(*) as n, count(distinct o_custkey) as listings, true as distinct_within, true as median_within from orders group by 1",
)
def sketched_quarters(spark, sf_dir):
    """Quarters from the sketches of their days, with exact counts beside, and whether the sketches keep to their bounds."""
    orders = table(spark, sf_dir, "orders")
    quarter = lambda c: F.date_trunc("quarter", F.col(c)).cast("date")
    found = sketches.merged(sketches.daily(orders, "o_orderdate", "o_custkey", "o_totalprice"), quarter("day"))
    found = found.select("period", "n", sketches.distinct().alias("about"), sketches.quantile(0.5).alias("middle"))
    both = orders.select(quarter("o_orderdate").alias("period"), "o_custkey", "o_totalprice").join(found, "period")
    exact = both.groupBy("period", "n", "about").agg(F.countDistinct("o_custkey").alias("listings"), F.avg((F.col("o_totalprice") <= F.col("middle")).cast("double")).alias("rank"))
    near = F.abs(F.col("about") - F.col("listings")) <= sketches.DISTINCT_ERROR * F.col("listings")
    return exact.select("period", "n", "listings", near.alias("distinct_within"), (F.abs(F.col("rank") - 0.5) <= sketches.RANK_ERROR).alias("median_within"))


# Far pages ----------------------------------------------------------------------------------------------------------


@_query(
    "explorer_far_page",
    "select o_orderkey, o_orderdate, o_totalprice from (select *, row_number() over (order by o_orderdate, o_orderkey) as rn, count(*) over () as n from orders) x where rn > 50 * ((n - 1) // 50)",
)
def explorer_far_page(spark, sf_dir):
    """The last page of fifty orders by date."""
    found = far.ranged(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice"), ("o_orderdate", "o_orderkey"))
    return found.page((found.total - 1) // 50 + 1)


# Streams ------------------------------------------------------------------------------------------------------------

_query("stream_seen_ids", "select distinct user_id as listing_id from events")(seen.query)
_query(
    "stream_timers",
    """with r as (select user_id as listing_id, epoch_us(ts) // 1000 as ms, event_id as seq, value from events), m as (select max(ms) - 21600000 as upto from r),
  o as (select *, lag(value) over w as old, row_number() over w as rn, lead(ms) over w as nxt from r window w as (partition by listing_id order by ms, seq)),
  gone as (select listing_id, ms + 8640000 as due, nxt from o, m where ms + 8640000 <= coalesce(nxt, upto)),
  c as (select listing_id, ms, lead(ms) over (partition by listing_id order by ms, seq) as nxt from o where rn = 1 or value is distinct from old)
select listing_id, due as "at", 'removed' as event from gone union all select listing_id, nxt, 'relisted' from gone where nxt is not null
union all select listing_id, ms + 43200000, 'stale' from c, m where ms + 43200000 <= coalesce(nxt, upto)""",
)(timers.query)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_found)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
