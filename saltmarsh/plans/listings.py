"""Registered queries of normalisation, extraction, routing and the ledger's rules, each with SQL written by hand for another engine.

The inputs are listings derived from the tables inside each query; ``RAW`` and the like are expressions that both engines
read. What is done with them is written twice: by the library's functions, and in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saltmarsh.functions import classify, money, places, shown
from saltmarsh.operators import canonical, html, rules, vendors
from saltmarsh.sources import sinks
from saltmarsh.sources.tables import OBSERVATIONS_SQL, observations, table

_found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}
AS_OF = "2026-02-20T00:00:00Z"
KEY = ("l_orderkey", "l_linenumber")


def _query(name: str, sql: str):
    def add(f):
        _found[name], _sql[name] = f, sql
        return f

    return add


# Canonical normalisation --------------------------------------------------------------------------------------------

#: Raw listings of line items and parts: money, flags and states as texts of several forms, some null or empty.
RAW = {
    "id": "case l_orderkey % 5 when 0 then '' when 1 then null else concat('x-', l_orderkey, '-', l_linenumber) end",
    "source_url": "case when l_orderkey % 11 = 0 then null else concat('https://b', l_suppkey, '.example/l/', l_partkey) end",
    "source_id": "concat(l_partkey, '')",
    "broker_id": "concat('br_', l_suppkey)",
    "broker_name": "concat('Broker ', l_suppkey)",
    "first_seen": "case l_linenumber % 3 when 0 then null when 1 then '' else '2026-01-15T08:30:00Z' end",
    "scraped_at": "case when l_linenumber % 2 = 0 then '2026-01-22T14:15:00Z' end",
    "status": "case l_linenumber % 3 when 0 then 'sold' when 1 then null else 'pending' end",
    "title": "p_name",
    "description": "case l_orderkey % 4 when 0 then null when 1 then concat(p_type, ' of ', p_brand) else concat(repeat(concat(p_type, ' '), 60), p_brand) end",
    "category": "p_type",
    "asking_price": "case l_orderkey % 7 when 0 then concat('$', l_partkey, ',500') when 1 then concat(l_partkey, '.75') when 2 then 'Contact us' when 3 then null when 4 then '  $1,234,567 ' when 5 then '450K' else concat('-', l_partkey) end",
    "revenue": "case l_orderkey % 13 when 0 then 'inf' when 1 then '' else concat(l_partkey * 3, '.0') end",
    "cash_flow": "case when l_linenumber % 5 = 0 then '1e3' else concat('$', l_suppkey) end",
    "inventory": "case when l_linenumber % 4 = 0 then '15,000' end",
    "price_hidden": "case l_linenumber % 4 when 0 then 'Yes' when 1 then ' yes' when 2 then 'N' end",
    "real_estate": "case l_linenumber % 3 when 0 then '1' when 1 then 'no' end",
    "seller_financing": "case l_orderkey % 3 when 0 then 'TRUE' when 1 then '' end",
    "franchise": "case when l_orderkey % 2 = 0 then 'y' end",
    "city": "case when l_linenumber % 4 = 3 then null else 'Dallas' end",
    "state": "case l_orderkey % 6 when 0 then ' texas ' when 1 then 'ny' when 2 then 'ZZ' when 3 then 'Nowhere' when 4 then '' end",
    "country": "case when l_orderkey % 3 = 0 then null else 'CA' end",
    "employees": "case when l_orderkey % 3 = 0 then '12' else 'many' end",
    "year_established": "concat(1950 + l_orderkey % 70, '')",
}
_RAW_SQL = f"raw as (select l_orderkey, l_linenumber, {', '.join(f'{e} as {n}' for n, e in RAW.items())} from lineitem join part on l_partkey = p_partkey)"


def raw_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    item = table(spark, sf_dir, "lineitem").select(*KEY, "l_partkey", "l_suppkey").join(part, F.col("l_partkey") == F.col("p_partkey"))
    return item.select(*KEY, *(F.expr(e).alias(n) for n, e in RAW.items()))


def _price(c: str) -> str:
    cleaned = f"regexp_replace(trim({c}), '[,$]', '', 'g')"
    return rf"case when regexp_full_match({cleaned}, '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?') then cast(trunc(cast({cleaned} as double)) as bigint) end"


def _flag(c: str) -> str:
    return f"lower({c}) in ('true', 'yes', '1', 'y')"


_FINITE = "lower(coalesce(revenue, '')) <> 'inf'"
_STATE_SQL = "case when length(trim(state)) = 2 then upper(trim(state)) when upper(trim(state)) = 'TEXAS' then 'TX' end"
_CANONICAL_SQL = f"""with {_RAW_SQL}, n as (
  select l_orderkey, l_linenumber, case when coalesce(id, '') <> '' then id else concat('dl_', substr(sha256(concat(broker_id, ':', coalesce(source_url, 'None'))), 1, 12)) end as id,
    source_url, source_id, broker_id, broker_name, case when coalesce(first_seen, '') = '' then '{AS_OF}' else first_seen end as first_seen, '{AS_OF}' as last_seen, coalesce(scraped_at, '{AS_OF}') as scraped_at,
    status, title, description, {_price('asking_price')} as asking_price, coalesce({_flag('price_hidden')}, false) as price_hidden, 'other' as vertical, category, city, {_STATE_SQL} as state, country,
    cast(null as varchar) as zip, cast(null as varchar) as region, false as location_hidden, {_price('revenue')} as revenue, {_price('cash_flow')} as cash_flow, cast(null as bigint) as ebitda, {_price('inventory')} as inventory,
    cast(null as bigint) as ffe, {_flag('real_estate')} as real_estate, cast(null as bigint) as real_estate_value, try_cast(year_established as bigint) as year_established, try_cast(employees as bigint) as employees,
    {_flag('seller_financing')} as seller_financing, cast(null as boolean) as sba_prequalified, {_flag('franchise')} as franchise, cast(null as varchar) as franchise_name, cast(null as boolean) as home_based,
    cast(null as boolean) as relocatable, cast(null as boolean) as absentee_owner, 0.5e0 as confidence, '' as flags
  from raw where {_FINITE})
"""  # fmt: skip
_HASH_SQL = "sha256(concat(coalesce(title, 'None'), coalesce(cast(asking_price as varchar), 'None'), coalesce(cast(revenue as varchar), 'None'), coalesce(cast(cash_flow as varchar), 'None'), coalesce(city, 'None'), coalesce(state, 'None'), substr(coalesce(description, 'None'), 1, 500)))"


@_query("canonical_listings", f"{_CANONICAL_SQL} select *, {_HASH_SQL} as content_hash from n")
def canonical_listings(spark, sf_dir):
    good, _ = canonical.normalised(raw_listings(spark, sf_dir), AS_OF, KEY)
    return good.withColumn("flags", F.array_join("flags", "|"))


@_query("canonical_rejects", f"with {_RAW_SQL} select l_orderkey, l_linenumber, 'revenue is infinite' as reason from raw where not ({_FINITE})")
def canonical_rejects(spark, sf_dir):
    _, rejected = canonical.normalised(raw_listings(spark, sf_dir), AS_OF, KEY)
    return rejected.select(*KEY, "reason")


_CSV = {"price_hidden": "case when price_hidden then 'true' else 'false' end", "seller_financing": "case when seller_financing then 'true' when not seller_financing then 'false' else '' end", "franchise": "case when franchise then 'true' when not franchise then 'false' else '' end", "sba_prequalified": "''", "content_hash": _HASH_SQL, "confidence": "'0.5'"}


@_query("snapshot_rows", f"{_CANONICAL_SQL} select l_orderkey, l_linenumber, {', '.join(_CSV.get(c, f'''coalesce(cast({c} as varchar), '')''') + f' as {c}' for c in canonical.SNAPSHOT)} from n")
def snapshot_rows(spark, sf_dir):
    good, _ = canonical.normalised(raw_listings(spark, sf_dir), AS_OF, KEY)
    return sinks.flat(good.select(*KEY, *canonical.SNAPSHOT), KEY)


#: What extraction gives: prices of which some are 0, texts of which some are empty.
EXTRACTED = {
    "listing_url": "case when l_orderkey % 3 = 0 then '' when l_orderkey % 3 = 1 then concat('https://b', l_suppkey, '.example/a/', l_partkey) end",
    "url": "case when l_linenumber % 6 = 5 then null else concat('https://b', l_suppkey, '.example/b/', l_partkey) end",
    "title": "concat(p_name, case l_orderkey % 5 when 0 then ' janitorial' when 1 then ' lawn care' when 2 then ' heating and cooling' when 3 then ' arcade' else '' end)",
    "price": "case when l_orderkey % 4 = 0 then 0 else cast(l_partkey as double) + 0.75 end",
    "asking_price": "cast(l_suppkey as double)",
    "price_text": "concat('$', l_partkey)",
    "revenue": "case when l_orderkey % 4 = 1 then 0 else l_quantity * 100.5 end",
    "annual_revenue": "case when l_linenumber % 2 = 0 then l_quantity * 7.25 end",
    "cash_flow": "case when l_linenumber % 3 = 0 then 0 else l_quantity * 9.5 end",
    "city": "'Austin'",
    "state": "'TX'",
    "location": "'Austin, TX'",
    "business_type": "case when l_orderkey % 2 = 0 then 'retail' when l_orderkey % 5 = 0 then '' end",
    "vertical": "case when l_orderkey % 9 = 0 then 'pool' when l_orderkey % 9 = 1 then '' end",
    "text": "case when l_orderkey % 7 = 0 then '' else concat(p_type, ' route') end",
    "full_text": "concat(p_type, ' route with equipment')",
    "description": "case when l_orderkey % 8 = 0 then null else repeat(concat(p_brand, ' '), 80) end",
    "broker_id": "case when l_suppkey % 2 = 0 then '' else concat(l_suppkey, '') end",
    "broker_account": "concat('acc', l_suppkey)",
    "broker_name": "concat('Broker ', l_suppkey)",
    "broker_url": "concat('https://b', l_suppkey, '.example')",
    "first_seen": "case when l_orderkey % 3 = 0 then '' else '2026-01-15' end",
    "scraped_at": "'2026-02-01'",
}
_EXTRACTED_SQL = f"x as (select l_orderkey, l_linenumber, {', '.join(f'{e} as {n}' for n, e in EXTRACTED.items())} from lineitem join part on l_partkey = p_partkey)"


def extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    item = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    return item.select(*KEY, *(F.expr(e).alias(n) for n, e in EXTRACTED.items()))


def _any_sql(text: str, words: list[str]) -> str:
    return " + ".join(f"cast(contains({text}, '{w}') as int)" for w in words)


_LOW = "lower(concat(title, ' ', text, ' ', full_text))"
_SCORES = {k: _any_sql(_LOW, w) for k, w in classify.SCORED.items()}
_BEST = f"case greatest({', '.join(_SCORES.values())}) when 0 then null " + " ".join(f"when {s} then '{k}'" for k, s in _SCORES.items()) + " end"


@_query(
    "ledger_listings",
    f"""with {_EXTRACTED_SQL}, u as (select *, coalesce(nullif(listing_url, ''), nullif(url, ''), '') as source from x)
select l_orderkey, l_linenumber, md5(source) as id, title, source as source_url, coalesce(nullif(broker_id, ''), broker_account) as broker_id, broker_name, broker_url, case when price <> 0 then price else asking_price end as asking_price, price_text,
  case when revenue <> 0 then revenue else annual_revenue end as revenue, cash_flow, location, city, state, 'US' as country, business_type, coalesce(nullif(vertical, ''), {_BEST}) as vertical,
  left(coalesce(nullif(text, ''), description, ''), 500) as description, 'active' as status from u""",
)
def ledger_listings(spark, sf_dir):
    return canonical.ledger_listing(extracted(spark, sf_dir), KEY)


_SHORT_SQL = "case " + " ".join("when " + " or ".join(f"contains(lower(concat(title, ' ', coalesce(description, 'None'))), '{w}')" for w in words) + f" then '{k}'" for k, words in classify.SHORT.items()) + " else 'other' end"


@_query(
    "simple_listings",
    f"""with {_EXTRACTED_SQL}, u as (select *, coalesce(nullif(listing_url, ''), nullif(url, ''), '') as source from x)
select l_orderkey, l_linenumber, concat('dl_', substr(md5(source), 1, 12)) as id, source as source_url, broker_id, broker_name, title, case when price <> 0 then cast(trunc(price) as bigint) end as asking_price, price_text,
  case when revenue <> 0 then cast(trunc(revenue) as bigint) end as revenue, case when cash_flow <> 0 then cast(trunc(cash_flow) as bigint) end as cash_flow, location, city, state, 'US' as country,
  coalesce(nullif(description, ''), left(full_text, 500)) as description, {_SHORT_SQL} as vertical, 'active' as status from u""",
)
def simple_listings(spark, sf_dir):
    return canonical.simple_listing(extracted(spark, sf_dir), KEY)


@_query(
    "vendor_rows",
    f"""with {_EXTRACTED_SQL} select l_orderkey, l_linenumber, md5(url) as listing_id, broker_account, title, price, price_text, location, city, state, left(nullif(description, ''), 500) as description, url as listing_url,
  cast(null as varchar) as image_url, 'business' as category, business_type, revenue, cash_flow from x""",
)
def vendor_rows(spark, sf_dir):
    return canonical.vendor_listing(extracted(spark, sf_dir), KEY)


@_query(
    "explorer_rows",
    f"""with {_EXTRACTED_SQL} select l_orderkey, l_linenumber, title, case when asking_price <> 0 then asking_price else price end as price, state, city, coalesce(nullif(business_type, ''), vertical) as business_type,
  coalesce(nullif(listing_url, ''), url) as source_url, broker_name, coalesce(nullif(first_seen, ''), scraped_at) as scraped_at, location, revenue, cash_flow from x""",
)
def explorer_rows(spark, sf_dir):
    return canonical.explorer_row(extracted(spark, sf_dir), KEY)


@_query("public_rows", f"with {_EXTRACTED_SQL} select l_orderkey, l_linenumber, cast(null as varchar) as listing_id, title, price, price_text, location, city, state, description, listing_url, business_type, revenue, cash_flow, broker_account, scraped_at from x")
def public_rows(spark, sf_dir):
    return canonical.public_row(extracted(spark, sf_dir), KEY)


# Places, what is shown, links ---------------------------------------------------------------------------------------

_AT = "case l_orderkey % 6 when 0 then 'San Jose, CA' when 1 then 'New York, New York' when 2 then 'near TX coast' when 3 then 'Fort Worth, TX and Austin, TX' when 4 then 'somewhere' end"
_CITY, _NAME = r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*),\s*([A-Z]{2})\b", r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*),\s*([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)"


@_query(
    "place_dialects",
    rf"""with t as (select l_orderkey, l_linenumber, {_AT} as spot from lineitem) select l_orderkey, l_linenumber,
  nullif(case when regexp_matches(spot, '{_CITY}') then regexp_extract(spot, '{_CITY}', 1) when regexp_matches(spot, '{_NAME}') then regexp_extract(spot, '{_NAME}', 1) end, '') as city,
  nullif(case when regexp_matches(spot, '{_CITY}') then regexp_extract(spot, '{_CITY}', 2) when regexp_matches(spot, '{_NAME}') then regexp_extract(spot, '{_NAME}', 2) else regexp_extract(spot, '\b[A-Z]{{2}}\b', 0) end, '') as state,
  case when regexp_matches(spot, '^[^,]+,\s*[A-Z]{{2}}') then trim(split_part(spot, ',', 1)) end as anchored_city,
  nullif(case when regexp_matches(spot, '^[^,]+,\s*[A-Z]{{2}}') then regexp_extract(spot, '^[^,]+,\s*([A-Z]{{2}})', 1) else regexp_extract(spot, '\b[A-Z]{{2}}\b', 0) end, '') as anchored_state,
  case when regexp_matches(spot, '{_CITY}') then concat(regexp_extract(spot, '{_CITY}', 1), ', ', regexp_extract(spot, '{_CITY}', 2)) end as location from t""",
)
def place_dialects(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(*KEY, F.expr(_AT).alias("spot"))
    loose, anchored = places.place(F.col("spot")), places.anchored_place(F.col("spot"))
    return rows.select(*KEY, loose.city.alias("city"), loose.state.alias("state"), anchored.city.alias("anchored_city"), anchored.state.alias("anchored_state"), places.location(F.col("spot")).alias("location"))


_SHOWN = "case o_orderkey % 4 when 0 then o_totalprice * 100 when 1 then o_totalprice when 2 then cast(o_custkey % 1000 as double) when 3 then 0e0 end"


@_query(
    "shown_values",
    f"""with t as (select o_orderkey, floor({_SHOWN}) as p, case when o_orderkey % 7 = 0 then null else o_orderdate end as d, case when o_orderkey % 5 = 0 then '' else repeat(o_orderpriority, 3) end as s, concat('about $1,', o_custkey, ' or so') as n, concat('https://b.example/l/', o_orderkey, case when o_orderkey % 3 = 0 then '/' when o_orderkey % 3 = 1 then '/x' else '' end) as u from orders)
select o_orderkey, case when p = 0 then '—' when p >= 1000000 then concat('$', printf('%.1f', round(cast(p as decimal(18,0)) / 1000000, 1)), 'M') when p >= 1000 then concat('$', cast(floor(p / 1000 + 0.5) as bigint), 'K') else concat('$', cast(p as bigint)) end as price,
  coalesce(strftime(d, '%Y-%m-%d'), '—') as day, case when s = '' then '—' when length(s) > 20 then concat(left(s, 20), '…') else s end as short, try_cast(regexp_extract(replace(n, ',', ''), '\\d+', 0) as bigint) as number,
  nullif(regexp_extract(u, '/(\\d+)/?$', 1), '') as source_id, strftime(d, '%Y%m%d_%H%M%S') as run_id from t""",
)
def shown_values(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    date = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate"))
    short = F.when(F.col("o_orderkey") % 5 == 0, F.lit("")).otherwise(F.repeat("o_orderpriority", 3))
    url = F.expr("concat('https://b.example/l/', o_orderkey, case when o_orderkey % 3 = 0 then '/' when o_orderkey % 3 = 1 then '/x' else '' end)")
    return o.select("o_orderkey", shown.shown_price(F.floor(F.expr(_SHOWN))).alias("price"), shown.shown_date(date).alias("day"), shown.shortened(short, 20).alias("short"), shown.first_integer(F.expr("concat('about $1,', o_custkey, ' or so')")).alias("number"), places.source_id(url).alias("source_id"), shown.run_id(date).alias("run_id"))


_LINK = "case page_id % 5 when 0 then '/a/b' when 1 then 'https://other.example/x' when 2 then '?page=2' when 3 then '//cdn.example/y' when 4 then '/' end"
_BASE = "concat('https://h', page_id, '.example/list')"


@_query("resolved_links", f"with t as (select page_id, {_LINK} as link, concat('https://h', page_id, '.example') as root from pages) select page_id, case when starts_with(link, '//') then concat('https:', link) when starts_with(link, '/') then concat(root, link) when starts_with(link, '?') then concat(root, '/list', link) else link end as link from t")
def resolved_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", shown.resolved(F.expr(_BASE), F.expr(_LINK)).alias("link"))


# Filters ------------------------------------------------------------------------------------------------------------

_WORDS = "concat(text, case doc_id % 7 when 0 then ' Turnkey shop' when 1 then ' $5,000' when 2 then ' 3 bed home 2 bath' when 3 then ' MLS # 9 with price' when 4 then ' idx' else '' end)"
_ESTATE = r"regexp_matches(w, '(?i)\bmls\s*#|\bidx\b|\d+\s*bed.*\d+\s*bath')"


@_query(
    "include_modes",
    rf"""with t as (select doc_id, {_WORDS} as w from documents), f as (select doc_id, {_ESTATE} as estate, regexp_matches(w, '\$[\d,]+') as priced, ({_any_sql('lower(w)', classify.HINTS)}) > 0 as hinted from t)
select doc_id, case when doc_id % 2 = 0 then not estate else priced or hinted end as included, not estate and (priced or hinted) as business from f""",
)
def include_modes(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.expr(_WORDS).alias("w"))
    return rows.select("doc_id", classify.two_mode_include(F.col("w"), F.col("doc_id") % 2 == 0).alias("included"), classify.is_business(F.col("w")).alias("business"))


_SOURCE = "case l_orderkey % 5 when 0 then 'https://www.bizbuysell.com/x' when 1 then 'http://sub.bizquest.com/y' else concat('https://b', l_suppkey, '.example/z') end"
_HTTP = "case l_linenumber % 4 when 0 then 404 when 1 then null else 200 end"
_STATUS = "case l_orderkey % 7 when 0 then null when 1 then 'sold' else 'active' end"
_NAMED = "case when l_suppkey % 6 = 0 then '' else concat('Broker ', l_suppkey) end"


@_query("verified_sources", f"select l_orderkey, l_linenumber from (select l_orderkey, l_linenumber, l_suppkey, {_SOURCE} as url, {_HTTP} as code, {_STATUS} as status from lineitem) t where not contains(url, 'bizbuysell.com') and not contains(url, 'bizquest.com') and code = 200 and status is not null and l_suppkey % 6 <> 0")
def verified_sources(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(*KEY, F.expr(_SOURCE).alias("url"), F.expr(_HTTP).alias("code"), F.lit("t").alias("title"), F.expr(_NAMED).alias("broker"), F.expr(_STATUS).alias("status"))
    return rules.verified_sources(rows, "url", "code", "title", "broker", "status").select(*KEY)


@_query("schema_missing", f"select l_orderkey, l_linenumber, case when l_suppkey % 6 = 0 then 'broker' else 'status' end as lacks from (select *, {_STATUS} as status from lineitem) t where l_suppkey % 6 = 0 or status is null")
def schema_missing(spark, sf_dir):
    lacks = rules.missing_field(F.lit("t"), F.expr(_NAMED), F.expr(_STATUS))
    return table(spark, sf_dir, "lineitem").select(*KEY, lacks.alias("lacks")).filter("lacks is not null")


@_query("included_brokers", f"select l_suppkey, concat('Broker ', l_suppkey) as name, cast(sum(case when {_STATUS} = 'active' then 1 else 0 end) as bigint) as active from lineitem where l_suppkey % 6 <> 0 group by l_suppkey having sum(case when {_STATUS} = 'active' then 1 else 0 end) >= 400")
def included_brokers(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.expr(_NAMED).alias("name"), F.expr(_STATUS).alias("status"))
    return rules.included_brokers(rows, "l_suppkey", "name", "status", 400)


@_query("unknown_brokers", "select distinct l_suppkey + 5 as broker from lineitem where l_suppkey + 5 not in (select s_suppkey from supplier)")
def unknown_brokers(spark, sf_dir):
    return rules.unknown_brokers(table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") + 5).alias("broker")), table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("broker")))


@_query("export_since", "select o_orderkey, cast(o_orderdate >= timestamp '1998-07-01' - interval 30 days as boolean) as days, true as everything from orders where o_orderdate >= timestamp '1998-07-01' - interval 90 days")
def export_since(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    recent = rules.since(o, "o_orderdate", "1998-07-01T00:00:00", 30).select("o_orderkey", F.lit(True).alias("d"))
    within = rules.since(o, "o_orderdate", "1998-07-01T00:00:00", 90)
    return rules.since(within, "o_orderdate", "1998-07-01", everything=True).join(recent, "o_orderkey", "left").select("o_orderkey", F.coalesce("d", F.lit(False)).alias("days"), F.lit(True).alias("everything"))


_ERROR = "case event_id % 9 when 0 then 'Read timed out' when 1 then 'bad Certificate' when 2 then 'no pattern here' when 3 then repeat('odd ', 80) end"
_CODE = "case event_id % 8 when 0 then 403 when 1 then 404 when 2 then 502 when 3 then 200 end"
_PAGE = "case event_id % 5 when 0 then '' when 1 then 'please solve this ReCaptcha' when 2 then repeat('x', 10000) when 3 then 'short' end"


@_query(
    "failure_details",
    f"""with f as (select event_id, {_CODE} as code, lower(coalesce({_ERROR}, '')) as low, coalesce({_ERROR}, '') as error, {_PAGE} as html from events where event_type = 'error'),
 k as (select *, case when code = 403 then 1 when code = 404 then 2 when code >= 500 then 3 when contains(low, 'timed out') then 4 when contains(low, 'certificate') then 5 when contains(lower(html), 'captcha') then 6 when contains(low, 'no pattern') then 7 when html <> '' and length(html) < 10000 then 8 else 9 end as k from f)
select event_id, (['HTTP_403', 'HTTP_404', 'HTTP_500', 'TIMEOUT', 'SSL_ERROR', 'CAPTCHA', 'NO_PATTERN', 'JAVASCRIPT_HEAVY', 'UNKNOWN'])[k] as failure_type,
  case k when 1 then 'Site blocking (403) - anti-bot protection' when 2 then 'Page not found (404) - URL may be outdated' when 3 then concat('Server error (', code, ')') when 4 then 'Connection timeout' when 5 then 'SSL certificate error'
    when 6 then 'CAPTCHA protection detected' when 7 then 'Could not detect listing pattern' when 8 then 'Minimal content - JavaScript-heavy' else concat('Unknown: ', left(error, 200)) end as detail from k""",
)
def failure_details(spark, sf_dir):
    f = table(spark, sf_dir, "events").filter("event_type = 'error'").select("event_id", F.expr(_CODE).alias("code"), F.expr(_ERROR).alias("error"), F.expr(_PAGE).alias("html"))
    why = classify.failure(F.col("code"), F.col("error"), F.col("html"))
    return f.withColumn("f", why).select("event_id", F.col("f.type").alias("failure_type"), "f.detail")


# Vendors ------------------------------------------------------------------------------------------------------------

_BROKER = "case s_suppkey % 11 when 0 then 'Murphy Business' when 1 then 'Sunbelt of Ohio' when 2 then 'VR Business Brokers' when 3 then 'First Choice' when 4 then 'FCBB Miami' when 5 then 'Larry Bodner' when 6 then 'Link Business West' when 7 then null when 8 then 'Hedgestone' when 9 then 'Acme' else 'Murphy and Bodner' end"
_SITE = "case s_suppkey % 7 when 0 then 'https://www.tworld.com/x' when 1 then 'https://vrbbusa.com' when 2 then 'http://EXECBB.com' when 3 then null else concat('https://b', s_suppkey, '.example') end"


@_query(
    "vendor_routes",
    f"""with t as (select s_suppkey, lower(coalesce({_BROKER}, '')) as n, lower(coalesce({_SITE}, '')) as u from supplier), r as (select s_suppkey, case when n like '%bodner%' or u like '%execbb.com%' then 'bodner' when n like '%link business%' or u like '%linkbusiness%' then 'link'
  when n like '%murphy%' or u like '%murphybusiness.com%' then 'murphy' when n like '%hedgestone%' or u like '%hedgestone.com%' then 'hedgestone' when n like '%transworld%' or u like '%tworld.com%' then 'transworld' when n like '%sunbelt%' or u like '%sunbeltnetwork.com%' then 'sunbelt'
  when n like '%vr business%' or u like '%vrbbusa.com%' or u like '%vrbusinessbrokers%' then 'vr' when n like '%first choice%' or n like '%fcbb%' or u like '%fcbb.com%' then 'fcbb' end as vendor from t)
select s_suppkey, vendor, case when vendor not in ('bodner', 'link') then vendor end as simple from r""",
)
def vendor_routes(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.expr(_BROKER).alias("n"), F.expr(_SITE).alias("u"))
    full, simple = vendors.vendor_of(F.col("n"), F.col("u")), vendors.simple_vendor_of(F.col("n"), F.col("u"))
    return s.select("s_suppkey", full.alias("vendor"), F.when(full.isin("bodner", "link"), F.lit(None)).otherwise(simple).alias("simple"))


#: Cards of the parts in the forms of six vendors; ``{n}`` is the part's key and ``{c}`` its size.
CARDS = {
    "murphy": """concat('<div class="card-body"><h5 class="card-title">Shop of ', p_name, '</h5><p class="price">$', p_partkey, ',000</p><a class="btn btn-primary" href="/l/', p_partkey, '">More</a><p>SDE: $', p_size, ',500 | Austin, TX</p></div>')""",
    "hedgestone": """concat('<div class="single-listing"><a href="https://www.hedgestone.com/business-opportunity/', p_partkey, '"><h3>Shop of ', p_name, '</h3></a><p class="listing-location">Boise, Idaho</p><div class="price-info"><div class="listing-price"><span class="value">$', p_partkey, 'k</span></div><div class="listing-cashflow"><span class="value">$1.5m</span></div></div></div>')""",
    "sunbelt": """concat('<article class="latestBusinesses__item"><a href="/fort-worth-tx/listing-details/', p_partkey, '"><span>View Listing Now</span><h3>Shop of ', p_name, '</h3></a><p>Asking Price $', p_size, '.5m</p><p>$', p_size, 'k Cash Flow</p><p>$2.5m Gross Revenue</p></article>')""",
    "vr": """concat('<a href="/vr/', p_partkey, '"><div class="vrbb-listing-box"><div class="vrbb-listing-title">Shop of ', p_name, '</div><div class="vrbb-listing-pretty-price">$', p_partkey, '</div><div class="vrbb-listing-loc">', case when p_size % 2 = 0 then 'Miami, FL' else 'Florida' end, '</div><div class="vrbb-listing-pretty-industry-name">Retail</div></div></a>')""",
    "link": """concat('<div class="featured-listing-item"><h3>Shop of ', p_name, '</h3><a href="/k/', p_partkey, '">go</a><p class="price">Price: ', case when p_size % 3 = 0 then 'Refer to Broker' else concat('$', p_partkey, ',999') end, '</p><p>Sales: $', p_size, ',000</p><p>Profit: refer to broker</p><p>Location: Salem, OR</p></div>')""",
    "bodner": """concat('<table><tr><td><a href="listingdetail.asp?id=', p_partkey, '">', p_partkey, ' Corner Deli</a></td></tr><tr><td>1</td><td>2</td><td>', case when p_size % 2 = 0 then 'Undisclosed' else concat('$', p_size, '00') end, '</td><td>$', p_partkey, '</td><td>Newark,  NJ</td></tr></table>')""",
}


@_query(
    "vendor_listings",
    """with p as (select p_partkey as page_id, p_partkey as k, p_size as c, p_name, ['murphy', 'hedgestone', 'sunbelt', 'vr', 'link', 'bodner'][cast(p_partkey % 6 as int) + 1] as v from part),
 f as (select page_id, v as broker_account, k, c, p_name,
  case v when 'murphy' then concat('https://murphybusiness.com/l/', k) when 'hedgestone' then concat('https://www.hedgestone.com/business-opportunity/', k) when 'sunbelt' then concat('https://www.sunbeltnetwork.com/fort-worth-tx/listing-details/', k)
    when 'vr' then concat('https://www.vrbusinessbrokers.com/vr/', k) when 'link' then concat('https://linkbusiness.com/k/', k) else concat('listingdetail.asp?id=', k) end as url from p where not (v = 'link' and c % 3 = 0))
select page_id, 0 as seq, md5(url) as listing_id, broker_account, case broker_account when 'bodner' then concat(k, ' Corner Deli') else concat('Shop of ', p_name) end as title,
  case broker_account when 'murphy' then k * 1000e0 when 'hedgestone' then k * 1000e0 when 'sunbelt' then (c + 0.5e0) * 1000000 when 'link' then k * 1000e0 + 999 else cast(k as double) end as price,
  case broker_account when 'murphy' then concat('$', k, ',000') when 'hedgestone' then concat('$', k, 'k') when 'sunbelt' then concat('$', c, '.5m') when 'link' then concat('$', k, ',999') else concat('$', k) end as price_text,
  case broker_account when 'murphy' then 'Austin, TX' when 'hedgestone' then 'Boise, Idaho' when 'sunbelt' then 'Fort Worth, TX' when 'vr' then case when c % 2 = 0 then 'Miami, FL' else 'Florida' end when 'link' then 'Salem, OR' else 'Newark, NJ' end as location,
  case broker_account when 'murphy' then 'Austin' when 'hedgestone' then 'Boise' when 'sunbelt' then 'Fort Worth' when 'vr' then case when c % 2 = 0 then 'Miami' end when 'link' then 'Salem' else 'Newark' end as city,
  case broker_account when 'murphy' then 'TX' when 'hedgestone' then 'Idaho' when 'sunbelt' then 'TX' when 'vr' then case when c % 2 = 0 then 'FL' else 'Florida' end when 'link' then 'OR' else 'NJ' end as state,
  case broker_account when 'murphy' then concat('Shop of ', p_name, chr(10), '$', k, ',000', chr(10), 'More', chr(10), 'SDE: $', c, ',500 | Austin, TX') end as description, url as listing_url, cast(null as varchar) as image_url, 'business' as category,
  case broker_account when 'vr' then 'Retail' when 'bodner' then 'Corner Deli' end as business_type, case broker_account when 'sunbelt' then 2500000e0 when 'link' then c * 1000e0 end as revenue,
  case broker_account when 'murphy' then c * 1000e0 + 500 when 'hedgestone' then 1500000e0 when 'sunbelt' then c * 1000e0 when 'bodner' then case when c % 2 = 1 then c * 100e0 end end as cash_flow from f""",
)
def vendor_listings(spark, sf_dir):
    names = list(CARDS)
    vendor = F.element_at(F.array(*(F.lit(n) for n in names)), (F.col("p_partkey") % len(names) + 1).cast("int"))
    pages = table(spark, sf_dir, "part").withColumn("vendor", vendor)
    card = F.coalesce(*(F.when(F.col("vendor") == n, F.expr(e)) for n, e in CARDS.items()))
    found = vendors.cards(pages.select(F.col("p_partkey").alias("page_id"), "vendor", F.concat(F.lit("<html><body>"), card, F.lit("</body></html>")).alias("html")))
    # Each page here has one card; the second row of a table has no link and is none.
    return vendors.listings(found).withColumn("seq", F.lit(0))


_ITEM = {"id": "case when p_partkey % 4 = 0 then null else p_partkey % 500 end", "slug": "concat('s-', p_partkey % 700)", "name": "case when p_partkey % 3 = 0 then '' else p_name end", "title": "p_type", "c_listing_price__c": "case when p_size % 5 = 0 then 0 else p_size * 1000 end", "price": "p_partkey", "location": "case when p_size % 2 = 0 then null else 'Reno, NV' end", "city_state": "'Provo, Utah'", "c_discretionary_earnings__c": "case when p_size % 7 = 0 then 0 else p_size * 10 end"}


@_query(
    "feed_listings",
    f"""with i as (select p_partkey as n, {', '.join(f'{e} as {k}' for k, e in _ITEM.items())} from part), o as (select *, row_number() over (partition by coalesce(cast(id as varchar), slug) order by n) as r, case when c_listing_price__c <> 0 then c_listing_price__c else price end as p from i)
select md5(concat('https://www.tworld.com/listings/', slug)) as listing_id, 'transworld' as broker_account, coalesce(nullif(name, ''), title) as title, cast(p as double) as price, format('${{:,}}', cast(p as bigint)) as price_text, coalesce(location, city_state) as location,
  case when location is null then 'Provo' else 'Reno' end as city, case when location is null then 'Utah' else 'NV' end as state, cast(null as varchar) as description, concat('https://www.tworld.com/listings/', slug) as listing_url, cast(null as varchar) as image_url, 'business' as category,
  cast(null as varchar) as business_type, cast(null as double) as revenue, nullif(cast(c_discretionary_earnings__c as double), 0) as cash_flow from o where r = 1""",
)
def feed_listings(spark, sf_dir):
    items = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("n"), F.to_json(F.struct(*(F.expr(e).alias(k) for k, e in _ITEM.items()))).alias("value"))
    return vendors.from_items(items, "transworld", ("n",), zero_price=True)


_DETAIL = """concat('<html><body><h1>', case when p_partkey % 9 = 0 then 'Search Results' else concat('Shop of ', p_name) end, '</h1><span class="price">', case when p_size % 4 = 0 then 'Call us' else concat('$', p_size, 'K') end, '</span><div class="listing-location">', case when p_size % 3 = 0 then 'in OH' else 'Mesa, AZ' end,
'</div><div class="listing-description">A pizza cafe</div><table><tr><td>Gross Revenue</td><td>$', p_partkey, '</td></tr></table><table><tr><td>Cash Flow</td><td>$', p_size, ',000</td></tr></table><table><tr><td>Employees</td><td>', p_size, ' people</td></tr></table></body></html>')"""


@_query(
    "detail_listings",
    """select p_partkey as page_id, concat('https://d.example/l/', p_partkey, '/') as source_url, cast(p_partkey as varchar) as source_id, concat('Shop of ', p_name) as title, 'A pizza cafe' as description, case when p_size % 4 <> 0 then cast(p_size * 1000 as bigint) end as asking_price,
  p_size % 4 = 0 as price_hidden, 'restaurant' as vertical, cast(null as varchar) as category, case when p_size % 3 <> 0 then 'Mesa' end as city, case when p_size % 3 = 0 then 'OH' else 'AZ' end as state, p_partkey as revenue, cast(p_size * 1000 as bigint) as cash_flow, cast(p_size as bigint) as employees
from part where p_partkey % 9 <> 0""",
)
def detail_listings(spark, sf_dir):
    pages = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), F.expr("concat('https://d.example/l/', p_partkey, '/')").alias("url"), F.expr(_DETAIL).alias("html"))
    return vendors.details(pages)


# Cards --------------------------------------------------------------------------------------------------------------

_SHELL = ("<html><body><main>", "</main></body></html>")


_SIG = "div|children:a,p|has_link|text:medium|has_price"
_SIG2 = "section|children:a,p|has_link|text:medium"


@_query(
    "chosen_patterns",
    f"""with o as (select l_orderkey as page_id, count(*) as n from lineitem group by l_orderkey), c as (select page_id, n, page_id % 4 as k from o where n >= 3)
select page_id, case when k in (0, 3) then '{_SIG2}' else '{_SIG}' end as signature, case k when 0 then 'cached' when 3 then 'predicted' else 'ranked' end as role, n as cards from c""",
)
def chosen_patterns(spark, sf_dir):
    """Pages with two patterns of equally many cards; the second one is cached for a quarter of them, and predicted for another."""
    item = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page_id"), "l_linenumber")
    cards = lambda tag, text: F.array_join(F.sort_array(F.collect_list(F.concat(F.lit(f'<{tag}><a href="/l/'), F.col("l_linenumber").cast("string"), F.lit(f'">A card of some kind</a><p>{text}</p></{tag}>')))), "")
    both = item.groupBy("page_id").agg(cards("div", "Asking $5,000 for a place with a good number of words").alias("a"), cards("section", "Without any price but with a good number of words too").alias("b"))
    pages = both.select("page_id", F.concat(F.lit(_SHELL[0]), "a", "b", F.lit(_SHELL[1])).alias("html"), F.lit("https://h.example/x").alias("url"), F.when(F.col("page_id") % 4 == 0, _SIG2).when(F.col("page_id") % 4 == 1, "gone").alias("cached"), F.when(F.col("page_id") % 4 == 3, F.array(F.lit("gone"), F.lit(_SIG2))).alias("predicted"))
    return html.cards(pages).groupBy("page_id", "signature", "role").agg(F.count("*").alias("cards"))


@_query(
    "extracted_cards",
    rf"""with {OBSERVATIONS_SQL}, c as (select l_orderkey as page_id, l_linenumber, p_name, url, text, count(*) over (partition by l_orderkey) as n, row_number() over (partition by l_orderkey order by l_linenumber, concat(url, '"><h3>Listing of ', p_name, '</h3></a><p>', text)) as k from obs)
select page_id, cast(3 + 4 * (k - 1) as int) as seq, '{_SIG}' as signature, 'ranked' as role, concat('Listing of ', p_name) as title, url as link, concat('Listing of ', p_name, ' ', text) as text,
  case when regexp_matches(text, '{_CITY}') then concat(regexp_extract(text, '{_CITY}', 1), ', ', regexp_extract(text, '{_CITY}', 2)) end as location, nullif(regexp_extract(text, '{_CITY}', 1), '') as city, nullif(regexp_extract(text, '{_CITY}', 2), '') as state,
  list_max(list_transform(regexp_extract_all(text, '\$[\d,]+(?:\.\d{{2}})?'), lambda m: struct_pack(v := cast(replace(replace(m, '$', ''), ',', '') as double), m := m))).m as price_text, list_max(list_transform(regexp_extract_all(text, '\$[\d,]+(?:\.\d{{2}})?'), lambda m: cast(replace(replace(m, '$', ''), ',', '') as double))) as price,
  case when contains(lower(text), 'shop') then 'retail' end as business_type, try_cast(replace(regexp_extract(lower(text), 'gross sales[:\s]*\$?([\d,]+)', 1), ',', '') as double) as sales, left(concat('Listing of ', p_name, ' ', text), 500) as description
from c where n >= 3""",
)
def extracted_cards(spark, sf_dir):
    o = observations(spark, sf_dir)
    card = F.concat(F.lit('<div class="card"><a href="'), "url", F.lit('"><h3>Listing of '), "p_name", F.lit("</h3></a><p>"), "text", F.lit("</p></div>"))
    pages = o.groupBy(F.col("l_orderkey").alias("page_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", card.alias("card")))), lambda x: x.card), "").alias("cards"))
    found = html.cards(pages.select("page_id", F.concat(F.lit(_SHELL[0]), "cards", F.lit(_SHELL[1])).alias("html")))
    sales = money.number(F.replace(F.regexp_extract(F.lower("text"), money.REVENUE[1], 1), F.lit(","), F.lit("")))
    return html.fields(found).withColumn("sales", sales).drop("revenue", "cash_flow", "vertical")


# Rules of the ledger ------------------------------------------------------------------------------------------------

_W = "partition by o_custkey order by o_orderdate, o_orderkey"
_LIFE = "case o_orderkey % 8 when 0 then 'removed' when 1 then 'sold' when 2 then 'pending' when 3 then 'relisted' else 'active' end"


def _orders(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumn("status", F.expr(_LIFE))


@_query("ledger_price_changes", f"select o_custkey, o_orderdate, o_orderkey, prev as old_price, o_totalprice as new_price, round(100 * (o_totalprice - prev) / prev, 4) as pct from (select *, lag(o_totalprice) over ({_W}) as prev from orders) x where prev <> o_totalprice")
def ledger_price_changes(spark, sf_dir):
    return rules.price_changes(_orders(spark, sf_dir), "o_custkey", ("o_orderdate", "o_orderkey"), "o_totalprice")


@_query("ledger_status_changes", f"select o_custkey, o_orderdate, o_orderkey, prev as from_status, status as to_status, (prev, status) in (('active', 'removed'), ('active', 'sold'), ('active', 'pending'), ('removed', 'active'), ('removed', 'relisted')) as legal from (select *, lag(status) over ({_W}) as prev from (select *, {_LIFE} as status from orders) y) x where prev <> status")
def ledger_status_changes(spark, sf_dir):
    return rules.status_changes(_orders(spark, sf_dir), "o_custkey", ("o_orderdate", "o_orderkey"), "status")


_OK = "(l_suppkey + 3 * (year(l_shipdate) * 12 + month(l_shipdate))) % 7 <> 0"
_NO = "year(l_shipdate) * 12 + month(l_shipdate)"


@_query(
    "ledger_presence",
    f"""with s as (select distinct l_suppkey as b, l_suppkey * 100 + l_partkey % 20 as id, {_NO} as n from lineitem where {_OK}), r as (select distinct b, n from s), e as (select s0.id, s0.b, r.n, x.id is not null as there from (select distinct id, b from s) s0 join r on s0.b = r.b left join s x on x.id = s0.id and x.n = r.n),
 w as (select *, lag(there) over (partition by id order by n) as was, max(there) over (partition by id order by n rows between unbounded preceding and 1 preceding) as ever from e)
select id as listing_id, n as snapshot_no, case when there then 'relisted' else 'removed' end as event from w where ever and there <> was""",
)
def ledger_presence(spark, sf_dir):
    """Months are the snapshots, brokers' parts modulo 20 their listings; a seventh of the brokers' months failed."""
    item = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("broker_id"), (F.col("l_suppkey") * 100 + F.col("l_partkey") % 20).alias("listing_id"), F.expr(_NO).alias("snapshot_no"), F.expr(_OK).alias("ok"))
    return rules.presence(item.select("listing_id", "broker_id", "snapshot_no"), item.select("broker_id", "snapshot_no", "ok"))


_DAY = "date '1998-08-02'"


@_query("ledger_ages", f"select o_custkey, max(o_orderdate) as last_change, max_by(status, o_orderkey) = 'active' and date_diff('day', cast(max(o_orderdate) as date), {_DAY}) >= 90 as stale, case when date_diff('day', cast(max(o_orderdate) as date), {_DAY}) > 30 then 'weekly' else 'daily' end as cadence from (select *, {_LIFE} as status from orders) x group by o_custkey")
def ledger_ages(spark, sf_dir):
    last = _orders(spark, sf_dir).groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_change"), F.max_by("status", "o_orderkey").alias("status"))
    day = F.expr(_DAY)
    return last.select("o_custkey", "last_change", rules.stale(F.col("status"), F.col("last_change"), day).alias("stale"), rules.cadence(F.col("last_change"), day).alias("cadence"))


_JUDGED = {"url_ok": "o_orderkey % 5 <> 0", "code": "case when o_orderkey % 5 = 0 then 404 else 200 end", "price": "case when o_orderkey % 3 <> 0 then o_totalprice end", "place": "case when o_orderkey % 4 <> 0 then 'TX' end", "revenue": "case when o_orderkey % 6 = 0 then null when o_orderkey % 6 = 1 then o_totalprice * 20 when o_orderkey % 6 = 2 then o_totalprice / 20 when o_orderkey % 6 = 3 then 0e0 else o_totalprice end", "checked": "o_custkey % 2 = 0", "again": "o_orderkey % 9 = 0", "twin": "o_orderkey % 7 = 0"}


@_query(
    "ledger_confidence_flags",
    f"""with j as (select *, {', '.join(f'{e} as {n}' for n, e in _JUDGED.items())}, {_LIFE} as status, max(o_totalprice) over ({_W} rows between unbounded preceding and 1 preceding) as top from orders)
select o_orderkey, round(case when url_ok then 0.3e0 else 0 end + case when price is not null then 0.15e0 else 0 end + case when place is not null then 0.15e0 else 0 end + case when revenue is not null then 0.2e0 else 0 end + case when checked then 0.1e0 else 0 end + case when date_diff('day', cast(o_orderdate as date), {_DAY}) < 7 then 0.1e0 else 0 end, 2) as confidence,
  array_to_string(list_filter([case when twin then 'duplicate_suspected' end, case when o_totalprice < 0.5 * top then 'price_drop_50' end, case when revenue <> 0 and (price / revenue < 0.1 or price / revenue > 10) then 'price_suspicious' end, case when again then 'relist_detected' end, case when code = 404 then 'source_404' end,
    case when status = 'active' and date_diff('day', cast(o_orderdate as date), {_DAY}) >= 90 then 'stale_90' end], lambda x: x is not null), '|') as flags from j""",
)
def ledger_confidence_flags(spark, sf_dir):
    c = F.col
    o = _orders(spark, sf_dir).withColumns({n: F.expr(e) for n, e in _JUDGED.items()})
    day = F.expr(_DAY)
    marks = rules.flags(rules.price_dropped("o_custkey", ("o_orderdate", "o_orderkey"), "o_totalprice"), c("again"), rules.stale(c("status"), c("o_orderdate"), day), c("twin"), c("code"), c("price"), c("revenue"))
    return o.select("o_orderkey", rules.confidence(c("url_ok"), c("price"), c("place"), c("revenue"), c("checked"), c("o_orderdate"), day).alias("confidence"), F.array_join(marks, "|").alias("flags"))


_COUNTRY = "case c_custkey % 6 when 0 then ' united states ' when 1 then 'us' when 2 then 'Canada' when 3 then 'Atlantis' when 4 then '' end"
_WHERE = "case when c_custkey % 4 = 0 then 'Confidential, TX' when c_custkey % 4 = 1 then 'Reno, NV' end"
_RANGE = "case c_custkey % 5 when 0 then '$100K - $200K' when 1 then '$5,000 to $9,000' when 2 then '$75,000' when 3 then 'pre-owned $5' end"


@_query("location_extras", f"select c_custkey, case upper(trim({_COUNTRY})) when 'UNITED STATES' then 'US' when 'US' then 'US' when 'CANADA' then 'CA' end as country, coalesce(contains(lower({_WHERE}), 'confidential'), false) as location_hidden, coalesce(c_custkey % 5 in (0, 1), false) as price_range, case c_custkey % 5 when 0 then 100000 when 1 then 5000 when 2 then 75000 when 3 then 5 end as lower_bound from customer")
def location_extras(spark, sf_dir):
    price = F.expr(_RANGE)
    return table(spark, sf_dir, "customer").select("c_custkey", rules.country_code(F.expr(_COUNTRY)).alias("country"), rules.location_hidden(F.expr(_WHERE)).alias("location_hidden"), rules.is_range(price).alias("price_range"), money.any_price(price).cast("int").alias("lower_bound"))


@_query("broker_aliases", "with t as (select l_suppkey, l_partkey, concat('https://b', l_suppkey, '.example/', l_orderkey) as u, l_shipdate from lineitem), f as (select l_suppkey, l_partkey, u, row_number() over (partition by l_suppkey, l_partkey order by l_shipdate, u) as r from t), c as (select l_suppkey, l_partkey, u as canonical_url from f where r = 1) select c.l_suppkey, c.l_partkey, c.canonical_url, coalesce(string_agg(distinct f.u, ' ' order by f.u) filter (where f.u <> c.canonical_url), '') as aliases from c join f using (l_suppkey, l_partkey) group by all")
def broker_aliases(spark, sf_dir):
    item = table(spark, sf_dir, "lineitem").withColumn("u", F.expr("concat('https://b', l_suppkey, '.example/', l_orderkey)"))
    return rules.aliases(item, "l_suppkey", "l_partkey", "u", "l_shipdate").withColumn("aliases", F.array_join("aliases", " "))


@_query("cross_broker_pairs", "select distinct a.l_partkey, a.l_suppkey as first_broker, b.l_suppkey as second_broker from lineitem a join lineitem b on a.l_partkey = b.l_partkey and a.l_suppkey < b.l_suppkey")
def cross_broker_pairs(spark, sf_dir):
    """Brokers that list the same part: flagged in pairs, never merged. A part has few brokers."""
    own = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    pairs = own.select("l_partkey", F.col("l_suppkey").alias("first_broker")).join(own.select("l_partkey", F.col("l_suppkey").alias("second_broker")), "l_partkey")
    return pairs.filter("first_broker < second_broker")


_VERTICAL = "case when p_size % 7 = 0 then null else p_type end"


@_query("by_vertical", f"select coalesce({_VERTICAL}, 'other') as vertical, count(*) as n from lineitem join part on l_partkey = p_partkey group by 1")
def by_vertical(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.expr(_VERTICAL).alias("v"))
    return rules.by_vertical(table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")), "v")


@_query("pattern_stats", "select count(distinct user_id) as total_patterns, count(*) as total_scrapes, cast(sum(event_id % 50) as bigint) as total_listings from events")
def pattern_stats(spark, sf_dir):
    cache = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("success_count"), F.sum(F.col("event_id") % 50).alias("total_listings"))
    return rules.pattern_stats(cache)


@_query("broker_records", "select l_suppkey, s_name, cast(sum(case when l_linestatus = 'O' then 1 else 0 end) as bigint) as active_listings, count(distinct l_partkey) as total_observed, min(l_shipdate) as first_seen, max(l_shipdate) as last_scraped, string_agg(distinct l_returnflag, '|' order by l_returnflag) as coverage_states, string_agg(distinct l_linestatus, '|' order by l_linestatus) as verticals from lineitem join supplier on l_suppkey = s_suppkey group by l_suppkey, s_name")
def broker_records(spark, sf_dir):
    names = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    item = table(spark, sf_dir, "lineitem").join(names, F.col("l_suppkey") == F.col("s_suppkey"))
    rows = item.select("l_suppkey", "s_name", F.col("l_partkey").alias("url"), F.when(F.col("l_linestatus") == "O", "active").otherwise("sold").alias("status"), F.col("l_returnflag").alias("state"), F.col("l_linestatus").alias("vertical"), F.col("l_shipdate").alias("at"))
    return rules.broker_records(rows, "l_suppkey", "s_name").withColumns({c: F.array_join(c, "|") for c in ("coverage_states", "verticals")})


@_query("explorer_search", "select o_orderkey, n_name, c_mktsegment, o_orderdate from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where n_name = (select min(n_name) from nation) and c_mktsegment = 'BUILDING' order by o_orderdate nulls first, o_orderkey limit 5 offset 5")
def explorer_search(spark, sf_dir):
    """The second page, of five rows, of one state and one business type; a listing without a date would come first."""
    nation = table(spark, sf_dir, "nation")
    state = nation.agg(F.min("n_name")).first()[0]
    customer = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = table(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "n_name", "c_mktsegment", "o_orderdate")
    return rules.explore(rows, "o_orderdate", ("o_orderkey",), 2, 5, n_name=state, c_mktsegment="BUILDING")


@_query("run_results", "select count(*) as brokers_attempted, cast(sum(case when s_suppkey % 3 <> 0 then 1 else 0 end) as bigint) as brokers_success, cast(sum(case when s_suppkey % 3 = 0 then 1 else 0 end) as bigint) as brokers_failed, round(100e0 * sum(case when s_suppkey % 3 <> 0 then 1 else 0 end) / count(*), 1) as success_rate, (select count(*) from lineitem) as listings_total, (select cast(sum(case when l_discount <> 0 then 1 else 0 end) as bigint) from lineitem) as with_price, (select cast(sum(case when l_tax <> 0 then 1 else 0 end) as bigint) from lineitem) as with_revenue, (select cast(sum(case when l_quantity <> 0 then 1 else 0 end) as bigint) from lineitem) as with_cashflow from supplier")
def run_results(spark, sf_dir):
    results = table(spark, sf_dir, "supplier").select(F.when(F.col("s_suppkey") % 3 == 0, "error").otherwise("success").alias("status"))
    return sinks.run_summary(results, table(spark, sf_dir, "lineitem").select(F.col("l_discount").alias("asking_price"), F.col("l_tax").alias("revenue"), F.col("l_quantity").alias("cash_flow")))


@_query("pattern_learned", "select user_id as name, max_by(event_type, event_id) as pattern, count(*) as success_count, cast(sum(event_id % 50) as bigint) as total_listings, min(event_id) as first_seen, max(event_id) as last_used from events where event_type <> 'error' group by user_id")
def pattern_learned(spark, sf_dir):
    log = table(spark, sf_dir, "events").filter("event_type <> 'error'").withColumn("n", F.col("event_id") % 50)
    return rules.learned(log, "user_id", "event_type", "n", "event_id")


@_query("run_totals", "select count(*) as total_brokers, cast(sum(case when s_suppkey % 4 <> 0 then 1 else 0 end) as bigint) as successful, cast(sum(case when s_suppkey % 4 = 0 then 1 else 0 end) as bigint) as failed, cast(sum(case when s_suppkey % 4 <> 0 then n else 0 end) as bigint) as total_listings from (select s_suppkey, count(l_suppkey) as n from supplier left join lineitem on l_suppkey = s_suppkey group by s_suppkey) x")
def run_totals(spark, sf_dir):
    counted = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    brokers = table(spark, sf_dir, "supplier").join(counted, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return rules.run_totals(brokers.select(F.when(F.col("s_suppkey") % 4 == 0, "error").otherwise("success").alias("status"), F.coalesce("n", F.lit(0)).alias("listings_count")))


_SIMILAR = "0.4 * (1 - levenshtein(a.title, b.title) / cast(greatest(length(a.title), length(b.title), 1) as double)) + 0.2 + 0.2 * cast(abs(a.price - b.price) <= 0.2 * greatest(a.price, b.price) as int) + 0.2 * cast(abs(a.cash_flow - b.cash_flow) <= 0.25 * greatest(a.cash_flow, b.cash_flow) as int)"


@_query("suspected_duplicates", f"with p as (select p_partkey as id, p_brand as broker, p_name as title, p_type as state, p_retailprice as price, p_size as cash_flow from part) select a.id, count(*) as twins from p a join p b on a.state = b.state and a.broker <> b.broker and round({_SIMILAR}, 6) > 0.85 group by a.id")
def suspected_duplicates(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("broker"), F.col("p_name").alias("title"), F.col("p_type").alias("state"), F.col("p_retailprice").alias("price"), F.col("p_size").alias("cash_flow"))
    return rules.suspected_duplicates(part)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_found)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
