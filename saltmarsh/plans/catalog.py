"""Registered queries of the ledger with the SQL that gives the same rows in another engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from saltmarsh.functions import classify as C
from saltmarsh.functions import money as M
from saltmarsh.functions import places as P
from saltmarsh.operators import html, rules, similar, stats
from saltmarsh.plans import listings, mechanisms
from saltmarsh.sources import sinks
from saltmarsh.sources.tables import OBSERVATIONS_SQL, observations, table
from saltmarsh.streaming import ledger

_found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}
KEY = ("l_orderkey", "l_linenumber")


def _query(name: str, sql: str | None = None):
    def add(f):
        _found[name] = f
        if sql:
            _sql[name] = sql
        return f

    return add


def _obs(select: str, more: str = "") -> str:
    return f"with {OBSERVATIONS_SQL}{more} select l_orderkey, l_linenumber, {select} from obs"


# Money, places, identifiers of synthetic listings -------------------------------------------------------------------

_NUM = r"regexp_full_match({0}, '\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*')"


def _num(x: str) -> str:
    return f"case when {_NUM.format(x)} then try_cast(trim({x}) as double) end"


@_query("extract_price", _obs(f"list_max(list_filter(list_transform(regexp_extract_all(text, '\\$[\\d,]+(?:\\.\\d{{2}})?'), lambda m: struct_pack(v := try_cast(regexp_replace(m, '[,$]', '', 'g') as double), m := m)), lambda s: s.v is not null)).m as price_text"))
def extract_price(spark, sf_dir):
    return observations(spark, sf_dir).select(*KEY, M.max_price_text(F.col("text")).alias("price_text"))


def _first_above(patterns, least):
    values = (f"try_cast(replace(regexp_extract(lower(text), '{p}', 1), ',', '') as double)" for p in patterns)
    return "coalesce(" + ", ".join(f"case when {v} > {least} then {v} end" for v in values) + ")"


@_query("extract_financials", _obs(f"{_first_above(M.REVENUE, 10000)} as revenue, {_first_above(M.CASH_FLOW, 1000)} as cash_flow"))
def extract_financials(spark, sf_dir):
    return observations(spark, sf_dir).select(*KEY, M.revenue(F.col("text")).alias("revenue"), M.cash_flow(F.col("text")).alias("cash_flow"))


@_query("extract_city_state", _obs(r"nullif(regexp_extract(text, '\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*),\s*([A-Z]{2})\b', 1), '') as city, coalesce(nullif(regexp_extract(text, '\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*),\s*([A-Z]{2})\b', 2), ''), nullif(regexp_extract(text, '\b[A-Z]{2}\b', 0), '')) as state"))
def extract_city_state(spark, sf_dir):
    return observations(spark, sf_dir).select(*KEY, P.city(F.col("text")).alias("city"), P.state(F.col("text")).alias("state"))


#: Price texts in several dialects from order totals; amount is the total in whole dollars.
_DIALECT = "case cast(o_orderkey % 9 as int) when 0 then concat('$', amount) when 1 then concat('$', amount % 90 + 1, '.5M') when 2 then concat(amount % 900, 'k') when 3 then '1.2 million' when 4 then 'Contact for Price' when 5 then concat('$', amount % 100 + 1, 'K - $200K') when 6 then '' when 7 then '-3.9' end"


def _f2(t):
    up, first = f"upper({t})", f"regexp_extract(replace(replace(upper({t}), '$', ''), ',', ''), '[\\d.]+', 0)"
    return f"case when not regexp_matches({up}, 'CONTACT|CALL|TBD|N/A|NEGOTIABLE|UPON REQUEST') then try_cast(trunc(try_cast({first} as double) * case when contains({up}, 'M') then 1e6 when contains({up}, 'K') then 1e3 else 1 end) as bigint) end"


def _f3(t):
    low = f"lower(replace(replace({t}, '$', ''), ',', ''))"
    return f"case when contains({low}, 'k') then ({_num(f'replace({low}, chr(107), chr(32))')}) * 1000 when contains({low}, 'm') then ({_num(f'replace({low}, chr(109), chr(32))')}) * 1000000 else {_num(low)} end"


@_query("money_dialects", f"""with t as (select o_orderkey, {_DIALECT} as t from (select o_orderkey, cast(trunc(o_totalprice) as bigint) as amount from orders))
select o_orderkey, try_cast(trunc({_num("replace(replace(t, '$', ''), ',', '')")}) as bigint) as whole, {_f2('t')} as any_price, {_f3('t')} as scaled, try_cast(replace(regexp_extract(t, '[\\d,.]+', 0), ',', '') as double) as first_number from t""")  # fmt: skip
def money_dialects(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.expr("cast(o_totalprice as bigint)").alias("amount"))
    t = orders.select("o_orderkey", F.expr(_DIALECT).alias("t"))
    return t.select("o_orderkey", M.whole_price(F.col("t")).alias("whole"), M.any_price(F.col("t")).alias("any_price"), M.scaled_money(F.col("t")).alias("scaled"), M.first_number(F.col("t")).alias("first_number"))


_STATE = "case cast(c_custkey % 6 as int) when 0 then ' texas ' when 1 then 'New York' when 2 then 'zz' when 3 then n_name when 4 then 'District of Columbia' end"


@_query("normalize_state", f"with t as (select c_custkey, {_STATE} as s from customer join nation on c_nationkey = n_nationkey) select c_custkey, case when length(trim(s)) = 2 then upper(trim(s)) else case upper(trim(s)) {' '.join(f'when {chr(39)}{k}{chr(39)} then {chr(39)}{v}{chr(39)}' for k, v in P.STATES.items())} end end as state from t")
def normalize_state(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    t = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.expr(_STATE).alias("s"))
    return t.select("c_custkey", P.normal_state(F.col("s")).alias("state"))


_FLAG = "case cast(o_orderkey % 5 as int) when 0 then 'Yes' when 1 then ' yes' when 2 then 'TRUE' when 3 then '' end"


@_query("booleans_and_falsy", f"with t as (select o_orderkey, o_orderpriority, {_FLAG} as f from orders) select o_orderkey, lower(f) in ('true', 'yes', '1', 'y') as flag, coalesce(nullif(f, ''), o_orderpriority) as shown from t")
def booleans_and_falsy(spark, sf_dir):
    t = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.expr(_FLAG).alias("f"))
    return t.select("o_orderkey", P.truthy_text(F.col("f")).alias("flag"), P.or_else(F.col("f"), F.col("o_orderpriority")).alias("shown"))


_HASH = "coalesce(cast({} as varchar), 'None')"


@_query("listing_ids", _obs("concat('dl_', left(sha256(concat(broker_id, ':', url)), 12)) as sha_id, md5(url) as md5_id, concat('dl_', left(md5(url), 12)) as short_id, sha256(concat(p_name, cast(l_quantity as bigint), 'None', left(text, 500))) as content_hash"))
def listing_ids(spark, sf_dir):
    o = observations(spark, sf_dir)
    content = P.content_hash([F.col("p_name"), F.col("l_quantity").cast("bigint"), F.lit(None), F.substring("text", 1, 500)])
    return o.select(*KEY, P.sha_id(F.col("broker_id").cast("string"), F.col("url")).alias("sha_id"), F.md5("url").alias("md5_id"), P.short_id(F.col("url")).alias("short_id"), content.alias("content_hash"))


@_query("url_domain", r"select page_id, replace(nullif(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1), ''), 'www.', '') as domain, case when regexp_matches(url, 'page=\d+') then regexp_replace(url, 'page=\d+', concat('page=', try_cast(regexp_extract(url, 'page=(\d+)', 1) as bigint) + 1), 'g') end as next_page from pages")
def url_domain(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", P.domain(F.col("url")).alias("domain"), P.next_page(F.col("url")).alias("next_page"))


# Classes ------------------------------------------------------------------------------------------------------------

_TITLES = ("concat(text, case cast(doc_id % 19 as int) when 0 then ' Janitorial route' when 1 then ' coin laundry' when 2 then ' ATM route' when 3 then ' HVAC heating' when 4 then ' Lawn maintenance' when 5 then ' pool service' when 6 then ' pest control' "
           "when 7 then ' plumber' when 8 then ' electrician' when 9 then ' auto body' when 10 then ' Pizza cafe' when 11 then ' boutique' when 12 then ' shopify' when 13 then ' factory' when 14 then ' wholesale' when 15 then ' staffing' when 16 then ' dental' when 17 then ' 3 bed 2 bath' else '' end)")  # fmt: skip


def _case(words: dict, other: str | None) -> str:
    whens = " ".join("when " + " or ".join(f"contains(low, '{w}')" for w in own) + f" then '{name}'" for name, own in words.items())
    return f"case {whens} else {f'{chr(39)}{other}{chr(39)}' if other else 'null'} end"


def _any(words) -> str:
    return "(" + " or ".join(f"contains(low, '{w}')" for w in words) + ")"


_DOCS = f"with t as (select doc_id, x as text, lower(x) as low from (select doc_id, {_TITLES} as x from documents))"


def _titled(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(_TITLES).alias("text"))


@_query("vertical_first_match", f"{_DOCS} select doc_id, {_case(C.FIRST_MATCH, 'other')} as plain, {_case(C.RICH, 'other')} as rich, {_case(C.SHORT, 'other')} as short, {_case(C.BUSINESS, None)} as business, {_case(C.BUSINESS_SECOND, None)} as business_second from t")
def vertical_first_match(spark, sf_dir):
    low = F.col("low")
    found = {"plain": C.FIRST_MATCH, "rich": C.RICH, "short": C.SHORT, "business": C.BUSINESS, "business_second": C.BUSINESS_SECOND}
    titled = _titled(spark, sf_dir).select("doc_id", F.lower("text").alias("low"))
    return titled.select("doc_id", *(C.first_class(low, words, None if name.startswith("business") else "other").alias(name) for name, words in found.items()))


_SCORES = ", ".join(f"struct_pack(n := {' + '.join(f'cast(contains(low, {chr(39)}{w}{chr(39)}) as int)' for w in words)}, k := {-k}, name := '{name}')" for k, (name, words) in enumerate(C.SCORED.items()))


@_query("vertical_score", f"{_DOCS} select doc_id, case when (list_max([{_SCORES}])).n > 0 then (list_max([{_SCORES}])).name end as vertical from t")
def vertical_score(spark, sf_dir):
    return _titled(spark, sf_dir).select("doc_id", C.best_score(F.col("text")).alias("vertical"))


@_query("text_filters", f"{_DOCS} select doc_id, regexp_matches(low, '\\bmls\\s*#|\\bidx\\b|\\d+\\s*bed.*\\d+\\s*bath') as real_estate, {_any(C.HINTS)} as hinted, not {_any(C.EXCLUDED['cleaning'])} and {_any(C.SCORED['cleaning'])} as cleaning, not {_any(C.EXCLUDED['hvac'])} and {_any(C.SCORED['hvac'])} as hvac from t")
def text_filters(spark, sf_dir):
    t = F.col("text")
    return _titled(spark, sf_dir).select("doc_id", C.is_real_estate(t).alias("real_estate"), C.any_of(F.lower(t), C.HINTS).alias("hinted"), C.in_vertical(t, "cleaning").alias("cleaning"), C.in_vertical(t, "hvac").alias("hvac"))


_VERTICALS = ", ".join(f"not {_any(C.EXCLUDED[v])} and {_any(C.SCORED[v])} as {v}" for v in C.SCORED)


@_query("vertical_membership", f"{_DOCS} select doc_id, {_VERTICALS} from t")
def vertical_membership(spark, sf_dir):
    """Whether each text is kept by each of the verticals: no word that excludes it, and one of its own at least."""
    return _titled(spark, sf_dir).select("doc_id", *(C.in_vertical(F.col("text"), v).alias(v) for v in C.SCORED))


_RANGED = "case l_orderkey % 6 when 0 then concat('$', l_partkey, ',000 - $', l_suppkey, 'K') when 1 then concat(l_linenumber, ' to ', l_partkey, 'k') when 2 then concat('$', l_linenumber, '.5M') when 3 then 'Call us' when 4 then concat('$', l_partkey, '-$', l_suppkey, 'm or less') end"


@_query(
    "price_ranges",
    rf"""with t as (select l_orderkey, l_linenumber, replace(replace(lower({_RANGED}), '$', ''), ',', '') as x from lineitem),
  m as (select l_orderkey, l_linenumber, regexp_extract(x, '([0-9.]+)\s*([km]?)', 1) as a, regexp_extract(x, '([0-9.]+)\s*([km]?)', 2) as u,
    regexp_extract(x, '[0-9.]+\s*[km]?\s*(?:-|to)\s*([0-9.]+)\s*([km]?)', 1) as b, regexp_extract(x, '[0-9.]+\s*[km]?\s*(?:-|to)\s*([0-9.]+)\s*([km]?)', 2) as v from t),
  n as (select l_orderkey, l_linenumber, try_cast(a as double) as a, try_cast(b as double) as b, case u when 'k' then 1e3 when 'm' then 1e6 else 1 end as u, case v when 'k' then 1e3 when 'm' then 1e6 else 1 end as v from m),
  r as (select l_orderkey, l_linenumber, a * case when u = 1 and a <= b then v else u end as p, b * v as q from n)
select l_orderkey, l_linenumber, cast(least(p, coalesce(q, p)) as double) as low, cast(greatest(p, coalesce(q, p)) as double) as high from r""",
)
def price_ranges(spark, sf_dir):
    """Both bounds of asking prices that are given as ranges."""
    found = M.price_range(F.expr(_RANGED))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", found.alias("found")).select("l_orderkey", "l_linenumber", "found.low", "found.high")


_STATUS = "case cast(event_id % 8 as int) when 0 then 403 when 1 then 404 when 2 then 502 else null end"
_ERROR = "case cast(event_id % 8 as int) when 3 then 'Read timed out' when 4 then 'SSL handshake' when 5 then 'No business listings' when 6 then 'odd' end"
_FAILED = f"with f as (select event_id, user_id, {_STATUS} as status, {_ERROR} as error, props as html from events where event_type = 'error'), c as (select *, case when status = 403 then 'HTTP_403' when status = 404 then 'HTTP_404' when status >= 500 then 'HTTP_500' when regexp_matches(lower(coalesce(error, '')), 'timeout|timed out') then 'TIMEOUT' when regexp_matches(lower(coalesce(error, '')), 'ssl|certificate') then 'SSL_ERROR' when contains(lower(html), 'captcha') then 'CAPTCHA' when regexp_matches(lower(coalesce(error, '')), 'no pattern|no business listings') then 'NO_PATTERN' when length(html) < 10000 then 'JAVASCRIPT_HEAVY' else 'UNKNOWN' end as failure_type from f)"


def _failures(spark, sf_dir):
    f = table(spark, sf_dir, "events").filter("event_type = 'error'").select("event_id", "user_id", F.expr(_STATUS).alias("status"), F.expr(_ERROR).alias("error"), F.col("props").alias("html"))
    return f.withColumn("failure_type", C.failure_type(F.col("status"), F.col("error"), F.col("html")))


@_query("failure_classify", f"{_FAILED} select event_id, failure_type from c")
def failure_classify(spark, sf_dir):
    return _failures(spark, sf_dir).select("event_id", "failure_type")


@_query("failures_by_type", f"{_FAILED} select failure_type, count(*) as n, round(100e0 * count(*) / greatest(1, (select count(*) from c)), 6) as share from c group by failure_type")
def failures_by_type(spark, sf_dir):
    by = _failures(spark, sf_dir).groupBy("failure_type").agg(F.count("*").alias("n"))
    return by.withColumn("share", F.round(100.0 * F.col("n") / F.greatest(F.lit(1), F.sum("n").over(W.partitionBy())), 6))


@_query("run_summary", "select user_id % 50 as broker, count(*) as attempted, cast(sum(case when event_type = 'error' then 1 else 0 end) as bigint) as failed, cast(sum(case when event_type = 'purchase' then 1 else 0 end) as bigint) as listings, round(100e0 * sum(case when event_type <> 'error' then 1 else 0 end) / greatest(1, count(*)), 6) as success_rate from events group by user_id % 50")
def run_summary(spark, sf_dir):
    events, kind = table(spark, sf_dir, "events"), F.col("event_type")
    rate = F.round(100.0 * F.count_if(kind != "error") / F.greatest(F.lit(1), F.count("*")), 6)
    return events.groupBy((F.col("user_id") % 50).alias("broker")).agg(F.count("*").alias("attempted"), F.count_if(kind == "error").alias("failed"), F.count_if(kind == "purchase").alias("listings"), rate.alias("success_rate"))



# Dedup, upsert, anti-joins ------------------------------------------------------------------------------------------


@_query("dedup_first_wins", f"with {OBSERVATIONS_SQL} select md5(url) as listing_id, l_orderkey, l_linenumber, l_extendedprice from obs qualify row_number() over (partition by url order by l_orderkey, l_linenumber) = 1")
def dedup_first_wins(spark, sf_dir):
    n = F.row_number().over(W.partitionBy("listing_id").orderBy(*KEY))
    return observations(spark, sf_dir).select(F.md5("url").alias("listing_id"), *KEY, "l_extendedprice").withColumn("n", n).filter("n = 1").drop("n")


@_query("upsert_last_wins", "select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_orderdate >= timestamp '1995-01-01' desc, o_orderdate desc, o_orderkey desc) as n from orders) where n = 1")
def upsert_last_wins(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    new = F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp_ntz")
    both = sinks.upsert(orders.filter(~new), orders.filter(new), "o_custkey", F.struct("o_orderdate", "o_orderkey").desc())
    return both.select("o_custkey", "o_orderkey", "o_totalprice")


@_query("seen_anti_join", "select distinct l_partkey, l_suppkey from lineitem l where l_linenumber > 1 and not exists (select 1 from lineitem s where s.l_linenumber = 1 and s.l_partkey = l.l_partkey and s.l_suppkey = l.l_suppkey)")
def seen_anti_join(spark, sf_dir):
    item = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber")
    return stats.unseen(item.filter("l_linenumber > 1"), item.filter("l_linenumber = 1"), "l_partkey", "l_suppkey")


@_query("within_broker_dedup", "select l_suppkey, l_partkey, min_by(l_orderkey, seq) as oldest, count(distinct l_orderkey) as aliases from (select l_suppkey, l_partkey, l_orderkey, l_orderkey * 10 + l_linenumber as seq from lineitem) x group by l_suppkey, l_partkey")
def within_broker_dedup(spark, sf_dir):
    item = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    found = rules.aliases(item, "l_suppkey", "l_partkey", "l_orderkey", "seq")
    return found.select("l_suppkey", "l_partkey", F.col("canonical_url").alias("oldest"), (F.size("aliases") + 1).cast("long").alias("aliases"))


@_query("union_intersect_except", "select 'both' as kind, count(*) as n from (select l_partkey from lineitem where l_discount > 0.05 intersect select l_partkey from lineitem where l_tax > 0.04) x union all select 'only', count(*) from (select l_partkey from lineitem where l_discount > 0.05 except select l_partkey from lineitem where l_tax > 0.04) y union all select 'bag', count(*) from (select l_partkey from lineitem where l_discount > 0.05 union all select l_partkey from lineitem where l_tax > 0.04) z")
def union_intersect_except(spark, sf_dir):
    item = table(spark, sf_dir, "lineitem")
    cheap, taxed = item.filter("l_discount > 0.05").select("l_partkey"), item.filter("l_tax > 0.04").select("l_partkey")
    count = lambda kind, rows: rows.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count("both", cheap.intersect(taxed)).union(count("only", rules.unknown_brokers(cheap, taxed))).union(count("bag", cheap.union(taxed)))



# Statistics and exploring -------------------------------------------------------------------------------------------

_SNAP = "select o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderstatus, c_mktsegment, n_name from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey"


def _snapshot(spark, sf_dir) -> DataFrame:
    customer = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_mktsegment", "n_name")
    return table(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))


@_query("snapshot_stats", f"select count(*) as listings, count(o_totalprice) as with_price, count(distinct o_custkey) as brokers, count(distinct n_name) as states, round(median(o_totalprice), 4) as median_price, round(avg(o_totalprice), 4) as mean_price, min(o_totalprice) as min_price, max(o_totalprice) as max_price from ({_SNAP}) s")
def snapshot_stats(spark, sf_dir):
    found = stats.snapshot_stats(_snapshot(spark, sf_dir), "o_totalprice", "o_custkey", "n_name")
    return found.withColumns({c: F.round(c, 4) for c in ("median_price", "mean_price")})


@_query("top_states", f"select n_name, count(*) as n from ({_SNAP}) s group by n_name order by n desc, n_name limit 10")
def top_states(spark, sf_dir):
    return stats.top(_snapshot(spark, sf_dir), "n_name")


@_query("top_types", f"select c_mktsegment, count(*) as n from ({_SNAP}) s group by c_mktsegment order by n desc, c_mktsegment limit 10")
def top_types(spark, sf_dir):
    return stats.top(_snapshot(spark, sf_dir), "c_mktsegment")


@_query("coverage_truthy", "select l_suppkey, cast(sum(case when coalesce(l_discount, 0) <> 0 then 1 else 0 end) as bigint) as with_discount, count(l_discount) as known_discount, cast(sum(case when coalesce(l_tax, 0) <> 0 or coalesce(l_discount, 0) <> 0 then 1 else 0 end) as bigint) as with_financials from lineitem group by l_suppkey")
def coverage_truthy(spark, sf_dir):
    item = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_discount", "l_tax")
    either = F.count_if((F.coalesce("l_tax", F.lit(0)) != 0) | (F.coalesce("l_discount", F.lit(0)) != 0))
    return item.groupBy("l_suppkey").agg(stats.truthy("l_discount").alias("with_discount"), F.count("l_discount").alias("known_discount"), either.alias("with_financials"))


@_query("broker_rollup", "select l_suppkey as broker_id, s_name, count(distinct l_partkey) as total_observed, cast(sum(case when l_linestatus = 'O' then 1 else 0 end) as bigint) as active, min(l_shipdate) as first_seen, max(l_shipdate) as last_seen from lineitem join supplier on l_suppkey = s_suppkey group by l_suppkey, s_name having count(distinct l_partkey) >= 5")
def broker_rollup(spark, sf_dir):
    item = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    rows = item.select(F.col("l_suppkey").alias("broker_id"), "s_name", F.col("l_partkey").alias("url"), F.when(F.col("l_linestatus") == "O", "active").alias("status"), F.col("l_returnflag").alias("state"), F.col("l_linestatus").alias("vertical"), F.col("l_shipdate").alias("at"))
    found = rules.broker_records(rows, "broker_id", "s_name").filter("total_observed >= 5")
    return found.select("broker_id", "s_name", "total_observed", F.col("active_listings").alias("active"), "first_seen", F.col("last_scraped").alias("last_seen"))


@_query("brokers_top_n", "select s_suppkey, s_name, s_acctbal from supplier order by s_acctbal desc, s_suppkey limit 20")
def brokers_top_n(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(20)


@_query("specialized_route", "select s_suppkey, case when contains(lower(s_name), '1') then 'first' when contains(lower(s_name), '2') then 'second' when contains(lower(s_name), '3') then 'third' else 'generic' end as route from supplier")
def specialized_route(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", C.first_match(F.col("s_name"), {"first": ["1"], "second": ["2"], "third": ["3"]}, "generic").alias("route"))


@_query("explorer_page", f"with s as ({_SNAP}) select o_orderkey, o_totalprice, n_name, c_mktsegment, o_orderdate from s where n_name = (select min(n_name) from s) and c_mktsegment = (select min(c_mktsegment) from s) order by o_orderdate, o_orderkey limit 50 offset 50")
def explorer_page(spark, sf_dir):
    rows = _snapshot(spark, sf_dir).select("o_orderkey", "o_totalprice", "n_name", "c_mktsegment", "o_orderdate")
    state, segment = rows.agg(F.min("n_name"), F.min("c_mktsegment")).first()
    return rules.explore(rows, "o_orderdate", ("o_orderkey",), page=2, n_name=state, c_mktsegment=segment)




@_query("explorer_facets", f"select distinct n_name as state, c_mktsegment as business_type from ({_SNAP}) s")
def explorer_facets(spark, sf_dir):
    return stats.facets(_snapshot(spark, sf_dir), "n_name", "c_mktsegment").toDF("state", "business_type")


@_query("explorer_header", f"select count(*) as total, count(distinct o_custkey) as brokers, count(distinct n_name) as states, max(o_orderdate) as latest from ({_SNAP}) s")
def explorer_header(spark, sf_dir):
    return stats.header(_snapshot(spark, sf_dir), "o_custkey", "n_name", "o_orderdate")


@_query("explorer_feed", "select o_orderkey as id, coalesce(nullif(o_totalprice, 0), 0) as price, coalesce(nullif(o_orderstatus, ''), 'active') as status, cast(o_orderdate as date) as scraped_on from orders")
def explorer_feed(spark, sf_dir):
    price, status = F.nullif(F.col("o_totalprice"), F.lit(0)), P.or_else(F.col("o_orderstatus"), F.lit("active"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.coalesce(price, F.lit(0)).alias("price"), status.alias("status"), F.col("o_orderdate").cast("date").alias("scraped_on"))



# The ledger ---------------------------------------------------------------------------------------------------------

_O = "partition by o_custkey order by o_orderdate, o_orderkey"


@_query("price_history", f"select o_custkey as listing_id, o_orderkey, prev as old_price, o_totalprice as new_price, round(100 * (o_totalprice - prev) / prev, 4) as pct from (select *, lag(o_totalprice) over ({_O}) as prev from orders) x where prev is not null and prev <> o_totalprice")
def price_history(spark, sf_dir):
    found = rules.price_changes(table(spark, sf_dir, "orders"), "o_custkey", ("o_orderdate", "o_orderkey"), "o_totalprice")
    return found.select(F.col("o_custkey").alias("listing_id"), "o_orderkey", "old_price", "new_price", "pct")


@_query("status_transitions", f"select prev as from_status, o_orderstatus as to_status, count(*) as n, prev <> 'F' as legal from (select *, lag(o_orderstatus) over ({_O}) as prev from orders) x where prev is not null and prev <> o_orderstatus group by prev, o_orderstatus")
def status_transitions(spark, sf_dir):
    found = rules.status_changes(table(spark, sf_dir, "orders"), "o_custkey", ("o_orderdate", "o_orderkey"), "o_orderstatus")
    return found.groupBy("from_status", "to_status").agg(F.count("*").alias("n")).withColumn("legal", F.col("from_status") != "F")




@_query("first_last_seen", "select o_custkey as listing_id, min(o_orderdate) as first_seen, max(o_orderdate) as last_seen, count(*) as n from orders group by o_custkey")
def first_last_seen(spark, sf_dir):
    return stats.seen_span(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate").withColumnRenamed("o_custkey", "listing_id")


@_query("price_drop_50", f"select o_custkey as listing_id, o_orderkey, o_totalprice < 0.5 * top as dropped from (select *, max(o_totalprice) over ({_O} rows between unbounded preceding and 1 preceding) as top from orders) x where top is not null")
def price_drop_50(spark, sf_dir):
    order = ("o_orderdate", "o_orderkey")
    marked = table(spark, sf_dir, "orders").withColumns({"dropped": rules.price_dropped("o_custkey", order, "o_totalprice"), "n": F.row_number().over(rules.in_order("o_custkey", order))})
    return marked.filter("n > 1").select(F.col("o_custkey").alias("listing_id"), "o_orderkey", "dropped")


@_query("stale_90", "select o_custkey as listing_id, max(o_orderdate) as last_change, cast(max(o_orderdate) as date) < date '1998-05-01' as stale from orders group by o_custkey")
def stale_90(spark, sf_dir):
    last = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("listing_id")).agg(F.max("o_orderdate").alias("last_change"))
    return last.withColumn("stale", rules.stale(F.lit("active"), F.col("last_change"), F.lit("1998-07-29").cast("date")))




@_query("relist", f"select o_custkey as listing_id, o_orderkey, cast(m - prev as bigint) as gap from (select *, lag(m) over (partition by o_custkey order by m, o_orderkey) as prev from (select o_custkey, o_orderkey, year(o_orderdate) * 12 + month(o_orderdate) as m from orders) y) x where m - prev > 1")
def relist(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "listing_id")
    return stats.gaps(orders, "listing_id", ("o_orderkey",), F.year("o_orderdate") * 12 + F.month("o_orderdate"))


@_query("snapshot_diff", "select coalesce(a.k, b.k) as listing_id, case when a.k is null then 'added' when b.k is null then 'removed' when a.p <> b.p then 'changed' else 'same' end as change from (select o_custkey as k, max(o_totalprice) as p from orders where year(o_orderdate) = 1996 group by o_custkey) a full outer join (select o_custkey as k, max(o_totalprice) as p from orders where year(o_orderdate) = 1997 group by o_custkey) b on a.k = b.k")
def snapshot_diff(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("listing_id"), "o_totalprice", F.year("o_orderdate").alias("y"))
    old, new = (orders.filter(F.col("y") == y).groupBy("listing_id").agg(F.max("o_totalprice").alias("p")) for y in (1996, 1997))
    return stats.diff(old, new, "listing_id", "p")


@_query("history_rows", f"select o_custkey as listing_id, o_orderkey, field, old_value, new_value from (select o_custkey, o_orderkey, 'status' as field, lag(o_orderstatus) over ({_O}) as old_value, o_orderstatus as new_value from orders union all select o_custkey, o_orderkey, 'priority', lag(o_orderpriority) over ({_O}), o_orderpriority from orders) x where old_value is not null and old_value <> new_value")
def history_rows(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "listing_id")
    return stats.history(orders, "listing_id", ("o_orderdate", "o_orderkey"), {"status": "o_orderstatus", "priority": "o_orderpriority"}).drop("o_orderdate")


@_query("confidence", "select o_orderkey, round((case when o_orderstatus <> 'P' then 30 else 0 end + case when o_totalprice > 0 then 15 else 0 end + case when c_nationkey is not null then 15 else 0 end + case when c_acctbal > 0 then 20 else 0 end + case when c_mktsegment = 'BUILDING' then 10 else 0 end + case when year(o_orderdate) >= 1998 then 10 else 0 end) / 100.0, 2) + 0e0 as confidence from orders join customer on o_custkey = c_custkey")
def confidence(spark, sf_dir):
    rows, as_of = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")), F.lit("1999-01-01").cast("date")
    seen = F.when(F.year("o_orderdate") >= 1998, as_of).otherwise(F.date_sub(as_of, 30))
    some = lambda c: F.when(F.col(c) > 0, F.col(c))
    return rows.select("o_orderkey", rules.confidence(F.col("o_orderstatus") != "P", some("o_totalprice"), F.col("c_nationkey"), some("c_acctbal"), F.col("c_mktsegment") == "BUILDING", seen, as_of).alias("confidence"))


@_query("flags", f"select o_orderkey, concat(case when drop50 then 'price_drop_50|' else '' end, case when suspicious then 'price_suspicious|' else '' end, case when stale then 'stale_90|' else '' end) as flags from (select o_orderkey, coalesce(o_totalprice < 0.5 * max(o_totalprice) over ({_O} rows between unbounded preceding and 1 preceding), false) as drop50, o_totalprice / greatest(abs(c_acctbal), 1) > 100 as suspicious, year(o_orderdate) < 1993 as stale from orders join customer on o_custkey = c_custkey) x")
def flags(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("drop50", rules.price_dropped("o_custkey", ("o_orderdate", "o_orderkey"), "o_totalprice"))
    rows = rows.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    funds, no = F.greatest(F.abs(F.col("c_acctbal")), F.lit(1)), F.lit(False)  # over a hundred times the funds is suspicious here, and nothing is for being low
    found = rules.flags(F.col("drop50"), no, F.year("o_orderdate") < 1993, no, F.lit(200), F.greatest("o_totalprice", 2 * funds), 10 * funds)
    return rows.select("o_orderkey", F.array_join(F.transform(found, lambda f: F.concat(f, F.lit("|"))), "").alias("flags"))


@_query("scrape_cadence", "select o_custkey as listing_id, case when cast(max(o_orderdate) as date) < date '1998-06-01' then 'weekly' else 'daily' end as cadence from orders group by o_custkey")
def scrape_cadence(spark, sf_dir):
    last = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("listing_id")).agg(F.max("o_orderdate").alias("last"))
    return last.select("listing_id", rules.cadence(F.col("last"), F.lit("1998-07-01").cast("date")).alias("cadence"))


@_query("schema_rejects", "select o_orderkey, case when o_orderpriority is null or o_orderpriority = '' then 'title' when o_totalprice <= 0 then 'price' else 'status' end as reason from orders where o_orderpriority is null or o_orderpriority = '' or o_totalprice <= 0 or o_orderstatus not in ('F', 'O')")
def schema_rejects(spark, sf_dir):
    status = F.when(F.col("o_orderstatus").isin("F", "O"), F.col("o_orderstatus"))
    missing = rules.missing_field(F.col("o_orderpriority"), F.when(F.col("o_totalprice") > 0, "priced"), status)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.replace(missing, F.lit("broker"), F.lit("price")).alias("reason")).filter("reason is not null")



# Similarity ---------------------------------------------------------------------------------------------------------

_HOSTS = "select distinct replace(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1), 'www.', '') as name from pages"
_GRAMS = f"h as ({_HOSTS}), g as (select name, list_distinct(list_transform(range(1, greatest(length(name) - 1, 1)), lambda i: substr(name, i, 3))) as t from h)"


@_query("trigram_similarity", f"with {_GRAMS} select a.name as a, b.name as b, round(len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))), 6) as similarity from g a join g b on a.name < b.name where len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) > 0.3")
def trigram_similarity(spark, sf_dir):
    return similar.similar_names(table(spark, sf_dir, "pages").select(P.domain(F.col("url")).alias("name")).distinct())


_SCORE = "0.4 * (1 - levenshtein(a.title, b.title) / cast(greatest(length(a.title), length(b.title), 1) as double)) + 0.2 * cast(a.state = b.state as int) + 0.2 * cast(abs(a.price - b.price) <= 0.2 * greatest(a.price, b.price) as int) + 0.2 * cast(abs(a.cash_flow - b.cash_flow) <= 0.25 * greatest(a.cash_flow, b.cash_flow) as int)"


_LISTINGS = "p as (select p_partkey as id, p_name as title, p_brand as state, p_retailprice as price, p_size as cash_flow, min(p_partkey) over (partition by p_name, p_brand, p_retailprice, p_size) as rep from part)"


@_query("similar_listings", f"with {_LISTINGS}, c as (select * from p where id = rep) select rep as a, id as b, 1e0 as score, true as same from p where id > rep union all select a.id, b.id, round({_SCORE}, 6), false from c a join c b on a.state = b.state and a.id < b.id where round({_SCORE}, 6) > 0.6")
def similar_listings(spark, sf_dir):
    """Over all listings: members of each class of equal rows with its representative, and the representatives' links."""
    listings = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("state"), F.col("p_retailprice").alias("price"), F.col("p_size").alias("cash_flow"))
    classed = listings.withColumn("rep", F.min("id").over(W.partitionBy("title", "state", "price", "cash_flow")))
    members = classed.filter("id > rep").select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("score"), F.lit(True).alias("same"))
    return members.union(similar.linked_listings(classed.filter("id = rep").drop("rep")).withColumn("same", F.lit(False)))


@_query("cross_broker_flag", "select l_partkey, count(distinct l_suppkey) as brokers from lineitem group by l_partkey having count(distinct l_suppkey) > 1")
def cross_broker_flag(spark, sf_dir):
    pairs = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    return pairs.groupBy("l_partkey").agg(F.count("*").alias("brokers")).filter("brokers > 1")


@_query("pattern_cache", "select user_id as domain, max_by(event_type, event_id) as pattern, count(*) as success_count, sum(value) >= 0 as any_value, min(ts) as first_seen, max(ts) as last_used from events group by user_id")
def pattern_cache(spark, sf_dir):
    found = rules.learned(table(spark, sf_dir, "events").withColumn("at", F.struct("event_id", "ts")), "user_id", "event_type", "value", "at")
    return found.select(F.col("name").alias("domain"), "pattern", "success_count", (F.col("total_listings") >= 0).alias("any_value"), F.col("first_seen.ts").alias("first_seen"), F.col("last_used.ts").alias("last_used"))


@_query("pattern_vote", "select grp, event_type as pattern from (select grp, event_type, row_number() over (partition by grp order by n desc, event_type) as r from (select user_id % 100 as grp, event_type, count(*) as n from events group by user_id % 100, event_type) x) y where r = 1")
def pattern_vote(spark, sf_dir):
    counted = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 100).alias("grp"), "event_type").agg(F.count("*").alias("n"))
    return counted.groupBy("grp").agg(F.min(F.struct(-F.col("n"), "event_type")).getField("event_type").alias("pattern"))



_SEGMENT = "^[a-zA-Z]+://[^/?#]*/([^/?#]*)"
_SEEN = f"s as (select replace(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1), 'www.', '') as name, regexp_extract(url, '{_SEGMENT}', 1) as pattern from pages), cache as (select name, pattern, n as success_count from (select *, row_number() over (partition by name order by n desc, pattern) as r from (select name, pattern, count(*) as n from s where length(name) % 2 = 0 group by name, pattern) x) y where r = 1)"
_NEAREST = "sims as (select a.name, b.name as other, round(len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))), 6) as similarity from g a join g b on a.name <> b.name where len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) > 0.3), ranked as (select sims.name, pattern, similarity * success_count as weight, row_number() over (partition by sims.name order by similarity desc, other) as r from sims join cache on other = cache.name), votes as (select name, pattern, round(sum(weight), 6) as score, min(r) as r from ranked where r <= 5 and (name, pattern) in (select name, pattern from s) group by name, pattern), best as (select name, pattern, row_number() over (partition by name order by score desc, r) as k from votes)"


@_query("predict_pattern", f"with {_SEEN}, {_GRAMS}, {_NEAREST} select h.name, coalesce(cache.pattern, best.pattern) as pattern from h left join cache on h.name = cache.name left join best on h.name = best.name and k = 1")
def predict_pattern(spark, sf_dir):
    """Page hosts with the first segment of a path as pattern; the cache has hosts of even length, the others are predicted."""
    seen = table(spark, sf_dir, "pages").select(P.domain(F.col("url")).alias("name"), F.regexp_extract("url", _SEGMENT, 1).alias("pattern"))
    counted = seen.filter(F.length("name") % 2 == 0).groupBy("name", "pattern").agg(F.count("*").alias("success_count"))
    first = F.row_number().over(W.partitionBy("name").orderBy(F.desc("success_count"), "pattern"))
    return similar.predicted_patterns(seen, counted.withColumn("r", first).filter("r = 1").drop("r"))


# Projections, pages, streams ----------------------------------------------------------------------------------------


@_query("csv_flatten", "select cast(o_orderkey as varchar) as id, coalesce(o_orderstatus, '') as status, case when o_totalprice > 100000 then 'true' else 'false' end as large, concat(o_orderpriority, '|', o_orderstatus) as tags from orders")
def csv_flatten(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return sinks.flat(o.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), (F.col("o_totalprice") > 100000).alias("large"), F.array("o_orderpriority", "o_orderstatus").alias("tags")))


@_query("public_projection", _obs("md5(url) as listing_id, p_name as title, l_extendedprice as price, text as description, url as listing_url, broker_id as broker_account"))
def public_projection(spark, sf_dir):
    o = observations(spark, sf_dir)
    return o.select(*KEY, F.md5("url").alias("listing_id"), F.col("p_name").alias("title"), F.col("l_extendedprice").alias("price"), F.col("text").alias("description"), F.col("url").alias("listing_url"), F.col("broker_id").alias("broker_account"))


def card_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a broker's listings as cards in a shell."""
    o = observations(spark, sf_dir)
    card = F.concat(F.lit('<div class="card"><a href="'), "url", F.lit('"><h3>Listing of '), "p_name", F.lit("</h3></a><p>"), "text", F.lit("</p></div>"))
    cards = o.groupBy((F.col("l_orderkey")).alias("page_id")).agg(F.concat_ws("", F.sort_array(F.collect_list(card))).alias("cards"))
    return cards.select("page_id", F.concat(F.lit("<html><body><main>"), "cards", F.lit("</main></body></html>")).alias("html"))


_CARDS = f"""with {OBSERVATIONS_SQL}, c as (select l_orderkey as page_id, p_name, url, text, count(*) over (partition by l_orderkey) as n,
  row_number() over (partition by l_orderkey order by concat(url, '"><h3>Listing of ', p_name, '</h3></a><p>', text)) as k from obs)"""


@_query("pattern_detect", f"{_CARDS} select page_id, 'div|children:a,p|has_link|text:medium|has_price' as signature, cast(n as int) as n, 1 as rank, round(avg(11 + length(p_name) + length(text)), 4) as mean_text from c where n >= 3 group by page_id, n")
def pattern_detect(spark, sf_dir):
    return html.patterns(card_pages(spark, sf_dir)).withColumn("mean_text", F.round("mean_text", 4))


def _amount(word: str, least: int) -> str:
    return f"case when try_cast(replace(regexp_extract(lower(text), '{word}[:\\s]*\\$?([\\d,]+)', 1), ',', '') as double) > {least} then try_cast(replace(regexp_extract(lower(text), '{word}[:\\s]*\\$?([\\d,]+)', 1), ',', '') as double) end"


_PLACE = r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*),\s*([A-Z]{2})\b"


@_query(
    "smart_extract",
    rf"""{_CARDS} select page_id, cast(3 + 4 * (k - 1) as int) as seq, concat('Listing of ', p_name) as title, url as link,
  list_max(list_transform(regexp_extract_all(text, '\$[\d,]+(?:\.\d{{2}})?'), lambda m: struct_pack(v := cast(replace(replace(m, '$', ''), ',', '') as double), m := m))).m as price_text,
  coalesce({_amount('gross sales', 10000)}, {_amount('sales', 10000)}) as revenue, {_amount('cash flow', 1000)} as cash_flow, nullif(regexp_extract(text, '{_PLACE}', 1), '') as city,
  coalesce(nullif(regexp_extract(text, '{_PLACE}', 2), ''), nullif(regexp_extract(text, '\b[A-Z]{{2}}\b', 0), '')) as state from c where n >= 3""",
)
def smart_extract(spark, sf_dir):
    t = F.col("text")
    return html.cards(card_pages(spark, sf_dir)).select("page_id", "seq", "title", "link", M.max_price_text(t).alias("price_text"), M.revenue(t).alias("revenue"), M.cash_flow(t).alias("cash_flow"), P.city(t).alias("city"), P.state(t).alias("state"))


_query("stream_ledger", "select user_id as listing_id, min(ts) as first_seen, max(ts) as last_seen, count(*) as n, max_by(value, struct_pack(ts := ts, s := event_id)) as last_value from events group by user_id")(ledger.query)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _found | listings.queries() | mechanisms.queries()


def oracle_sql() -> dict[str, str]:
    return _sql | listings.oracle_sql() | mechanisms.oracle_sql()
