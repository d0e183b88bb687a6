"""Normalisation, cards, vendors, rules, sources and sinks on hand-written inputs."""

import json

import pytest
from pyspark.sql import functions as F

import oracle
from saltmarsh.functions import classify, money, places, shown
from saltmarsh.operators import canonical, dom, html, rules, vendors
from saltmarsh.plans import listings
from saltmarsh.sources import sinks, tables

SF = "/root/testdata/sf0.01"
AS_OF = "2026-02-20T00:00:00Z"


@pytest.mark.parametrize("name", sorted(listings.queries()))
def test_against_sql(name, spark):
    assert oracle.same(listings.queries()[name](spark, SF), SF, listings.oracle_sql()[name]) > 0


def test_canonical_from_json(spark):
    """Missing keys take defaults, explicit nulls stay, and an infinite price rejects its listing."""
    rows = [{"source_url": "u", "broker_id": "b", "title": "t", "asking_price": "$450,000", "state": "Texas", "franchise": "yes", "employees": 12}, {"id": "x", "status": None, "vertical": None, "confidence": None, "flags": ["a"], "asking_price": 7.9, "price_hidden": True, "description": "d" * 600}, {"revenue": "Infinity"}]
    raw = canonical.from_json_lines(spark.createDataFrame([(json.dumps(r),) for r in rows], "value string"))
    good, rejected = canonical.normalised(raw, AS_OF)
    assert tuple(good.columns) == canonical.FIELDS and len(canonical.FIELDS) == 40
    a, b = sorted(good.collect(), key=lambda r: r.id == "x")
    assert (a.status, a.vertical, a.country, a.confidence, a.flags, a.asking_price, a.state, a.franchise, a.employees, a.first_seen) == ("active", "other", "US", 0.5, [], 450000, "TX", True, 12, AS_OF)
    assert a.id.startswith("dl_") and len(a.id) == 15 and a.price_hidden is False and a.seller_financing is None
    assert (b.status, b.vertical, b.confidence, b.flags, b.asking_price, b.price_hidden) == (None, None, None, ["a"], 7, True)
    assert [r.reason for r in rejected.collect()] == ["revenue is infinite"]


def test_content_hash_is_stable_and_sensitive(spark):
    import hashlib

    raw = spark.createDataFrame([("t", "5", "d" * 600), ("t", "5", "d" * 500), ("t", "6", "d" * 500)], "title string, asking_price string, description string")
    got = [r.content_hash for r in canonical.canonical(raw, AS_OF).collect()]
    assert got[0] == got[1] != got[2] and got[0] == hashlib.sha256(("t5" + "None" * 4 + "d" * 500).encode()).hexdigest()


def test_tree():
    root = dom.tree('<div class="a b"><p>one<b>two</b><br>three</div><ul><li>x<li>y</ul>')
    assert root.first("div.a").text() == "one two three" and root.first("div.a.b p b").text() == "two" and root.first("p.a") is None
    assert [n.text() for n in root.all("li")] == ["x y", "y"] and root.first("div").after().tag == "ul" and dom.tree(None).text() == ""


def page(*cards):
    return "<html><body><main>" + "".join(cards) + "</main></body></html>"


def card(k, inner="", href="/l/{0}"):
    return f'<div class="c"><a href="{href.format(k)}">go</a>{inner or f"<h3>Listing number {k} here</h3>"}<p>Asking $1{k},000 in <b>Austin</b>, with many many words in it</p></div>'


def test_gates_and_links(spark):
    pages = [
        (1, page(*(card(k) for k in range(3))), "https://a.example/x/"),
        (2, page(*(card(k) for k in range(2))), "https://a.example/"),
        (3, page(*(card(k, href="/contact/{0}") for k in range(3))), "https://a.example/"),
        (4, page(*(f'<a href="/l/{k}"><div>words {"enough " * 10}</div></a>' for k in range(3))), "https://a.example/"),
        (5, page(*(f'<div><p>unclosed <a href="x{k}">link</a> and {"more words " * 6}</div>' for k in range(3))), "https://a.example/d/"),
        (6, "<ul><li><a href='/x'>x</a></li></ul>" * 3, None), (7, None, None), (8, "", None), (9, page(*(card(k) for k in (0, 0, 0))), None),
    ]
    found = html.cards(spark.createDataFrame(pages, "page_id long, html string, url string"))
    rows = html.fields(found).orderBy("page_id", "seq").collect()
    assert [(r.page_id, r.link) for r in rows] == [(1, f"https://a.example/l/{k}") for k in range(3)] + [(5, f"https://a.example/d/x{k}") for k in range(3)] + [(9, "/l/0")] * 3
    assert rows[0].text == "go Listing number 0 here Asking $10,000 in Austin , with many many words in it" and rows[0].title == "Listing number 0 here" and rows[0].price == 10000


def test_title_order(spark):
    inner = ["<h4>A heading of level four</h4><h2>short</h2>", "<b>Bold words of a text</b><h6>Level six is before bold</h6>", "<h1>no</h1>", ""]
    pages = [(k, page(*(card(j, x) for j in range(3)))) for k, x in enumerate(inner)]
    titles = {r.page_id: r.title for r in html.cards(spark.createDataFrame(pages, "page_id long, html string")).filter("link = '/l/1'").collect()}
    assert titles[0] == "A heading of level four" and titles[1] == "Level six is before bold" and titles[2].startswith("go no Asking $11,000")


def test_ties_go_to_the_first_pattern(spark):
    other = lambda k: f'<section><a href="/s/{k}">go</a><p>another kind of card with enough of words in it, and more</p></section>'
    pages = [(1, page(other(0), card(0), card(1), card(2), other(1), other(2)))]
    got = [(r.signature, r.n, r.rank) for r in html.patterns(spark.createDataFrame(pages, "page_id long, html string")).collect()]
    assert [g[1:] for g in got] == [(3, 1), (3, 2)] and got[0][0].startswith("section|")


def test_known_patterns(spark):
    pages = spark.createDataFrame([(1, "https://www.abcdeh.com/x", ""), (2, "https://own.net/y", ""), (3, None, "")], "page_id long, url string, html string")
    cache = spark.createDataFrame([("abcdef.com", "x", 1), ("abcdeg.com", "y", 9), ("own.net", "z", 2)], "name string, pattern string, success_count long")
    got = {r.page_id: (r.cached, r.predicted) for r in html.with_known_patterns(pages, cache).collect()}
    assert got == {1: (None, ["y", "x"]), 2: ("z", None), 3: (None, None)}


def test_vendor_errors_are_isolated(spark):
    ok = '<div class="single-listing"><a href="/business-opportunity/1">x</a><h3>Shop</h3></div>' * 2
    pages = spark.createDataFrame([(1, "hedgestone", ok), (2, "nobody", ok), (3, "hedgestone", None)], "page_id long, vendor string, html string")
    found = vendors.cards(pages)
    assert [(r.page_id, r.error) for r in found.filter("error is not null").collect()] == [(2, "KeyError: 'nobody'")]
    assert sorted((r.broker_id, r.status, r.listings_count) for r in vendors.results(found).collect()) == [("hedgestone", "success", 2), ("nobody", "error", 0)]
    rows = vendors.listings(found).collect()
    assert [(r.page_id, r.seq, r.title, r.listing_url) for r in rows] == [(1, 0, "Shop", "https://www.hedgestone.com/business-opportunity/1")]


def test_second_feed(spark):
    items = [{"BusinessListingID": 5, "BusinessName": "B", "ListingPrice": 1234567, "GrossSales": 0, "TotalIncome": 9, "BusinessLocation": "Ohio", "ListingUrl": "/x"}, {"BusinessListingID": 5, "BusinessName": "again"}, {"BusinessListingID": 6}, {"BusinessName": "no key"}]
    df = spark.createDataFrame([(k, json.dumps(i)) for k, i in enumerate(items)], "n long, value string")
    rows = {r.listing_url: r for r in vendors.from_items(df, "fcbb", ("n",)).collect()}
    assert set(rows) == {"https://fcbb.com/x", "https://fcbb.com/listing/6"}
    r = rows["https://fcbb.com/x"]
    assert (r.title, r.price, r.price_text, r.revenue, r.cash_flow, r.city, r.state) == ("B", 1234567.0, "$1,234,567", None, 9.0, None, "Ohio")


def test_presence(spark):
    """A failed run removes nothing; gone and back again gives both events."""
    runs = [("b", n, n != 3) for n in range(1, 7)] + [("c", 1, True)]
    rows = [("x", "b", n) for n in (1, 2, 4)] + [("y", "b", n) for n in (1, 2, 5, 6)] + [("z", "b", 1), ("w", "c", 1), ("v", "b", 6)]
    got = rules.presence(spark.createDataFrame(rows, "listing_id string, broker_id string, snapshot_no int"), spark.createDataFrame(runs, "broker_id string, snapshot_no int, ok boolean"))
    assert sorted(tuple(r) for r in got.collect()) == [("x", 5, "removed"), ("y", 4, "removed"), ("y", 5, "relisted"), ("z", 2, "removed")]


def test_drop_by_exactly_half_is_none(spark):
    rows = spark.createDataFrame([("a", 1, 100.0), ("a", 2, 50.0), ("a", 3, 49.0), ("b", 1, None), ("b", 2, 1.0)], "id string, n int, price double")
    got = {(r.id, r.n): r.d for r in rows.withColumn("d", rules.price_dropped("id", ("n",), "price")).collect()}
    assert got == {("a", 1): False, ("a", 2): False, ("a", 3): True, ("b", 1): False, ("b", 2): False}


def test_shown(spark):
    df = spark.createDataFrame([(None,), (0,), (950,), (1500,), (2499,), (1250000,), (12345678,)], "p long")
    assert [r[0] for r in df.select(shown.shown_price(F.col("p"))).collect()] == ["—", "—", "$950", "$2K", "$2K", "$1.3M", "$12.3M"]


def test_failures(spark):
    df = spark.createDataFrame([(403, None, None), (None, "read TIMEOUT", ""), (None, "odd", ""), (None, None, "small"), (200, "no pattern", "captcha")], "s int, e string, h string")
    got = [tuple(r[0]) for r in df.select(classify.failure(F.col("s"), F.col("e"), F.col("h"))).collect()]
    assert [g[0] for g in got] == ["HTTP_403", "TIMEOUT", "UNKNOWN", "JAVASCRIPT_HEAVY", "CAPTCHA"] and got[2][1] == "Unknown: odd"


def test_sources(spark, tmp_path):
    (tmp_path / "b.csv").write_text("account,companyname,url,activeListingsCount\n1,A,http://a,5\n2,,http://b,9\n3,C,,7\n\n")
    assert [tuple(r) for r in tables.plain_brokers_csv(spark, f"{tmp_path}/b.csv").collect()] == [("2", "Unknown", "http://b", 9), ("1", "A", "http://a", 5)]
    assert tables.count_lines(spark, f"{tmp_path}/b.csv").first().brokers == 3
    with pytest.raises(ValueError):
        (tmp_path / "n.csv").write_text("listing_url\nx\n")
        tables.plain_brokers_csv(spark, f"{tmp_path}/n.csv")
    (tmp_path / "w.json").write_text('{"listings": [{"a": 1}, {"a": 2}]}')
    (tmp_path / "f.json").write_text('[{"a": 1}, {"a": 2}, {"a": 3}]')
    assert [tables.json_listings(spark, f"{tmp_path}/{n}.json").count() for n in "wf"] == [2, 3]
    (tmp_path / "p.json").write_text('{"a.com": {"pattern": "x", "success_count": 2, "total_listings": 9}}')
    assert [(r.name, r.pattern, r.success_count) for r in tables.pattern_cache(spark, f"{tmp_path}/p.json").collect()] == [("a.com", "x", 2)]
    (tmp_path / "q.json").write_text("not json")
    assert tables.pattern_cache(spark, f"{tmp_path}/q.json").collect() == []
    pages = spark.createDataFrame([("http://a/i", '<a href="/buy-a-business/1">x</a><a class="k" href="buy-a-business/2">'), ("http://a/j", '<a href="/buy-a-business/1"><a href="/other">')], "url string, html string")
    assert sorted(r.url for r in tables.listing_links(pages).collect()) == ["http://a/buy-a-business/1"]
    brokers = spark.createDataFrame([("1", "A", "u", 2.0), ("2", "B", "", 9.0), (None, "C", "u", 9.0), ("4", "D", "u", None)], "account string, name string, url string, leaderboard_score double")
    assert [r.account for r in tables.stored_brokers(brokers).collect()] == ["1", "4"] and tables.stored_brokers(brokers, 1).count() == 1


def test_downloaded_file(spark, tmp_path):
    (tmp_path / "d.csv").write_text("Business Name,Asking,City\nDeli,$5k,\"Austin, TX\"\n,,\nHome with 3 bed 2 bath,$9,x\n")
    rows = tables.downloaded_listings(spark, f"{tmp_path}/d.csv", "http://f/d.csv").collect()
    assert [(r.title, r.price, r.city, r.state, r.url) for r in rows] == [("Deli", 5000.0, "Austin", "TX", "http://f/d.csv#row0")]
    assert rows[0].description == "Business Name: Deli | Asking: $5k | City: Austin, TX"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("1", "t", 5.0, None), ("2", None, 0.0, 3.0)], "id string, title string, asking_price double, revenue double").withColumn("cash_flow", F.lit(None).cast("double"))
    sinks.write_normalised(df, f"{tmp_path}/n", AS_OF, "run")
    assert spark.read.json(f"{tmp_path}/n/metadata").first().asDict() == {"normalized_at": AS_OF, "source_run_id": "run", "listings_count": 2}
    sinks.write_snapshot_json(df, f"{tmp_path}/s", AS_OF, {"note": "x"})
    assert spark.read.json(f"{tmp_path}/s/metadata").first().note == "x" and spark.read.json(f"{tmp_path}/s/listings").count() == 2
    sinks.write_daily(df, f"{tmp_path}/d", "2026-01-01")
    assert spark.read.option("header", True).csv(f"{tmp_path}/d/daily/2026-01-01/csv").columns == df.columns
    results = spark.createDataFrame([("success",), ("error",), ("success",)], "status string")
    failures = spark.createDataFrame([("TIMEOUT",)], "failure_type string")
    for k in (1, 2):
        sinks.write_run(df, results, failures, f"{tmp_path}/r", f"run{k}")
    summary = spark.read.json(f"{tmp_path}/r/summary").first()
    assert (summary.brokers_attempted, summary.brokers_failed, summary.success_rate, summary.with_price, summary.with_revenue) == (3, 1, 66.7, 1, 1)
    assert spark.read.json(f"{tmp_path}/r/failures").count() == 2 and spark.read.option("header", True).csv(f"{tmp_path}/r/run1/csv").columns == ["id", "title", "asking_price", "revenue", "cash_flow"]
    sinks.append(df, f"{tmp_path}/log")
    sinks.append(df, f"{tmp_path}/log")
    assert spark.read.parquet(f"{tmp_path}/log").count() == 4
    run = spark.createDataFrame([("b", "success")], "broker_id string, status string").withColumn("at", F.lit("2026-01-01").cast("timestamp_ntz"))
    sinks.write_results(run, f"{tmp_path}/results")
    assert spark.read.json(f"{tmp_path}/results").first()["at"].startswith("2026-01-01T00:00:00")


def test_vocabularies():
    assert list(classify.FIRST_MATCH)[:3] == ["cleaning", "laundromat", "vending"] and len(classify.FIRST_MATCH) == len(classify.RICH) == 17 and len(classify.SHORT) == 10
    assert len(set(classify.HINTS)) == 46 and sum(map(len, classify.SCORED.values())) == 51 and len(places.STATES) == 51


def test_money_guard(spark):
    df = spark.createDataFrame([("Gross sales: $50,000 and revenue $5",), ("revenue $20,000",), ("nothing",)], "t string")
    assert [tuple(r) for r in df.select(money.revenue(F.col("t")), money.cash_flow(F.col("t"))).collect()] == [(50000.0, None), (20000.0, None), (None, None)]


def test_stream_keeps_changes_and_merges(spark, tmp_path, monkeypatch):
    """Two runs over files that come one by one, with merged tables in between, give what one batch over all gives."""
    import random

    from saltmarsh.streaming import ledger

    monkeypatch.setattr(ledger, "COMPACT", 3)
    rng = random.Random(4)
    rows = [(k, f"2026-01-{1 + k // 10:02d} 00:00:{k % 10:02d}", rng.randrange(6), "view", float(rng.randrange(3)), "{}") for k in range(80)]
    frame = lambda part: spark.createDataFrame(part, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1)
    for n in range(5):
        frame(rows[10 * n : 10 * n + 10]).write.parquet(f"{tmp_path}/in/f{n}")
    ledger.run(spark, f"{tmp_path}/in/*", f"{tmp_path}/to", 1)
    for n in range(5, 8):
        frame(rows[10 * n : 10 * n + 10]).write.parquet(f"{tmp_path}/in/f{n}")
    got = ledger.run(spark, f"{tmp_path}/in/*", f"{tmp_path}/to", 1).drop("mark")
    whole = ledger.fold(frame(rows).select(F.col("user_id").alias("listing_id"), "ts", F.col("event_id").alias("seq"), "value")).drop("mark")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect()))
    changes = spark.read.parquet(f"{tmp_path}/to/changes").orderBy("ts").collect()
    last = {}
    for r in changes:
        assert last.get(r.listing_id) == r.old_value and r.old_value != r.new_value
        last[r.listing_id] = r.new_value
    assert last == {r.listing_id: r.last_value for r in got.collect()}


def test_median(spark):
    import statistics

    from saltmarsh.operators import stats

    for n in (0, 1, 2, 7, 1000, 1001):
        values = [float((k * 7919) % 613) for k in range(n)]
        df = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
        assert stats.median(df, "v") == (statistics.median(values) if values else None)
    assert abs(stats.median(df, "v", 0.05) - 306) < 60
