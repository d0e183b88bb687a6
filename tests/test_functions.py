"""Golden values of the money dialects and other column functions, and the sources and sinks on small files."""

import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from saltmarsh.functions import money, places
from saltmarsh.operators import html
from saltmarsh.sources import sinks, tables

DIALECTS = [("$450,000", 450000, 450000, 450000.0, 450000.0), ("$1.2M", None, 1200000, 1200000.0, 1.2), ("500k", None, 500000, 500000.0, 500.0), ("1.2 million", None, 1200000, None, 1.2), ("Contact for Price", None, None, None, None), ("$100K - $200K", None, 100000, None, 100.0), ("", None, None, None, None), (None, None, None, None, None), ("-3.9", -3, 3, -3.9, 3.9), ("12d", None, 12, None, 12.0), ("inf", None, None, None, None)]


def test_money_dialects(spark):
    df = spark.createDataFrame([(t,) for t, *_ in DIALECTS], "t string")
    t = F.col("t")
    got = [tuple(r) for r in df.select("t", money.whole_price(t), money.any_price(t), money.scaled_money(t), money.first_number(t)).collect()]
    assert got == DIALECTS


def test_places(spark):
    df = spark.createDataFrame([("in Austin, TX now", " texas ", "https://www.a.com:8/x?page=9"), ("no", "zz", "http://b.org/page/12"), ("OK then", "Nowhere", "c")], "a string, b string, u string")
    got = [tuple(r) for r in df.select(places.city(F.col("a")), places.state(F.col("a")), places.normal_state(F.col("b")), places.domain(F.col("u")), places.next_page(F.col("u"))).collect()]
    assert got == [("Austin", "TX", "TX", "a.com:8", "https://www.a.com:8/x?page=10"), (None, None, "ZZ", "b.org", "http://b.org/page/13"), (None, "OK", None, None, None)]
    assert len(places.STATES) == 51 and places.STATES["NEW YORK"] == "NY"


def test_trigrams(spark):
    df = spark.createDataFrame([("abcabc",), ("ab",), ("",)], "t string")
    assert [sorted(r[0]) for r in df.select(places.trigrams(F.col("t"))).collect()] == [["abc", "bca", "cab"], [], []]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(0, 1e7), min_size=1, max_size=20))
def test_prices_survive_text(spark, values):
    values = [math.floor(v * 100) / 100 for v in values]
    df = spark.createDataFrame([(f"Asking ${v:,.2f} or less",) for v in values], "t string")
    got = [r[0] for r in df.select(money.number(F.regexp_replace(money.max_price_text(F.col("t")), "[$,]", ""))).collect()]
    assert got == [float(f"{v:.2f}") for v in values]


def test_brokers_csv(spark, tmp_path):
    (tmp_path / "b.csv").write_text("Account,CompanyName,url,leaderboard_score\n1,A,http://a,5\n2,B,,9\n3,C,http://c,7\n")
    assert [tuple(r) for r in tables.brokers_csv(spark, f"{tmp_path}/b.csv").collect()] == [("3", "C", "http://c"), ("1", "A", "http://a")]
    assert tables.brokers_csv(spark, f"{tmp_path}/b.csv", 1).count() == 1


def test_run_listings(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"run_id": "x", "brokers": [{"broker_id": "b", "broker_name": "B", "status": "success", "listings": [{"title": "t", "asking_price": 5}]}, {"broker_id": "c", "broker_name": "C", "status": "error", "listings": [{"title": "u", "asking_price": 6}]}]}')
    assert [(r.broker_id, r.title) for r in tables.run_listings(spark, f"{tmp_path}/r.json").collect()] == [("b", "t")]


def test_snapshot(spark, tmp_path):
    df = spark.createDataFrame([(1, True, None, ["a", "b"])], "id long, ok boolean, note string, tags array<string>")
    sinks.write_snapshot(df, f"{tmp_path}/s", "2026-01-01")
    back = spark.read.option("header", True).csv(f"{tmp_path}/s/latest").first()
    assert (back.id, back.ok, back.note, back.tags) == ("1", "true", None, "a|b")
    assert '"snapshot_version":"1.0.0"' in sinks.envelope(df, "now").first().value


def test_cards(spark):
    card = '<div class="c"><a href="/l/{0}"><h3>Listing number {0} here</h3></a><p>Asking $1{0},000 in a good place with many words</p></div>'
    page = "<html><body><main>" + "".join(card.format(k) for k in range(3)) + "</main></body></html>"
    few = "<html><body><main>" + "".join(card.format(k) for k in range(2)) + "</main></body></html>"
    df = spark.createDataFrame([(1, page), (2, few), (3, None), (4, "<ul><li><a href='/x'>x</a></li></ul>")], "page_id long, html string")
    rows = html.cards(df).orderBy("seq").collect()
    assert [(r.page_id, r.link, r.title) for r in rows] == [(1, f"/l/{k}", f"Listing number {k} here") for k in range(3)]


def test_price_ranges(spark):
    """The lower bound of a range, units shared or not; single prices have equal bounds, texts without a number none."""
    texts = ["$100,000 - $250,000", "90 to 120k", "$1.5M", "100,000-250K", "2m - 1m", "Asking $75K – 90K cash", "call", "", None, "5 - 5", "$ 300 , to"]
    want = [(1e5, 2.5e5), (9e4, 1.2e5), (1.5e6, 1.5e6), (1e5, 2.5e5), (1e6, 2e6), (7.5e4, 9e4), None, None, None, (5.0, 5.0), (300.0, 300.0)]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string").select("k", money.price_range(F.col("text")).alias("r")).orderBy("k").collect()
    assert [r.r and (r.r.low, r.r.high) for r in rows] == want
