"""Queries on rows that the given tables don't hold, each written to a folder of its own and compared with the query's SQL."""

import random
import re
import time

import oracle
import pytest
from pyspark.sql import functions as F

from saltmarsh.functions import classify
from saltmarsh.operators import cells, editdist, groups, keywords, rules, similar
from saltmarsh.plans import catalog

PART = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"


def against_sql(spark, folder, name, **tables):
    for table, rows in tables.items():
        rows.toPandas().to_parquet(f"{folder}/{table}.parquet")
    return oracle.same(catalog.queries()[name](spark, str(folder)), str(folder), catalog.oracle_sql()[name])


def test_feed_price_of_zero(spark, tmp_path):
    """An item whose prices are both 0 keeps the price 0, as the query's SQL has it."""
    rows = [(0, "hot bolt", "Brand#1", "SMALL", 5, 900.0), (1, "hot bolt", "Brand#1", "SMALL", 10, 900.1), (2, "", "Brand#1", "LARGE", 7, 900.2), (4, "red nut", "Brand#1", "LARGE", 6, 900.4)]
    assert against_sql(spark, tmp_path, "feed_listings", part=spark.createDataFrame(rows, PART)) == 4


def listings(spark, kind, n):
    """Listings whose amounts repeat, lie on bounds, or are dense and go over many bands."""
    rng = random.Random(n)
    titles = ["red bolt", "red bold", "hot bolt", "red rod", "steel ring", "steel rings", "", None]
    amount = {
        "bounds": lambda: rng.choice([None, 0.0, -5.0, 64.0, 80.0, 100.0, 125.0, 75.0, 56.25, 133.33, 1e6]),
        "dense": lambda: 10 * 1.2 ** (8 * rng.random()),
        "spread": lambda: 10 * 1.2 ** (60 * rng.random()),
    }[kind]
    rows = [(k, rng.choice(["x", "y", "y", None]), rng.choice(titles), rng.choice(["A", "A", "B", None]), amount(), amount()) for k in range(n)]
    return spark.createDataFrame(rows + [(n + k, *r[1:]) for k, r in enumerate(rows[: n // 10])], "id long, broker string, title string, state string, price double, cash_flow double")


def linked(table, least):
    """All pairs, scored one by one."""
    x, y = table.alias("x"), table.alias("y")
    score = F.round(similar.listing_score("x", "y"), 6)
    return x.join(y, F.expr("x.state = y.state and x.id < y.id")).filter(score > least).select("x.id", "y.id", "x.broker", "y.broker").collect()


@pytest.mark.parametrize(("kind", "n", "least"), [("bounds", 300, 0.8), ("bounds", 300, 0.85), ("dense", 250, 0.85), ("spread", 400, 0.85), ("spread", 400, 0.95)])
def test_counted_and_grouped_without_pairs(spark, monkeypatch, kind, n, least):
    """Neither query makes the pairs of listings, and both agree with all of them."""
    table = listings(spark, kind, n).cache()
    pairs, rows = linked(table, least), table.collect()

    def never(*_, **__):
        raise AssertionError("pairs of listings were made")

    for module in (groups, rules):
        monkeypatch.setattr(module, "linked_listings", never)
    counted = dict.fromkeys((r.id for r in rows), 0)
    top = {r.id: r.id for r in rows}

    def find(k):
        while top[k] != k:
            k = top[k]
        return k

    first = {}
    for r in rows:
        rep = first.setdefault((r.title, r.state, r.price, r.cash_flow), r.id)
        top[r.id] = find(rep)
    for a, b, x, y in pairs:
        if x is not None and y is not None and x != y:
            counted[a], counted[b] = counted[a] + 1, counted[b] + 1
        low, high = sorted((find(a), find(b)))
        top[high] = low
    got = rules.suspected_duplicates(table, least).collect()
    assert {r.id: r.twins for r in got} == {k: n for k, n in counted.items() if n} and len(got) == len({r.id for r in got}) > 0
    sizes = {}
    for r in rows:
        sizes[find(r.id)] = sizes.get(find(r.id), 0) + 1
    want = {(r.id, first[r.title, r.state, r.price, r.cash_flow], find(r.id), sizes[find(r.id)]) for r in rows if sizes[find(r.id)] > 1}
    found = [tuple(r) for r in groups.duplicate_groups(table.drop("broker"), least).select("id", "rep", "group", "size").collect()]
    assert len(found) == len(want) and set(found) == want


def test_cells_stand_for_any_number_of_rows(spark):
    """Ten times the rows make no more cells, nor links between them."""
    def made(n):
        table = spark.range(n).selectExpr("id", "concat('shop ', id % 7) as title", "'A' as state", "900e0 + id % 1000 / 10e0 as price", "cast(id % 50 + 1 as double) as cash_flow")
        own = cells.cells(table)
        return own.count(), cells.links(table, own, 0.85).count()

    assert made(20_000) == made(200_000)


@pytest.mark.parametrize("few", [0, 500])
def test_keywords_of_a_long_text(spark, monkeypatch, few):
    """Time goes with a text's length, by searches as by grams: walks to each character from the begin took minutes here."""
    monkeypatch.setattr(keywords, "FEW", few)
    texts = spark.createDataFrame([(1, "é𝄞x " * 150_000 + "Lawn Care"), (2, "\n" * 9 + "HVAC"), (3, None), (4, "")], "id long, text string")
    began = time.monotonic()
    found = keywords.hits(texts, keywords.vocabulary(spark, classify.SCORED | {"odd": ["𝄞x é", "\n\n", "x"]}), "id", "text").collect()
    assert time.monotonic() - began < 60
    low = {1: "é𝄞x lawn care", 2: "\n\nhvac"}
    assert {(1, "lawn care"), (1, "x"), (2, "hvac"), (2, "\n\n")} <= {(r.id, r.keyword) for r in found} and all(r.keyword in low[r.id] or r.keyword == "𝄞x é" for r in found)


def test_near_texts_meet_by_place(spark):
    """Texts meet by piece and place, and are compared before pairs are shuffled."""
    rows = spark.createDataFrame([("s", "abcdefghijklmno"), ("s", "abcdefghijklmnp"), ("s", "xxxxxxxxxxxxxxx")], "block string, text string")
    found = editdist.near_texts(rows, 0.8)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Join Inner, .*here#\d+ = here#\d+", plan) and plan.index("Aggregate") < plan.index("levenshtein")
    assert [tuple(r) for r in found.collect()] == [("s", "abcdefghijklmno", "abcdefghijklmnp", 1)]


def test_links_stay_out_of_the_driver(spark):
    """No side of a join of links is broadcast, and titles are compared after all else."""
    table = spark.createDataFrame([(1, "red bolt", "A", 100.0, 10.0), (2, "red bolt", "A", 110.0, 11.0)], "id long, title string, state string, price double, cash_flow double")
    found = similar.linked_listings(table)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and plan.count("SortMergeJoin") >= 3
    assert [tuple(r) for r in found.collect()] == [(1, 2, 1.0)]
    joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line]
    assert len(joins) == 3 and all(line.index("levenshtein") > line.index(" < ") for line in joins)
