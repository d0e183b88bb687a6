"""Links of whole listings, and patterns predicted from similar domains, on rows written by hand."""

import oracle
import pytest
from saltmarsh.operators import similar
from saltmarsh.plans import catalog

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["similar_listings", "predict_pattern"])
def test_against_sql(name, spark):
    assert oracle.same(catalog.queries()[name](spark, SF), SF, catalog.oracle_sql()[name]) > 0


def test_every_part_can_be_linked(spark):
    parts = spark.read.parquet(f"{SF}/part.parquet").count()
    rows = catalog.queries()["similar_listings"](spark, SF).collect()
    assert len({i for r in rows for i in (r.a, r.b)}) > 0.9 * parts


def test_links(spark):
    rows = [(1, "red bolt", "A", 100.0, 10.0), (2, "red bolt", "A", 100.0, 99.0), (3, "red bolt", "A", 500.0, 10.0), (4, "red bolt", "B", 100.0, 10.0), (5, "xyzuvwpq", "A", 80.0, 7.5), (6, "red bolt", "A", 125.0, None), (7, "red bolt", "A", 0.0, 0.0), (8, "red nut", "A", 0.0, 0.0)]
    got = {(r.a, r.b) for r in similar.linked_listings(spark.createDataFrame(rows, "id long, title string, state string, price double, cash_flow double")).collect()}
    assert got == {(1, 2), (1, 3), (1, 6), (2, 6), (7, 8)}


def test_vote(spark):
    cache = spark.createDataFrame([("abcdef.com", "x", 1), ("abcdeg.com", "y", 9), ("own.net", "z", 2)], "name string, pattern string, success_count long")
    available = spark.createDataFrame([("abcdeh.com", "x"), ("abcdeh.com", "y"), ("abcdei.com", "x"), ("own.net", "x"), ("qqq.org", "x")], "name string, pattern string")
    got = {r.name: r.pattern for r in similar.predicted_patterns(available, cache).collect()}
    assert got == {"abcdeh.com": "y", "abcdei.com": "x", "own.net": "z", "qqq.org": None}
