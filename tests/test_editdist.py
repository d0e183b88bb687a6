"""Near texts and linked listings against brute force, with the number of pairs that met."""

import random

import pytest
from pyspark.sql import functions as F

from saltmarsh.operators import editdist, similar

LONG = "".join(random.Random(3).choices("abcdefgh", k=400))
LISTINGS = "id long, title string, state string, price double, cash_flow double"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def edited(rng, text, n):
    for _ in range(n):
        k, c = rng.randrange(len(text) + 1), rng.choice("abcdefgh é")
        text = rng.choice([text[:k] + c + text[k:], text[:k] + text[k + 1 :], text[:k] + c + text[k + 1 :]])
    return text


@pytest.mark.parametrize("least", [0.3, 0.5, 0.625, 0.8, 0.95])
def test_near_texts(spark, least):
    rng = random.Random(int(least * 1000))
    texts = [edited(rng, base, rng.randrange(9)) for base in ("".join(rng.choices("abcdefgh é", k=rng.randrange(1, 40))) for _ in range(12)) for _ in range(6)] + ["", None, "a", "ab", LONG, LONG[:-1] + "y"]
    rows = [(b, t) for t in texts for b in ("s", "t", None) if rng.random() < 0.7] + [("s", LONG), ("s", LONG[:-1] + "y")]
    table = spark.createDataFrame(rows + rows[:9], "block string, text string")
    own = {b: sorted({t for c, t in rows if c == b and t}) for b in "st"}
    near = lambda a, b: abs(len(a) - len(b)) < (1 - least) * max(len(a), len(b)) and (d := distance(a, b)) < (1 - least) * max(len(a), len(b)) - 1e-9 and d
    want = {(c, a, b, near(a, b)) for c, ts in own.items() for a in ts for b in ts if a < b and near(a, b)}
    got = [tuple(r) for r in editdist.near_texts(table, least).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    if least >= 0.5:
        pairs = sum(len(ts) * (len(ts) - 1) // 2 for ts in own.values())
        assert editdist.candidates(table, least).count() - len(want) < (0.25 if least == 0.5 else 0.1) * pairs


def test_nothing(spark):
    assert editdist.near_texts(spark.createDataFrame([], "block string, text string"), 0.6).count() == 0
    with pytest.raises(ValueError):
        editdist.near_texts(spark.createDataFrame([], "block string, text string"), 0.1)


@pytest.mark.parametrize("least", [0.6, 0.7, 0.85])
def test_all_links(spark, least):
    """Every pair of a state is compared; repeated rows, null fields and a state that holds a third of all."""
    rng = random.Random(7)
    title = lambda: None if rng.random() < 0.05 else edited(rng, rng.choice(["red bolt", "steel ring", "Corner Deli in town", ""]), rng.randrange(5))
    amount = lambda: rng.choice([None, 0.0, 100.0, 80.0, 125.0, 75.0, 1e6, rng.random() * 200])
    rows = [(k, title(), rng.choice(["A", "A", "A", "B", "C", None]), amount(), amount()) for k in range(120)]
    table = spark.createDataFrame(rows, LISTINGS)
    x, y = table.alias("x"), table.alias("y")
    score = similar.listing_score("x", "y")
    every = x.join(y, F.expr("x.state = y.state and x.id < y.id")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.round(score, 6).alias("score")).filter(F.col("score") > least)
    got = [tuple(r) for r in similar.linked_listings(table, least).collect()]
    assert len(got) == len(set(got)) and set(got) == {tuple(r) for r in every.collect()} and got


def test_too_low(spark):
    with pytest.raises(ValueError):
        similar.linked_listings(spark.createDataFrame([], LISTINGS), 0.45)
