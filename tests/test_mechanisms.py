"""Page loops and status machines against loops in plain Python, and every query of the module against its SQL."""

import datetime
import random

import oracle
import pytest
from pyspark.sql import functions as F

from saltmarsh.functions import classify
from saltmarsh.operators import far, groups, intervals, keywords, paging, rules, sketches, states
from saltmarsh.plans import mechanisms
from saltmarsh.sources import sinks, tables

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(mechanisms.oracle_sql()))
def test_against_sql(name, spark):
    assert oracle.same(mechanisms.queries()[name](spark, SF), SF, mechanisms.oracle_sql()[name]) > 0


# Page loops ---------------------------------------------------------------------------------------------------------


def looped(pages, start, most, most_empty, listings=None, most_stale=None):
    """The loop as it is written: url -> (next, found)."""
    url, seen, taken, empty, stale, known, why = start, set(), [], 0, 0, set(), None
    while len(taken) < most:
        if url in seen:
            return taken, "visited"
        seen.add(url)
        if url not in pages:
            return taken, "missing"
        following, found = pages[url]
        if found is None:
            return taken, "no pattern"
        empty = empty + 1 if found == 0 else 0
        if most_empty and empty >= most_empty:
            return taken, "empty"
        new = set(listings.get(url, ())) - known if listings is not None else set()
        stale = stale + 1 if not new else 0
        if most_stale and stale >= most_stale:
            return taken, "nothing new"
        known |= new
        taken.append(url)
        if following is None and len(taken) < most:
            return taken, "last"
        url = following
    return taken, "limit"


def random_site(rng, n):
    """Chains that merge, end, leave the stored pages and close to cycles."""
    pages = {}
    for k in range(n):
        way = rng.random()
        to = f"p{k + 1}" if way < 0.93 else f"p{rng.randrange(n)}" if way < 0.97 else None if way < 0.99 else f"gone{k}"
        pages[f"p{k}"] = (to, None if rng.random() < 0.004 else rng.choice([0, 1, 2, 3]))
    return pages


@pytest.mark.parametrize("seed,most", [(1, 100), (2, 20), (3, 1)])
def test_page_loops(seed, most, spark):
    rng = random.Random(seed)
    pages = random_site(rng, 400) | {f"long{k}": (f"long{k + 1}", 1) for k in range(300)} | {f"ring{k}": (f"ring{(k + 1) % 7}", 1) for k in range(7)} | {"self": ("self", 2)}
    listings = {u: [f"l{rng.randrange(60)}" for _ in range(found or 0)] for u, (_, found) in pages.items()}
    starts = [*rng.sample([f"p{k}" for k in range(400)], 30), "long0", "long250", "ring3", "self", "unknown"]
    df = spark.createDataFrame([(u, *x) for u, x in pages.items()], "url string, next string, found long")
    first = spark.createDataFrame([(s,) for s in starts], "url string")
    shown = spark.createDataFrame([(u, x) for u, own in listings.items() for x in own], "url string, listing string")
    for more, stale in ((None, None), (shown, 5), (shown, 1)):
        got = {}
        for r in paging.paged(df, first, most, listings=more, most_stale=stale).orderBy("start", "page_no").collect():
            got.setdefault(r.start, []).append(r.url)
        want = {s: looped(pages, s, most, 3, listings if more is not None else None, stale) for s in starts}
        assert got == {s: taken for s, (taken, _) in want.items() if taken}
    rows = paging.marked(paging.walk(df, first, most), df)
    ended = {r.start: (r.pages, r.why) for r in paging.ends(rows, most).collect()}
    want = {s: looped(pages, s, most, 3) for s in starts}
    assert ended == {s: (len(taken), why) for s, (taken, why) in want.items()}


def test_next_urls(spark):
    rows = [
        ("http://a.b/x/list?page=3", '<a href="/one">1</a> <a class="btn next" href="?page=9">go</a>', "http://a.b/x/list?page=9"),
        ("http://a.b/x", '<a rel="next" href="two">2</a>', "http://a.b/two"),
        ("http://a.b/x", "<a href='/p3'>NEXT &raquo;</a>", "http://a.b/p3"),
        ("http://a.b/x", '<a href="/p4">&gt;</a>', "http://a.b/p4"),
        ("http://a.b/x", '<a class="next">no link</a><a rel=next href=/p5>5</a>', "http://a.b/p5"),
        ("http://a.b/x/page/7/", '<a href="/other">other</a>', "http://a.b/x/page/8/"),
        ("http://a.b/x?page=09", None, "http://a.b/x?page=10"),
        ("http://a.b/x", "<p>next</p>", None),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "url string, html string").coalesce(1)
    assert [r.n for r in df.select(paging.next_url(F.col("url"), F.col("html")).alias("n")).collect()] == [r[2] for r in rows]


# Status machines ----------------------------------------------------------------------------------------------------


def machine(history):
    out, state = [], None
    for at, status in history:
        if status not in states.STATES:
            out.append((at, status, state, state, "unknown"))
            continue
        kind = "first" if state is None else "same" if state == status else "legal" if (state, status) in rules.LEGAL else "illegal"
        new = state if kind == "illegal" else status
        out.append((at, status, state, new, kind))
        state = new
    return out


@pytest.mark.parametrize("span", [1, 3, 1000])
def test_machines(span, spark):
    rng = random.Random(span)
    rows = [("hot" if rng.random() < 0.4 else f"l{rng.randrange(20)}", k, rng.choice([*states.STATES, "active", "removed", None, "odd"])) for k in range(900)]
    want = sorted(((key, *x) for key in {r[0] for r in rows} for x in machine([(k, s) for i, k, s in rows if i == key])), key=repr)
    df = spark.createDataFrame(rows, "id string, at long, status string").repartition(3)
    for period in (None, F.floor(F.col("at") / 100)):
        got = states.histories(df, "id", ("at",), "status", period, span)
        assert sorted((tuple(r) for r in got.select("id", "at", "status", "from_status", "state", "kind").collect()), key=repr) == want
    good, bad = states.split(got)
    assert good.count() + bad.count() == len(rows) and bad.count() == sum(x[-1] in ("illegal", "unknown") for x in want)
    assert states.histories(df.limit(0), "id", ("at",), "status").collect() == []


# Groups, intervals, buckets -----------------------------------------------------------------------------------------


def test_components(spark):
    rng = random.Random(8)
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(35)] + [(5, 5), (300, 299), (299, 300)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    want = {x: find(x) for x in root if any(find(a) == find(x) and a != b for a, b in edges)}
    got = groups.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len(want) and {r.id: r.group for r in got} == want
    assert groups.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_as_of(spark):
    rng = random.Random(5)
    day = lambda k: datetime.datetime(2020, 1, 1) + datetime.timedelta(days=k)
    rows = [(rng.randrange(8), day(rng.choice([rng.randrange(2000), 5, 6])), k) for k in range(120)]
    asked = [(day(k).date(),) for k in (-1, 0, 5, 6, 7, 100, 1999, 5000, 60_000)] + [(r[1].date(),) for r in rows[:10]]
    held = intervals.validity(spark.createDataFrame(rows, "id long, at timestamp, seq long"), "id", "at", ("seq",))
    got = sorted((r.date, r.id, r.seq) for r in intervals.as_of(held, spark.createDataFrame(asked, "date date")).collect())
    want = []
    for (d,) in set(asked):
        for key in range(8):
            before = [(at, seq) for k, at, seq in rows if k == key and at.date() <= d]
            want += [(d, key, max(before)[1])] if before else []
    assert got == sorted(want)


def test_upsert_of_buckets(spark, tmp_path):
    folder = f"file://{tmp_path}/table"
    files = lambda: {p: p.stat().st_mtime_ns for p in tmp_path.glob("table/*/*.parquet")}
    rows = lambda *x: spark.createDataFrame(list(x), "id long, at long, v string")
    table = lambda: sorted((r.id, r["at"], r.v) for r in spark.read.schema("id long, at long, v string, bucket int").parquet(folder).collect())
    first = rows(*((k, 1, f"a{k}") for k in range(40)), (3, 2, "later"), (3, 0, "earlier"))
    last = F.col("at").desc()
    sinks.upsert_buckets(first, folder, "id", last, 8)
    want = {k: (k, 1, f"a{k}") for k in range(40)} | {3: (3, 2, "later")}
    assert table() == sorted(want.values())
    before = files()
    assert sinks.upsert_buckets(first, folder, "id", last, 8) == [] and files() == before
    second = rows((7, 5, None), (99, 5, "new"))
    touched = sinks.upsert_buckets(second, folder, "id", last, 8)
    assert 1 <= len(touched) <= 2 and table() == sorted((want | {7: (7, 5, None), 99: (99, 5, "new")}).values(), key=lambda r: r[:2])
    stayed = {p for p in before if p.parent.name not in {f"bucket={b}" for b in touched}}
    assert stayed and all(files()[p] == before[p] for p in stayed)
    assert sinks.upsert_buckets(second, folder, "id", last, 8) == []


# Vocabularies, row numbers ------------------------------------------------------------------------------------------


def test_keywords(spark):
    rng = random.Random(12)
    some = lambda: "".join(rng.choice("abcé ") for _ in range(rng.randrange(1, 7)))
    classes = {f"c{k}": [some() for _ in range(40)] for k in range(20)} | classify.SCORED | {"short": ["a", "é ", ""]}
    texts = [(k, rng.choice(["", "Lawn Care ", "HVAC and vending "]) + "".join(rng.choice("ABCÉabcé ") for _ in range(rng.randrange(0, 300)))) for k in range(60)] + [(100, None), (101, "")]
    words = keywords.vocabulary(spark, classes)
    df = spark.createDataFrame(texts, "id long, text string")
    found = keywords.hits(df, words, "id", "text")
    got = sorted((r.id, r["class"], r.keyword) for r in found.collect())
    assert got == sorted((k, name, w.lower()) for k, t in texts if t for name, own in classes.items() for w in dict.fromkeys(own) if w and w.lower() in t.lower())
    scored = keywords.hits(df, keywords.vocabulary(spark, classify.SCORED), "id", "text")
    plain = {r.id: r.v for r in df.select("id", classify.best_score(F.col("text")).alias("v")).collect() if r.v}
    assert {r.id: r["class"] for r in keywords.best(scored, "id").collect()} == plain
    kinds = keywords.hits(df, keywords.vocabulary(spark, classify.BUSINESS), "id", "text")
    plain = {r.id: r.v for r in df.select("id", classify.first_match(F.col("text"), classify.BUSINESS, None).alias("v")).collect() if r.v}
    assert {r.id: r["class"] for r in keywords.first(kinds, "id").collect()} == plain
    assert keywords.hits(df, words.limit(0), "id", "text").collect() == []


def test_row_numbers(spark):
    df = spark.range(0, 1000, 1, 7).filter("id % 3 = 1")
    assert [r.n for r in tables.numbered(df, "n").orderBy("id").collect()] == list(range(333))


def test_sketches_merge(spark):
    """Any grouping of days gives what the whole gives, within the bounds; nulls are in no sketch."""
    rng = random.Random(3)
    rows = [(datetime.datetime(2026, 1, 1 + k % 20), rng.choice([None, *range(3000)]), rng.choice([None, rng.uniform(0, 1000)])) for k in range(20_000)]
    df = spark.createDataFrame(rows, "at timestamp, id long, v double")
    days = sketches.daily(df, "at", "id", "v")
    assert days.count() == 20
    ids, values = len({r[1] for r in rows} - {None}), sorted(r[2] for r in rows if r[2] is not None)
    once = sketches.merged(days, F.lit("all"))
    halves = sketches.merged(days, F.dayofmonth("day") % 2)
    twice = sketches.merged(halves.withColumnRenamed("period", "half"), F.lit("all"))
    for whole in (once, twice):
        r = whole.select("n", sketches.distinct().alias("ids"), *(sketches.quantile(q).alias(f"q{k}") for k, q in enumerate((0.1, 0.5, 0.9)))).first()
        assert r.n == len(rows) and abs(r.ids - ids) <= sketches.DISTINCT_ERROR * ids
        for x, q in ((r.q0, 0.1), (r.q1, 0.5), (r.q2, 0.9)):
            assert abs(sum(v <= x for v in values) / len(values) - q) <= sketches.RANK_ERROR


def test_far_pages(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice([None, *range(40)])) for k in range(1003)]
    df = spark.createDataFrame(rows, "id long, v long")
    found = far.ranged(df, ("v", "id"), 16)
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    assert found.total == 1003 and max(found.counts) < 300
    for page in (1, 2, 7, 20, 21, 22):
        assert [tuple(r) for r in found.page(page).collect()] == want[50 * (page - 1) : 50 * page]
        held, _ = found.ranges_of(page, 50)
        assert sum(found.counts[k] for k in held) <= 400  # rows that are read
    assert far.ranged(df.limit(0), ("v", "id"), 4).page(1).collect() == []
