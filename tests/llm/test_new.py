"""Source divergence, line quality and limb codes against brute force, SQL, direct solutions and held-out accuracy; ranks against a direct solve."""

import os
import random
import sys
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from test_ops import SF, odd_texts

from saltmarsh.llm import divergence, limbcodes, linecrf, urlrank

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
import oracle  # noqa: E402

WIDE = "/root/testdata/sf0.01"


def terms(text):
    import re

    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(brute.LOWER))


def audited(rows, least, ranks=10):
    """A plain version over (lang, source, text)."""
    rows = [((a or ""), (b or ""), terms(t)) for a, b, t in rows]
    out, df = [], defaultdict(Counter)
    for lang, _, w in rows:
        df[lang].update(set(w))
    for lang in {r[0] for r in rows}:
        kept = {t for t, n in df[lang].items() if n >= least}
        counts = defaultdict(Counter)
        for a, source, w in rows:
            if a == lang:
                counts[source].update(t for t in w if t in kept)
        every = sum(counts.values(), Counter())
        share = lambda c, n: 1 + 10**9 * (c + 2) // (n + 2 * len(kept))
        f = lambda p, q: (p - q) ** 2 // (p + q)
        n_all = sum(every.values())
        for source, own in counts.items():
            n = sum(own.values())
            pairs = [(-sum(f(share(own[t], n), share(other[t], sum(other.values()))) for t in kept), name.encode()) for name, other in counts.items() if name != source]
            tops = [(-f(p, q), t.encode()) for t in kept if own[t] and (p := share(own[t], n)) > (q := share(every[t], n_all))]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(tops)[:ranks])):
                out += [(lang, source, part, item.decode(), -value, k + 1) for k, (value, item) in enumerate(found)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("module", [divergence, limbcodes])
def test_against_sql(module, spark):
    assert oracle.same(module.query(spark, SF), SF, module.ORACLE) > 0


def test_divergence_of_odd_rows(spark):
    long = ["prefixprefixprefix" + "x" * k for k in (0, 1, 30, 60, 61, 200)] + ["é" * 20, "é" * 21, "prefixpr", "prefixprefixpref"]
    rng = random.Random(3)
    rows = [(rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None]), t) for _, t in odd_texts() for _ in range(2)]
    rows += [(rng.choice(["en", ""]), rng.choice(["a", "b", "ü", None]), " ".join(rng.choice(long) for _ in range(9))) for _ in range(60)]
    rows += [("xx", "alone", "1 2 3"), ("xx", "other", None)]
    df = spark.createDataFrame([(*r, "clash", 7, 1) for r in rows], "lang string, source string, text string, term string, n int, df int").repartition(5)
    for least in (1, 3, 10):
        assert got(divergence.audit(df, least)) == audited(rows, least)
    assert got(divergence.audit(df.limit(0))) == []


def test_prefix_levels_discard(spark):
    """Terms of too few documents go with their prefixes; documents count once, however many of their terms share a prefix."""
    rows = [("en", "a", "abcdefghone abcdefghtwo abcdefghthree " + ("abcdefghijklmnopqrst" if k else ""))for k in range(3)]
    found = divergence.tallies(spark.createDataFrame(rows, "lang string, source string, text string"))
    assert divergence.refined(found, 4).count() == 0
    assert {r.term for r in divergence.refined(found, 3).collect()} == {"abcdefghone", "abcdefghtwo", "abcdefghthree"}
    assert {r.term for r in divergence.refined(found, 2).collect()} == {"abcdefghone", "abcdefghtwo", "abcdefghthree", "abcdefghijklmnopqrst"}


def test_blocks_of_many_sources(spark, monkeypatch):
    rows = [("en", f"s{k % 7}", f"alpha beta{k % 3} gamma") for k in range(40)]
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    monkeypatch.setattr(divergence, "SIDE", 1)
    monkeypatch.setattr(divergence, "ROWS", 3)
    assert got(divergence.audit(df, 2)) == audited(rows, 2)


def coded(rows, rounds=2):
    """A plain version over (vec_id, vector, label)."""
    import math

    kept = sorted((i, tuple(math.floor(256 * x) for x in v), lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v))
    width = len(kept[0][1]) // 16
    part = lambda v, k: v[k * width : (k + 1) * width]
    books = [[part(v, k) for _, v, _ in kept[:64]] for k in range(16)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    best = lambda v, k: min(range(len(books[k])), key=lambda e: (far(part(v, k), books[k][e]), e))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v, _ in kept:
            for k in range(16):
                groups[k, best(v, k)].append(part(v, k))
        for (k, e), own in groups.items():
            books[k][e] = tuple(sum(x) // len(own) for x in zip(*own))
    out = [(i, [best(v, k) for k in range(16)], v, lab) for i, v, lab in kept]
    errors = [sum(far(part(v, k), books[k][c[k]]) for k in range(16)) for _, c, v, _ in out]
    by_label = Counter()
    for (*_, lab), e in zip(out, errors):
        by_label[lab] += e
    sha = brute.sha(",".join(str(x) for b in books for e in b for x in e))
    return sorted((i, "".join(f"{x:02x}" for x in c), e, by_label[lab], sha) for (i, c, _, lab), e in zip(out, errors))


def test_limb_codes_of_odd_rows(spark):
    rng = random.Random(9)
    vec = lambda scale: [rng.gauss(0, scale) for _ in range(32)]
    rows = [(k, vec(10.0 ** (k % 6)), rng.choice([1, 2, None])) for k in range(150)]
    rows += [rows[5], rows[5], (-7, [0.0] * 32, None), (900, None, 1), (901, [None, *[1.0] * 31], 1), (902, [float("nan")] * 32, 1), (903, [float("inf")] * 32, 2), (904, [], 2), (905, [-1e-9] * 32, 3)]
    df = spark.createDataFrame([(i, v, lab, "clash", 3) for i, v, lab in rows], "vec_id long, embedding array<double>, label int, code string, n int").repartition(4)
    assert sorted(tuple(r) for r in limbcodes.compress(df).collect()) == coded(rows)
    few = df.filter("vec_id between 3 and 9")
    assert sorted(tuple(r) for r in limbcodes.compress(few).collect()) == coded([r for r in rows if 3 <= r[0] <= 9])
    assert limbcodes.compress(df.limit(0)).collect() == [] and limbcodes.compress(df.filter("embedding is null")).collect() == []
    other = spark.createDataFrame([(1, [1.0] * 16, 1), (2, [1.0] * 17, 1), (3, [3e38] * 16, 1)], "vec_id long, embedding array<double>, label int")
    assert [(r.vec_id, r.error) for r in limbcodes.compress(other).orderBy("vec_id").collect()] == [(1, 0), (3, 0)]  # another length goes, beyond the bound is held


def test_limbs_are_exact():
    rng = np.random.default_rng(1)
    for width, top in ((4, 1 << 29), (64, 1 << 20), (3, 200)):
        x, c = rng.integers(-top, top, (50, width)), rng.integers(-top, top, (64, width))
        assert (limbcodes.dots(x, c) == np.array([[sum(int(a) * int(b) for a, b in zip(r, s)) for s in c] for r in x], dtype=object)).all()
        far = [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, s)) for s in c] for r in x]
        best, error = limbcodes.nearest(x, np.concatenate([c, c]))
        assert best.tolist() == [row.index(min(row)) for row in far] and error.tolist() == [min(row) for row in far]


def test_quality_of_held_out(spark):
    """Held-out accuracy, and not by the commonest label alone."""
    docs, labels = spark.read.parquet(f"{WIDE}/documents.parquet"), spark.read.parquet(f"{WIDE}/labels.parquet")
    found = {r.doc_id: r for r in linecrf.query(spark, WIDE).collect()}
    assert len(found) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for d, r in found.items())
    held = [(r.quality, found[r.doc_id].predicted) for r in labels.collect() if found[r.doc_id].held_out]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    bad = [b for a, b in held if a == 0]
    assert bad and sum(b == 0 for b in bad) >= 0.8 * len(bad)


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)] + [(3, 1), (4, None), (None, 1), (5, 7)], "doc_id long, quality int")
    df = spark.createDataFrame([(i, t, "clash", 0.5) for i, t in [*odd_texts(), odd_texts()[6], (None, None)]], "doc_id long, text string, y string, score double").repartition(3)
    rows = linecrf.classify(df, labels).collect()
    assert len(rows) == df.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, None)}) == 1
    assert linecrf.classify(df.limit(0), labels).collect() == []
    assert {r.score for r in linecrf.classify(df, labels.limit(0)).collect()} == {0.5}


def test_marginals_by_enumeration():
    rng = np.random.default_rng(4)
    sizes = [1, 4, 2, 4, 3]
    at = np.concatenate([[0], np.cumsum(sizes)])
    u, edge = rng.normal(size=at[-1]), rng.normal(size=(2, 2))
    p, changes = linecrf.marginals(u, edge, at)
    want = np.zeros((2, 2))
    for a, b in zip(at, at[1:]):
        paths = [[(k >> i) & 1 for i in range(b - a)] for k in range(2 ** (b - a))]
        weight = np.array([np.exp(sum(u[a + i] * y for i, y in enumerate(path)) + sum(edge[x, y] for x, y in zip(path, path[1:]))) for path in paths])
        weight /= weight.sum()
        assert np.allclose(p[a:b], weight @ np.array(paths))
        for w, path in zip(weight, paths):
            for x, y in zip(path, path[1:]):
                want[x, y] += w
    assert np.allclose(changes, want)


def test_lines_and_neighbours():
    data = b"One\n\nTWO!!\n" + b"x" + b"a a a"
    x, at, size = linecrf.features(np.frombuffer(data, np.uint8), np.array([0, 11, 12, 12, 17]))
    assert at.tolist() == [0, 4, 5, 6, 7] and size.tolist() == [3, 0, 5, 0, 1, 0, 5]
    own = linecrf.OWN
    assert (x[1, own : 2 * own] == x[0, :own]).all() and (x[1, 2 * own : 3 * own] == x[2, :own]).all()
    assert (x[4, own : 3 * own] == 0).all() and x[4, 3 * own :].tolist() == [1, 1]
    assert x[2, 1] == 1 and x[0, 1] == np.float32(1 / 3)


def test_ranks_of_cycles(spark):
    """Pairs that send to each other, rings and chains: equal to a direct solution."""
    rng = random.Random(2)
    edges = [(f"a{k}", f"b{k}") for k in range(5)] + [(f"b{k}", f"a{k}") for k in range(5)] + [(f"r{k}", f"r{(k + 1) % 9}") for k in range(9)] + [(f"c{k}", f"c{k + 1}") for k in range(20)] + [(f"c{rng.randrange(20)}", f"r{rng.randrange(9)}") for _ in range(6)]
    edges = [(a, b, float(1 + k % 3)) for k, (a, b) in enumerate(sorted(set(edges)))]
    names = sorted({x for e in edges for x in e[:2]})
    seeds = {h: (float(rng.randrange(3)), float(rng.randrange(3)), float(1 + rng.randrange(5))) for h in names}
    hosts = spark.createDataFrame([(h, *s) for h, s in seeds.items()], "host string, seed_trust double, seed_distrust double, seed_base double")
    found = {r.host: r for r in urlrank.pagerank(hosts, spark.createDataFrame(edges, "src string, dst string, weight double")).collect()}
    at = {h: k for k, h in enumerate(names)}
    for c, (kind, flip) in enumerate((("trust", False), ("distrust", True), ("base", False))):
        m = np.zeros((len(names), len(names)))
        for a, b, w in edges:
            m[(at[a], at[b]) if flip else (at[b], at[a])] += w
        m[:, m.sum(axis=0) == 0] = np.eye(len(names))[:, m.sum(axis=0) == 0]
        want = np.linalg.solve(np.eye(len(names)) - 0.85 * m / m.sum(axis=0), 0.15 * np.array([seeds[h][c] for h in names]))
        assert np.abs(np.array([getattr(found[h], kind) for h in names]) - want).max() < 1e-7
