"""URL filters: rules by host and path; for other urls, personalised PageRank of trust and of reversed distrust over host edges.

Trust starts from hosts with allowed pages and flows along links; distrust starts from hosts with blocked pages and flows
against them. Both are set against a PageRank from all hosts' pages, so that a large host needs no more than a small one.
Edges are links of pages to other hosts, and ties of a host to its parent domain (its last two labels) where that is a host
itself or several hosts share it; a shared parent is a node of its own. Ranks are iterated until no host's changes by more than TOLERANCE of
itself and one, however many rounds it takes; a round goes on from the mix of the last WINDOW rounds whose remainder is least (Anderson's method),
and from the last round alone after a mix that made the remainder grow. Every round is a written table. A host is blocked where (distrust - trust) / base exceeds a threshold. Null urls and urls without ``://`` have an empty
host and path, no rule, and are allowed; without any edge each host is judged by its own seeds; a table without pages
gives no rows. Repeated rows count as pages of their own; of rules that tie in length none can fit the same url. Very long html is
searched for links as a whole. Only ``page_id``, ``url`` and ``html`` are read. Edges and ranks stay in DataFrames; hosts of
very many edges have these dealt to several tasks by a salt.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saltmarsh.llm._io import cut, sized, table

#: Fixed rules of the contract: host, path, verdict.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
DAMPING, TOLERANCE, THRESHOLD = 0.85, 1e-9, 0.5
#: Rounds that are mixed; mixes that may fail before rounds go on without.
WINDOW, FAILURES = 4, 5
_KINDS = ("trust", "distrust", "base")
#: Edges of a host that one task takes, pages likewise.
EDGES_A_SALT = 100_000
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, weight: links of pages to other hosts, and ties between a host and the host it is a subdomain of."""
    hrefs = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"""(?i)\b(?:href|src)\s*=\s*["']?((?:https?:)?//[^\s"'<>]+)"""), 1)
    links = pages.select("host", F.explode(hrefs).alias("link")).select(F.col("host").alias("src"), host_of(F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), "link")).otherwise(F.col("link"))).alias("dst"))
    links = links.filter("src != '' and dst != '' and src != dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    hosts = pages.select("host").filter("host != ''").distinct()
    up = hosts.select(F.col("host").alias("src"), F.regexp_extract("host", r"^[^.]+\..*?([^.]+\.[^.]+)$", 1).alias("dst")).filter("dst != ''")
    shared = up.groupBy("dst").agg(F.count("*").alias("n")).filter("n > 1").select("dst").union(hosts.withColumnRenamed("host", "dst"))
    known = up.join(shared.distinct(), "dst", "left_semi")
    ties = known.select("src", "dst").union(known.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("weight", F.lit(1.0))
    return links.union(ties).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def pagerank(hosts: DataFrame, edges: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """host, trust, distrust, base, to the tolerance. ``hosts``: host, seed_trust, seed_distrust, seed_base.

    Trust and base flow from src to dst in proportion to weights, distrust from dst to src. What a host without
    outgoing edges holds stays with it.
    """
    forth = edges.join(edges.groupBy("src").agg(F.sum("weight").alias("w")), "src").select("src", "dst", (F.col("weight") / F.col("w")).alias("share"))
    back = edges.join(edges.groupBy("dst").agg(F.sum("weight").alias("w")), "dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("weight") / F.col("w")).alias("share"))
    sinks = hosts.select("host").join(forth.select(F.col("src").alias("host")).distinct(), "host", "left_anti").select(F.col("host").alias("src"), F.col("host").alias("dst"), F.lit(1.0).alias("share"))
    sources = hosts.select("host").join(back.select(F.col("src").alias("host")).distinct(), "host", "left_anti").select(F.col("host").alias("src"), F.col("host").alias("dst"), F.lit(1.0).alias("share"))
    flows = cut(forth.union(sinks).withColumn("reverse", F.lit(False)).union(back.union(sources).withColumn("reverse", F.lit(True))), "flows")
    salts = flows.groupBy("src").agg(F.ceil(F.count("*") / EDGES_A_SALT).alias("salts"))
    hosts = cut(hosts.join(salts, hosts["host"] == salts["src"], "left").drop("src").withColumn("salts", F.coalesce("salts", F.lit(1).cast("long"))), "hosts")
    many = hosts.filter("salts > 1").select(F.col("host").alias("src"), "salts")
    flows = flows.join(F.broadcast(many), "src", "left").withColumn("salt", F.when(F.col("salts") > 1, F.pmod(F.xxhash64("dst"), "salts")).otherwise(F.lit(0).cast("long"))).drop("salts")  # at most edges / EDGES_A_SALT rows
    flows = cut(flows, "salted") if many.limit(1).count() else flows
    none = F.expr("cast(array() as array<double>)")
    state = hosts.select("*", *(F.col(f"seed_{c}").alias(c) for c in _KINDS), *(F.lit(None).cast("double").alias(f"{x}_{c}") for c in _KINDS for x in ("g", "f")), *(none.alias(f"{x}_{c}") for c in _KINDS for x in ("dg", "df")))
    best, failures, mixed = float("inf"), 0, False
    while True:
        state = cut(one_round(state, flows, damping), "ranks")
        left, mixes = remainder(state)
        if left is None or left <= tolerance:
            return state.select("host", *(F.col(f"g_{c}").alias(c) for c in _KINDS))
        if mixed and left > 2 * best:
            failures, mixes = failures + 1, {c: [] for c in _KINDS}
        mixed, best = failures < FAILURES and any(mixes.values()), min(best, left)
        for c in _KINDS:
            steps = sum((w * F.element_at(f"dg_{c}", i + 1) for i, w in enumerate(mixes[c] if mixed else [])), F.lit(0.0))
            state = state.withColumn(c, F.col(f"g_{c}") - steps)
            if not mixed:
                state = state.withColumns({f"dg_{c}": none, f"df_{c}": none}) if failures else state


def one_round(state: DataFrame, flows: DataFrame, damping: float) -> DataFrame:
    """The hosts with what flows to them from the ranks: g, the remainder f = g - rank, and their differences to the last WINDOW rounds."""
    copies = state.select(F.col("host").alias("src"), *_KINDS, F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    moved = flows.join(copies.hint("merge"), ["src", "salt"])
    flow = lambda c: F.sum(F.col("share") * (F.col("reverse") if c == "distrust" else ~F.col("reverse")).cast("double") * F.col(c)).alias(f"in_{c}")
    inflow = moved.groupBy(F.col("dst").alias("host")).agg(*map(flow, _KINDS))
    out = state.join(inflow.hint("merge"), "host", "left")
    for c in _KINDS:
        g = (1 - damping) * F.col(f"seed_{c}") + damping * F.coalesce(f"in_{c}", F.lit(0.0))
        f = g - F.col(c)
        longer = lambda new, old, all: F.when(F.col(old).isNull(), F.col(all)).otherwise(F.slice(F.array_prepend(all, new - F.col(old)), 1, WINDOW))
        out = out.withColumns({f"g_{c}": g, f"f_{c}": f, f"dg_{c}": longer(g, f"g_{c}", f"dg_{c}"), f"df_{c}": longer(f, f"f_{c}", f"df_{c}")})
    return out.select(state.columns)


def remainder(state: DataFrame) -> tuple[float | None, dict[str, list[float]]]:
    """The largest remainder of a host against its rank and one, and for each kind the weights of the last differences that leave least."""
    far = F.max(F.greatest(*(F.abs(F.col(f"f_{c}")) / (1 + F.abs(F.col(f"g_{c}"))) for c in _KINDS)))
    d = lambda c, i: F.coalesce(F.get(f"df_{c}", F.lit(i)), F.lit(0.0))
    products = [F.sum(d(c, i) * (d(c, j) if j < WINDOW else F.col(f"f_{c}"))).alias(f"{c}_{i}_{j}") for c in _KINDS for i in range(WINDOW) for j in range(i, WINDOW + 1)]
    row = state.agg(far.alias("far"), F.max(F.size("df_base")).alias("n"), *products).first()
    weights = {}
    for c in _KINDS:
        n = row.n or 0
        a = np.array([[row[f"{c}_{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)]).reshape(n, n)
        weights[c] = np.linalg.lstsq(a, np.array([row[f"{c}_{i}_{WINDOW}"] for i in range(n)]), rcond=1e-12)[0].tolist() if n else []
    return row.far, weights


def judge(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's trust, distrust and score for every page."""
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumns({"rule": rule, "ruled": verdict})
    count = lambda v: F.sum((F.col("ruled") == v).cast("double"))
    hosts = own.filter("host != ''").groupBy("host").agg(F.coalesce(count("allow"), F.lit(0.0)).alias("seed_trust"), F.coalesce(count("block"), F.lit(0.0)).alias("seed_distrust"), F.count("*").cast("double").alias("seed_base"))
    edges = host_edges(pages.select(host_of(F.col("url")).alias("host"), "html"))
    outside = edges.select(F.col("dst").alias("host")).distinct().join(hosts, "host", "left_anti").select("host", *(F.lit(0.0).alias(c) for c in hosts.columns[1:]))
    edges = cut(edges, "edges")
    hosts = cut(hosts.unionByName(outside), "hosts")
    ranks = pagerank(hosts, edges)
    score = F.when(F.col("base") > 0, (F.col("distrust") - F.col("trust")) / F.col("base")).otherwise(0.0)
    ranks = ranks.select("host", F.round("trust", 9).alias("trust"), F.round("distrust", 9).alias("distrust"), F.round(score, 9).alias("score"))
    judged = own.join(sized(cut(ranks, "scores")), "host", "left")
    by_rank = F.when(F.col("score") > threshold, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_rank).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"), F.coalesce("score", F.lit(0.0)).alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
