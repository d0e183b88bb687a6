"""Source divergence audit: which sources of a language differ, and by which terms, over terms found by iceberg prefix refinement.

Terms are runs of letters and of characters beyond ASCII, A-Z lowered. A language keeps the terms that stand in LEAST of its
documents. They are found level by level: byte prefixes of 8 bytes are counted by distinct documents, those under LEAST are
discarded with all terms below them, the others are extended to 16, 32 and 64 bytes; a term shorter than a level's width stands for
itself and is complete there. Terms of 64 bytes and more that are left are counted whole. All counts are exact: a term's row
says in how many documents it is the first term with its prefix, and these add up to the prefix's documents.

Documents are brought together by language and source (partitions that are too large are split), counted in tasks, and only
these counts are shuffled again. Null text, lang and source count as ``''``; empty texts have no terms but make their group
occur; repeated rows are documents of their own; a very long text is handled alone and as a whole; ties in value are ranked by the
item's bytes; a table without rows gives none. Only ``lang``, ``source`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from saltmarsh.llm import _vec
from saltmarsh.llm._io import cut, sized, table

#: Documents that a kept term stands in at least, the scale of shares, and the ranks of terms.
LEAST, SCALE, RANKS = 10, 1_000_000_000, 10
#: Widths of the levels in bytes; the first two are held as numbers.
LEVELS = (8, 16, 32, 64)
#: Bytes of survivors that are broadcast; beyond it they are shuffled.
SURVIVORS = 16 << 20
#: Counts that a task holds at most, and sources of a language whose sums it holds as a matrix.
ROWS, SIDE = 600_000, 2_000
_COUNTS = ("n", "df", *(f"d{w}" for w in LEVELS))
_SEPARATOR = np.ones(256, bool)
_SEPARATOR[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


def heads(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first 8 and the second 8 bytes of each value as numbers, zeros behind its end, and its size. Terms hold no zero byte."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    size = np.diff(offsets)
    raw = column.buffers()[2]
    data = np.zeros(offsets[-1] + 16, np.uint8)
    if raw is not None and raw.size:
        data[: offsets[-1]] = np.frombuffer(raw, np.uint8)[: offsets[-1]]
    eight = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))
    first, second = eight[offsets[:-1]].astype(np.uint64), eight[offsets[:-1] + np.minimum(size, 8)].astype(np.uint64)
    keep = lambda n: np.where(n > 0, ~np.uint64(0) << ((8 - np.clip(n, 1, 8)) * 8).astype(np.uint64), np.uint64(0))
    return first & keep(size), second & keep(size - 8), size


def chunk_counts(part: pa.RecordBatch, groups: np.ndarray) -> pa.Table:
    """g, term, n, df and d* of a chunk of documents whose groups' numbers are given."""
    data, offsets = _vec.buffers(part.column("text"))
    starts, ends, at = _vec.word_spans(data, offsets, _SEPARATOR)
    sizes = ends - starts
    own = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=own[1:])
    words = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(own), pa.py_buffer(np.ascontiguousarray(_vec.lowered(data)[~_SEPARATOR[data]]))])
    coded = words.dictionary_encode()
    terms, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    first, second, size = heads(terms)
    tail = np.zeros(len(terms), np.int64)  # order of the terms of more than 16 bytes
    long = np.flatnonzero(size > 16)
    long = long[sorted(range(len(long)), key=terms.take(pa.array(long)).to_pylist().__getitem__)]
    tail[long] = np.arange(1, len(long) + 1)
    order = np.lexsort((tail, second, first))
    first, second = first[order], second[order]
    same = {8: first[1:] == first[:-1]}
    same[16] = same[8] & (second[1:] == second[:-1])
    for width in LEVELS[2:]:
        same[width] = same[16] & (size[order[1:]] > 16) & (size[order[:-1]] > 16)
        for k in np.flatnonzero(same[width]):
            a, b = terms[int(order[k])].as_py(), terms[int(order[k + 1])].as_py()
            same[width][k] = a[:width] == b[:width]
    place = np.empty(len(terms), np.int64)
    place[order] = np.arange(len(terms))
    row = np.repeat(np.arange(part.num_rows), np.diff(at))
    pair, n = np.unique(row * max(1, len(terms)) + place[code], return_counts=True)
    row, term = np.divmod(pair, max(1, len(terms)))
    counts = [n, np.ones(len(pair), np.int64)]
    for width in LEVELS:
        prefix = np.concatenate([[0], np.cumsum(~same[width])]) if len(terms) else np.zeros(0, np.int64)
        counts.append(np.r_[True, (row[1:] != row[:-1]) | (prefix[term[1:]] != prefix[term[:-1]])].astype(np.int64)[: len(pair)])
    key = groups[row] * max(1, len(terms)) + term
    order = np.argsort(key, kind="stable")
    starts = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]][: len(key)])
    sums = [np.add.reduceat(c[order], starts) if len(starts) else c for c in counts]
    g, term = np.divmod(key[order][starts], max(1, len(terms)))
    ranked = np.flatnonzero(place >= 0)[np.argsort(place)]
    return pa.table([pa.array(g), terms.take(pa.array(ranked[term])), *map(pa.array, sums)], ["g", "term", *_COUNTS])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    numbers: dict[tuple[str, str], int] = {}
    parts: list[pa.Table] = []
    held = waiting = 0

    def merged() -> pa.Table:
        found = pa.concat_tables(parts).group_by(["g", "term"], use_threads=False).aggregate([(c, "sum") for c in _COUNTS])
        return found.rename_columns([c.removesuffix("_sum") for c in found.column_names]).select(["g", "term", *_COUNTS])

    def out(found: pa.Table) -> Iterator[pa.RecordBatch]:
        names = list(numbers)
        for batch in found.combine_chunks().to_batches(max_chunksize=50_000):
            g = batch.column("g").to_numpy()
            lang, source = (pa.DictionaryArray.from_arrays(pa.array(g.astype(np.int32)), pa.array([x[k] for x in names], pa.string())).cast(pa.string()) for k in (0, 1))
            first, second, size = heads(batch.column("term"))
            yield pa.RecordBatch.from_arrays([lang, source, batch.column("term").cast(pa.string()), *(pa.array(_vec.signed(x)) for x in (first, second)), pa.array(size.astype(np.int32)), *(batch.column(c) for c in _COUNTS)], ["lang", "source", "term", "p1", "p2", "size", *_COUNTS])

    for batch in batches:
        for part in _vec.chunks(batch, limit=4 * _vec.CHUNK):
            pairs = list(zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), strict=True))
            groups = np.array([numbers.setdefault(x, len(numbers)) for x in pairs])
            parts.append(chunk_counts(part, groups))
            waiting += parts[-1].num_rows
            if waiting > max(ROWS, held):
                parts[:] = [merged()]
                held, waiting = parts[0].num_rows, 0
                if held > ROWS:
                    yield from out(parts.pop())
                    held = 0
    if parts:
        yield from out(merged())


def tallies(docs: DataFrame) -> DataFrame:
    """lang, source, term, its first 16 bytes as two numbers, its size, and counts of a part of a group's documents: occurrences,
    documents, and for each level the documents where it is the first term with its prefix."""
    texts = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    schema = "lang string, source string, term string, p1 long, p2 long, size int, " + ", ".join(f"{c} long" for c in _COUNTS)
    return texts.hint("rebalance", "lang", "source").mapInArrow(_vec.tidied(_count), schema)


def refined(rows: DataFrame, least: int = LEAST) -> DataFrame:
    """The rows of ``tallies`` whose prefixes of every level stand in ``least`` documents of their language."""

    def survivors(rows: DataFrame, width: int, *key: Column) -> DataFrame:
        counted = rows.groupBy("lang", *key).agg(F.sum(f"d{width}").alias("documents")).filter(F.col("documents") >= least)
        return sized(cut(counted.drop("documents"), f"prefixes{width}"), SURVIVORS)

    rows = rows.join(survivors(rows, LEVELS[0], F.col("p1")), ["lang", "p1"], "left_semi")
    rows = rows.join(survivors(rows, LEVELS[1], F.col("p1"), F.col("p2")), ["lang", "p1", "p2"], "left_semi")
    done, left = [rows.filter(F.col("size") < LEVELS[1])], cut(rows.filter(F.col("size") >= LEVELS[1]), "longer")
    for width in LEVELS[2:]:
        if left.isEmpty():
            break
        prefix = F.substring(F.encode("term", "utf-8"), 1, width).alias("prefix")
        kept = left.withColumn("prefix", prefix).join(survivors(left, width, prefix), ["lang", "prefix"], "left_semi").select(left.columns)
        done.append(kept.filter(F.col("size") < width))
        left = cut(kept.filter(F.col("size") >= width), f"over{width}")
    return reduce(DataFrame.unionByName, [*done, left])


def share(count: str, total: str, kept: str) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * kept)), exact at any count; null where nothing is kept."""
    return F.expr(f"1 + cast({SCALE} as decimal(10,0)) * cast({count} + 2 as decimal(19,0)) div cast(nullif({total} + 2 * {kept}, 0) as decimal(20,0))")


def apart(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def cells(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """The kept terms' counts, one row for each term of each group that has it: lang, source, term, n, all (in the language),
    top (one row of each term); and the groups: lang, source, s (the source's number), total, kept, lang_total."""
    rows = cut(tallies(docs), "terms")
    each = refined(rows, least).select("lang", "source", "term", "n", "df").repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    own = W.partitionBy("lang", "term")
    counted = each.withColumns({"all": F.sum("n").over(own), "documents": F.sum("df").over(own), "top": F.row_number().over(own.orderBy("source")) == 1})
    counted = cut(counted.filter(F.col("documents") >= least).drop("documents", "df"), "cells")
    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    sums = counted.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if("top").alias("tops"))
    zero = {"total": 0, "tops": 0}
    by_lang = W.partitionBy("lang")
    known = groups.join(sums, ["lang", "source"], "left").fillna(zero)
    known = known.select("lang", "source", (F.row_number().over(by_lang.orderBy("source")) - 1).alias("s"), "total", F.sum("tops").over(by_lang).alias("kept"), F.sum("total").over(by_lang).alias("lang_total"))
    return counted, cut(known, "groups")


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}

    def out(lang: str, m: np.ndarray) -> Iterator[pa.RecordBatch]:
        a, b = np.nonzero(np.triu(np.ones(m.shape, bool), 1))
        for k in range(0, len(a), 100_000):
            x, y = a[k : k + 100_000], b[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(x), pa.string()), pa.array(x.astype(np.int32)), pa.array(y.astype(np.int32)), pa.array(m[x, y])], ["lang", "a", "b", "value"])

    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        for lang in dict.fromkeys(langs.tolist()):
            mine = batch.filter(pa.array(langs == lang))
            none = np.array(mine.column("none")[0].as_py(), np.int64)
            p = np.repeat(none[None, :], mine.num_rows, axis=0)
            lists = mine.column("own")
            row = np.repeat(np.arange(mine.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            p[row, lists.flatten().field("s").to_numpy()] = lists.flatten().field("p").to_numpy()
            m = sums.setdefault(lang, np.zeros((len(none), len(none)), np.int64))
            for a in range(len(none) - 1):
                x, y = p[:, a : a + 1], p[:, a + 1 :]
                m[a, a + 1 :] += ((x - y) ** 2 // (x + y)).sum(axis=0)
            if len(none) > SIDE:
                yield from out(lang, sums.pop(lang))
    for lang, m in sums.items():
        yield from out(lang, m)


def audit(docs: DataFrame, least: int = LEAST, ranks: int = RANKS) -> DataFrame:
    """lang, source, part, item, value, rank: for each group its distance to every other source of its language (part ``pair``),
    and the terms that it has more of than its language has (part ``term``), to rank ``ranks``."""
    counted, groups = cells(docs, least)
    groups = sized(groups)
    p = counted.join(groups, ["lang", "source"]).select("lang", "source", "s", "term", share("n", "total", "kept").alias("p"), share("all", "lang_total", "kept").alias("q"))
    p = cut(p, "shares")
    in_order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = p.filter("p > q").select("lang", "source", F.col("term").alias("item"), apart("p", "q").alias("value")).withColumn("rank", F.row_number().over(in_order)).filter(F.col("rank") <= ranks)
    none = groups.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("s", share("0L", "total", "kept").alias("p")))), lambda x: x.p).alias("none"))
    dense = p.groupBy("lang", "term").agg(F.collect_list(F.struct("s", "p")).alias("own")).join(sized(cut(none, "none")), "lang").select("lang", "own", "none")
    found = dense.mapInArrow(_vec.tidied(_pairs), "lang string, a int, b int, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = found.select("lang", F.explode(F.array(F.struct(F.col("a").alias("s"), F.col("b").alias("other"), "value"), F.struct(F.col("b").alias("s"), F.col("a").alias("other"), "value"))).alias("x")).select("lang", "x.*")
    names = groups.select("lang", "s", "source")
    every = names.join(names.withColumnRenamed("s", "other").withColumnRenamed("source", "item"), "lang").filter("s != other")  # the result's own rows
    pairs = every.join(both, ["lang", "s", "other"], "left").select("lang", "source", "item", F.coalesce("value", F.lit(0).cast("long")).alias("value")).withColumn("rank", F.row_number().over(in_order))
    named = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return named(pairs, "pair").union(named(terms, "term"))


ORACLE = r"""
with d as (select row_number() over () as rid, coalesce(lang, '') as lang, coalesce(source, '') as source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w
           from documents),
     t as (select rid, lang, source, unnest(w) as term from d),
     l as (select lang, term, count(*) as c from t group by lang, term having count(distinct rid) >= 10),
     n as (select t.lang, t.source, t.term, count(*) as c from t join l using (lang, term) group by all),
     g as (select lang, source, coalesce(sum(n.c), 0) as total from (select distinct lang, source from d) left join n using (lang, source) group by all),
     v as (select lang, coalesce(count(l.term), 0) as kept, coalesce(sum(l.c), 0) as total from (select distinct lang from d) left join l using (lang) group by all),
     p as (select g.lang, g.source, l.term, coalesce(n.c, 0) as c,
                  1 + (1000000000::hugeint * (coalesce(n.c, 0) + 2)) // (g.total + 2 * v.kept) as p,
                  1 + (1000000000::hugeint * (l.c + 2)) // (v.total + 2 * v.kept) as q
           from g join v using (lang) join l using (lang) left join n on n.lang = g.lang and n.source = g.source and n.term = l.term),
     f as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value
           from p a join p b on a.lang = b.lang and a.term = b.term and a.source != b.source group by all),
     pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(f.value, 0) as value
               from g a join g b on a.lang = b.lang and a.source != b.source left join f on f.lang = a.lang and f.source = a.source and f.item = b.source),
     terms as (select lang, source, 'term' as part, term as item, ((p - q) * (p - q)) // (p + q) as value from p where c > 0 and p > q),
     r as (select *, row_number() over (partition by lang, source, part order by value desc, encode(item)) as rank from (select * from pairs union all select * from terms))
select lang, source, part, item, cast(value as bigint) as value, cast(rank as integer) as rank from r where part = 'pair' or rank <= 10
"""


def query(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))
