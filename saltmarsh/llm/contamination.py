"""Benchmark decontamination with DataFrame functions only: a broadcast hash set of normalised test n-grams.

Every document is scanned once. Short grams at strided positions, of which each window holds one, are looked up in a
bitmap of the test items' grams (a literal of bounded size, two bits a gram); only documents with a hit there unfold all their windows, which
are joined as whole strings with the test windows, so no hit rests on a hash; which rows go is then told by a 64-bit hash of id and text. Null and empty texts have no words and are
clean; items without words have no window; without items every document is clean; repeated rows are judged one by one, and
items that share a window (ties) all count. A very long text is one row of words until it is unfolded into windows.
Only ``doc_id``, ``text`` and ``item_id``, ``text`` are read; further columns, of any name, pass through ``remove_documents``
as they are. The bitmap grows with the test windows up to LONGS_MOST; beyond that it fills up, and more documents than need be unfold.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saltmarsh.llm._io import cut, fresh, sized, table

#: Words of a window; an item with fewer words is one window.
WINDOW = 13
#: Fixed class of the contract: what separates words after A-Z have been lowered; and before.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
SEPARATOR_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: The bitmap's 64-bit longs at least and at most, and its bits for each test window.
BITMAP_LONGS, LONGS_MOST, BITS_A_WINDOW = 1 << 14, 1 << 16, 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """The words in lower case; texts of ASCII alone take the faster of two functions that then do the same. Splitting at the
    separators takes a tenth of the time that extracting all words takes, which copies the text for each."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(low, f"{SEPARATOR}+"), "")


def key_of() -> Column:
    """What names a row: its id and text. Rows that share both are judged alike."""
    return F.xxhash64("doc_id", "text")


def test_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, len, gram: the distinct windows of each item, as words joined by a space."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("words")).filter("size(words) > 0")
    items = items.withColumn("len", F.least(F.size("words"), F.lit(window)))
    each = F.expr("transform(sequence(1, size(words) - len + 1), i -> array_join(slice(words, i, len), ' '))")
    return items.select("item_id", "len", F.explode(F.array_distinct(each)).alias("gram")).distinct()


def anchor(length: int) -> tuple[int, int]:
    """Words of a short gram and the stride of its starts, so that each window of ``length`` words holds a whole one."""
    short = (length + 1) // 2
    return short, length - short + 1


def _anchors(words: str, length: int, stride: int) -> str:
    """SQL for the hashes of the short grams of an array of words, none if there are too few words."""
    short = anchor(length)[0]
    return f"if(size({words}) < {short}, array(), transform(sequence(1, size({words}) - {short} + 1, {stride}), i -> xxhash64({length}, slice({words}, i, {short}))))"


def longs_for(windows: int) -> int:
    """The bitmap's size: a power of two."""
    return min(LONGS_MOST, max(BITMAP_LONGS, 1 << (windows * BITS_A_WINDOW // 64).bit_length()))


def bitmap(windows: DataFrame, lengths: list[int], longs: int = BITMAP_LONGS) -> str:
    """SQL for an array of longs with two bits set for each short gram of the windows, by both halves of its hash."""
    grams = windows.select("len", F.split("gram", " ").alias("w"))
    hashes = reduce(DataFrame.union, (grams.filter(F.col("len") == n).select(F.explode(F.expr(_anchors("w", n, 1))).alias("h")) for n in lengths))
    halves = hashes.select(F.explode(F.array("h", F.shiftright("h", 32))).alias("h"))
    bits = halves.select(F.expr(f"pmod(shiftright(h, 6), {longs})").cast("int").alias("k"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit"))
    found = {r.k: r.bits for r in bits.groupBy("k").agg(F.bit_or("bit").alias("bits")).collect()}  # at most ``longs`` rows
    return "array(" + ",".join(f"{x}L" if x != -(2**63) else "shiftleft(1L, 63)" for x in (found.get(k, 0) for k in range(longs))) + ")"


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """row_id, key, doc_id, n_words, spans (array of (first, last) word positions that are hit), items for every row of ``docs``."""
    windows = test_windows(benchmark, window)
    counted = {r.len: r.n for r in windows.groupBy("len").agg(F.count("*").alias("n")).collect()}  # at most ``window`` rows
    lengths, longs = sorted(counted), longs_for(sum(counted.values()))
    own = docs.select(F.monotonically_increasing_id().alias("row_id"), key_of().alias("key"), "doc_id", words_of(F.col("text")).alias("words"))
    own = own.withColumn("n_words", F.size("words").cast("long"))
    empty = F.expr("cast(array() as array<struct<at:int,len:int,gram:string>>)")
    if not lengths:
        return own.select("row_id", "key", "doc_id", "n_words", F.expr("cast(array() as array<struct<first:int,last:int>>)").alias("spans"), F.expr("cast(array() as array<bigint>)").alias("items"))
    bits = bitmap(windows, lengths, longs)
    unfolded = []
    for n in lengths:
        bit = lambda h: f"(shiftright(get({bits}, cast(pmod(shiftright({h}, 6), {longs}) as int)), cast({h} & 63 as int)) & 1) = 1"
        hit = F.expr(f"exists({_anchors('words', n, anchor(n)[1])}, h -> {bit('h')} and {bit('shiftright(h, 32)')})")
        every = F.expr(f"transform(sequence(1, size(words) - {n} + 1), i -> named_struct('at', i, 'len', {n}, 'gram', array_join(slice(words, i, {n}), ' ')))")
        unfolded.append(F.when((F.col("n_words") >= n) & hit, every).otherwise(empty))
    rows = own.select("row_id", "key", "doc_id", "n_words", F.explode_outer(F.concat(*unfolded)).alias("w")).select("row_id", "key", "doc_id", "n_words", "w.at", "w.len", "w.gram")
    tests = windows.groupBy("len", "gram").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    tests = sized(tests)
    hits = rows.join(tests, ["len", "gram"], "left")
    span = F.when(F.col("items").isNotNull(), F.struct(F.col("at").alias("first"), (F.col("at") + F.col("len") - 1).alias("last")))
    grouped = hits.groupBy("row_id", "key", "doc_id", "n_words").agg(F.sort_array(F.collect_set(span)).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    return grouped


def judge(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of ``docs``."""
    found = scan(docs, benchmark, window)
    n_hit = F.expr("aggregate(spans, named_struct('n', 0L, 'upto', 0), (a, s) -> named_struct('n', a.n + greatest(0, s.last - greatest(a.upto, s.first - 1)), 'upto', greatest(a.upto, s.last)), a -> a.n)")
    digest = F.sha2(F.array_join(F.sort_array(F.transform("items", lambda i: i.cast("string"))), ","), 256)
    out = found.select("row_id", "key", "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"))
    return out.withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))


def remove_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without its contaminated rows, in the same columns."""
    bad = cut(judge(docs, benchmark, window).filter("contaminated").select("key").distinct(), "contaminated")
    own = fresh(docs, "key")
    return docs.withColumn(own, key_of()).join(sized(bad.withColumnRenamed("key", own)), own, "left_anti").select(docs.columns)


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text: every row's text without the words that are hit, each with what separates it from the word before."""
    found = scan(docs, benchmark, window).filter("size(spans) > 0").select("key", "spans").dropDuplicates(["key"])
    own = docs.select(key_of().alias("key"), "doc_id", "text").join(sized(cut(found, "spans")), "key", "left")
    parts = F.split("text", f"(?<={SEPARATOR_ANY_CASE.replace('[', '[^', 1)})(?={SEPARATOR_ANY_CASE})")  # a word with what stands before it; last what is left
    kept = F.filter(parts, lambda p, i: ~F.exists("spans", lambda s: (s.first <= i + 1) & (i + 1 <= s.last)))
    rest = F.array_join(kept, "")
    return own.select("doc_id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(rest).alias("text"))


ORACLE = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w, row_number() over () as rid from documents),
     b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
     t as (select distinct item_id, least(len(w), 13) as l, unnest(list_transform(range(1, len(w) - least(len(w), 13) + 2), lambda i: array_to_string(w[i : i + least(len(w), 13) - 1], ' '))) as g from b where len(w) > 0),
     ls as (select distinct l from t),
     p as (select rid, l, unnest(range(1, len(w) - l + 2)) as i, w from d, ls where len(w) >= l),
     h as (select p.rid, p.i, p.l, t.item_id from p join t on t.l = p.l and t.g = array_to_string(p.w[p.i : p.i + p.l - 1], ' ')),
     n as (select rid, count(distinct k) as n_hit from (select rid, unnest(range(i, i + l)) as k from h) group by rid),
     m as (select rid, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as items from h group by rid)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(n.n_hit, 0) as n_hit, coalesce(m.n_items, 0) as n_items, sha256(coalesce(m.items, '')) as items_sha256,
       coalesce(n.n_hit, 0) > 0 and 20 * coalesce(n.n_hit, 0) >= len(d.w) as contaminated
from d left join n using (rid) left join m using (rid)
"""


def query(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row_id", "key")
