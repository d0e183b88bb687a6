"""MinHash near-dedup with circulant signatures: two permutations make all coordinates, one of them circularly shifted.

A shingle x has coordinate pi(sigma(x) + k mod 2^32) under shift k; sigma and pi are fixed bijections of 32-bit numbers.
Bands of coordinates propose pairs, full sets of 64-bit shingle hashes confirm them. Documents with equal sets are one
class, of which one member goes on. In each bucket every member is first compared with a leader, the member that shares most
bucket places with others (in a group of copies of one text that differ from one another, the text itself), which settles
large groups in a linear number of pairs; a leader has then met its whole bucket and leaves it. Further rounds take leaders
by a hash. Buckets that after these rounds still hold more than one component are compared pair by pair across components, so no candidate is left out; bit sketches first drop pairs that can't share enough. With
54 bands of 6 a pair of similarity 0.8 is missed with probability (1 - 0.8^6)^54 = 7e-8.

Null and empty texts have an empty set, link with nothing and are kept. Texts of fewer words than a shingle are one
shingle; very long texts are one set as all others. Rows without an id link with nothing. Rows that repeat an id count as one node;
of texts that tie as copies the smallest id is kept. Other columns aren't read, and ``keep_one`` gives them back as they were.
An empty table gives no rows. Large buckets are dealt to several tasks by a salt, their leaders copied to each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltmarsh.llm import _vec
from saltmarsh.llm._io import cut, sized, table

SHINGLE, SIMILARITY, BANDS, ROWS = 5, 80, 54, 6
#: Leaders that the members of a bucket meet: in the first round by shared places, in the others by a hash.
ROUNDS = 2
#: Longs of a document's bit sketch; the sketches bound how many shingles two sets can share.
SKETCH = 16
#: Pairs for one copy of a leader's set when pairs are brought together with it, and members of a bucket that one task takes.
PAIRS_A_SALT, BUCKET = 1000, 500
_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def sigma(x: np.ndarray) -> np.ndarray:
    """The first permutation, after folding 64-bit hashes to 32 bits."""
    return ((x ^ (x >> np.uint64(32))) & np.uint64(0xFFFFFFFF)).astype(np.uint32) * np.uint32(0x9E3779B1)


def pi(x: np.ndarray) -> np.ndarray:
    """The second permutation, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def signature(shingles: np.ndarray, k: int) -> np.ndarray:
    """The k coordinates of a set that isn't empty."""
    shifts = np.arange(k, dtype=np.uint32)[:, None]
    best = np.full(k, 0xFFFFFFFF, np.uint32)
    own = sigma(shingles)
    for at in range(0, len(own), 2048):
        np.minimum(best, pi(own[None, at : at + 2048] + shifts).min(axis=1), out=best)
    return best


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each row its distinct shingles' hashes, in order."""
    words, at = _vec.word_hashes(column)
    sums = np.zeros(len(words), np.uint64)
    for j in range(width):
        sums[: max(0, len(words) - j)] += words[j:] * _K[j % len(_K)] * np.uint64(2 * j + 1)
    whole = _vec.mix(sums)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= width:
            yield np.unique(whole[a : b - width + 1])
        elif b > a:
            parts = words[a:b] * _K[np.arange(b - a) % len(_K)] * (np.arange(b - a, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
            yield _vec.mix(parts.sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def signatures(docs: DataFrame, width: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, set_hash, bands (array of band hashes, empty for an empty set), sketch (a bit for each shingle's hash)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mult = _K[np.arange(rows) % len(_K)]
        for batch in batches:
            for part in _vec.chunks(batch):
                sizes, hashes, lists, sketches = [], [], [], []
                for s in shingle_sets(part.column("text"), width):
                    sizes.append(len(s))
                    hashes.append(int(_vec.mix(_vec.mix(s + _K[0]).sum(keepdims=True, dtype=np.uint64))[0]) if len(s) else 0)
                    lists.append(signature(s, bands * rows) if len(s) else None)
                    bits = np.zeros(64 * SKETCH, np.uint8)
                    bits[(s % np.uint64(64 * SKETCH)).astype(np.int64)] = 1
                    sketches.append(np.packbits(bits).view(np.int64))
                full = np.array([x for x in lists if x is not None], np.uint64).reshape(-1, bands, rows)
                keys = _vec.mix((full * mult).sum(axis=2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * _K[1])
                offsets = np.r_[0, np.cumsum([0 if x is None else bands for x in lists])].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(_vec.signed(np.array(hashes, np.uint64))), pa.ListArray.from_arrays(offsets, _vec.signed(keys.reshape(-1))), pa.ListArray.from_arrays(np.arange(0, SKETCH * len(sizes) + 1, SKETCH, dtype=np.int32), np.concatenate(sketches))],
                    ["doc_id", "n_shingles", "set_hash", "bands", "sketch"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_vec.tidied(each), "doc_id long, n_shingles long, set_hash long, bands array<long>, sketch array<long>")


def full_sets(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, shingles: the whole sets."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _vec.chunks(batch):
                sets = list(shingle_sets(part.column("text"), width))
                offsets = np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int32)
                values = _vec.signed(np.concatenate([np.zeros(0, np.uint64), *sets]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(offsets, values)], ["doc_id", "shingles"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_vec.tidied(each), "doc_id long, shingles array<long>")


def verified(pairs: DataFrame, sets: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """Those (a, b) of ``pairs`` whose whole sets are similar enough. A frequent b is salted, and its set copied per salt."""
    salts = cut(pairs.groupBy("b").agg(F.ceil(F.count("*") / PAIRS_A_SALT).cast("int").alias("salts")), "salts")
    many = sized(salts.filter("salts > 1"))
    salted = pairs.join(many, "b", "left").select("a", "b", F.when(F.col("salts") > 1, F.pmod(F.xxhash64("a"), "salts").cast("int")).otherwise(0).alias("salt"))
    right = sets.join(salts.withColumnRenamed("b", "doc_id"), "doc_id").select(F.col("doc_id").alias("b"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("shingles").alias("right"))
    both = salted.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("left")), "a").join(right, ["b", "salt"])
    both = both.withColumn("common", F.size(F.array_intersect("left", "right")))
    return both.filter(100 * F.col("common") >= similarity * (F.size("left") + F.size("right") - F.col("common"))).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """a, b: every node a that isn't its component's smallest, with the smallest b. Large and small stars in turn until nothing changes."""
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "edges")
    state = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == state or not mark[0]:
            return now
        state = mark
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").union(least.select("a", F.col("m").alias("b")))
        now = cut(small.distinct(), "stars")


def near_duplicates(docs: DataFrame, width: int = SHINGLE, similarity: int = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``."""
    signed = cut(signatures(docs, width, bands, rows), "signatures")
    full = signed.filter("n_shingles > 0 and doc_id is not null")
    classes = cut(full.groupBy("n_shingles", "set_hash").agg(F.min("doc_id").alias("rep")), "classes")
    heads = full.join(classes.select("n_shingles", "set_hash", F.col("rep").alias("doc_id")), ["n_shingles", "set_hash", "doc_id"], "left_semi")
    entries = heads.select("doc_id", "n_shingles", F.explode("bands").alias("bucket"))
    shared = cut(entries.groupBy("bucket").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("size")).filter("least != most").select("bucket", "size"), "buckets")
    members = cut(entries.join(sized(shared), "bucket").distinct(), "members")
    stars = docs.sparkSession.createDataFrame([], "a long, b long")
    if members.limit(1).count():
        needed = cut(members.select("doc_id").distinct(), "needed")
        sets = cut(full_sets(docs.join(sized(needed), "doc_id", "left_semi"), width), "sets")
        left = members.withColumn("root", F.col("doc_id"))
        for k in range(ROUNDS):
            led, left = meet_leaders(left, k)
            pairs = cut(fitting(led, similarity), "pairs")
            stars = components(stars.union(verified(pairs, sets, similarity)))
            left = still_mixed(left, stars)
        sketches = signed.filter("doc_id is not null").select("doc_id", "n_shingles", "sketch").dropDuplicates(["doc_id", "n_shingles"])
        left = cut(left.join(sketches, ["doc_id", "n_shingles"]), "left")
        x, y = salted(left).alias("x"), copied(left).alias("y")
        met = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.salt") == F.col("y.salt")) & (F.col("x.doc_id") > F.col("y.doc_id")) & (F.col("x.root") != F.col("y.root")) & may_link(similarity))
        pairs = cut(met.select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct(), "pairs")
        stars = components(stars.union(verified(pairs, sets, similarity)))
    roots = classes.join(stars.select(F.col("a").alias("rep"), F.col("b").alias("root")), "rep", "left").select("n_shingles", "set_hash", F.coalesce("root", "rep").alias("root"))
    joined = signed.select("doc_id", "n_shingles", "set_hash").join(roots, ["n_shingles", "set_hash"], "left")
    component = F.when(F.col("n_shingles") > 0, F.least("root", "doc_id")).otherwise(F.col("doc_id"))
    out = joined.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def meet_leaders(members: DataFrame, number: int) -> tuple[DataFrame, DataFrame]:
    """(a, b, n, m) for members a and their buckets' leaders b of other components, and the members without the leaders.

    By a hash each bucket has a leader of its own, so that a member meets as many as it has buckets: among copies that
    are similar in chains rather than to one text, this joins nearly all of them.
    """
    if number:
        ranked = members.withColumn("degree", F.xxhash64("bucket", "doc_id"))
    else:
        ranked = members.join(members.groupBy("doc_id").agg(F.sum("size").alias("degree")), "doc_id")
    leaders = ranked.groupBy("bucket").agg(F.max(F.struct("degree", "doc_id", "n_shingles", "root")).alias("leader"), F.max("size").alias("size"))
    both = cut(salted(members).join(copied(leaders).drop("size"), ["bucket", "salt"]).drop("salt").filter("doc_id != leader.doc_id"), "led")
    other = both.filter("root != leader.root")
    led = other.select(F.col("doc_id").alias("a"), F.col("leader.doc_id").alias("b"), F.col("n_shingles").alias("n"), F.col("leader.n_shingles").alias("m")).distinct()
    return led, both.select("bucket", "size", "doc_id", "n_shingles")


def salted(members: DataFrame) -> DataFrame:
    """Members with one of their bucket's salts, by their ids: large buckets are dealt to several tasks."""
    return members.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("size") / BUCKET)))


def copied(rows: DataFrame) -> DataFrame:
    """Rows once for each salt of their bucket."""
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / BUCKET) - 1)))


def still_mixed(members: DataFrame, stars: DataFrame) -> DataFrame:
    """The members, with their components' roots, of buckets that hold more than one component."""
    rooted = members.join(stars.select(F.col("a").alias("doc_id"), F.col("b").alias("root")), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    mixed = rooted.groupBy("bucket").agg(F.min("root").alias("r"), F.max("root").alias("s"), F.max("size").alias("size")).filter("r != s").select("bucket", "size")
    return cut(salted(rooted).join(copied(mixed).drop("size"), ["bucket", "salt"], "left_semi").drop("salt"), "mixed")


def may_link(similarity: int):
    """Whether x and y can be similar enough, by sizes and sketches: each bit that only one has is a shingle that only it has."""
    only = lambda a, b: sum((F.bit_count(F.col(f"{a}.sketch")[k].bitwiseAND(F.bitwise_not(F.col(f"{b}.sketch")[k]))) for k in range(SKETCH)), F.lit(0))
    n, m = F.col("x.n_shingles"), F.col("y.n_shingles")
    sizes = 100 * F.least(n, m) >= similarity * F.greatest(n, m)
    enough = lambda own, lost: (100 + similarity) * (own - lost) >= similarity * (n + m)
    return sizes & enough(n, only("x", "y")) & enough(m, only("y", "x"))


def fitting(pairs: DataFrame, similarity: int) -> DataFrame:
    """Pairs (a, b) whose set sizes n, m allow the similarity."""
    return pairs.filter(100 * F.least("n", "m") >= similarity * F.greatest("n", "m")).select("a", "b")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each group of near copies, the one of the smallest id, and one row of repeated ids."""
    found = near_duplicates(docs, **options)
    gone = cut(found.filter(~F.col("kept")).select("doc_id").distinct(), "gone")
    kept = docs.join(sized(gone), "doc_id", "left_anti")
    again = kept.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if again.limit(1).count():
        once = kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"])
        kept = kept.join(again, "doc_id", "left_anti").unionByName(once)
    return kept.select(docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=4)
