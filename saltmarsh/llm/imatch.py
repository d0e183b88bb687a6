"""Document fingerprints by I-Match: hashes of the sorted distinct terms of randomised lexicon subsets.

The lexicon has the terms whose document frequency lies in a band of inverse document frequencies, counted over all
documents; as a term of it occurs in a share LEAST of them at least, it has at most (mean distinct terms) / LEAST terms at
any input size. The lexicon subsets are fixed: SUBSETS of each rate 2^-level, one has a term by a hash of the term and the subset's
number, whatever text it stands in. A text's hash under a subset is that of the sequence of its sorted distinct terms that the subset has.
Of all rates a fingerprint has the three about that at which a subset has one of the text's terms: lower rates are empty
for it, and higher ones change with any edit; so long and short texts both get hashes that an edit may leave as they are.
The likeness of two fingerprints is the share of equal hashes among subsets that aren't empty for both, at the higher of both
texts' own levels.

Texts whose terms all lie outside the band are fingerprinted by the set of all their terms; texts without a word (null ones
too) by ``-``. The next document is by ascending doc_id (rows without an id first, equal ids by text), after the last the
first; a lone document is its own next. Very long texts are fingerprinted by all their terms; terms that tie in frequency are in the
band or not together; repeated rows are rows of their own; an empty table gives no rows. Only ``doc_id`` and ``text`` are read. Rows reach their neighbours in buckets dealt to tasks by range, each with the first row of
the next.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltmarsh.llm import _vec, ordered
from saltmarsh.llm._io import table

#: Shares of documents that a term of the lexicon occurs in.
LEAST, MOST = 3e-4, 3e-2
#: In small tables a term occurs in so many documents at least.
LEAST_DOCS = 2
#: Subsets at each rate, rates that a text is fingerprinted at, hexadecimal digits of a code.
SUBSETS, LEVELS, DIGITS = 40, 3, 8
_SALT = _vec.mix(np.arange(1, SUBSETS + 1, dtype=np.uint64))


def lexicon(docs: DataFrame, least: float = LEAST, most: float = MOST) -> np.ndarray:
    """Hashes of the terms within the band, in order."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _vec.Tally()

        def out(least_keys: int) -> Iterator[pa.RecordBatch]:
            found = tally.take(least_keys)
            for k in range(0, len(found[0]) if found else 0, 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(_vec.signed(found[0][k : k + 100_000])), pa.array(found[1][k : k + 100_000])], ["term", "n"])

        for batch in batches:
            for part in _vec.chunks(batch):
                words, at = _vec.word_hashes(part.column("text"))
                distinct = [np.unique(words[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                tally.add(np.concatenate(distinct))
                yield from out(tally.most)
        yield from out(0)

    total = docs.count()
    counted = docs.select("text").mapInArrow(_vec.tidied(each), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = counted.filter((F.col("n") >= max(LEAST_DOCS, least * total)) & (F.col("n") <= max(LEAST_DOCS, most * total))).select("term").toPandas()
    return np.sort(found["term"].to_numpy(np.int64).view(np.uint64))


def level_of(terms: int) -> int:
    """The level at which a subset keeps one of the terms or less, on average."""
    return terms.bit_length()


def subset_hashes(terms: np.ndarray, level: int) -> np.ndarray:
    """For each lexicon subset of rate 2^-level the hash of those of the sorted distinct ``terms`` that it has; 0 if it has none.

    The hash is a polynomial of the sequence: the k-th term counts with the k-th power of a constant.
    """
    kept = _vec.mix(terms[:, None] ^ _SALT)
    inside = (kept >> np.uint64(64 - level)) == 0 if level else np.ones(kept.shape, bool)
    place = np.cumsum(inside, axis=0)
    values = _vec.mix(terms + _POWERS[1])[:, None] * np.take(_powers_upto(len(terms)), place)
    sums = np.where(inside, values, np.uint64(0)).sum(axis=0, dtype=np.uint64)
    return np.where(place[-1] > 0, 1 + (_vec.mix(sums) % np.uint64(16**DIGITS - 1)).astype(np.int64), 0)


_POWERS = np.multiply.accumulate(np.r_[np.uint64(1), np.full(4096, 0x9E3779B97F4A7C15, np.uint64)])


def _powers_upto(n: int) -> np.ndarray:
    return _POWERS if n < len(_POWERS) else np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, _POWERS[1], np.uint64)])


def fingerprint(terms: np.ndarray, words: np.ndarray) -> str:
    """Of sorted distinct terms of the lexicon; of all sorted distinct words if there are none."""
    if not len(terms):
        return f"w{int(_vec.mix(words).sum(dtype=np.uint64)):016x}" if len(words) else "-"
    own = level_of(len(terms))
    levels = range(max(0, own - 1), own + LEVELS - 1)
    return f"{own:02d}|" + "|".join(f"{level:02d}" + subset_hashes(terms, level).astype(">u4").tobytes().hex() for level in levels)


def likeness(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if "|" not in a or "|" not in b:
        return 0.0
    level = max(a[:2], b[:2])
    x, y = (next((p[2:] for p in f.split("|")[1:] if p[:2] == level), None) for f in (a, b))
    if x is None or y is None:
        return 0.0
    x, y = np.frombuffer(bytes.fromhex(x), ">u4"), np.frombuffer(bytes.fromhex(y), ">u4")
    some = (x > 0) | (y > 0)
    return float(((x == y) & some).sum() / some.sum()) if some.any() else 0.0


def fingerprints(texts: list[str], slots: _vec.Slots) -> list[str]:
    words, at = _vec.word_hashes(pa.array(texts, pa.large_string()))
    inside = slots.find(words) >= 0
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        terms = np.unique(words[a:b][inside[a:b]])
        out.append(fingerprint(terms, terms if len(terms) else np.unique(words[a:b])))
    return out


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def neighbours(docs: DataFrame) -> DataFrame:
    """bucket, ghost, doc_id, text in order within partitions; each bucket ends with a ghost of the row after its last."""
    at = ordered.bounds(docs)
    own = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumn("bucket", ordered.bucket(at)).withColumn("at", F.coalesce("doc_id", F.lit(ordered.NO_ID)))
    firsts = own.groupBy("bucket").agg(F.min("at").alias("at")).orderBy("bucket").collect()  # a row per bucket
    before = docs.sparkSession.createDataFrame([(r.at, firsts[k - 1].bucket) for k, r in enumerate(firsts)], "at long, to int")
    heads = own.join(F.broadcast(before), "at").groupBy("at", "to").agg(F.min("text").alias("text"), F.min("doc_id").alias("doc_id"))
    ghosts = heads.select("doc_id", "text", F.col("to").alias("bucket"), F.lit(1).alias("ghost"))
    rows = own.select("doc_id", "text", F.col("bucket").cast("int").alias("bucket"), F.lit(0).alias("ghost")).union(ghosts)
    return rows.repartitionById(max(2, len(at) + 1), F.col("bucket")).sortWithinPartitions("bucket", "ghost", F.col("doc_id").asc_nulls_first(), "text")


def compare(docs: DataFrame, least: float = LEAST, most: float = MOST) -> DataFrame:
    """The fingerprint of every text, of its edited text, and their likenesses; see SCHEMA."""
    terms = docs.sparkSession.sparkContext.broadcast(lexicon(docs, least, most))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = _vec.Slots(terms.value)
        waiting: list[tuple[int, int | None, str]] = []  # rows whose next isn't there yet: one at most

        def out(rows: list) -> Iterator[pa.RecordBatch]:
            """``rows``: (ghost, doc_id, text); all but the last are given out with the row after."""
            own = fingerprints([t for _, _, t in rows], slots)
            edited = [t[: len(t) - len(t) // 4] + n[: len(t) // 4] for (_, _, t), (_, _, n) in zip(rows, rows[1:], strict=False)]
            changed = fingerprints(edited, slots)
            keep = [k for k in range(len(rows) - 1) if not rows[k][0]]
            if keep:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([rows[k][1] for k in keep], pa.int64()), pa.array([len(rows[k][2]) for k in keep], pa.int64()),
                        pa.array([hashlib.sha256(edited[k].encode()).hexdigest() for k in keep]), pa.array([own[k] for k in keep]), pa.array([changed[k] for k in keep]),
                        pa.array([likeness(own[k], changed[k]) for k in keep], pa.float64()), pa.array([likeness(own[k], own[k + 1]) for k in keep], pa.float64()),
                    ],
                    [x.split()[0] for x in SCHEMA.split(", ")],
                )

        for batch in batches:
            for part in _vec.chunks(batch):
                rows = waiting + list(zip(part.column("ghost").to_pylist(), part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True))
                waiting = rows[-1:]
                if len(rows) > 1:
                    yield from out(rows)

    return neighbours(docs).mapInArrow(_vec.tidied(each), SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    return compare(table(spark, sf_dir, "documents"))
