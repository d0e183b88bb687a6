"""Suffix-array dedup of exact repeated substrings, by a logarithmic family of suffix indexes.

A suffix is judged by its first ``length`` bytes, so it is a window of the text. Windows are dealt out by content: by the
smallest hash of the short grams that a window holds. Equal windows share it, so each task holds all suffixes that can
equal one another. Runs of successive windows with one smallest gram travel as one record. Records whose gram occurs in
no other record can't repeat; records that equal another as a whole repeat as a whole; only records whose gram occurs in
differing surroundings, one of each kind, are sent to the index with their bytes.

In a task each new batch of suffixes gets a suffix array (order: first eight bytes, then a 64-bit fingerprint of the whole
window), is scanned against the existing levels for windows they share, and joins the family as a level; levels of equal
size merge, so that n batches leave log n levels. A gram with very many surroundings is split by fingerprint over tasks.

The registered query also tells how many passages of more than WORDS words repeat, from a first search for strings of PASSAGE
bytes; a passage of fewer bytes than LENGTH stays in the text. Passages whose words have about four letters on average may
be shorter than PASSAGE and aren't counted.

Null and empty texts, and texts shorter than ``length``, have no windows and stay as they are. Repeated rows count as
occurrences of one another. Two different windows of equal 64-bit fingerprint would count as equal (2^-64 a pair).
Very long texts are cut into windows as all others; of strings that tie all occurrences are removed, the first too; an
empty table gives no rows. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltmarsh.llm import _vec
from saltmarsh.llm._io import cut, sized, table

#: Bytes of a repeated string, bytes of the grams by which windows are dealt, most windows of one record.
LENGTH, GRAM, RUN = 400, 32, 1024
#: Surroundings of one gram that one task takes; with more, its windows are split over up to SALTS tasks.
SURROUNDINGS, SALTS = 4000, 64
#: Windows of one task's index.
WINDOWS_A_TASK = 2_000_000
#: Bytes of the repeated strings that make up passages, and the words that a passage has more of.
PASSAGE, WORDS = 256, 50


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` successive numbers, from running minima of blocks in both directions."""
    n = len(x) - width + 1
    pad = -len(x) % width
    blocks = np.concatenate([x, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    forth = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], forth[width - 1 : width - 1 + n])


def runs_of(data: np.ndarray, offsets: np.ndarray, length: int, gram: int, most: int = RUN):
    """(row, gram hash, first window, number of windows, hash of all their bytes, own) for all runs, as arrays.

    ``own`` says that the smallest gram stands in the run more than once, so that windows of one run can be equal.
    """
    n, reach = len(data) - length + 1, length - gram
    none = np.zeros(0, np.int64)
    empty = none, none.astype(np.uint64), none, none, none.astype(np.uint64), none.astype(bool)
    if n <= 0:
        return empty
    rolling = _vec.Rolling(data)
    hashes = rolling.windows(gram)
    least = sliding_min(hashes, reach + 1)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    inside = np.arange(n) + length <= offsets[row + 1]
    new = np.ones(n, bool)
    new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
    new |= ~inside
    start = np.flatnonzero(new & inside)
    if not len(start):
        return empty
    stop = np.append(np.flatnonzero(new), n)
    count = stop[np.searchsorted(stop, start, "right")] - start
    own = np.zeros(len(start), bool)
    highest = ~sliding_min(~np.concatenate([np.zeros(reach, np.uint64), least, np.zeros(reach, np.uint64)]), reach + 1)
    chosen = np.flatnonzero(hashes == highest)  # each gram that is the smallest of some window
    value = hashes[chosen]
    twice = np.flatnonzero((value[1:] == value[:-1]) & (chosen[1:] - chosen[:-1] <= reach))
    if len(twice):
        lo = np.searchsorted(start + count, chosen[twice + 1] - reach, "right")
        hi = np.maximum(lo, np.searchsorted(start, chosen[twice], "right"))
        run = np.arange((hi - lo).sum()) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
        own[run[least[start[run]] == np.repeat(value[twice], hi - lo)]] = True
    if count.max() > most:  # e.g. one letter, again and again
        parts = -(-count // most)
        at = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        start, own = np.repeat(start, parts) + at * most, np.repeat(own, parts)
        count = np.minimum(np.repeat(count, parts) - at * most, most)
    return row[start], least[start], start, count, rolling.ranges(start, start + count + length - 1), own


def records(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """key, gram, start, count, whole, own for every run of windows; ``key`` names a document's id and text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _vec.chunks(batch):
                data, offsets = _vec.buffers(part.column("text"))
                row, least, start, count, whole, own = runs_of(data, offsets, length, gram)
                key = part.column("key").to_numpy(zero_copy_only=False)[row].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(_vec.signed(least)), pa.array((start - offsets[row]).astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(_vec.signed(whole)), pa.array(own)], ["key", "gram", "start", "count", "whole", "own"])

    return docs.mapInArrow(_vec.tidied(each), "key long, gram long, start int, count int, whole long, own boolean")


def with_bytes(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """gram, salt, salts, key, start, count, bytes for the wanted records, each ``salts`` times."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("gram", pa.int64()), ("salt", pa.int32()), ("salts", pa.int32()), ("key", pa.int64()), ("start", pa.int32()), ("count", pa.int32()), ("bytes", pa.binary())])
        for batch in batches:
            rows, size = [], 0
            for key, text, parts in zip(batch.column("key").to_pylist(), batch.column("text"), batch.column("parts").to_pylist(), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                for p in parts:
                    cutout = raw[p["start"] : p["start"] + p["count"] + length - 1]
                    for salt in range(p["salts"]):
                        rows.append((p["gram"], salt, p["salts"], key, p["start"], p["count"], cutout))
                        size += len(cutout)
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    by_doc = cut(wanted.groupBy("key").agg(F.collect_list(F.struct("gram", "start", "count", "salts")).alias("parts")), "wanted")
    joined = docs.select("key", "text").join(sized(by_doc), "key")
    return joined.mapInArrow(_vec.tidied(each), "gram long, salt int, salts int, key long, start int, count int, bytes binary")


class SuffixLevels:
    """The logarithmic family: levels of suffixes sorted by (head, fingerprint), with each suffix's number."""

    def __init__(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.hits: list[np.ndarray] = []
        self.total = 0

    def add(self, head: np.ndarray, mark: np.ndarray) -> None:
        """A new batch: sort it, scan it against all levels, and merge levels of about one size."""
        now = self.ordered(head, mark, np.arange(self.total, self.total + len(head)))
        self.total += len(head)
        for level in self.levels:
            self.scan(level, now)
        self.levels.append(now)
        while len(self.levels) > 1 and len(self.levels[-2][0]) <= 2 * len(self.levels[-1][0]):
            b, a = self.levels.pop(), self.levels.pop()
            self.levels.append(self.ordered(*(np.concatenate([x, y]) for x, y in zip(a, b, strict=True))))

    def ordered(self, head: np.ndarray, mark: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted suffixes, one of each kind: of equal ones all are hits, and the first stays."""
        order = np.lexsort((mark, head))
        head, mark, number = head[order], mark[order], number[order]
        same = (head[1:] == head[:-1]) & (mark[1:] == mark[:-1])
        if same.any():
            self.hits += [number[1:][same], number[:-1][same]]
            first = np.r_[True, ~same]
            head, mark, number = head[first], mark[first], number[first]
        return head, mark, number

    def scan(self, level: tuple, batch: tuple) -> None:
        """Hits among a level and a batch: walk the level's suffixes of the same head up to the fingerprint."""
        at = np.searchsorted(level[0], batch[0])
        end = np.searchsorted(level[0], batch[0], "right")
        lo, hi = at.copy(), end.copy()
        todo = np.flatnonzero(lo < hi)
        while len(todo):  # binary search by fingerprint between suffixes of equal heads
            mid = (lo[todo] + hi[todo]) // 2
            below = level[1][mid] < batch[1][todo]
            lo[todo[below]], hi[todo[~below]] = mid[below] + 1, mid[~below]
            todo = todo[lo[todo] < hi[todo]]
        found = np.flatnonzero(lo < end)
        found = found[level[1][lo[found]] == batch[1][found]]
        self.hits += [level[2][lo[found]], batch[2][found]]

    def repeated(self) -> np.ndarray:
        marks = np.zeros(self.total, bool)
        for numbers in self.hits:
            marks[numbers] = True
        return marks


def repeats(pieces: DataFrame, length: int) -> DataFrame:
    """key, first, last (exclusive) bytes covered by windows that repeat among the records of their gram, and once more, as
    ``across``, those that repeat in another key."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, records = SuffixLevels(), []
        for batch in batches:
            for part in _vec.chunks(batch, "bytes"):
                column = part.column("bytes").cast(pa.large_binary())
                offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
                data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
                offsets = offsets - offsets[0]
                count, salt, salts, key, start = (part.column(c).to_numpy(zero_copy_only=False) for c in ("count", "salt", "salts", "key", "start"))
                owner = np.repeat(np.arange(len(count)), count)
                step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                at = offsets[:-1][owner] + step
                mark = _vec.Rolling(data).ranges(at, at + length)
                mine = (mark >> np.uint64(40)).astype(np.int64) % salts[owner] == salt[owner]
                owner, step, at, mark = owner[mine], step[mine], at[mine], mark[mine]
                head = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))[at].astype(np.uint64)
                family.add(head, mark)
                records.append((key[owner], (start[owner] + step).astype(np.int32), mark))
        if not records:
            return
        hit = family.repeated()
        key, start, mark = (np.concatenate(x)[hit] for x in zip(*records, strict=True))
        if not len(key):
            return
        order = np.lexsort((key, mark))  # windows of one mark have several keys if the first and the last of them differ
        head = np.flatnonzero(np.r_[True, mark[order][1:] != mark[order][:-1]])
        tail = np.r_[head[1:], len(order)] - 1
        several = np.zeros(len(key), bool)
        several[order] = np.repeat(key[order][head] != key[order][tail], tail - head + 1)
        for across in (False, True):
            own, at = (key[several], start[several]) if across else (key, start)
            order = np.lexsort((at, own))
            own, at = own[order], at[order]
            if len(own):
                first = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (at[1:] > at[:-1] + length)])
                last = np.r_[first[1:], len(own)] - 1
                yield pa.RecordBatch.from_arrays([pa.array(own[first]), pa.array(at[first]), pa.array(at[last] + np.int32(length)), pa.array(np.full(len(first), across))], ["key", "first", "last", "across"])

    return pieces.mapInArrow(_vec.tidied(each), "key long, first int, last int, across boolean")


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """key, first, last: byte spans (end exclusive, they may overlap) of repeated strings, and whether they are known to repeat
    ``across`` keys. ``docs`` has key and text."""
    found = cut(records(docs, length, gram), "windows")
    grams = found.groupBy("gram").agg(F.count("*").alias("n"), F.max("own").alias("own")).filter("n > 1 or own").select("gram", "own")
    several = cut(found.drop("own").join(sized(cut(grams, "grams")), "gram"), "several")
    kinds = cut(several.groupBy("gram", "whole").agg(F.count("*").alias("n"), F.max("own").alias("own"), F.min(F.struct("key", "start", "count")).alias("one"), (F.min("key") != F.max("key")).alias("across")), "kinds")
    wholly = sized(cut(kinds.filter("n > 1").select("gram", "whole", "across"), "wholly"))
    twice = several.join(wholly, ["gram", "whole"])
    spans = twice.select("key", F.col("start").alias("first"), (F.col("start") + F.col("count") + length - 1).alias("last"), "across")
    mixed = kinds.groupBy("gram").agg(F.count("*").alias("kinds"), F.max("own").alias("own")).filter("kinds > 1 or own")
    mixed = cut(mixed.select("gram", F.least(F.lit(SALTS), F.ceil(F.col("kinds") / SURROUNDINGS)).cast("int").alias("salts")), "mixed")
    # One record of each kind: others with the same bytes repeat as a whole and are in ``spans`` already.
    wanted = cut(kinds.join(sized(mixed), "gram").select("gram", "salts", "one.*"), "pieces")
    pieces = with_bytes(docs, wanted, length)
    windows = wanted.agg(F.sum(F.col("count").cast("long"))).first()[0] or 0
    parts = max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-windows // WINDOWS_A_TASK))
    indexed = repeats(pieces.repartition(parts, "gram", "salt"), length)
    return spans.union(indexed)


def removed(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, text, spans: every row with the merged spans of its text's bytes that repeat, null if there are none."""
    docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))
    spans = repeated_spans(docs.select("key", "text"), length, gram)
    return docs.join(sized(by_key(spans, "spans")), "key", "left").select("doc_id", "text", "spans")


def kept_bytes(raw: bytes, spans: list[dict] | None) -> tuple[bytes, int, int]:
    """What is left, how many bytes went, and in how many maximal runs."""
    if not spans:
        return raw, 0, 0
    parts, at, runs = [], 0, merged(spans)
    for a, b in runs:
        parts.append(raw[at:a])
        at = b
    return b"".join(parts) + raw[at:], sum(b - a for a, b in runs), len(runs)


def deduplicated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary): a cut may fall inside a character, so bytes are returned."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _vec.chunks(batch):
                rows = []
                for text, spans in zip(part.column("text"), part.column("spans").to_pylist(), strict=True):
                    raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                    rows.append((len(raw), *kept_bytes(raw, spans)))
                size, kept, gone, runs = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return removed(docs.select(F.col("doc_id").cast("long"), "text"), length, gram).mapInArrow(_vec.tidied(each), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Spans in order of their starts as maximal runs."""
    out: list[list[int]] = []
    for s in spans:
        if out and s["first"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s["last"])
        else:
            out.append([s["first"], s["last"]])
    return [(a, b) for a, b in out]


def runs_from(texts: DataFrame, length: int) -> DataFrame:
    """key, at, text: the bytes of each text's merged ``spans`` of ``length`` bytes at least, with where they start."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _vec.chunks(batch):
                rows = []
                for key, text, spans in zip(part.column("key").to_pylist(), part.column("text"), part.column("spans").to_pylist(), strict=True):
                    raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                    rows += [(key, a, raw[a:b]) for a, b in merged(spans) if b - a >= length]
                key, at, cutouts = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(at, pa.int32()), pa.array(cutouts, pa.binary())], ["key", "at", "text"])

    return texts.select("key", "text", "spans").mapInArrow(_vec.tidied(each), "key long, at int, text binary")


def by_key(spans: DataFrame, name: str, *more: str) -> DataFrame:
    return cut(spans.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("first", "last", *more))).alias(name)), name)


def with_passages(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, passage: int = PASSAGE, words: int = WORDS) -> DataFrame:
    """The columns of ``deduplicated`` and n_passages: maximal runs of strings of ``passage`` bytes that repeat in other documents
    and hold more than ``words`` words, removed or not. ``passage`` isn't longer than ``length``.

    Strings of ``passage`` bytes are found first. A longer repeated string lies within one of their runs, so only runs of
    ``length`` bytes at least go on to the search for strings of ``length`` bytes.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64(F.col("doc_id").cast("long"), "text").alias("key"))
    runs = by_key(repeated_spans(docs.select("key", "text"), passage, gram), "spans", "across")
    texts = runs_from(docs.join(sized(runs), "key"), length).withColumnRenamed("key", "doc").withColumn("key", F.xxhash64("doc", "at"))
    parts = cut(texts, "runs")
    found = repeated_spans(parts.select("key", "text"), length, gram).join(parts.select("key", "doc", "at").distinct(), "key")
    gone = by_key(found.select(F.col("doc").alias("key"), (F.col("first") + F.col("at")).alias("first"), (F.col("last") + F.col("at")).alias("last")), "gone")
    both = cut(runs.join(gone, "key", "left"), "both")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _vec.chunks(batch):
                rows = []
                for text, spans, gone in zip(part.column("text"), part.column("spans").to_pylist(), part.column("gone").to_pylist(), strict=True):
                    raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                    kept, n_removed, n_spans = kept_bytes(raw, gone)
                    rows.append((len(raw), n_removed, n_spans, sum(len(raw[a:b].split()) > words for a, b in merged([x for x in spans or [] if x["across"]])), kept))
                size, removed, n, passages, kept = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x, pa.int64()) for x in (size, removed, n, passages)), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "n_passages", "kept"])

    joined = docs.join(sized(both), "key", "left").select("doc_id", "text", "spans", "gone")
    return joined.mapInArrow(_vec.tidied(each), "doc_id long, n_bytes long, n_removed long, n_spans long, n_passages long, kept binary")


def query(spark, sf_dir: str) -> DataFrame:
    out = with_passages(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passages")
