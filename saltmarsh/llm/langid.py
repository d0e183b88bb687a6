"""Language ID by prediction by partial matching: per-language byte context trees of variable order with escapes.

Each language has counts of bytes after contexts of up to ORDER bytes, frozen after training. A byte after a context with
n occurrences of d different bytes has probability c / (n + d); a byte that never followed it escapes with d / (n + d) to
the context shorter by one; below the empty one all 256 bytes are alike. A text's code length in a language is the exact
sum of its bytes' under these statistics (without exclusions). The language of the shortest code is predicted.

Training is a classifier's fit on a bounded sample: labelled documents, about SAMPLE of them, chosen by a hash of the id.
Every gram of the sample counts. Null texts and texts without a letter are ``und`` with score 0; without
labelled documents every text is ``und``. Ties go to the language first in order. Repeated rows are judged one by one; very
long texts are scored whole; an empty table gives no rows. Of the documents only ``doc_id``, ``text`` and, in training, ``lang`` are read; ``keep_languages``
gives back all columns, of any name, as they were.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltmarsh.llm import _vec
from saltmarsh.llm._io import fresh, table
from saltmarsh.llm._trees import Scorer

if TYPE_CHECKING:
    import pandas as pd

ORDER, PAD = 3, 10
#: Documents that training takes, about.
SAMPLE = 10_000
FOLDS = 5
#: Documents with a lower score are rejected by ``keep_languages``, and those of LONG bytes at least whose shortest code takes more
#: than MOST_BITS a byte: an unmodelled byte takes eight, texts of learned languages two to four.
LEAST_SCORE, MOST_BITS, LONG = 0.5, 6.0, 64
_LETTER = re.compile(r"[^\W\d_]")


def fold(folds: int = FOLDS):
    return F.crc32(F.col("doc_id").cast("string")) % folds


def _count(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tallies: dict[str, _vec.Tally] = {}

    def out(lang: str, found: tuple[np.ndarray, np.ndarray] | None) -> Iterator[pa.RecordBatch]:
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found[0]), pa.string()), pa.array(_vec.signed(found[0])), pa.array(found[1])], ["lang", "gram", "n"])

    for batch in frames:
        for part in _vec.chunks(batch):
            data, offsets = _vec.buffers(part.column("text"))
            keys = _vec.grams(data, offsets, ORDER + 1, PAD)
            langs = part.column("lang").to_pylist()
            for lang in set(langs):
                mine = np.repeat(np.array([x == lang for x in langs]), np.diff(offsets))
                tally = tallies.setdefault(lang, _vec.Tally())
                tally.add(keys[mine])
                yield from out(lang, tally.take(tally.most))
    for lang, tally in tallies.items():
        yield from out(lang, tally.take())


def train(docs: DataFrame, sample: int = SAMPLE, folds: int = FOLDS) -> tuple[list[str], Scorer | None]:
    """The languages in order, and the scorer of code lengths in bits. The fold 0 is held out."""
    labelled = docs.filter((fold(folds) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    n = labelled.count()
    if n > sample:
        labelled = labelled.filter(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) < int(sample / n * (1 << 20)))
    counted = labelled.select("text", "lang").mapInArrow(_vec.tidied(_count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return build(counted.toPandas())  # at most a row for each byte of the sample


def build(found: pd.DataFrame) -> tuple[list[str], Scorer | None]:
    """Scorer from rows of (lang, gram, n), grams of ORDER + 1 bytes."""
    langs = sorted(found["lang"].unique())
    if not langs:
        return langs, None
    levels: list[list[tuple[np.ndarray, np.ndarray]]] = []  # by order, then by language: pairs and counts
    for width in range(ORDER + 1, 0, -1):
        own = []
        for lang in langs:
            f = found[found["lang"] == lang]
            own.append(_vec.unique_counts(f["gram"].to_numpy().view(np.uint64) & np.uint64((1 << (8 * width)) - 1), f["n"].to_numpy()))
        levels.append(own)
    steps, shorter, unknown = [], None, np.full(len(langs), 8.0, np.float32)
    for own in reversed(levels):  # the shortest contexts first: longer ones escape to them
        pairs = np.unique(np.concatenate([k for k, _ in own]))
        contexts = np.unique(pairs >> np.uint64(8))
        values, leave = np.zeros((len(pairs), len(langs)), np.float32), np.zeros((len(contexts), len(langs)), np.float32)
        at = np.searchsorted(contexts, pairs >> np.uint64(8))
        for k, (keys, counts) in enumerate(own):
            place = np.searchsorted(contexts, keys >> np.uint64(8))
            n, d = np.bincount(place, counts, len(contexts)), np.bincount(place, minlength=len(contexts))
            leave[:, k] = np.where(d > 0, -np.log2(np.maximum(d, 1) / np.maximum(n + d, 1)), 0)
            below = unknown[k] if shorter is None else shorter(pairs & np.uint64((1 << (8 * (len(steps)))) - 1), k)
            values[:, k] = leave[at, k] + below
            values[np.searchsorted(pairs, keys), k] = -np.log2(counts / (n + d)[place])
        steps.append((pairs, values, contexts, leave))
        shorter = _Shorter(list(steps), unknown)
    return langs, Scorer(steps[::-1], unknown, PAD)


class _Shorter:
    """Code lengths of pairs under the orders built so far."""

    def __init__(self, steps: list, unknown: np.ndarray):
        self.steps, self.unknown = steps[::-1], unknown

    def __call__(self, pairs: np.ndarray, k: int) -> np.ndarray:
        out, todo = np.zeros(len(pairs), np.float32), np.arange(len(pairs))
        for j, (keys, values, contexts, leave) in enumerate(self.steps):
            own = pairs[todo] & np.uint64((1 << (8 * (len(self.steps) - j))) - 1)
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            hit = keys[at] == own
            out[todo[hit]] += values[at[hit], k]
            todo, own = todo[~hit], own[~hit] >> np.uint64(8)
            at = np.minimum(np.searchsorted(contexts, own), len(contexts) - 1)
            out[todo] += np.where(contexts[at] == own, leave[at, k], 0)
        out[todo] += self.unknown[k]
        return out


def predictions(langs: list[str], bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and score of the shortest code: its share among 2^-bits of all languages."""
    best = bits.argmin(axis=1)
    return best, 1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)


def predict(docs: DataFrame, langs: list[str], scorer: Scorer | None, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every row, then lang_pred, score and bits (of the shortest code a byte, null for short texts);
    underscores stand before these if ``keep`` has such names."""
    fields = docs.select(*keep).schema.fields
    kept = [f.name for f in fields]
    names = [fresh(docs.select(*keep), n) for n in ("lang_pred", "score", "bits")]
    own = [F.col(c).alias(f"k{i}") for i, c in enumerate(kept)]
    schema = ", ".join(f"k{i} {f.dataType.simpleString()}" for i, f in enumerate(fields))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _vec.chunks(batch):
                lettered = [bool(t and _LETTER.search(t)) for t in part.column("text").to_pylist()]
                label, score = ["und"] * len(lettered), np.zeros(len(lettered))
                data, offsets = _vec.buffers(part.column("text"))
                sizes, fit = np.diff(offsets), np.zeros(len(lettered))
                if scorer is not None:
                    lengths = scorer.sums(data, offsets)
                    best, share = predictions(langs, lengths)
                    fit = lengths.min(axis=1) / np.maximum(sizes, 1)
                    label = [langs[b] if ok else "und" for b, ok in zip(best.tolist(), lettered, strict=True)]
                    score = np.where(lettered, share, 0.0)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(label, pa.string()), pa.array(score, pa.float64()), pa.array(fit, pa.float64(), mask=sizes < LONG)], [*(f"k{i}" for i in range(len(kept))), "lang_pred", "score", "bits"])

    out = docs.select("text", *own).mapInArrow(_vec.tidied(each), f"{schema}, lang_pred string, score double, bits double")
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(kept)), F.col("lang_pred").alias(names[0]), F.col("score").alias(names[1]), F.col("bits").alias(names[2]))


def identify(docs: DataFrame, sample: int = SAMPLE, folds: int = FOLDS) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row."""
    langs, scorer = train(docs, sample, folds)
    held = docs.select(F.col("doc_id").cast("long"), "text", (fold(folds) == 0).alias("held_out"))
    return predict(held, langs, scorer, ["doc_id", "held_out"]).drop("bits")


def keep_languages(docs: DataFrame, least: float = LEAST_SCORE, sample: int = SAMPLE, most: float = MOST_BITS) -> DataFrame:
    """The rows, in their columns, whose text has a learned language: not ``und``, of a score that isn't too low, nor in a code that is too long."""
    langs, scorer = train(docs, sample)
    found = predict(docs, langs, scorer, docs.columns)
    label, score, bits = found.columns[-3:]
    return found.filter((F.col(label) != "und") & (F.col(score) >= least) & (F.coalesce(bits, F.lit(0.0)) <= most)).select(docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
