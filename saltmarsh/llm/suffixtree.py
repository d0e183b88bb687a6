"""LM scoring with a probabilistic suffix tree over bytes, beside a smoothed unigram of words.

A text is read as its lower-cased words, a space after each, and one end byte. The tree's contexts have up to DEPTH bytes. A
context stays if its next-byte distribution diverges from its suffix's: n * KL >= DIVERGENCE (nats); suffixes of what stays
stay too. Distributions are smoothed with their suffix's: each count gives up DISCOUNT, P(s | c) = (count - DISCOUNT + slack
* P(s | suffix of c)) / n, where the slack is all that was given up. A byte is scored in its longest suffix state, and a
text's score is the sum over its bytes: no word counts enter it. Every counted context is judged, however rare.

Contexts of up to WIDE - 1 bytes (2^24 pairs at most) are held by the driver. All deeper ones are dealt to tasks by their last
WIDE bytes, so that each task holds whole branches; it values every gram that any document has, seen in training or not.
Values of grams of a share COMMON of the training bytes (1 / COMMON at most) are broadcast; all others reach the documents
by a join. In the same way words of a share FREQUENT of all tokens are broadcast for the unigram, whose counts are exact and by
64-bit hashes of the words.

Null and empty texts are the end token alone. Without training documents the base is uniform over one type and the tree
gives every byte 1/256. Repeated rows train and are scored one by one. Very long texts are
scored whole, half a megabyte or one text at a time; counts that tie are kept or dropped by the same test; an empty table gives no rows.
Only ``doc_id`` and ``text`` are read, so further columns of any name may be there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltmarsh.llm import _vec
from saltmarsh.llm._io import cut, table
from saltmarsh.llm._trees import Scorer

DEPTH, DIVERGENCE, DISCOUNT, FREQUENT = 5, 1.0, 0.75, 4e-6
#: Bytes of the grams that the driver holds, and of a context by which branches are dealt to tasks.
WIDE = 3
#: Share of the training bytes from which a gram's value is broadcast, and grams of a task's branches.
COMMON, GRAMS_A_TASK = 1e-7, 1_000_000
FOLDS = 10
ALPHA = 0.1
END, SPACE = 10, 32
#: The end token's place among the hashes of words.
END_HASH = np.uint64(1)


def fold(folds: int = FOLDS):
    return F.crc32(F.col("doc_id").cast("string")) % folds


def normalised(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows' lower-cased words, a space after each, and an end byte after each row; with the rows' offsets."""
    rows = len(at) - 1
    sizes = ends - starts + 1
    row_of = np.repeat(np.arange(rows), np.diff(at))
    target = np.cumsum(sizes) - sizes + row_of
    total = int(sizes.sum()) + rows
    out = np.full(total, SPACE, np.uint8)
    source = np.repeat(starts - target, sizes - 1)
    place = np.repeat(target - (np.cumsum(sizes - 1) - (sizes - 1)), sizes - 1) + np.arange(int((sizes - 1).sum()))
    out[place] = data[place + source]
    words_upto = np.r_[0, np.cumsum(sizes)][at]
    offsets = words_upto + np.arange(rows + 1)
    out[offsets[1:] - 1] = END
    return out, offsets


def prepared(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens, the rows' offsets among them, the normalised bytes, the tokens' offsets in them."""
    data, offsets = _vec.buffers(column)
    data = _vec.lowered(data)
    starts, ends, at = _vec.word_spans(data, offsets)
    rows = len(at) - 1
    tokens, sizes = np.full(len(starts) + rows, END_HASH), np.ones(len(starts) + rows, np.int64)
    place = np.arange(len(starts)) + np.repeat(np.arange(rows), np.diff(at))
    tokens[place], sizes[place] = _vec.Rolling(data).ranges(starts, ends), ends - starts + 1
    return tokens, at + np.arange(rows + 1), normalised(data, starts, ends, at)[0], np.r_[0, np.cumsum(sizes)]


def low(width: int) -> np.uint64:
    return np.uint64((1 << (8 * width)) - 1)


def located(own: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys' places in the sorted ``own``, and whether they are there."""
    if not len(own):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
    return at, own[at] == keys


def counts(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """kind (0: word, 1: gram of depth + 1 bytes), item, n over all rows; rows that are held out give their grams only, as n = 0."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies = _vec.Tally(), _vec.Tally()

        def out(kind: int, least: int) -> Iterator[pa.RecordBatch]:
            found = tallies[kind].take(least)
            if found is not None:
                for k in range(0, len(found[0]), 100_000):
                    keys, n = found[0][k : k + 100_000], found[1][k : k + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(_vec.signed(keys)), pa.array(n)], ["kind", "item", "n"])

        for batch in batches:
            for part in _vec.chunks(batch):
                tokens, at, data, offsets = prepared(part.column("text"))
                held = part.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
                grams, of_gram = _vec.grams(data, offsets[at], depth + 1, END), np.repeat(held, np.diff(offsets[at]))
                tallies[0].add(tokens[~np.repeat(held, np.diff(at))])
                tallies[1].add(grams[~of_gram])
                if held.any():
                    new = np.unique(grams[of_gram])
                    tallies[1].add(new, np.zeros(len(new), np.int64))
                for kind in (0, 1):
                    yield from out(kind, tallies[kind].most)
        for kind in (0, 1):
            yield from out(kind, 0)

    held_out = F.coalesce("held_out", F.lit(False)) if "held_out" in docs.columns else F.lit(False)
    parts = docs.select("text", held_out.alias("held_out")).mapInArrow(_vec.tidied(each), "kind int, item long, n long")
    return parts.groupBy("kind", "item").agg(F.sum("n").alias("n"))


def gram_levels(counted: DataFrame, total: int, depth: int = DEPTH) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each number of bytes from depth + 1 down to 1 all grams in order and their counts, ``total`` in sum, on the driver."""
    item = F.col("item").bitwiseAND(F.lit((1 << (8 * (depth + 1))) - 1)).alias("item")
    widest = counted.filter("kind = 1 and n > 0").select(item, "n").groupBy("item").agg(F.sum("n").alias("n")).toPandas() if total else None
    now = _vec.unique_counts(*((widest["item"].to_numpy(np.int64).view(np.uint64), widest["n"].to_numpy(np.int64)) if total else (np.zeros(0, np.uint64), np.zeros(0, np.int64))))
    levels = [now]
    for width in range(depth, 0, -1):
        levels.append(_vec.unique_counts(levels[-1][0] & low(width), levels[-1][1]))
    return levels


def smoothed(keys: np.ndarray, n: np.ndarray, lower: np.ndarray, discount: float) -> tuple[np.ndarray, ...]:
    """Of all pairs of context and byte of one width: the contexts, the pairs' places among them, their smoothed
    probabilities, the contexts' divergences, and what leaving a context for a shorter one adds."""
    context, place = np.unique(keys >> np.uint64(8), return_inverse=True)
    whole = np.bincount(place, n, len(context))
    off = np.minimum(discount, n)
    slack = np.bincount(place, off, len(context))
    p = (n - off + slack[place] * lower) / whole[place]
    less = np.minimum(discount, n - 1)  # each occurrence is judged by all others
    others = (n - 1 - less + (slack[place] - off + less) * lower) / np.maximum(whole[place] - 1, 1)
    gain = np.bincount(place, np.where(whole[place] > 1, n * np.log(np.maximum(others, 1e-9 * lower) / lower), 0.0), len(context))
    return context, place, p, gain, np.log10(slack / whole)


def branch(keys: np.ndarray, n: np.ndarray, upper: tuple[np.ndarray, np.ndarray], depth: int, wide: int, divergence: float = DIVERGENCE, discount: float = DISCOUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For grams that hold all branches of some contexts of ``wide`` bytes: their scores in the branches' states, whether
    they go on to the contexts that are shorter, and whether the branch stays at all. ``upper`` has the pairs of ``wide`` bytes."""
    levels, now = {}, _vec.unique_counts(keys[n > 0], n[n > 0])
    for width in range(depth + 1, wide, -1):
        levels[width] = now = _vec.unique_counts(now[0] & low(width), now[1])
    exact, found = {wide: upper}, {}
    for width in range(wide + 1, depth + 2):
        own, seen = levels[width]
        found[width] = smoothed(own, seen.astype(float), Tree.lookup(exact[width - 1], own & low(width - 1)), discount)
        exact[width] = own, found[width][2]
    states, need = {}, np.zeros(0, np.uint64)
    for width in range(depth + 1, wide, -1):
        context, _, _, gain, leave = found[width]
        on = (gain >= divergence) | np.isin(context, need)
        states[width] = context[on], leave[on]
        need = np.unique(context[on] & low(width - 2))
    score, more, todo = np.zeros(len(keys)), np.ones(len(keys), bool), np.arange(len(keys))
    for width in range(depth + 1, wide, -1):
        now = keys[todo] & low(width)
        state, inside = located(states[width][0], now >> np.uint64(8))
        pair, seen = located(exact[width][0], now)
        done, left = inside & seen, inside & ~seen
        score[todo[done]] += np.log10(exact[width][1][pair[done]])
        more[todo[done]] = False
        score[todo[left]] += states[width][1][state[left]]
        todo = todo[~done]
    stays = located(states[wide + 1][0], (keys >> np.uint64(8)) & low(wide))[1] if depth >= wide else np.zeros(len(keys), bool)
    return score, more, stays


def branches(counted: DataFrame, upper: tuple[np.ndarray, np.ndarray], grams: int, depth: int = DEPTH, wide: int = WIDE) -> DataFrame:
    """item, n, p, more, stays of all grams, those held out too, as ``branch`` has them."""
    spark = counted.sparkSession
    shared = spark.sparkContext.broadcast(upper)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column("item").to_numpy(), b.column("n").to_numpy()) for b in batches if b.num_rows]
        if parts:
            items, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            found = branch(items.view(np.uint64), n, shared.value, depth, wide)
            for k in range(0, len(items), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[k : k + 100_000]) for x in (items, n, *found)], ["item", "n", "p", "more", "stays"])

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-grams // GRAMS_A_TASK))
    ends = F.shiftrightunsigned("item", 8).bitwiseAND(F.lit(int(low(wide))))
    return counted.filter("kind = 1").select("item", "n").repartition(tasks, ends).mapInArrow(_vec.tidied(each), "item long, n long, p double, more boolean, stays boolean")


class Tree:
    """The retained contexts by length, their smoothed distributions, and the scorer made from them. ``need``: contexts of
    the greatest length that stay in any case, as deeper ones do."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]], total: int, divergence: float = DIVERGENCE, discount: float = DISCOUNT, need: np.ndarray | None = None):
        depth = len(levels) - 1
        by_width = {depth + 1 - k: (keys, n.astype(float)) for k, (keys, n) in enumerate(levels)}
        unknown = -np.log10(256.0)
        keys, n = by_width[1]
        top = (n + 1 / 256) / (total + 1)
        self.exact = {1: (keys, top)}  # by width: smoothed probabilities, whether the context stays or not
        found = {}
        for width in range(2, depth + 2):
            keys, n = by_width[width]
            found[width] = smoothed(keys, n, self.lookup(self.exact[width - 1], keys & low(width - 1)), discount)
            self.exact[width] = keys, found[width][2]
        stay: dict[int, np.ndarray] = {}
        need = np.zeros(0, np.uint64) if need is None else need
        for width in range(depth + 1, 1, -1):
            context, gain = found[width][0], found[width][3]
            stay[width] = (gain >= divergence) | np.isin(context, need)
            need = np.unique(context[stay[width]] & low(width - 2))
        self.kept = {0: 1, **{w - 1: int(on.sum()) for w, on in stay.items()}}
        # A pair's score is that of its longest state: with a context that stays its own, else that of the shorter context.
        self.final = {1: (by_width[1][0], np.log10(top))}
        self.states = {1: (np.zeros(1, np.uint64), np.array([-np.log10(total + 1.0)]))}
        for width in range(2, depth + 2):
            context, place, p, _, out = found[width]
            self.states[width] = context[stay[width]], out[stay[width]]
            keys, scores = by_width[width][0], np.log10(p)
            gone = ~stay[width][place]
            scores[gone] = self.walk(self.final, self.states, keys[gone], width - 1, unknown)
            self.final[width] = keys, scores
        steps = []
        for width in range(depth + 1, 0, -1):
            steps.append((self.final[width][0], self.final[width][1][:, None].astype(np.float32), self.states[width][0], self.states[width][1][:, None].astype(np.float32)))
        self.scorer = Scorer(steps, np.array([unknown], np.float32), END)

    @staticmethod
    def lookup(exact, keys):
        """Smoothed probability of each pair under the shorter context; it is there, as its count is no smaller."""
        own, p = exact
        at = np.minimum(np.searchsorted(own, keys), max(0, len(own) - 1))
        hit = own[at] == keys if len(own) else np.zeros(len(keys), bool)
        return np.where(hit, p[at] if len(own) else 0, 1 / 256)

    @staticmethod
    def walk(final, states, keys, width, unknown):
        """Scores of pairs from ``width`` bytes on downwards, as the scorer takes them."""
        out, todo = np.zeros(len(keys)), np.arange(len(keys))
        for w in range(width, 0, -1):
            now = keys[todo] & np.uint64((1 << (8 * w)) - 1)
            own, score = final[w]
            at = np.minimum(np.searchsorted(own, now), max(0, len(own) - 1))
            hit = own[at] == now if len(own) else np.zeros(len(now), bool)
            out[todo[hit]] += score[at[hit]]
            todo, now = todo[~hit], now[~hit] >> np.uint64(8)
            context, leave = states[w]
            if len(context):
                at = np.minimum(np.searchsorted(context, now), len(context) - 1)
                out[todo] += np.where(context[at] == now, leave[at], 0)
        out[todo] += unknown
        return out


SUMMARY = "row long, doc_id long, held_out boolean, n_tokens long, known long, logs double, score double, words array<long>, grams array<struct<item:long,tail:double>>"


def score(docs: DataFrame, folds: int = FOLDS, depth: int = DEPTH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row."""
    docs = docs.select(F.col("doc_id").cast("long"), "text", (fold(folds) == 0).alias("held_out"))
    counted = cut(counts(docs, depth), "counts")
    sums = {r.kind: r for r in counted.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    tokens, types = (sums[0].n, sums[0].v) if 0 in sums else (0, 0)
    letters, wide = sums[1].n if 1 in sums else 0, min(WIDE, depth + 1)
    words = counted.filter((F.col("kind") == 0) & (F.col("n") >= max(1.0, FREQUENT * tokens))).toPandas()  # at most 1 / FREQUENT rows
    levels = gram_levels(counted, letters, wide - 1)  # at most 2^24 of the widest
    unknown, least = -np.log10(256.0), max(1.0, COMMON * letters)
    values = cut(branches(counted, Tree(levels, letters).exact[wide], sums[1].v if 1 in sums else 0, depth, wide), "values")
    need = values.filter("stays").select(F.shiftrightunsigned("item", 8).bitwiseAND(F.lit(int(low(wide - 1)))).alias("c")).distinct().toPandas()  # at most 2^16 rows
    tree = Tree(levels, letters, need=need["c"].to_numpy(np.int64).view(np.uint64))
    upper = tree.final, tree.states
    often = values.filter(F.col("n") >= least).select("item", "p", "more").toPandas()  # at most 1 / COMMON rows
    keys = often["item"].to_numpy(np.int64).view(np.uint64)
    worth = often["p"].to_numpy(float) + np.where(often["more"].to_numpy(bool), Tree.walk(*upper, keys, wide, unknown), 0.0)
    model = docs.sparkSession.sparkContext.broadcast((_vec.Slots(words["item"].to_numpy().view(np.uint64)), np.append(words["n"].to_numpy(float), 1.0), _vec.Slots(keys), np.append(worth, 0.0), upper))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, frequent, common, worth, upper = model.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in _vec.chunks(batch):
                hashes, at, data, offsets = prepared(part.column("text"))
                rows, ends = part.num_rows, offsets[at]
                place = slots.find(hashes)
                known = place >= 0
                logs = np.where(known, np.log10(frequent[place] + ALPHA), 0.0)
                grams = _vec.grams(data, ends, depth + 1, END)
                gram = common.find(grams)
                rare = gram < 0
                far = grams[rare]
                lists = pa.ListArray.from_arrays(np.r_[0, np.cumsum(~known)][at].astype(np.int32), pa.array(_vec.signed(hashes[~known])))
                tails = pa.StructArray.from_arrays([pa.array(_vec.signed(far)), pa.array(Tree.walk(*upper, far, wide, unknown))], ["item", "tail"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + rows)), part.column("doc_id"), part.column("held_out"), pa.array(np.diff(at)), pa.array(_vec.row_sums(known.astype(float), at).astype(np.int64)), pa.array(_vec.row_sums(logs, at)), pa.array(_vec.row_sums(worth[gram], ends)), lists, pa.ListArray.from_arrays(np.r_[0, np.cumsum(rare)][ends].astype(np.int32), tails)],
                    ["row", "doc_id", "held_out", "n_tokens", "known", "logs", "score", "words", "grams"],
                )
                row += rows

    summary = cut(docs.mapInArrow(_vec.tidied(each), SUMMARY), "summary")
    others = counted.filter(f"kind = 0 and n < {max(1.0, FREQUENT * tokens)}").select("item", "n")
    found = summary.select("row", F.explode("words").alias("item")).join(others, "item", "left").groupBy("row").agg(F.count("n").alias("more"), F.sum(F.log10(F.coalesce(F.col("n"), F.lit(0)) + ALPHA)).alias("gain"))
    grams = summary.select("row", F.explode("grams").alias("g")).select("row", "g.item", "g.tail").join(values.filter(F.col("n") < least).select("item", "p", "more"), "item")
    rest = grams.groupBy("row").agg(F.sum(F.col("p") + F.when(F.col("more"), F.col("tail")).otherwise(0.0)).alias("rest"))
    base = F.col("logs") + F.coalesce("gain", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(tokens + ALPHA * (types + 1)))
    out = summary.drop("words", "grams").join(found, "row", "left").join(rest, "row", "left")
    return out.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") + F.coalesce("rest", F.lit(0.0))).alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
