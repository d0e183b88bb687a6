"""Byte-level BPE by prefix-sharing trie traversal.

The encoding of a prefix ends in one token, and what stands before it is the encoding of the rest: exactly one suffix of the
prefix is a token that may follow the last token before it. So every trie node needs no more than its last token. Sorted
distinct words are the trie in depth-first order; a word starts from what it shares with the word before, so prefixes
that words share are encoded once. Two tokens may follow one another if merging both strings' bytes ends in these two. Where
each token has one merge, of higher rank than those of its halves, this is told by undoing the merges at the border from the
last on: none of them may come after a merge across it. With other vocabularies the bytes are merged.

Texts are cut at single line ends and single spaces, where no pre-token can span; the pieces' ids are kept in a cache of bounded size
per worker, new pieces go through the pre-tokenizer's pattern and the trie. Texts with other white space or with special
tokens go through the pattern as a whole. Null and empty texts have no ids and decode to the empty text; repeated rows are
encoded one by one; very long texts are encoded whole; merges that tie go left to right, as the
library's do; an empty table gives no rows. Only ``doc_id`` and ``text`` are read by ``digest``.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltmarsh.llm import _vec
from saltmarsh.llm._io import table

#: Fixed value: the pre-tokenizer's public pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A worker's cached pieces (as many again from before), steps of the trie, and judgements whether a token may follow another:
#: about 30 MB of each at most.
PIECES, STEPS, FOLLOWS = 120_000, 100_000, 300_000
#: Texts that are encoded at once.
AT_ONCE = 200
#: Letters alone, with or without a space before: one word to the pattern.
#: A mark after them is the next word.
_WORD = re.compile("([ ]?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([,.;:!?])?")
#: White space that isn't a single space or line end between others.
_ODD = ("  ", " \n", "\n ", "\n\n", *"\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class TrieBpe:
    """Encodes and decodes with the vocabulary file of a byte-level BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letter = byte_letters()
        raw = lambda token: bytes(letter[c] for c in token)
        self.vocab = {raw(token): number for token, number in spec["model"]["vocab"].items()}
        self.bytes_of = {number: token for token, number in self.vocab.items()}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.ranks: dict[tuple[bytes, bytes], int] = {}
        for rank, (a, b) in enumerate(pairs):
            self.ranks.setdefault((raw(a), raw(b)), rank)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {number: content.encode() for content, number in self.special.items()}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.heads = {token[:end] for token, number in self.vocab.items() if number not in self.special.values() for end in range(1, len(token) + 1)}
        del spec, pairs
        top = max(self.bytes_of, default=-1) + 1
        self.sizes, self.said = [len(self.bytes_of.get(k, b"")) for k in range(top)], [str(k) for k in range(top)]
        self.whole: list[bool | None] = [None] * top  # whether a token's own bytes are merged into it, as far as it was asked
        self.halve(top)
        self.follows: dict[int, dict[int, bool]] = {}
        self.judged = 0
        self.forget_steps()
        self.pattern = regex.compile(PATTERN)
        self.pieces: dict[str, str] = {}
        self.before: dict[str, str] = {}
        self.id_bytes = {str(number): token for number, token in self.bytes_of.items()}

    def merged(self, raw: bytes) -> list[bytes]:
        """Plain merging, smallest rank first, leftmost first among equals."""
        parts = [raw[k : k + 1] for k in range(len(raw))]
        none = len(self.ranks)
        ranks = [self.ranks.get(pair, none) for pair in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) < none:
            k = ranks.index(least)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del ranks[k]
            if k:
                ranks[k - 1] = self.ranks.get((parts[k - 1], parts[k]), none)
            if k < len(ranks):
                ranks[k] = self.ranks.get((parts[k], parts[k + 1]), none)
        return parts

    def halve(self, top: int) -> None:
        """Of each token its merge's rank (-1: a byte) and halves, and the ranks by pairs of tokens; ``proper``: they tell what may follow."""
        self.rank_of, self.halves = [-1] * top, [(-1, -1)] * top
        self.pair_rank: dict[int, int] = {}
        self.proper = True
        for (a, b), rank in self.ranks.items():  # ascending
            left, right, both = self.vocab.get(a), self.vocab.get(b), self.vocab.get(a + b)
            if left is None or right is None or both is None or self.rank_of[both] >= 0 or any(len(x) > 1 and self.rank_of[n] < 0 for x, n in ((a, left), (b, right))):
                self.proper = False
                return
            self.rank_of[both], self.halves[both] = rank, (left, right)
            self.pair_rank[left << 32 | right] = rank

    def apart(self, a: int, b: int) -> bool:
        """Whether no merge across the border of two tokens comes before one that they are made by."""
        rank_of, halves, across = self.rank_of, self.halves, self.pair_rank.get
        limit = len(self.ranks)
        while True:
            rank = across(a << 32 | b)
            if rank is not None and rank < limit:
                return False
            if rank_of[a] > rank_of[b]:
                limit, a = rank_of[a], halves[a][1]
            elif rank_of[b] < 0:
                return True
            else:  # of equal merges the left one comes first
                limit, b = rank_of[b] + 1, halves[b][0]

    def is_whole(self, token: int) -> bool:
        if (found := self.whole[token]) is None:
            raw = self.bytes_of[token]
            found = self.whole[token] = self.merged(raw) == [raw] and (len(raw) == 1 or self.rank_of[token] >= 0)
        return found

    def judge(self, a: int, b: int) -> bool:
        """Whether token ``b`` may follow token ``a``."""
        if self.proper:
            return self.is_whole(a) and self.is_whole(b) and self.apart(a, b)
        a_bytes, b_bytes = self.bytes_of[a], self.bytes_of[b]
        return self.merged(a_bytes + b_bytes) == [a_bytes, b_bytes]

    def may_follow(self, a: int, b: int) -> bool:
        """``judge``, kept among the token's judgements."""
        if self.judged > FOLLOWS:
            for known in self.follows.values():
                known.clear()
                known[-1] = True
            self.judged = 0
        self.judged += 1
        found = self.follows[b][a] = self.judge(a, b)
        return found

    def forget_steps(self) -> None:
        """States are dicts from a byte to the next state and its tokens, filled as they are walked; at -1 stands a state's string."""
        self.root: dict = {-1: b""}
        self.states: dict[bytes, tuple[dict, list]] = {b"": (self.root, [])}
        self.filled = 0

    def step(self, state: dict, byte: int) -> tuple[dict, list[tuple[int, int, dict[int, bool]]]]:
        """The longest end of what was read that begins a token, and the tokens that it ends in, longest first, with their lengths and what they may follow (-1: nothing)."""
        path = state[-1] + bytes((byte,))
        while path and path not in self.heads:
            path = path[1:]
        if (found := self.states.get(path)) is None:
            tokens = [(self.vocab[path[k:]], len(path) - k) for k in range(len(path)) if path[k:] in self.vocab]
            found = self.states[path] = {-1: path}, [(token, size, self.follows.setdefault(token, {-1: True})) for token, size in tokens]
        state[byte] = found
        self.filled += 1
        return found

    def encode_words(self, words: list[str]) -> None:
        """Ids of distinct words into ``pieces``, in one depth-first walk of their trie."""
        may_follow, pieces, step, sizes, said = self.may_follow, self.pieces, self.step, self.sizes, self.said
        words = sorted(words)  # by code points, which is the order of their bytes
        todo = [w.encode() for w in words]
        room = max(map(len, todo), default=0) + 1
        last, states = [-1] * room, [self.root] * room  # of each prefix of the word at hand, its last token and the state
        held = b""
        for raw, word in zip(todo, words, strict=True):
            shared, top = 0, min(len(raw), len(held))
            while shared < top and raw[shared] == held[shared]:
                shared += 1
            state, end = states[shared], shared
            for byte in raw[shared:]:
                end += 1
                try:
                    state, ends = state[byte]
                except KeyError:
                    state, ends = step(state, byte)
                for token, size, known in ends:
                    try:
                        if known[last[end - size]]:
                            break
                    except KeyError:
                        if may_follow(last[end - size], token):
                            break
                last[end] = token
                states[end] = state
            held, ids = raw, []
            while end:
                token = last[end]
                ids.append(said[token])
                end -= sizes[token]
            pieces[word] = ",".join(ids[::-1])

    def add_pieces(self, missing: set[str]) -> None:
        """Ids of pieces; one that is a single word to the pattern is its own word, as every word is by itself."""
        missing.discard("")
        cut, word = {}, _WORD.fullmatch
        for piece in missing:
            if piece.isascii():  # the same as by the pattern of words
                stem = piece.rstrip(",.;:!?")
                marks = len(piece) - len(stem)
                if marks > 1 or not (stem[1:] if stem[:1] == " " else stem).isalpha():
                    cut[piece] = self.pattern.findall(piece)
                elif marks:
                    cut[piece] = stem, piece[-1]
            elif (m := word(piece)) is None:
                cut[piece] = self.pattern.findall(piece)
            elif m[2]:
                cut[piece] = m.groups()
        new = {w for own in cut.values() for w in own if w not in self.pieces} | missing.difference(cut)
        self.encode_words(list(new))
        for piece, own in cut.items():
            self.pieces[piece] = ",".join([self.pieces[w] for w in own])

    def plain(self, text: str) -> bool:
        return not any(map(text.__contains__, _ODD)) and text[:1] not in ("\n", " ") and text[-1:] not in ("\n", " ") and not any(s in text for s in self.special)

    def encode_batch(self, texts: list[str]) -> list[str]:
        """For each text its ids in decimal, joined by commas."""
        if len(self.pieces) > PIECES:
            self.pieces, self.before = {}, self.pieces
        if self.filled > STEPS:
            self.forget_steps()
        pieces, before = self.pieces, self.before
        cut = [t.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0") if t and self.plain(t) and "\0" not in t else None for t in texts]
        missing = set().union(*filter(None, cut)).difference(pieces)
        again = before.keys() & missing
        pieces.update(zip(again, map(before.__getitem__, again), strict=True))
        get = pieces.__getitem__
        gc.disable()  # many small tuples and lists that are kept, no cycles but among states
        try:
            self.add_pieces(missing.difference(again))
        finally:
            gc.enable()
        return [",".join(map(get, own)) if own else self.encode_odd(text) for text, own in zip(texts, cut, strict=True)]

    def encode_odd(self, text: str) -> str:
        """Any text: special tokens first, then the pattern over all the rest."""
        out = []
        for part in self.split_special.split(text) if self.split_special else [text]:
            if part in self.special:
                out.append(str(self.special[part]))
            elif part:
                words = self.pattern.findall(part)
                self.encode_words(list(set(words).difference(self.pieces)))
                out += [self.pieces[w] for w in words]
        return ",".join(out)

    def decode(self, ids: str) -> str:
        return b"".join(map(self.id_bytes.__getitem__, ids.split(","))).decode("utf-8", "replace") if ids else ""


_loaded: dict[str, TrieBpe] = {}


def coder(path: str) -> TrieBpe:
    """The coder of a vocabulary file, one per worker."""
    if path not in _loaded:
        _loaded[path] = TrieBpe(path)
    return _loaded[path]


def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[pa.Array, list[str], list[str]]]:
    """Ids of rows, their texts (null: empty) and these texts' token ids, AT_ONCE rows or a megabyte at a time."""
    own = coder(path)
    for batch in batches:
        for some in _vec.chunks(batch):
            for k in range(0, some.num_rows, AT_ONCE):
                part = some.slice(k, AT_ONCE)
                texts = [t or "" for t in part.column("text").to_pylist()]
                yield part.column("doc_id"), texts, own.encode_batch(texts)


def digest(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for doc_id, _, ids in _encoded(batches, path):
            counts = pa.array([i.count(",") + 1 if i else 0 for i in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([doc_id, counts, pa.array([sha(i) for i in ids]), pa.array([sha(coder(path).decode(i)) for i in ids])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_vec.tidied(each), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (array<int>), exact: whether the ids decode to the text, for every row; a null text counts as empty."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, texts, ids in _encoded(batches, path):
            arrays = [np.array(i.split(","), np.int32) if i else np.zeros(0, np.int32) for i in ids]
            sizes = np.array([len(a) for a in arrays], np.int64)
            lists = pa.ListArray.from_arrays(np.r_[0, np.cumsum(sizes)].astype(np.int32), np.concatenate(arrays))
            exact = [coder(path).decode(i) == t for i, t in zip(ids, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([doc_id, pa.array(sizes), lists, pa.array(exact, pa.bool_())], ["doc_id", "n_tokens", "ids", "exact"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_vec.tidied(each), "doc_id long, n_tokens long, ids array<int>, exact boolean")


def encode(docs: DataFrame, path: str, column: str = "ids") -> DataFrame:
    """The rows with an array of their text's ids as a further column."""
    import pandas as pd

    def ids(texts: pd.Series) -> pd.Series:
        return pd.Series([[int(i) for i in x.split(",")] if x else [] for x in coder(path).encode_batch([t or "" for t in texts])])

    ids.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return docs.withColumn(column, F.pandas_udf(ids, "array<int>")("text"))


def decode(encoded: DataFrame, path: str, column: str = "ids") -> DataFrame:
    """The rows with the text of ``column`` as ``decoded``."""
    import pandas as pd

    def text(ids: pd.Series) -> pd.Series:
        return pd.Series([coder(path).decode(",".join(map(str, x))) if x is not None else None for x in ids], dtype=object)

    text.__annotations__ = {"ids": pd.Series, "return": pd.Series}
    return encoded.withColumn("decoded", F.pandas_udf(text, "string")(column))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"), vocabulary())
