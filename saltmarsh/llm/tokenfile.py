"""Token-ID output: each document's ids compressed alone under a shared zstandard dictionary.

A file set is a Parquet table of shard records: ``dictionary`` (sha256 of the dictionary), the records' documents in
ascending doc_id order with their ids' counts and the offsets of their frames, and ``payload``, the frames one after
another. A document is read by its offset alone. The dictionary is one more small file beside them. It is trained on the
serialized ids of a bounded sample of documents (DICTIONARY_DOCS of up to SAMPLE_CHARS characters, by a hash of the id).
Spark's writer commits the files, so a lost executor leaves no half-written shard.

Ids come from the tokenizers library. No token spans ASCII white space under the pre-tokenizer stated here, so each
distinct piece between white space is encoded once per worker, up to a cache of bounded size. Null and empty texts have the end id
alone; rows without an id come first; repeated ids follow one another, ordered by text hash; an empty table gives no records. Very long texts
are one record as all others; further columns, of any name, aren't read. Ids are two bytes wide where all of the vocabulary's fit
(up to 65,536), else four; the file set states the width and the vocabulary's hash, and is read by the width it states. Pieces are put together only
under the normaliser and pre-tokenizer stated here (NORMALIZER, PRE_TOKENIZER); with any others each text is encoded as a whole.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from saltmarsh.llm import _vec, ordered
from saltmarsh.llm._io import shared_dir, table

#: Fixed value of the contract: the id after each document.
END_ID = 1
DICTIONARY_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES, LEVEL = 2_000, 20_000, 64 << 10, 1
#: Bytes of frames of a shard record, cached pieces of a worker (as many again from before).
SHARD, CACHE = 4 << 20, 300_000
#: Ids of a piece from which it is packed as an array.
LONG = 64
_loaded: dict = {}
#: Letters of ASCII and Latin-1, composed, and marks after them: normalisation only lowers the letters, and letters and marks
#: are a pre-token each. Apostrophes may begin one with the letters after, so they are left out.
SIMPLE = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-&(-/:-@\[-`{-~]*)")
#: The marks that may stand after letters there.
MARKS = bytes(b for b in range(33, 127) if b != 39 and not chr(b).isalnum())
#: The normaliser and pre-tokenizer under which pieces between white space may be encoded one by one.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: The vocabulary's letters for the bytes that aren't printable in Latin-1.
LETTERS = {b: 256 + k for k, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b))}


def steps(tokenizer: Tokenizer) -> tuple[bool, str]:
    """Whether pieces between white space may be encoded one by one, and the type of ids that holds all of the vocabulary's."""
    own = json.loads(tokenizer.to_str())
    plain = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in own["added_tokens"])
    by_piece = plain and own["normalizer"] == NORMALIZER and own["pre_tokenizer"] == PRE_TOKENIZER and own["post_processor"] is None
    return by_piece, "<u2" if max(tokenizer.get_vocab().values(), default=0) < 1 << 16 else "<u4"


class Known(dict):
    """Serialized ids by piece. A piece that isn't there is looked for among those from before, or learnt."""

    def __init__(self, learn: Callable[[bytes], bytes], before: dict[bytes, bytes]):
        super().__init__()
        self.learn, self.before = learn, before

    def __missing__(self, piece: bytes) -> bytes:
        found = self.before.get(piece)
        if found is None:
            found = self.learn(piece)
        self[piece] = found
        return found


class Pieces:
    """Ids of texts, by their pieces between ASCII white space where the vocabulary's own steps allow it."""

    def __init__(self, path: str, stated: tuple[bool, str] | None = None):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenize = self.tokenizer.model.tokenize
        self.by_piece, self.width = stated or steps(self.tokenizer)
        self.packs = [struct.Struct(f"<{n}{'H' if self.width == '<u2' else 'I'}").pack for n in range(LONG)]
        self.known = Known(self.learn, {})

    def encode(self, texts: list[bytes], end: int = END_ID) -> list[bytes]:
        """Serialized ids of each text, the end id last."""
        if not self.by_piece:
            return [np.array([*self.tokenizer.encode(t.decode(), add_special_tokens=False).ids, end], self.width).tobytes() for t in texts]
        if len(self.known) > CACHE:
            self.known.before = {}
            self.known = Known(self.learn, self.known)
        last, get = np.array([end], self.width).tobytes(), self.known.__getitem__
        gc.disable()  # a million small lists and strings, no cycles
        try:
            return [b"".join(map(get, t.split())) + last for t in texts]
        finally:
            gc.enable()

    def learn(self, piece: bytes) -> bytes:
        """Ids of a new piece; one of letters with marks after them is put together from its lowered letters and its marks."""
        if (word := piece.rstrip(MARKS)).isalpha():  # ASCII alone; the same as below without the pattern
            if len(word) < len(piece):
                return self.known[word.lower()] + self.known[piece[len(word) :]]
            if (lower := piece.lower()) != piece:
                return self.known[lower]
            return self.packed(piece.decode())
        if (m := SIMPLE.fullmatch(piece)) is None:
            return np.array(self.tokenizer.encode(piece.decode(), add_special_tokens=False).ids, self.width).tobytes()
        stem, tail = m.groups()
        letters = stem.decode().lower()
        if tail:
            return self.known[letters.encode()] + self.known[tail]
        if (low := letters.encode()) != piece:
            return self.known[low]
        return self.packed(piece.decode("latin-1").translate(LETTERS))

    def packed(self, letters: str) -> bytes:
        """Ids of a pre-token, given in the vocabulary's letters for its bytes."""
        ids = [t.id for t in self.tokenize(letters)]
        return self.packs[len(ids)](*ids) if len(ids) < LONG else np.array(ids, self.width).tobytes()


def pieces_of(path: str, stated: tuple[bool, str] | None = None) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path, stated)
    return _loaded[path]


def train_dictionary(docs: DataFrame, path: str, docs_most: int = DICTIONARY_DOCS, size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary of the sample's serialized ids; empty if there is too little to train on."""
    short = docs.filter(F.length("text").between(1, SAMPLE_CHARS))
    n = short.count()
    if n > docs_most:
        short = short.filter(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20)) < int(docs_most / n * (1 << 20)))
    samples = pieces_of(path).encode([r.text.encode() for r in short.select("text").limit(2 * docs_most).collect()])
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def frames(docs: DataFrame, path: str, dictionary: bytes, at: list[int]) -> DataFrame:
    """bucket, doc_id, tie, n, frame for every row. The driver looks at the vocabulary's steps once, for all tasks."""
    driver = pieces_of(path)
    stated = driver.by_piece, driver.width

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces_of(path, stated)
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if shared:
            shared.precompute_compress(level=LEVEL)
        zip_ = zstandard.ZstdCompressor(dict_data=shared) if shared else zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            for part in _vec.chunks(batch):
                raw = own.encode([t.as_buffer().to_pybytes() if t.is_valid else b"" for t in part.column("text")])
                width = np.dtype(own.width).itemsize
                yield pa.RecordBatch.from_arrays([part.column("bucket"), part.column("doc_id"), part.column("tie"), pa.array([len(r) // width for r in raw], pa.int64()), pa.array([zip_.compress(r) for r in raw], pa.binary())], ["bucket", "doc_id", "tie", "n", "frame"])

    dealt = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("tie")).withColumn("bucket", ordered.bucket(at))
    return dealt.mapInArrow(_vec.tidied(each), "bucket int, doc_id long, tie long, n long, frame binary")


SHARDS = "bucket int, part int, first long, dictionary string, doc_ids array<long>, counts array<long>, offsets array<long>, payload binary"


def shards(rows: DataFrame, name: str, limit: int = SHARD) -> DataFrame:
    """Shard records from rows in order by bucket and doc_id; ``first`` counts the bucket's ids before a record."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("first", pa.int64()), ("dictionary", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("payload", pa.binary())])
        ids: list = []
        counts: list[int] = []
        parts: list[bytes] = []
        now, number, first, size = None, 0, 0, 0

        def record() -> pa.RecordBatch:
            offsets = np.r_[0, np.cumsum([len(p) for p in parts])].tolist()
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, (now, number, first, name, ids, counts, offsets, b"".join(parts)), strict=True))], schema)

        for batch in batches:
            for bucket, doc_id, n, frame in zip(*(batch.column(c).to_pylist() for c in ("bucket", "doc_id", "n", "frame")), strict=True):
                if ids and (bucket != now or size >= limit):
                    yield record()
                    number, first = (number + 1, first + sum(counts)) if bucket == now else (0, 0)
                    ids, counts, parts, size = [], [], [], 0
                now = bucket
                ids.append(doc_id)
                counts.append(n)
                parts.append(frame)
                size += len(frame)
        if ids:
            yield record()

    return rows.mapInArrow(_vec.tidied(each), SHARDS)


def write(docs: DataFrame, path: str, to: str) -> None:
    """Write the ids of ``docs`` under the folder ``to``: shards/ and dictionary/."""
    dictionary = train_dictionary(docs, path)
    at = ordered.bounds(docs)
    rows = frames(docs, path, dictionary, at)
    parts = max(2, len(at) + 1)
    dealt = rows.repartitionById(parts, F.col("bucket")).sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first(), "tie")
    name = hashlib.sha256(dictionary).hexdigest()
    with open(path, "rb") as f:
        vocabulary = hashlib.file_digest(f, "sha256").hexdigest()
    stated = [(name, bytearray(dictionary), np.dtype(pieces_of(path).width).itemsize, vocabulary)]
    docs.sparkSession.createDataFrame(stated, "dictionary string, bytes binary, width int, vocabulary string").write.parquet(f"{to}/dictionary")
    shards(dealt.drop("tie"), name).write.option("compression", "uncompressed").parquet(f"{to}/shards")


def dictionaries_of(spark: SparkSession, to: str) -> tuple[dict[str, bytes], str]:
    """The file set's dictionary by its hash, which is computed anew and must be the one in its name, and the type of its ids."""
    stated = spark.read.parquet(f"{to}/dictionary").collect()  # one row of bounded size
    found = {r.dictionary: bytes(r.bytes) for r in stated}
    for name, raw in found.items():
        if hashlib.sha256(raw).hexdigest() != name:
            raise ValueError(f"the dictionary in {to} isn't the one its documents were compressed with")
    return found, f"<u{stated[0].width}"


def read_document(spark: SparkSession, to: str, doc_id: int) -> list[list[int]]:
    """The ids of one document (a list for each row of that id): only its shard records are read, and only its frame is decompressed."""
    dictionaries, width = dictionaries_of(spark, to)
    held = spark.read.parquet(f"{to}/shards").filter(F.array_contains("doc_ids", F.lit(doc_id).cast("long")))
    at = F.filter(F.transform("doc_ids", lambda d, i: F.when(d == doc_id, i)), lambda i: i.isNotNull())
    frame = lambda i: F.expr("payload").substr(F.element_at("offsets", i + 1).cast("int") + 1, (F.element_at("offsets", i + 2) - F.element_at("offsets", i + 1)).cast("int"))
    out = []
    for r in held.select("bucket", "part", "dictionary", F.transform(at, frame).alias("frames")).orderBy("bucket", "part").collect():
        shared = zstandard.ZstdCompressionDict(dictionaries[r.dictionary]) if dictionaries[r.dictionary] else None
        unzip = zstandard.ZstdDecompressor(dict_data=shared) if shared else zstandard.ZstdDecompressor()
        out += [np.frombuffer(unzip.decompress(bytes(f)), width).tolist() for f in r.frames]
    return out


def read(spark: SparkSession, to: str, ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids (binary, little-endian of 32 bits) and their checksum of every document of a file set.

    Without ``ids`` they are read and checked as well, but stay in the tasks' workers: they are several times the size of the file set.
    """
    dictionaries, width = dictionaries_of(spark, to)
    written = spark.read.parquet(f"{to}/shards")
    totals = written.groupBy("bucket").agg(F.sum(F.expr("aggregate(counts, 0L, (a, x) -> a + x)")).alias("n")).orderBy("bucket").collect()  # a row per bucket
    begin, upto = {}, 0
    for r in totals:
        begin[r.bucket], upto = upto, upto + r.n

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, first, name, doc_ids, counts, offsets, payload in zip(*(batch.column(c).to_pylist() for c in ("bucket", "first", "dictionary", "doc_ids", "counts", "offsets", "payload")), strict=True):
                shared = zstandard.ZstdCompressionDict(dictionaries[name]) if dictionaries[name] else None
                unzip = zstandard.ZstdDecompressor(dict_data=shared) if shared else zstandard.ZstdDecompressor()
                view, starts = memoryview(payload), begin[bucket] + first + np.r_[0, np.cumsum(counts)[:-1]]
                for k in range(0, len(doc_ids), 200):
                    raw = [np.frombuffer(unzip.decompress(view[a:b]), width).astype("<u4").tobytes() for a, b in zip(offsets[k : k + 200], offsets[k + 1 : k + 201], strict=False)]
                    found = [pa.array(doc_ids[k : k + 200], pa.int64()), pa.array(starts[k : k + 200], pa.int64()), pa.array([len(r) // 4 for r in raw], pa.int64()), pa.array([zlib.crc32(r) for r in raw], pa.int64())]
                    yield pa.RecordBatch.from_arrays(found + [pa.array(raw, pa.binary())] * ids, names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * ids
    names = [c.split()[0] for c in schema.split(", ")]
    return written.mapInArrow(_vec.tidied(each), schema)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = f"{shared_dir(spark)}/saltmarsh-ids-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "documents"), vocabulary(), to)
    return read(spark, to, ids=False)
