"""Vector code compression: product codes of integer vectors, with exact distances from limb-split GEMM.

A component x is the integer floor(256 * x). Vectors are cut into PARTS equal parts, each with a codebook of ENTRIES entries; ROUNDS
times the entries become the floored means of the parts assigned to them. Distances are |x|^2 - 2 x.c + |c|^2 in int64, where x.c is put
together from float64 BLAS products of limbs of LIMB bits, each sum of which stays under 2^53, so that nothing is rounded;
of equal distances the first entry is taken.

Rows whose vector is null, empty, or has null, NaN or infinite components are dropped, and so are those whose length isn't that of the smallest
kept vec_id's or isn't a multiple of PARTS. Integers beyond what squared distances in int64 allow (2^29 for parts of four components,
that is |x| of 2^21) are held at that bound. Of repeated vec_ids the smaller vector comes first; with fewer than ENTRIES vectors
codebooks are shorter; a table without vectors gives no rows; labels that are null are one label. Only ``vec_id``, ``embedding`` and
``label`` are read. The driver gets the first ENTRIES vectors and PARTS * ENTRIES sums a round, at any size of the table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saltmarsh.llm import _vec
from saltmarsh.llm._io import cut, sized, table

PARTS, ENTRIES, ROUNDS, SCALE, LIMB = 16, 64, 2, 256, 15
#: Components of vectors that are taken at once.
BLOCK = 1 << 18


def bound_for(width: int) -> int:
    """The largest integers for which ``width`` squared differences add up to less than 2^62."""
    return 1 << ((60 - (max(1, width) - 1).bit_length()) // 2)


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """x as a sum of limbs times powers of 2^LIMB, the low ones within +-2^(LIMB - 1); upper limbs that are all zero are left out."""
    out = []
    while True:
        upper = (x + (1 << (LIMB - 1))) >> LIMB
        out.append((x - (upper << LIMB)).astype(np.float64))
        if not upper.any():
            return out
        x = upper


def dots(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact x @ c.T of int64 matrices within ``bound_for`` their width."""
    step = 1 << (53 - 2 * LIMB)  # inner products of so many limbs stay under 2^53
    out = np.zeros((len(x), len(c)), np.int64)
    for at in range(0, x.shape[1], step):
        for i, a in enumerate(limbs(x[:, at : at + step])):
            for j, b in enumerate(limbs(c[:, at : at + step])):
                out += (a @ b.T).astype(np.int64) << (LIMB * (i + j))
    return out


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the first entry of c with the smallest squared distance, and this distance."""
    far = (x * x).sum(axis=1)[:, None] - 2 * dots(x, c) + (c * c).sum(axis=1)[None, :]
    best = far.argmin(axis=1)
    return best, far[np.arange(len(x)), best]


def kept_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array of double), label of rows with whole and finite vectors."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select("vec_id", v.alias("v"), "label").filter(F.col("v").isNotNull() & (F.size("v") > 0) & fine)


def blocks(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of a batch with their vectors as integers, (rows, components)."""
    if not batch.num_rows:
        return
    width = len(batch.column("v")[0])
    bound = bound_for(width // PARTS)
    step = max(1, BLOCK // width)
    for at in range(0, batch.num_rows, step):
        part = batch.slice(at, step)
        x = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        yield part, np.clip(np.floor(x * SCALE), -bound, bound).astype(np.int64)


def sums(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """part, entry, n, total (array): counts and sums of the parts nearest to each entry, a row for each task and entry that has some."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, width = books.shape
        n, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            for _, x in blocks(batch):
                for k in range(parts):
                    own = x[:, k * width : (k + 1) * width]
                    best, _ = nearest(own, books[k])
                    n[k] += np.bincount(best, minlength=entries)
                    np.add.at(total[k], best, own)
        at = np.nonzero(n)
        if len(at[0]):
            yield pa.RecordBatch.from_arrays([pa.array(at[0].astype(np.int32)), pa.array(at[1].astype(np.int32)), pa.array(n[at]), pa.array(total[at].tolist(), pa.list_(pa.int64()))], ["part", "entry", "n", "total"])

    return vectors.select("v").mapInArrow(_vec.tidied(each), "part int, entry int, n long, total array<long>")


def first_books(vectors: DataFrame, width: int, entries: int = ENTRIES) -> np.ndarray:
    """(parts, entries, width): the parts of the vectors of the smallest ids; ``entries`` rows come to the driver."""
    rows = vectors.orderBy("vec_id", "v").limit(entries).collect()
    bound = bound_for(width // PARTS)
    x = np.clip(np.floor(np.array([r.v for r in rows], np.float64) * SCALE), -bound, bound).astype(np.int64)
    return x.reshape(len(rows), PARTS, width // PARTS).swapaxes(0, 1).copy()


def trained(vectors: DataFrame, books: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks after some rounds; entries without parts stay."""
    for _ in range(rounds):
        each = sums(vectors, books).select("part", "entry", "n", F.posexplode("total").alias("at", "x"))
        total = each.groupBy("part", "entry", "at").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
        books = books.copy()
        for r in total.collect():  # one row for each component of the codebooks
            books[r.part, r.entry, r.at] = int(r.x) // int(r.n)
    return books


def encode(vectors: DataFrame, books: np.ndarray, label: T.DataType) -> DataFrame:
    """vec_id, label, code (two hex digits a part), error of every vector."""
    hexes = np.array([f"{k:02x}" for k in range(256)])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, _, width = books.shape
        for batch in batches:
            for part, x in blocks(batch):
                codes, error = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
                for k in range(parts):
                    codes[:, k], far = nearest(x[:, k * width : (k + 1) * width], books[k])
                    error += far
                text = ["".join(row) for row in hexes[codes].tolist()]
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), pa.array(text, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    schema = T.StructType([vectors.schema["vec_id"], T.StructField("label", label), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    return vectors.select("vec_id", "label", "v").mapInArrow(_vec.tidied(each), schema)


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every kept row."""
    schema = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
    kept = kept_vectors(vectors)
    first = kept.orderBy("vec_id", "v").select(F.size("v")).first()
    if first is None or first[0] % PARTS:
        return vectors.sparkSession.createDataFrame([], schema)
    kept = cut(kept.filter(F.size("v") == first[0]), "vectors")
    books = trained(kept, first_books(kept, first[0]), rounds)
    found = cut(encode(kept, books, kept.schema["label"].dataType), "codes")
    by_label = sized(cut(found.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "own"), "labels"))
    out = found.join(by_label, F.col("label").eqNullSafe(F.col("own")))
    return out.select(F.col("vec_id").cast("long").alias("vec_id"), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    """The same in SQL: one row for each vector, part and component; codebooks c0 to c2, assignments a1 to a3."""
    head = """
with k as (select vec_id, label, embedding as v from embeddings where embedding is not null and len(embedding) > 0
           and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
     x as (select vec_id, label, i // (len(v) // 16) as part, i % (len(v) // 16) as pos, cast(floor(256 * cast(v[i + 1] as double)) as bigint) as x
           from (select vec_id, label, v, unnest(range(len(v))) as i from k)),
     o as (select vec_id, row_number() over (order by vec_id) - 1 as entry from k order by vec_id limit 64),
     c0 as (select part, entry, pos, x as c from x join o using (vec_id))"""
    rounds = ""
    for k in range(1, ROUNDS + 2):
        rounds += f""",
     d{k} as (select vec_id, part, entry, sum((x.x - c.c) * (x.x - c.c)) as far from x join c{k - 1} c using (part, pos) group by all),
     a{k} as (select vec_id, part, entry, far from d{k} qualify row_number() over (partition by vec_id, part order by far, entry) = 1)"""
        if k <= ROUNDS:
            rounds += f""",
     s{k} as (select part, entry, pos, sum(x.x) as s, count(*) as n from x join a{k} using (vec_id, part) group by all),
     c{k} as (select part, entry, pos, case when n is null then c else (s - ((s % n) + n) % n) // n end as c from c{k - 1} left join s{k} using (part, entry, pos))"""
    last = ROUNDS + 1
    return f"""{head}{rounds},
     h as (select sha256(string_agg(cast(c as varchar), ',' order by part, entry, pos)) as codebooks_sha256 from c{ROUNDS}),
     e as (select vec_id, string_agg(lpad(format('{{:x}}', entry), 2, '0'), '' order by part) as code, sum(far) as error from a{last} group by vec_id)
select e.vec_id, code, cast(error as bigint) as error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256
from e join k using (vec_id), h
"""


ORACLE = _oracle()


def query(spark, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))
