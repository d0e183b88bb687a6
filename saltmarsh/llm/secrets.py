"""Secret scans: two character Markov models, of random strings and of ordinary identifiers, compared by log-likelihood ratio.

Both models are trained from labelled samples of the corpus itself, of about SAMPLE documents chosen by a hash of the id. What
stands in a known secret pattern is labelled random. Ordinary are the text's words joined three by three in the usual
ways (camel case, snake case, kebab case, constants, paths, with a number), and the identifier-like runs made of words, numbers and
marks. A character's probability after another is backed by classes: lower case, capitals, digits and marks follow one
another in identifiers as they do in the samples, and within a class each character has its own frequency; so a language whose
letter pairs the samples don't have isn't random.

A run is judged by its best-scoring stretch; what is left of a run beside a pattern match is a run too.
Null and empty texts have no spans; a table without documents gives no rows; without any labelled sample the models are
uniform, and nothing but the patterns is found. Spans that start together (ties) are ordered by kind. Repeated rows are scanned one by one; very long texts are scanned
whole. Extra columns, of any name, are dropped by the query and kept by ``redact``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltmarsh.llm import _vec
from saltmarsh.llm._io import table

#: Fixed patterns of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "markov")
#: Runs that the models judge: identifier-like, of this length at least.
LEAST = 16
RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST)
#: Ordinary samples are shorter runs too.
SHORT = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % (LEAST * 3 // 4))
ORDINARY = re.compile(r"(?:[+/_=-]*(?:[A-Z]?[a-z]{3,}|[A-Z]{3,}|[0-9]{1,4}(?![0-9])))+[+/_=-]*")
#: Ordinary words, and the ways in which three of them make an identifier.
WORD = re.compile(r"[A-Za-z]{3,12}")
FORMS = (
    lambda a, b, c, n: a + b.capitalize() + c.capitalize(),
    lambda a, b, c, n: a.capitalize() + b.capitalize() + c.capitalize(),
    lambda a, b, c, n: f"{a}_{b}_{c}",
    lambda a, b, c, n: f"{a}-{b}-{c}",
    lambda a, b, c, n: f"/{a}/{b}/{c}",
    lambda a, b, c, n: f"{a}_{b}{n}",
    lambda a, b, c, n: f"{a}{b.capitalize()}{n}",
    lambda a, b, c, n: f"{a}-{n}-{b}",
    lambda a, b, c, n: a + b + c,
    lambda a, b, c, n: a[:4].upper() + b.capitalize() + c.capitalize(),
    lambda a, b, c, n: f"{a}_{b}_{c}".upper(),
)
#: Documents that training takes, about.
SAMPLE = 20_000
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-"
SIZE = len(ALPHABET) + 1  # the last state: the start
#: Classes of characters: lower case, capitals, digits, marks, the start.
CLASS = np.array([0] * 26 + [1] * 26 + [2] * 10 + [3] * (len(ALPHABET) - 62) + [4])
#: Weight of the classes in the ordinary model against the pairs seen, as a share of what a character was seen and in samples.
BACK, FEW = 0.2, 20
#: A stretch is random if the ratio's logarithm is at least this in all, and this for each character. Fewer than EDGE
#: characters beside it belong to it.
TOTAL, EACH, EDGE = 12.0, 1.0, 4

_code = np.full(128, 0, np.int64)
_code[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, kind, secret) of the pattern matches, code points, end exclusive; per kind leftmost, not overlapping."""
    found = [(m.start(), m.end(), 0, m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1, m[0]) for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), 2, m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def runs(text: str, taken: list[tuple[int, int, int, str]], pattern: re.Pattern = RUN) -> list[tuple[int, int]]:
    """Identifier-like runs outside of the pattern matches; digits alone are a number, not one."""
    if not taken:
        return [m.span() for m in pattern.finditer(text) if not m[0].isdigit()]
    out, at = [], 0
    for s, e in [*((s, e) for s, e, _, _ in taken), (len(text), len(text))]:
        out += [m.span() for m in pattern.finditer(text, at, max(at, s)) if not m[0].isdigit()]
        at = max(at, e)
    return out


def folded(run: str) -> str:
    """A run whose letters are all capitals as its lower-case form: capitals alone don't make it random."""
    return run.lower() if run.upper() == run else run


def pair_codes(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the strings' character pairs, the start with the first character included, and the strings' offsets."""
    codes = _code[np.frombuffer("".join(strings).encode("ascii"), np.uint8)]
    offsets = np.r_[0, np.cumsum([len(s) for s in strings])].astype(np.int64)
    before = np.empty_like(codes)
    before[1:] = codes[:-1]
    before[offsets[:-1]] = SIZE - 1
    return before * SIZE + codes, offsets


def identifiers(text: str) -> list[str]:
    """The text's words, three by three, as identifiers of all forms in turn."""
    words = [w.lower() for w in WORD.findall(text)]
    return [FORMS[k % len(FORMS)](*words[3 * k : 3 * k + 3], (7 * k + len(words)) % 1000) for k in range(len(words) // 3)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, SIZE * SIZE), np.int64)
    for part in (p for b in batches for p in _vec.chunks(b)):
        samples: tuple[list[str], list[str]] = ([], [])
        for text in part.column("text").to_pylist():
            if text:
                base = base_spans(text)
                samples[1].extend(folded(secret) for _, _, _, secret in base if len(secret) >= LEAST)
                own = (text[a:b] for a, b in runs(text, base, SHORT))
                samples[0].extend(folded(r) for r in own if r.isalpha() and r.islower() or ORDINARY.fullmatch(r))
                samples[0].extend(identifiers(text))
        for label in (0, 1):
            if samples[label]:
                counts[label] += np.bincount(pair_codes(samples[label])[0], minlength=SIZE * SIZE)
    label, pair = np.nonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(label.astype(np.int32)), pa.array(pair.astype(np.int32)), pa.array(counts[label, pair])], ["label", "pair", "n"])


def ratio_of(counts: np.ndarray) -> np.ndarray:
    """Logarithms of the ratio random : ordinary of each character after each other, from counts of shape (2, SIZE, SIZE).

    The random model is smoothed with the uniform distribution, with the weight of many samples, so that alphabets that
    no pattern shows count as random too; the ordinary one with the classes' sequence and the characters' frequencies in it.
    """
    random = (counts[1] + (1 + counts[1].sum() / SIZE) / SIZE) / (counts[1].sum(1, keepdims=True) + 1 + counts[1].sum() / SIZE)
    kinds = np.eye(5)[CLASS]  # (SIZE, 5)
    follow = kinds.T @ counts[0] @ kinds + FEW * kinds.sum(0) / SIZE
    follow /= follow.sum(1, keepdims=True)
    single = counts[0].sum(0) + FEW / SIZE
    single /= (kinds.T @ single)[CLASS]  # within the character's class
    backing = follow[CLASS][:, CLASS] * single
    seen = counts[0].sum(1, keepdims=True)
    ordinary = (counts[0] + (BACK * seen + 1) * backing) / (seen + BACK * seen + 1)
    return np.log(random) - np.log(ordinary)


def train(docs: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """``ratio_of`` the labelled samples of about ``sample`` documents."""
    n = docs.count()
    if n > sample:
        docs = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(1 << 20)) < int(sample / n * (1 << 20)))
    parts = docs.select("text").mapInArrow(_vec.tidied(_count), "label int, pair int, n long")
    counts = np.zeros((2, SIZE * SIZE))
    for row in parts.groupBy("label", "pair").agg(F.sum("n").alias("n")).collect():  # at most 2 * SIZE * SIZE rows
        counts[row.label, row.pair] = row.n
    return ratio_of(counts.reshape(2, SIZE, SIZE))


def random_runs(texts: list[str], bases: list[list], ratio: np.ndarray) -> list[list[tuple[int, int]]]:
    """For each text the best-scoring stretches of runs that are random rather than ordinary."""
    spans = [runs(t, b) if t else [] for t, b in zip(texts, bases, strict=True)]
    strings = [folded(t[a:b]) for t, own in zip(texts, spans, strict=True) for a, b in own]
    if not strings:
        return [[] for _ in texts]
    codes, offsets = pair_codes(strings)
    gain = ratio.reshape(-1)[codes]
    upto = np.r_[0.0, np.cumsum(gain)]
    found: list[tuple[int, int] | None] = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        sums = upto[a : b + 1]
        rise = sums - np.minimum.accumulate(sums)
        end = int(rise.argmax())
        start = int(sums[: end + 1].argmin())
        start, end = 0 if start < EDGE else start, b - a if end > b - a - EDGE else end
        enough = end - start >= LEAST and sums[end] - sums[start] >= max(TOTAL, EACH * (end - start))
        found.append((start, end) if enough else None)
    judged = iter(found)
    return [[(a + s[0], a + s[1]) for a, _ in own if (s := next(judged))] for own in spans]


def all_spans(texts: list[str], ratio: np.ndarray) -> Iterator[tuple[list, list]]:
    """For each text the pattern spans and all spans, as (start, end, kind, ...) in order."""
    bases = [base_spans(t) if t else [] for t in texts]
    for base, extra in zip(bases, random_runs(texts, bases, ratio), strict=True):
        yield base, sorted([s[:3] for s in base] + [(a, b, 3) for a, b in extra], key=lambda s: (s[0], s[2]))


def joined(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k, *_ in sorted(spans, key=lambda s: (s[0], s[2])))


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan(docs: DataFrame) -> DataFrame:
    """Every document's secrets: counts of the pattern kinds, a digest of their spans, and all spans with the models'."""
    ratio = train(docs)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in _vec.chunks(b)):
            counts: tuple[list[int], list[int], list[int]] = ([], [], [])
            digests, shown = [], []
            for base, spans in all_spans(part.column("text").to_pylist(), ratio):
                kinds = [s[2] for s in base]
                for k in range(3):
                    counts[k].append(kinds.count(k))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                shown.append(joined(spans))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(shown, pa.string())], [c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_vec.tidied(each), SCHEMA)


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The same rows and columns with every span in ``text`` replaced by ``mark``; overlapping spans become one."""
    ratio = train(docs)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in _vec.chunks(b)):
            place = part.schema.get_field_index("text")
            out = []
            texts = part.column(place).to_pylist()
            for text, (_, spans) in zip(texts, all_spans(texts, ratio), strict=True):
                parts, at, upto = [], 0, -1
                for a, b, _ in spans:
                    if a >= upto:
                        parts += [text[at:a], mark]
                    at = upto = max(upto, b)
                out.append("".join(parts) + text[at:] if spans else text)
            yield part.set_column(place, part.schema.field(place), pa.array(out, part.schema.field(place).type))

    return docs.mapInArrow(_vec.tidied(each), docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
