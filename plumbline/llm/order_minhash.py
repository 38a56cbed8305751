"""Order MinHash: fingerprints that follow the edit distance of texts.

Every k-mer of code points is numbered by how often it has come before in its text, so
repeats count. For each of ``ROWS`` random orders the ``TUPLE`` smallest numbered k-mers
are chosen, put back into the order in which the text has them, and hashed together. Two
texts agree in a row only if they share those k-mers and their order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch, record_batches, rows_of, texts

K = 8
ROWS = 32
TUPLE = 2
SEED = 20240607
#: Up to this many k-mers all orders are worked out in one matrix; beyond, one by one.
MATRIX = 8192
_BASE = np.uint64(0x9E3779B97F4A7C15)

_ODD = np.random.default_rng(SEED).integers(0, 2**63, size=4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values, as the last step of a common hash does."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)


def numbered_kmers(codes: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each (k-mer, occurrence) and the position of each; a shorter text is one k-mer."""
    n = max(1, len(codes) - k + 1) if len(codes) else 0
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = np.zeros(n, np.uint64)
    for i in range(min(k, len(codes))):
        h = h * _BASE + codes[i : n + i] + np.uint64(1)
    bits = np.uint64(int(n).bit_length())
    # Sorted by hash, then by position, which takes the lowest bits of the same word.
    order = np.sort((_mix(h) >> bits << bits) | np.arange(n, dtype=np.uint64))
    kmer, at = order >> bits, (order & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    index = np.arange(n)
    first = np.ones(n, bool)
    first[1:] = kmer[1:] != kmer[:-1]
    seen = index - np.maximum.accumulate(np.where(first, index, 0))
    return _mix((kmer << bits) + seen.astype(np.uint64) * _BASE), at


def _smallest(x: np.ndarray, odd: np.ndarray, size: int) -> np.ndarray:
    """Indices of the ``size`` smallest values of ``x * odd[i]`` for every i, unordered."""
    n = len(x)
    if n <= size:
        return np.tile(np.arange(n), (len(odd), 1))
    limit = np.uint64(min(2**64 - 1, int(2**64 * (16 * size / n)))) if n > 16 * size else None
    if limit is not None and n <= MATRIX:
        values = np.multiply.outer(odd, x)
        row, col = np.nonzero(values < limit)
        held = np.bincount(row, minlength=len(odd))
        if held.min() >= size:
            order = np.lexsort((values[row, col], row))
            starts = np.cumsum(held) - held
            return col[order][starts[:, None] + np.arange(size)]
    out = np.empty((len(odd), size), np.int64)
    for i, a in enumerate(odd):
        values = x * a
        low = np.flatnonzero(values < limit) if limit is not None else np.arange(n)
        if len(low) < size:  # rare: the bound was too low
            low = np.arange(n)
        out[i] = low[np.argsort(values[low], kind="stable")[:size]]
    return out


def signature(codes: np.ndarray, k: int = K, rows: int = ROWS, size: int = TUPLE) -> np.ndarray:
    """One 32-bit value per order; empty for an empty text."""
    x, at = numbered_kmers(codes, k)
    if not len(x):
        return np.empty(0, np.uint32)
    chosen = _smallest(x, _ODD[:rows], size)
    chosen = np.take_along_axis(chosen, np.argsort(at[chosen], axis=1, kind="stable"), axis=1)
    h = np.arange(rows, dtype=np.uint64)
    for j in range(chosen.shape[1]):
        h = _mix(h * _BASE + x[chosen[:, j]])
    return (h >> np.uint64(32)).astype(np.uint32)


def as_text(found: np.ndarray) -> str:
    return found.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal rows; two empty texts are alike, an empty and another one are not."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return float(np.mean(a == b))


def fingerprints(docs: DataFrame, k: int = K, rows: int = ROWS, size: int = TUPLE) -> DataFrame:
    """``doc_id`` and the fingerprint of each whole text as hexadecimal text; null and empty texts: ''."""

    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ((i, as_text(signature(code_points(t), k, rows, size))) for i, t in rows_of(batches, "doc_id", "text"))
        yield from record_batches(found, schema)

    return texts(docs).mapInArrow(run, "doc_id bigint, fingerprint string")


# ---- documents against their edited texts and the next documents

RESULT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_RESULT_ARROW = [
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
]
_EDGE_ARROW = pa.schema([*_RESULT_ARROW, ("part", pa.int32()), ("edge", pa.int32()), ("text", pa.string())])
FIRST, LAST = 1, 2


class _Text:
    def __init__(self, doc_id: int | None, text: str):
        self.doc_id, self.text, self.codes = doc_id, text, code_points(text)
        self.found = signature(self.codes)


def _compared(one: _Text, after: _Text) -> tuple:
    half = len(one.codes) // 2
    keep = len(one.codes) - half
    edited = signature(np.concatenate([one.codes[:keep], after.codes[:half]]))
    sha = hashlib.sha256((one.text[:keep] + after.text[:half]).encode("utf-8", "surrogatepass")).hexdigest()
    return (
        one.doc_id, len(one.codes), sha, as_text(one.found), as_text(edited),
        likeness(one.found, edited), likeness(one.found, after.found),
    )


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Each document against its edited text and against the next document by ``doc_id``.

    The edited text has the last half of its code points replaced by the beginning of the
    next document; after the last document comes the first. Rows are ranged over tasks by
    (``doc_id``, hash of the text), so that a repeated ``doc_id`` is split as well, and each
    task walks its rows in order. The last row of a task meets the first row of the next one
    in a second, small step of one row per task. A null ``doc_id`` comes first; null texts
    are empty; an empty table gives no rows; a single document is its own next one.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "order_minhash")
    rows = texts(docs).withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def found():
            before = None
            for doc_id, text in rows_of(batches, "doc_id", "text"):
                here = _Text(doc_id, text)
                if before is None:
                    yield (doc_id, *[None] * 6, part, FIRST, text)
                else:
                    yield (*_compared(before, here), part, None, None)
                before = here
            if before is not None:
                yield (before.doc_id, *[None] * 6, part, LAST, before.text)

        yield from record_batches(found(), _EDGE_ARROW, 1024)

    walked = scratch.keep(rows.select("doc_id", "text").mapInArrow(walk, RESULT + ", part int, edge int, text string"))
    names = [c for c, _ in _RESULT_ARROW]
    # One row per task: which task with rows comes next; after the last one, the first.
    parts = walked.filter(f"edge = {FIRST}").select("part")
    order = Window.orderBy("part")
    following = parts.select(
        "part", F.coalesce(F.lead("part").over(order), F.first("part").over(order)).alias("next_part")
    )
    last = walked.filter(f"edge = {LAST}").select("part", "doc_id", "text")
    first = walked.filter(f"edge = {FIRST}").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
    pairs = last.join(following, "part").join(first, "next_part").select("doc_id", "text", "next_text")

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (_compared(_Text(i, a), _Text(None, b)) for i, a, b in rows_of(batches, "doc_id", "text", "next_text"))
        yield from record_batches(found, pa.schema(_RESULT_ARROW), 64)

    return walked.filter("edge IS NULL").select(*names).unionByName(pairs.mapInArrow(ends, RESULT))
