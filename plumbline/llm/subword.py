"""Supervised subword embeddings: hashed words and character n-grams, averaged, then softmax.

A document is the mean of the vectors of its words and of the byte n-grams within words,
boundaries included; a word that repeats the one before it has a vector of its own. Vectors
and the output layer are trained by stochastic gradient descent on a bounded sample. Since
the mean and the output layer are linear, a trained model scores a document by one table of
outputs per feature.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import record_batches, rows_of, texts

BITS = 15
BUCKETS = 1 << BITS
#: The bucket of a word that repeats the word before it.
REPEATED = 0
DIM = 16
#: Labelled rows that a model is fitted on at most, taken by order of their hashes. A row
#: comes to the driver as one weight per bucket that it has, 128 KB at most.
SAMPLE = 3000
EPOCHS = 10
RATE = 30.0
SEED = 5

_POWERS = np.cumprod(np.full(256, 0x9E3779B97F4A7C15, dtype=np.uint64))
#: Bytes of white space, as bounds of words.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SHIFT = np.uint32(32 - BITS)


def features(text: str) -> np.ndarray:
    """Buckets of all features of a text, repeats included; none for a text without words."""
    raw = np.frombuffer(b" " + text.encode("utf-8", "surrogatepass") + b" ", dtype=np.uint8)
    space = _SPACE[raw]
    inner = ~space
    starts = np.flatnonzero(inner[1:] & space[:-1]) + 1
    if not len(starts):
        return np.empty(0, np.int64)
    ends = np.flatnonzero(inner[:-1] & space[1:]) + 1
    b = np.where(space, np.uint8(32), raw).astype(np.uint32) + np.uint32(1)
    pair = b[:-1] * np.uint32(0x01000193) + b[1:]
    three = pair[:-1] * np.uint32(0x01000193) + b[2:]
    four = three[:-1] * np.uint32(0x01000193) + b[3:]
    three = three[inner[1:-1]]
    four = four[inner[1:-2] & inner[2:-1]]
    # Words: a polynomial over the bytes of each, by sums between word bounds.
    at = np.arange(len(raw))
    first = np.zeros(len(raw), np.int64)
    first[starts] = starts
    place = at - np.maximum.accumulate(first)
    terms = np.where(inner, b.astype(np.uint64) * _POWERS[place & 255], np.uint64(0))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms)])
    words = sums[ends] - sums[starts]
    again = int(np.count_nonzero(words[1:] == words[:-1]))
    word = ((words ^ (words >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)).astype(np.int64)
    gram = np.concatenate([three * np.uint32(0x9E3779B1), (four ^ np.uint32(0x5BD1E995)) * np.uint32(0x85EBCA6B)]) >> _SHIFT
    return np.concatenate([word, np.full(again, REPEATED, np.int64), gram.astype(np.int64)])


def weights(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a document and the share of each."""
    buckets, counts = np.unique(found, return_counts=True)
    return buckets, counts / max(1, len(found))


@dataclass
class Model:
    """Outputs per feature and class relative to the first class, and the classes' constants."""

    classes: list
    table: np.ndarray
    constant: np.ndarray

    def probabilities(self, text: str) -> np.ndarray:
        found = features(text)
        out = self.constant.astype(np.float64).copy()
        if len(found):
            out[1:] += [float(self.table[k][found].mean(dtype=np.float64)) for k in range(len(self.classes) - 1)]
        e = np.exp(out - out.max())
        return e / e.sum()


def fit(rows: list[tuple], dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
    """Train on (label, buckets, shares). One class alone gives a constant model, no rows none."""
    classes = sorted({r[0] for r in rows})
    if len(classes) < 2:
        return Model(classes or [0], np.zeros((0, BUCKETS), np.float32), np.zeros(1))
    random = np.random.default_rng(seed)
    vectors = random.normal(0, 0.1, (BUCKETS, dim)).astype(np.float32)
    output = random.normal(0, 0.3, (dim, len(classes))).astype(np.float32)
    share = np.bincount([classes.index(r[0]) for r in rows], minlength=len(classes)) / len(rows)
    constant = np.log(share)
    data = [(classes.index(label), b.astype(np.int64), w.astype(np.float32)) for label, b, w in rows]
    steps, done = epochs * len(data), 0
    for _ in range(epochs):
        for i in random.permutation(len(data)):
            label, buckets, share_of = data[i]
            now = rate * (1 - done / steps)
            done += 1
            held = vectors[buckets]
            mean = share_of @ held
            out = mean @ output + constant
            slope = np.exp(out - out.max())
            slope = (slope / slope.sum()).astype(np.float32)
            slope[label] -= 1
            back = output @ slope
            output -= np.float32(0.01 * now) * np.outer(mean, slope)
            constant -= 0.002 * now * slope
            vectors[buckets] = held - np.outer(np.float32(now) * share_of, back)
    table = (vectors @ (output[:, 1:] - output[:, :1])).T
    return Model(classes, np.ascontiguousarray(table, dtype=np.float32), constant - constant[0])


def train(docs: DataFrame, labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` rows of ``labelled`` (``doc_id``, ``label``), features worked out in tasks.

    A ``doc_id`` labelled several times has its largest label; rows without an id or a label
    are left out, and so are ids without a document.
    """
    usable = labelled.filter("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # At most ``sample`` small rows: fit for a broadcast at any size of the tables.
    rows = texts(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", F.col("label").cast("string").alias("label"), "text")
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.string()), ("buckets", pa.binary()), ("shares", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for doc_id, label, text in rows_of(batches, "doc_id", "label", "text"):
                buckets, shares = weights(features(text))
                yield doc_id, label, buckets.astype("<u2").tobytes(), shares.astype("<f2").tobytes()

        yield from record_batches(found(), schema, 64)

    found = rows.mapInArrow(run, "doc_id bigint, label string, buckets binary, shares binary").collect()
    unpacked = [
        (r["label"], np.frombuffer(r["buckets"], "<u2"), np.frombuffer(r["shares"], "<f2"))
        for r in sorted(found, key=lambda r: (r["doc_id"], r["label"], bytes(r["buckets"])))
    ]
    return fit(unpacked)


def scored(docs: DataFrame, model: Model, names: list[str]) -> DataFrame:
    """All columns of ``docs`` and the probability of each class of its text as ``names``.

    A null text counts as empty. The names must not be among the columns.
    """
    at = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([model.probabilities(t or "") for t in batch.column(at).to_pylist()]).reshape(-1, len(names))
            arrays = [*batch.columns, *[pa.array(found[:, k], pa.float64()) for k in range(len(names))]]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, *names])

    return docs.mapInArrow(run, schema)
