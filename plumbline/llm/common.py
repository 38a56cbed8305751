"""Helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import scratch_path

#: Bits of a bitmap of keys: 16 a key, and never more than these (32 MB).
MOST_MARKS = 1 << 28
#: Bits of one row of it, as Spark's own bitmap functions cut it.
_ROW_BITS = 32768
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """Only ``doc_id`` and ``text``, a missing text as the empty one: columns of other names cannot clash."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))


def set_aside(docs: DataFrame, *used: str) -> DataFrame:
    """``docs`` with its columns but those ``used`` in one, so that no name of theirs can clash with a working column."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in used]
    return docs.select(*[c for c in docs.columns if c in used], F.struct(*others or [F.lit(0)]).alias("others"))


def bring_back(done: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns of what ``set_aside`` gave, each again at its place."""
    kept = [c for c in done.columns if c != "others"]
    return done.select(*[F.col(f"`{c}`") if c in kept else F.col(f"others.`{c}`") for c in columns])


def among(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The ``rows`` whose ``key`` may be one of the ``wanted`` table, by a bitmap of bounded size and without a shuffle of theirs.

    None of the wanted is left out. With more keys than the bitmap is made for, others stay too.
    """
    bits = _ROW_BITS
    while bits < min(16 * wanted.count(), MOST_MARKS):
        bits *= 2
    place = F.pmod(F.xxhash64(key), F.lit(bits)).alias("_place")
    row, at = F.floor(F.col("_place") / _ROW_BITS).alias("_row"), F.pmod("_place", F.lit(_ROW_BITS))
    marks = wanted.select(place).select(row, F.bitmap_bit_position(at + 1).alias("_bit"))
    marks = marks.groupBy("_row").agg(F.bitmap_construct_agg("_bit").alias("_marks"))
    byte = F.conv(F.hex(F.substring("_marks", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = rows.select("*", place).select("*", row).join(F.broadcast(marks), "_row")
    return met.filter(F.getbit(byte, F.pmod("_place", F.lit(8)).cast("int")) == 1).select(*rows.columns)


def rows_of(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """Tuples of Python values, batch by batch, so that one batch at a time is in memory."""
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns))


def record_batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of a bounded size."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


class Scratch:
    """Tables in the shared folder that one run needs for a while.

    ``keep`` writes a DataFrame and reads it back: a lost executor repeats no earlier
    step, and plans stay short. ``drop`` removes a table that no later step reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = scratch_path(spark, name)
        self.paths: dict[int, str] = {}
        self.number = 0

    def path(self) -> str:
        self.number += 1
        return f"{self.root}/{self.number}"

    def keep(self, df: DataFrame, codec: str = "zstd") -> DataFrame:
        path = self.path()
        df.write.option("compression", codec).parquet(path)
        read = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(read)] = path
        return read

    def drop(self, *tables: DataFrame | None) -> None:
        for df in tables:
            path = self.paths.pop(id(df), None)
            if path is not None:
                remove(self.spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared storage that this run has written."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    with contextlib.suppress(Exception):  # what is left behind costs space only
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def is_file(spark: SparkSession, path: str) -> bool:
    """Whether a path of any storage that Spark reads is a single file."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isFile()


def one_thread() -> None:
    """Tasks share the cores already; native libraries must not start threads of their own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
