"""Exact duplicates by a stateful stream over a folder of Parquet files.

The stream keeps, without expiry, one entry per digest in a disk-backed state store: how
many rows had it, and the largest identifier with the place (file and row) of its text.
Each micro-batch writes the entries that it changed. A digest seen more than once is a hit:
its texts are read again by their places and compared byte by byte, so that texts of equal
digests that differ become groups of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch, is_file

#: Input taken into one micro-batch at most.
BYTES_PER_BATCH = 64 << 30
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    # Many small stores: reserving space ahead for each of their logs would take more than the entries.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "300",
}
PLACE = ["file", "row"]


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _rows(source: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return source.select(
        "doc_id",
        text.alias("text"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
    ).withColumn("digest", digest(F.col("text")))


def state_of(
    spark: SparkSession, path: str, digest: Callable[[Column], Column], scratch: Scratch, bytes_per_batch: int = BYTES_PER_BATCH
) -> DataFrame:
    """Run the stream to the end of what is there; the last entry of every digest."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxBytesPerTrigger", str(bytes_per_batch))
    if is_file(spark, path):  # a stream reads folders: take the one file of its folder
        folder, _, name = path.rpartition("/")
        source = reader.option("pathGlobFilter", name).parquet(folder)
    else:
        source = reader.parquet(path)
    entries = (
        _rows(source, digest)
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", *PLACE)).alias("keep"))
    )
    out = scratch.path()

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    with _settings(spark, STATE):
        writer = entries.writeStream.outputMode("update").foreachBatch(store)
        query = writer.option("checkpointLocation", scratch.path()).trigger(availableNow=True).start()
        query.awaitTermination()
    empty = spark.read.schema(schema).parquet(path).limit(0).select("_metadata.file_path")
    try:
        written = spark.read.parquet(out).drop("batch")
    except Exception as e:  # no batch ran: the folder has no rows
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return empty.selectExpr("binary(null) digest", "0L group_size", "named_struct('doc_id', 0L, 'file', '', 'row', 0L) keep")
    # Counts only grow, so the largest entry of a digest is its last one.
    last = written.groupBy("digest").agg(F.max(F.struct("group_size", "keep")).alias("e"))
    return last.select("digest", "e.group_size", "e.keep")


def exact_groups(
    spark: SparkSession, path: str, digest: Callable[[Column], Column] = sha256, bytes_per_batch: int = BYTES_PER_BATCH
) -> DataFrame:
    """One row per row of the folder: ``doc_id``, its place, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Of rows with equal texts the one with the largest ``doc_id`` stays; among rows that
    repeat that ``doc_id``, the one in the last file and row, so exactly one row of a group
    is kept. Null texts count as empty. A null ``doc_id`` is smaller than any other.
    """
    scratch = Scratch(spark, "stream_dedup")
    state = scratch.keep(state_of(spark, path, digest, scratch, bytes_per_batch))
    rows = _rows(spark.read.parquet(path), digest)
    labelled = scratch.keep(
        rows.select("doc_id", *PLACE, "digest", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")).join(state, "digest")
    )
    hits = labelled.filter("group_size > 1").select(*PLACE, "digest")
    texts = rows.select("doc_id", *PLACE, "text").join(hits, PLACE)
    # All texts of a digest are equal if the first and the last of them are.
    unequal = scratch.keep(
        texts.groupBy("digest").agg(F.min("text").alias("a"), F.max("text").alias("b")).filter("a <> b").select("digest")
    )
    if unequal.isEmpty():  # as a rule: then no text has to be read again
        mended = labelled.limit(0).select(*PLACE, F.col("group_size").alias("part_size"), F.col("keep").alias("part_keep"))
    else:
        split = texts.join(unequal, "digest", "left_semi")
        parts = split.groupBy("digest", "text").agg(
            F.count(F.lit(1)).alias("part_size"), F.max(F.struct("doc_id", *PLACE)).alias("part_keep")
        )
        mended = split.join(parts, ["digest", "text"]).select(*PLACE, "part_size", "part_keep")
    keep = F.coalesce("part_keep", "keep")
    return labelled.join(mended, PLACE, "left").select(
        "doc_id",
        *PLACE,
        keep["doc_id"].alias("keep_id"),
        F.coalesce("part_size", "group_size").alias("group_size"),
        ((F.col("file") == keep["file"]) & (F.col("row") == keep["row"])).alias("kept"),
        "text_sha256",
    )
