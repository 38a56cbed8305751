"""Session settings and the shared folder that jobs may write to."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

X = TypeVar("X")
JOBS_AT_ONCE = 4


def local_session(cores: int | str = "*", app: str = "plumbline") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


#: Folders made for local sessions without the setting, by application: a running session does not take it.
_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: on a cluster that
    folder would exist on one machine only, so a missing setting is an error there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or _local_dirs.get(spark.sparkContext.applicationId)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        root = tempfile.mkdtemp(prefix="plumbline-")
        _local_dirs[spark.sparkContext.applicationId] = root
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; never reused, so reruns cannot collide."""
    return f"{shared_dir(spark)}/plumbline/{uuid.uuid4().hex}/{name}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: losing an executor costs no recomputation,
    the plan starts over, and later steps read only the columns they use."""
    path = scratch_path(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_frame(spark: SparkSession, rows: list[tuple], ddl: str | T.StructType) -> DataFrame:
    """A DataFrame of catalogue-sized rows that becomes part of the plan, without a job of its own."""
    schema = T.StructType.fromDDL(ddl) if isinstance(ddl, str) else ddl
    arrow = to_arrow_schema(schema)
    columns = list(zip(*rows)) if rows else [()] * len(arrow)
    arrays = [pa.array(list(c), type=f.type) for c, f in zip(columns, arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow), schema)


def at_once(jobs: list[Callable[[], X]]) -> list[X]:
    """Run independent Spark actions side by side, so that small ones do not wait for each other."""
    if len(jobs) <= 1:
        return [job() for job in jobs]
    with ThreadPoolExecutor(min(JOBS_AT_ONCE, len(jobs))) as pool:
        return list(pool.map(lambda job: job(), jobs))


class Steps:
    """Tables that one job writes to the shared folder on its way, removed when it ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.number = spark, scratch_path(spark, name), 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.number += 1
        path = f"{self.root}/{self.number}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Steps:
        return self

    def __exit__(self, *_) -> None:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
