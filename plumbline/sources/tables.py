"""Tables of a warehouse: list, load, store, describe, and the append-only logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from plumbline.session import small_frame

HISTORY_RUNS = 20


def list_tables(spark: SparkSession, database: str | None = None) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables(database))


def load_table(spark: SparkSession, name: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.table(name)
    return df.select(*columns) if columns else df


def load_jdbc(
    spark: SparkSession, url: str, table: str, partition_column: str, low: int, high: int, parts: int, **options: str
) -> DataFrame:
    """A database table read in parallel by ranges of a number column."""
    return (
        spark.read.format("jdbc")
        .options(
            url=url,
            dbtable=table,
            partitionColumn=partition_column,
            lowerBound=str(low),
            upperBound=str(high),
            numPartitions=str(parts),
            **options,
        )
        .load()
    )


def load_all(spark: SparkSession, database: str | None = None) -> dict[str, DataFrame]:
    """Every table of a database, lazily; views over it read nothing until used."""
    return {name: spark.table(f"{database}.{name}" if database else name) for name in list_tables(spark, database)}


def sample_rows(df: DataFrame, fraction: float, key: list[str], seed: int = 42) -> DataFrame:
    """An optional row sample; whole rows, so that columns stay aligned.

    A row is taken by the md5 of its key and the seed: the same rows in every run, layout and engine.
    """
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in key])
    number = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")
    return df.where(number < int(fraction * 2**32))


def write_table(df: DataFrame, name: str, path: str | None = None, mode: str = "overwrite") -> None:
    """Replace a table. With a path the data lies there, outside the warehouse folder."""
    writer = df.write.mode(mode).format("parquet")
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)


def append_rows(df: DataFrame, path: str) -> None:
    """Add rows to a log kept as a folder of Parquet files."""
    df.write.mode("append").parquet(path)


def catalogue(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """One row per column of the given tables."""
    rows = [
        (name, i, f.name, f.dataType.simpleString())
        for name, df in tables.items()
        for i, f in enumerate(df.schema.fields)
    ]
    return small_frame(spark, rows, "`table` string, ordinal int, `column` string, dtype string")


def ddl_text(table: str, df: DataFrame) -> str:
    body = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
    return f"CREATE TABLE {table} ({body})"


def ddl_rows(columns: DataFrame) -> DataFrame:
    """DDL text and its md5 for every table of a column catalogue."""
    listed = columns.groupBy("table").agg(
        F.array_sort(F.collect_list(F.struct("ordinal", F.concat_ws(" ", "column", "dtype").alias("def")))).alias("defs")
    )
    body = F.concat_ws(", ", F.transform("defs", lambda d: d["def"]))
    ddl = F.concat(F.lit("CREATE TABLE "), F.col("table"), F.lit(" ("), body, F.lit(")"))
    return listed.select("table", F.size("defs").alias("columns"), ddl.alias("ddl"), F.md5(ddl).alias("ddl_hash"))


def last_runs(history: DataFrame, n: int = HISTORY_RUNS, key: str = "table", time: str = "run_ts") -> DataFrame:
    """The latest runs of every table; the log itself is never cut."""
    # Runs of one time are told apart by all they hold, so that every call picks the same.
    latest = Window.partitionBy(key).orderBy(F.desc(time), F.xxhash64(*[F.col(f"`{c}`") for c in history.columns]))
    return history.withColumn("_rank", F.row_number().over(latest)).where(F.col("_rank") <= n).drop("_rank")
