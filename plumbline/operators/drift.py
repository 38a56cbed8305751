"""Schema snapshots, the changes between them, and what a type change would cost."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.grading import is_breaking_type_change
from plumbline.sources.tables import catalogue, ddl_rows
from plumbline.session import small_frame

RECENT = 50


def snapshot(spark: SparkSession, tables: dict[str, DataFrame], snapshot_id: str) -> DataFrame:
    """One row per column with the row count and the DDL hash of its table."""
    columns = catalogue(spark, tables)
    counts = reduce(
        DataFrame.unionByName,
        [df.agg(F.count(F.lit(1)).alias("row_count")).withColumn("table", F.lit(t)) for t, df in tables.items()],
    )
    hashes = ddl_rows(columns).select("table", "ddl_hash")
    return (
        columns.join(hashes, "table")
        .join(counts, "table")
        .select(F.lit(snapshot_id).alias("snapshot_id"), "table", "ordinal", "column", "dtype", "row_count", "ddl_hash")
    )


def changes(old: DataFrame, new: DataFrame, at: Column | None = None) -> DataFrame:
    """Added and removed tables and columns, and changed types, each with its severity.

    Tables with an equal DDL hash are dropped before the columns are compared.
    """
    a = old.select("table", "column", F.col("dtype").alias("old_dtype"), F.col("ddl_hash").alias("old_hash"))
    b = new.select("table", "column", F.col("dtype").alias("new_dtype"), F.col("ddl_hash").alias("new_hash"))
    old_tables = old.select("table", F.col("ddl_hash").alias("oh")).distinct()
    new_tables = new.select("table", F.col("ddl_hash").alias("nh")).distinct()
    state = old_tables.join(new_tables, "table", "full_outer").where(~F.col("oh").eqNullSafe(F.col("nh")))
    both = a.join(b, ["table", "column"], "full_outer").join(state, "table")
    kind = (
        F.when(F.col("oh").isNull(), "added")
        .when(F.col("nh").isNull(), "removed")
        .when(F.col("old_dtype").isNull(), "column_added")
        .when(F.col("new_dtype").isNull(), "column_removed")
        .when(F.col("old_dtype") != F.col("new_dtype"), "dtype_changed")
    )
    severity = (
        F.when(F.col("change_type").isin("added", "column_added"), "info")
        .when(F.col("change_type").isin("removed", "column_removed"), "breaking")
        .when(is_breaking_type_change(F.col("old_dtype"), F.col("new_dtype")), "breaking")
        .otherwise("warning")
    )
    return (
        both.withColumn("change_type", kind)
        .where(F.col("change_type").isNotNull())
        .select(
            (F.current_timestamp() if at is None else at).alias("ts"),
            "change_type",
            "table",
            F.col("column").alias("field"),
            "old_dtype",
            "new_dtype",
            severity.alias("severity"),
        )
    )


def name_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per table of both snapshots, the names that came and went."""
    common = old.select("table").distinct().join(new.select("table").distinct(), "table", "left_semi")
    a = old.join(common, "table", "left_semi").select("table", "column", F.lit(True).alias("was"))
    b = new.join(common, "table", "left_semi").select("table", "column", F.lit(True).alias("now"))
    both = a.join(b, ["table", "column"], "full_outer")
    added = F.array_sort(F.collect_list(F.when(F.col("was").isNull(), F.col("column"))))
    removed = F.array_sort(F.collect_list(F.when(F.col("now").isNull(), F.col("column"))))
    found = both.groupBy("table").agg(added.alias("added"), removed.alias("removed"))
    return found.where((F.size("added") > 0) | (F.size("removed") > 0))


def with_history(new_changes: DataFrame, history: DataFrame) -> DataFrame:
    """New changes and earlier ones, newest first."""
    return new_changes.unionByName(history).orderBy(F.desc("ts"), "table", "field", "change_type")


def recent_changes(log: DataFrame, n: int = RECENT) -> DataFrame:
    return log.orderBy(F.desc("ts"), "table", "field", "change_type").limit(n)


def severity_summary(rows: DataFrame) -> DataFrame:
    """Totals per severity in one row."""

    def of(s: str) -> Column:
        return F.count_if(F.col("severity") == s)

    return rows.agg(
        F.count("*").alias("total"),
        of("breaking").alias("breaking"),
        of("critical").alias("critical"),
        of("warning").alias("warning"),
        of("info").alias("info"),
        (of("breaking") > 0).alias("has_breaking"),
    )


def timeline(log: DataFrame, n: int = 20) -> DataFrame:
    """The latest n changes grouped by day; n bounds every group."""
    item = F.struct("ts", "change_type", "table", "field", "severity")
    return recent_changes(log, n).groupBy(F.to_date("ts").alias("day")).agg(
        F.count("*").alias("count"), F.array_sort(F.collect_list(item)).alias("changes")
    )


def cast_survival(df: DataFrame, casts: dict[str, str]) -> DataFrame:
    """Per column and proposed type, how many values would be lost; one scan for all."""
    spark = df.sparkSession
    aggs = []
    for i, (c, t) in enumerate(casts.items()):
        v = F.col(f"`{c}`")
        aggs += [F.count(v).alias(f"n{i}"), F.count_if(v.isNotNull() & v.try_cast(t).isNull()).alias(f"l{i}")]
    row = df.agg(*aggs).first()
    rows = [
        (c, df.schema[c].dataType.simpleString(), t, row[f"n{i}"], row[f"l{i}"])
        for i, (c, t) in enumerate(casts.items())
    ]
    return small_frame(spark, rows, "`column` string, old_dtype string, new_dtype string, values long, lost long")
