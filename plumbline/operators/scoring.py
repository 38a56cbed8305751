"""Scores of columns, tables and warehouses, as DataFrame expressions over profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.grading import badge, letter_grade
from plumbline.session import small_frame

# Weights of the three parts of a table score, and default thresholds.
NULL_WEIGHT, OUTLIER_WEIGHT, UNIQUE_WEIGHT = 0.40, 0.35, 0.25
NULL_THRESHOLD = 0.30
TABLE_NULL_THRESHOLDS = {"ods_raw_data": 0.40, "dwd_cleaned": 0.05, "ads_report": 0.02}
SCORE_MIN, NULL_RATE_MAX, OUTLIER_MAX = 70, 0.05, 10


def floored(c: Column) -> Column:
    return F.greatest(c, F.lit(0.0))


def layer_of(table: Column) -> Column:
    """Warehouse layer by the prefix of the table name."""
    prefix = F.split_part(table, F.lit("_"), F.lit(1))
    return F.when(prefix.isin("dwd", "ads"), prefix).otherwise("ods")


def table_scores(profile: DataFrame, null_thresholds: dict[str, float] | None = None) -> DataFrame:
    """Weighted score per table: few nulls, few outliers, distinct values."""
    unique = F.avg(F.when(F.col("distinct_pct") < 1, F.col("distinct_pct") * 100))
    parts = profile.groupBy("table").agg(
        F.max("row_count").alias("row_count"),
        F.count("*").alias("column_count"),
        F.avg("null_pct").alias("null_rate"),
        F.sum("null_count").alias("nulls"),
        F.sum("outlier_count").alias("outliers"),
        F.coalesce(unique, F.lit(100.0)).alias("uniqueness_score"),
        F.flatten(F.array_sort(F.collect_list(issues(null_thresholds)))).alias("issues"),
    )
    return (
        parts.withColumn("null_score", floored(100 - F.col("null_rate") * 100))
        .withColumn(
            "outlier_score",
            floored(100 - F.col("outliers") / F.greatest(F.col("nulls") + F.col("outliers"), F.lit(1)) * 100),
        )
        .withColumn(
            "score",
            F.when(
                F.col("row_count") > 0,
                F.col("null_score") * NULL_WEIGHT
                + F.col("outlier_score") * OUTLIER_WEIGHT
                + F.col("uniqueness_score") * UNIQUE_WEIGHT,
            ).otherwise(0.0),
        )
        .withColumn("layer", layer_of(F.col("table")))
    )


def issues(null_thresholds: dict[str, float] | None = None) -> Column:
    """Issue codes of a profile row: too many nulls for its table, any outlier."""
    limits = TABLE_NULL_THRESHOLDS if null_thresholds is None else null_thresholds
    limit = F.lit(NULL_THRESHOLD)
    for table, value in limits.items():
        limit = F.when(F.col("table") == table, F.lit(value)).otherwise(limit)
    found = F.array(
        F.when(F.col("null_pct") > limit, F.concat(F.col("column"), F.lit(":null_rate"))),
        F.when(F.col("outlier_count") > 0, F.concat(F.col("column"), F.lit(":outliers"))),
    )
    return F.filter(found, lambda x: x.isNotNull())


def issue_rows(profile: DataFrame, null_thresholds: dict[str, float] | None = None) -> DataFrame:
    return profile.select("table", "column", F.explode(issues(null_thresholds)).alias("issue"))


def quick_scores(profile: DataFrame) -> DataFrame:
    """Mean over columns of the present share and the in-bounds share; an empty table scores 0."""
    score = (
        F.sum(floored(100 - F.col("null_pct") * 100)) + F.sum(floored(100 - F.col("outlier_pct") * 100))
    ) / (2 * F.count("*"))
    return profile.groupBy("table").agg(
        F.max("row_count").alias("row_count"),
        F.when(F.max("row_count") > 0, score).otherwise(0.0).alias("score"),
    )


def column_scores(audit: DataFrame) -> DataFrame:
    """Audit score of a column with the codes of what lowered it."""
    nulls, outliers = F.col("null_pct"), F.col("outlier_pct")
    null_code = (
        F.when(nulls > 0.5, "critical_null_rate")
        .when(nulls > 0.1, "high_null_rate")
        .when(nulls > 0.01, "minor_null_rate")
    )
    null_loss = F.when(nulls > 0.5, 50).when(nulls > 0.1, 25).when(nulls > 0.01, 10).otherwise(0)
    flat = (F.col("row_count") > 100) & (F.col("distinct_pct") < 0.005) & (F.col("null_count") < F.col("row_count"))
    spread = (outliers > 0.1) & (F.col("row_count") > 0)
    loss = null_loss + F.when(flat, 15).otherwise(0) + F.when(spread, 20).otherwise(0)
    codes = F.array(null_code, F.when(flat, "near_constant"), F.when(spread, "high_outlier_rate"))
    return audit.withColumns(
        {
            "score": F.greatest(F.lit(100) - loss, F.lit(0)),
            "issues": F.filter(codes, lambda x: x.isNotNull()),
        }
    )


def audit_tables(scored: DataFrame, unreadable: list[str] | None = None) -> DataFrame:
    """Table score = mean of its column scores; a table that cannot be read scores 0."""
    mean = F.avg("score")
    tables = scored.groupBy("table").agg(
        F.max("row_count").alias("row_count"),
        F.count("*").alias("column_count"),
        F.round(mean, 2).alias("score"),
        letter_grade(mean).alias("grade"),
    )
    if unreadable:
        spark = scored.sparkSession
        lost = small_frame(spark, [(t, 0, 0, 0.0, "F") for t in unreadable], tables.schema)
        tables = tables.unionByName(lost)
    return tables


def audit_warehouse(tables: DataFrame) -> DataFrame:
    mean = F.coalesce(F.avg("score"), F.lit(0.0))
    return tables.agg(
        F.count("*").alias("table_count"),
        F.sum("row_count").alias("total_rows"),
        F.round(mean, 2).alias("overall_score"),
        letter_grade(mean).alias("overall_grade"),
    )


def worst_columns(scored: DataFrame, n: int = 5) -> DataFrame:
    """Among the n columns of lowest score, those with an issue."""
    return (
        scored.orderBy("score", "table", "column")
        .limit(n)
        .where(F.size("issues") > 0)
        .select("table", "column", "score", "issues")
    )


def alerts(scores: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Alerts per table for a low score, a high null rate and many outliers."""

    def alert(kind: str, value: Column, limit: float, bad: Column, severity: Column) -> Column:
        return F.when(
            bad,
            F.struct(
                F.lit(kind).alias("type"),
                value.cast("double").alias("value"),
                F.lit(float(limit)).alias("threshold"),
                severity.alias("severity"),
            ),
        )

    score, nulls, outliers = F.col("score"), F.col("null_rate"), F.col("outliers")
    found = F.array(
        alert("quality_score", score, SCORE_MIN, score < SCORE_MIN, F.when(score < 50, "high").otherwise("medium")),
        alert("null_rate", F.round(nulls, 2), NULL_RATE_MAX, nulls > NULL_RATE_MAX, F.lit("medium")),
        alert(
            "anomaly_count",
            outliers,
            OUTLIER_MAX,
            outliers > OUTLIER_MAX,
            F.when(outliers > 2 * OUTLIER_MAX, "high").otherwise("medium"),
        ),
    )
    at = F.current_timestamp() if as_of is None else as_of
    return scores.select(at.alias("ts"), "table", F.inline(F.filter(found, lambda x: x.isNotNull())))


def report_rows(profile: DataFrame, scores: DataFrame) -> DataFrame:
    """Per table: mean null share, outliers and badge for the report."""
    parts = profile.groupBy("table").agg(
        F.avg("null_pct").alias("mean_null_pct"), F.sum("outlier_count").alias("outliers")
    )
    return scores.select("table", "row_count", "score", badge(F.col("score")).alias("badge")).join(parts, "table")


def fleet_summary(scores: DataFrame, history: DataFrame, alert_rows: DataFrame) -> DataFrame:
    """One row for the whole fleet; every side is a single aggregated row."""
    totals = scores.agg(
        F.count("*").alias("tables"), F.sum("row_count").alias("rows"), F.avg("score").alias("mean_score")
    )
    latest = history.agg(F.max("run_ts").alias("latest_run"))
    count = alert_rows.agg(F.count("*").alias("alerts"))
    one = F.lit(1)
    return (
        totals.withColumn("one", one)
        .join(latest.withColumn("one", one), "one")
        .join(count.withColumn("one", one), "one")
        .drop("one")
    )


def lineage_listing(lineage: DataFrame, n: int = 5) -> DataFrame:
    """First tables by name with the number of their traced columns."""
    return lineage.groupBy("table").agg(F.count_distinct("column").alias("columns")).orderBy("table").limit(n)


def top_violations(violations: DataFrame, group: str, n: int = 5) -> DataFrame:
    order = Window.partitionBy(group).orderBy(F.desc("failed_count"), "rule_id", "field")
    return violations.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
