"""Column profiles kept per load: a new load is scanned once, and merged with the earlier ones.

Counts, extremes and moments of loads add up; distinct values do not, so each load keeps a
HyperLogLog sketch per column, of a size that does not depend on the load. A load that is
profiled again replaces its own rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from plumbline.operators.profile import chunks, is_flat
from plumbline.operators.quantiles import numeric_columns, numeric_value

#: Log of a sketch's buckets: a relative error of about 0.8 %, and 16 KB at most.
BUCKETS_LOG = 14
PARTS = ("rows", "present", "low", "high", "mean", "m2", "sketch")


def _sketched(value: Column, dtype: T.DataType) -> Column:
    """The sketch of a column; types that sketches do not take go as text."""
    whole = isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    return F.hll_sketch_agg(value.cast("long" if whole else "string"), BUCKETS_LOG)


def profile_load(df: DataFrame, table: str, load: str) -> DataFrame:
    """One row per flat column: what of its profile can be merged, by one scan for 25 columns."""
    flat = [c for c in df.columns if is_flat(df.schema[c].dataType)]
    numeric = set(numeric_columns(df))
    parts = []
    for names in chunks(flat):
        aggs = [F.count(F.lit(1)).alias("rows")]
        for i, c in enumerate(names):
            value = F.col(f"`{c}`")
            number = numeric_value(df, c) if c in numeric else F.lit(None).cast("double")
            aggs += [
                F.count(value).alias(f"present{i}"),
                F.min(value).cast("string").alias(f"low{i}"),
                F.max(value).cast("string").alias(f"high{i}"),
                F.avg(number).alias(f"mean{i}"),
                (F.var_pop(number) * F.count(number)).alias(f"m2{i}"),
                _sketched(value, df.schema[c].dataType).alias(f"sketch{i}"),
            ]
        wide = df.agg(*aggs)
        columns = [
            F.struct(
                F.lit(c).alias("column"),
                F.lit(df.schema[c].dataType.simpleString()).alias("dtype"),
                F.lit(c in numeric).alias("numeric"),
                F.col("rows"),
                *[F.col(f"{p}{i}").alias(p) for p in PARTS[1:]],
            )
            for i, c in enumerate(names)
        ]
        parts.append(wide.select(F.inline(F.array(*columns))))
    whole = parts[0]
    for more in parts[1:]:
        whole = whole.unionByName(more)
    return whole.select(F.lit(table).alias("table"), F.lit(load).alias("load"), "*")


def store_load(df: DataFrame, table: str, load: str, path: str) -> None:
    """Profile a load and keep the result below ``path``, in place of an earlier one of that load."""
    profile_load(df, table, load).coalesce(1).write.mode("overwrite").parquet(f"{path}/{table}/{load}")


def stored_loads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", "true").parquet(path)


def merged_profile(loads: DataFrame) -> DataFrame:
    """The profile over all loads, without reading any of their rows again.

    ``distinct_count`` is the estimate of the united sketches. Extremes are compared as numbers
    where the column is one, else as text. A column that a load lacks counts as null there.
    """
    by_column = Window.partitionBy("table", "column")
    size = loads.select("table", "load", "rows").distinct().groupBy("table").agg(F.sum("rows").alias("row_count"))
    # The mean over all loads comes first, so that deviations are taken from it and nothing cancels out.
    known = F.when(F.col("mean").isNotNull(), F.col("present"))
    centred = loads.withColumn("all", F.sum(F.col("mean") * known).over(by_column) / F.sum(known).over(by_column))
    spread = F.sum(F.col("m2") + F.col("present") * (F.col("mean") - F.col("all")) ** 2)
    number = lambda c: F.when(F.col("numeric"), F.col(c).cast("double"))
    merged = centred.groupBy("table", "column").agg(
        F.max("dtype").alias("dtype"),
        F.sum("present").alias("present"),
        F.coalesce(F.min_by("low", number("low")), F.min("low")).alias("min"),
        F.coalesce(F.max_by("high", number("high")), F.max("high")).alias("max"),
        F.max("all").alias("mean"),
        F.sqrt(F.try_divide(spread, F.sum(known) - 1)).alias("std"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_count"),
    )
    rows = F.col("row_count")
    return merged.join(size, "table").select(
        "table",
        "column",
        "dtype",
        "row_count",
        (rows - F.col("present")).alias("null_count"),
        F.coalesce(F.try_divide(rows - F.col("present"), rows), F.lit(0.0)).alias("null_pct"),
        "distinct_count",
        "min",
        "max",
        "mean",
        "std",
    )
