"""Foreign-key checks between tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXAMPLES = 5


def orphans(source: DataFrame, source_field: str, target: DataFrame, target_field: str) -> DataFrame:
    """Distinct non-null source values without an equal target value.

    Both sides are marked and grouped together by value. Marks combine per task before the
    one shuffle, so a value that fills a third of the source costs one row per task; a join
    would send all its rows to one place.
    """
    here = source.select(F.col(source_field).alias("value"), F.lit(True).alias("used"), F.lit(False).alias("known"))
    there = target.select(F.col(target_field).alias("value"), F.lit(False).alias("used"), F.lit(True).alias("known"))
    marked = here.unionByName(there).where(F.col("value").isNotNull())
    seen = marked.groupBy("value").agg(F.bool_or("used").alias("used"), F.bool_or("known").alias("known"))
    return seen.where(F.col("used") & ~F.col("known")).select("value")


def orphan_summary(source: DataFrame, source_field: str, target: DataFrame, target_field: str) -> DataFrame:
    """Count of orphans with the five smallest as examples."""
    lost = orphans(source, source_field, target, target_field)
    examples = lost.orderBy("value").limit(EXAMPLES).agg(
        F.array_sort(F.collect_list("value")).alias("examples")
    )
    one = F.lit(1)
    return (
        lost.agg(F.count("*").alias("orphans"))
        .withColumn("one", one)
        .join(examples.withColumn("one", one), "one")
        .select("orphans", F.transform("examples", lambda v: v.cast("string")).alias("examples"))
    )
