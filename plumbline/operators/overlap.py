"""Shared values between columns, from one grouped pass over all values.

Every value carries a bit mask of the columns it occurs in. Masks combine per task
before the shuffle, so a value that fills a third of all rows costs one entry per task,
and pairs are formed over the few distinct masks and never over rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.profile import is_flat
from plumbline.session import small_frame

WORD = 62  # columns per mask word

PAIR_SCHEMA = (
    "source string, target string, shared long, source_distinct long, target_distinct long, "
    "overlap double, jaccard double"
)


#: Characters from which on a value stands as its hash.
LONG_TEXT = 64


def _family(dtype: T.DataType) -> str:
    return "number" if isinstance(dtype, T.NumericType) else "text"


def _as_family(df: DataFrame, name: str) -> Column:
    c = F.col(f"`{name}`")
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.IntegralType):
        # Exact in the string form too: whole numbers of any size stay apart.
        return c.cast("long").cast("string")
    if isinstance(dtype, T.NumericType):
        d = c.cast("double")
        whole = (d == F.floor(d)) & (F.abs(d) < 2**53)
        return F.when(whole, d.cast("long").cast("string")).otherwise(d.cast("string"))
    # Long texts are compared by their 128-bit hashes, so that no whole text is a shuffle key.
    text = c.cast("string")
    return F.when(F.length(text) > LONG_TEXT, F.md5(text.cast("binary"))).otherwise(text)


def candidate_columns(tables: dict[str, DataFrame]) -> list[tuple[str, str]]:
    return [(t, f.name) for t, df in tables.items() for f in df.schema.fields if is_flat(f.dataType)]


def value_masks(tables: dict[str, DataFrame]) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Per distinct (family, value), the mask of the columns that hold it and the mask's words."""
    columns = candidate_columns(tables)
    at = {c: i for i, c in enumerate(columns)}
    words = (len(columns) + WORD - 1) // WORD
    parts = []
    for t, df in tables.items():
        entries = []
        for f in df.schema.fields:
            i = at.get((t, f.name))
            if i is None:
                continue
            mask = [F.lit(1 << (i % WORD) if w == i // WORD else 0).cast("long").alias(f"m{w}") for w in range(words)]
            entries.append(F.struct(F.lit(_family(f.dataType)).alias("family"), _as_family(df, f.name).alias("value"), *mask))
        if entries:
            parts.append(df.select(F.inline(F.array(*entries))))
    rows = reduce(DataFrame.unionByName, parts).where(F.col("value").isNotNull())
    return rows.groupBy("family", "value").agg(*[F.bit_or(f"m{w}").alias(f"m{w}") for w in range(words)]), columns


def mask_counts(tables: dict[str, DataFrame]) -> tuple[DataFrame, list[tuple[str, str]]]:
    """How many values share each combination of columns; as many rows as there are combinations."""
    masks, columns = value_masks(tables)
    words = [c for c in masks.columns if c.startswith("m")]
    return masks.groupBy(*words).agg(F.count("*").alias("n")), columns


def overlaps(spark: SparkSession, tables: dict[str, DataFrame], across: bool = True) -> DataFrame:
    """Shared distinct values of all column pairs that share any; ``across`` leaves out pairs of one table."""
    counts, columns = mask_counts(tables)
    words = [c for c in counts.columns if c.startswith("m")]
    ids = F.array(*[F.lit(i) for i in range(len(columns))])
    held = F.filter(
        ids,
        lambda i: reduce(
            lambda a, b: a | b,
            [
                (F.floor(i / WORD) == w)
                & (F.col(m).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (i % WORD).cast("int"))) != 0)
                for w, m in enumerate(words)
            ],
        ),
    )
    sets = counts.select(held.alias("ids"), "n")
    single = sets.select(F.explode("ids").alias("id"), "n").groupBy("id").agg(F.sum("n").alias("distinct"))
    # A combination of columns is no data group: its size is bounded by the catalogue.
    pairs = (
        sets.where(F.size("ids") > 1)
        .select(F.explode("ids").alias("a"), "ids", "n")
        .select("a", F.explode("ids").alias("b"), "n")
        .where("a < b")
        .groupBy("a", "b")
        .agg(F.sum("n").alias("shared"))
    )
    names = small_frame(spark, 
        [(i, t, f"{t}.{c}") for i, (t, c) in enumerate(columns)], "id int, `table` string, node string"
    ).join(single, "id")
    a, b = names.alias("x"), names.alias("y")
    joined = pairs.join(a, F.col("a") == F.col("x.id")).join(b, F.col("b") == F.col("y.id"))
    if across:
        joined = joined.where(F.col("x.table") != F.col("y.table"))
    least = F.least("x.distinct", "y.distinct")
    return joined.select(
        F.col("x.node").alias("source"),
        F.col("y.node").alias("target"),
        "shared",
        F.col("x.distinct").alias("source_distinct"),
        F.col("y.distinct").alias("target_distinct"),
        (F.col("shared") / least).alias("overlap"),
        (F.col("shared") / (F.col("x.distinct") + F.col("y.distinct") - F.col("shared"))).alias("jaccard"),
    )


def candidate_pairs(columns: DataFrame) -> DataFrame:
    """All unordered pairs of a column catalogue, in catalogue order (metadata, not data)."""
    ids = columns.select(F.struct("table", "column").alias("c"))
    listed = ids.agg(F.array_sort(F.collect_list("c")).alias("all"))
    first = listed.select(F.posexplode("all").alias("i", "a"), "all")
    pairs = first.select("i", "a", F.explode(F.slice("all", F.col("i") + 2, F.size("all"))).alias("b"))
    return pairs.select(
        F.concat_ws(".", "a.table", "a.column").alias("source"), F.concat_ws(".", "b.table", "b.column").alias("target")
    )


def relationships(a: DataFrame, a_column: str, b: DataFrame, b_column: str) -> DataFrame:
    """Shared values, the number of joined rows, and the kind of relation of two columns.

    Both sides are counted per value first: the join is on distinct values, not rows.
    """
    left = a.where(F.col(a_column).isNotNull()).groupBy(F.col(a_column).alias("value")).agg(F.count("*").alias("na"))
    right = b.where(F.col(b_column).isNotNull()).groupBy(F.col(b_column).alias("value")).agg(F.count("*").alias("nb"))
    many_a, many_b = F.max("na") > 1, F.max("nb") > 1
    return left.join(right, "value").agg(
        F.count("*").alias("shared_values"),
        F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("join_rows"),
        F.when(many_a & many_b, "many-to-many")
        .when(many_a, "many-to-one")
        .when(many_b, "one-to-many")
        .otherwise("one-to-one")
        .alias("relationship"),
    )
