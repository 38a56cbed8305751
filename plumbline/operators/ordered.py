"""Running computations along an order, safe when one key holds a large part of all rows.

A window over ``partitionBy(key)`` puts a whole key into one task. Here rows are ranged over
tasks by key and order columns of any type, so that a large key, and even many rows of one
time, spread over several. The part of the range that a row lies in is written down as its
chunk; the window runs per (key, chunk), and what a chunk needs from earlier ones is carried
over by a small table of one row per (key, chunk).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.session import cut_lineage

CHUNK = "_chunk"


def with_chunks(df: DataFrame, keys: list[str], order: list[str], chunks: int | None = None) -> DataFrame:
    """Add a chunk number that never decreases along the order within a key.

    ``chunks`` is the number of ranges; by default it is the number of shuffle partitions.
    The rows are written to the shared folder, which fixes the numbers.
    """
    by = [F.col(f"`{c}`") for c in [*keys, *order]]
    ranged = df.repartitionByRange(chunks, *by) if chunks else df.repartitionByRange(*by)
    return cut_lineage(ranged.withColumn(CHUNK, F.spark_partition_id()))


def last_known(
    df: DataFrame, keys: list[str], order: list[str], columns: list[str], chunks: int | None = None
) -> DataFrame:
    """Carry the last non-null value of each column forward within its key.

    The order must be total within a key: ties are broken by the later order columns.
    """
    cut = with_chunks(df, keys, order, chunks)
    by_key, by_order = [F.col(f"`{k}`") for k in keys], [F.col(f"`{c}`") for c in order]
    value = {c: F.col(f"`{c}`") for c in columns}
    run = Window.partitionBy(*by_key, CHUNK).orderBy(*by_order).rowsBetween(Window.unboundedPreceding, 0)
    filled = cut.withColumns({f"_run_{i}": F.last(value[c], ignorenulls=True).over(run) for i, c in enumerate(columns)})
    spot = F.struct(*by_order)
    ends = cut.groupBy(*by_key, CHUNK).agg(
        *[F.max_by(value[c], F.when(value[c].isNotNull(), spot)).alias(f"_end_{i}") for i, c in enumerate(columns)]
    )
    before = Window.partitionBy(*by_key).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carry = {f"_carry_{i}": F.last(f"_end_{i}", ignorenulls=True).over(before) for i in range(len(columns))}
    filled = join_carry(filled, ends, keys, carry)
    known = {c: F.coalesce(f"_run_{i}", f"_carry_{i}") for i, c in enumerate(columns)}
    return filled.select(*[known[c].alias(c) if c in known else F.col(f"`{c}`") for c in df.columns])


def join_carry(rows: DataFrame, ends: DataFrame, keys: list[str], carry: dict[str, Column]) -> DataFrame:
    """Add to every row what its (key, chunk) takes over from earlier chunks; null keys meet each other.

    ``ends`` has one row per (key, chunk), and ``carry`` windows over it.
    """
    names = {k: f"_key_{i}" for i, k in enumerate(keys)}
    small = ends.select(*[F.col(f"`{k}`").alias(n) for k, n in names.items()], F.col(CHUNK).alias("_at"), *[c.alias(n) for n, c in carry.items()])
    same = F.col(CHUNK) == F.col("_at")
    for k, n in names.items():
        same = same & F.col(f"`{k}`").eqNullSafe(F.col(n))
    return rows.join(small, same, "left").drop(*names.values(), "_at")
