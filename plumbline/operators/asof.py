"""As-of join: to each row the last row of another table before its time.

Both tables are laid into one order and the found columns are carried forward along it, over
ranges of rows (``ordered``): a key that holds a large part of either table spreads over tasks,
and no row is paired with more than the one that it keeps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.ordered import last_known


def as_of(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    ts: str,
    columns: list[str],
    tie: str,
    strict: bool = True,
    chunks: int | None = None,
) -> DataFrame:
    """``left`` with ``columns`` of the last row of ``right`` that has its keys and a time before ``ts``.

    Both sides name their keys and the time alike. Without ``strict`` a row of the same time
    counts too. Of right rows of one time the greatest ``tie`` is the last. Rows without a key, a
    time or an earlier row get nulls; every left row stays, once.
    """
    key = [f"_key{i}" for i in range(len(keys))]
    both = lambda df: [F.col(f"`{k}`").alias(n) for k, n in zip(keys, key)]
    found = F.struct(*[F.col(f"`{c}`") for c in columns])
    # Of equal times, what comes first in the order is seen by what comes after it.
    mine, theirs = (0, 1) if strict else (1, 0)
    rows = left.select(*both(left), F.col(f"`{ts}`").alias("_ts"), F.lit(mine).alias("_side"), F.struct("*").alias("_left"))
    known = right.where(F.col(f"`{ts}`").isNotNull())
    known = known.select(*both(right), F.col(f"`{ts}`").alias("_ts"), F.lit(theirs).alias("_side"), F.col(f"`{tie}`").alias("_tie"), found.alias("_found"))
    every = rows.unionByName(known, allowMissingColumns=True)
    carried = last_known(every, key, ["_ts", "_side", "_tie"], ["_found"], chunks).where("_left is not null")
    fits = F.col("_ts").isNotNull()
    for k in key:
        fits = fits & F.col(k).isNotNull()
    return carried.select("_left.*", *[F.when(fits, F.col("_found")[c]).alias(c) for c in columns])


def factual_scores(ops: DataFrame, history: DataFrame, at: str = "run_ts") -> DataFrame:
    """Each operation with the score its table had when it was made: that of the last run before it.

    ``ops(table, run_ts, ...)`` and ``history(table, run_ts, score)``; runs of one time go by the score.
    """
    return as_of(ops, history, ["table"], at, ["score"], "score").withColumnRenamed("score", "factual")
