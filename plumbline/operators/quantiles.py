"""Exact quantiles and outlier counts for many columns, in bounded memory.

A single ``percentile`` aggregate keeps every distinct value of a column in one
buffer, which cannot hold at cluster scale. Here the first scan only brackets each
quartile with ``percentile_approx`` (its rank error is bounded). Further scans count the
values below, inside and on the ends of each bracket, and narrow a bracket that really holds
too many values between its ends by a grid of those values. Then one scan picks the single values at
the wanted ranks from what lies inside, and one counts the values beyond the fences. A value that
repeats heavily becomes an end of a bracket, where a count is all it costs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from plumbline.session import small_frame

QUARTILES = (0.25, 0.5, 0.75)
ACCURACY = 10000
#: Most values that may lie between the ends of a bracket when single values are picked.
BRACKET_LIMIT = 200_000
#: Cells that a bracket is cut into when it is narrowed.
STEPS = 500
#: Columns handled by one job.
CHUNK = 25


@dataclass(frozen=True)
class Spread:
    """Quartiles of one column with the fences and the number of values outside them."""

    n: int
    q25: float | None
    q50: float | None
    q75: float | None
    lower: float | None
    upper: float | None
    outliers: int

    @property
    def known(self) -> bool:
        return self.q25 is not None


EMPTY = Spread(0, None, None, None, None, None, 0)


def numeric_value(df: DataFrame, name: str) -> Column:
    """The column as double with NaN as null, so that NaN cannot disturb ranks."""
    c = F.col(f"`{name}`")
    v = c.cast("double")
    if isinstance(df.schema[name].dataType, T.FractionalType):
        return F.when(~F.isnan(v), v)
    return v


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def spreads(
    df: DataFrame,
    columns: list[str],
    k: float = 1.5,
    method: str = "exact",
    accuracy: int = ACCURACY,
    bracket_limit: int = BRACKET_LIMIT,
) -> dict[str, Spread]:
    """Quartiles (linear interpolation) and outlier counts of the given numeric columns."""
    found: dict[str, Spread] = {}
    for i in range(0, len(columns), CHUNK):
        part = columns[i : i + CHUNK]
        first = df.agg(*bracket_aggs(df, part, accuracy)).first()
        found |= finish(df, part, first, k, method, accuracy, bracket_limit)
    return found


def _grid(accuracy: int) -> list[float]:
    slack = 2.0 / accuracy
    around = [min(1.0, max(0.0, p + d)) for p in QUARTILES for d in (-slack, slack)]
    return [*around, *QUARTILES]


def bracket_aggs(df: DataFrame, columns: list[str], accuracy: int = ACCURACY) -> list[Column]:
    """Aggregates of the first scan; callers may add their own to the same scan."""
    aggs = []
    for i, c in enumerate(columns):
        v = numeric_value(df, c)
        aggs += [
            F.percentile_approx(v, _grid(accuracy), accuracy).alias(f"bracket{i}"),
            F.count(v).alias(f"finite{i}"),
            F.count(F.col(f"`{c}`")).alias(f"present{i}"),
        ]
    return aggs


def finish(
    df: DataFrame,
    columns: list[str],
    first: Row,
    k: float = 1.5,
    method: str = "exact",
    accuracy: int = ACCURACY,
    bracket_limit: int = BRACKET_LIMIT,
) -> dict[str, Spread]:
    """The remaining scans, given the row of ``bracket_aggs``."""
    points = {c: first[f"bracket{i}"] for i, c in enumerate(columns)}
    counts = {c: first[f"finite{i}"] for i, c in enumerate(columns)}
    not_null = {c: first[f"present{i}"] for i, c in enumerate(columns)}
    known = [c for c in columns if counts[c] > 0]
    # Only NaN, which sorts above every fence, or nothing at all.
    result = {c: Spread(not_null[c], None, None, None, None, None, not_null[c]) for c in columns if c not in known}
    if not known:
        return result
    if method == "approx":
        return result | _approx_spreads(df, known, points, not_null, k)
    return result | _exact_spreads(df, known, points, counts, not_null, k, accuracy, bracket_limit)


def fences(q25: float, q75: float, k: float) -> tuple[float, float]:
    iqr = q75 - q25
    return q25 - k * iqr, q75 + k * iqr


def _approx_spreads(df, columns, points, not_null, k) -> dict[str, Spread]:
    quart = {c: points[c][-3:] for c in columns}
    edges = {c: fences(q[0], q[2], k) for c, q in quart.items()}
    row = df.agg(*[F.count_if(~F.col(f"`{c}`").cast("double").between(*edges[c])) for c in columns]).first()
    return {c: Spread(not_null[c], *quart[c], *edges[c], n) for c, n in zip(columns, row)}


def _rank_positions(n: int, p: float) -> tuple[int, int, float]:
    at = p * (n - 1)
    low = math.floor(at)
    return low, math.ceil(at), at - low


def _exact_spreads(df, columns, points, counts, not_null, k, accuracy, bracket_limit) -> dict[str, Spread]:
    values = {c: numeric_value(df, c) for c in columns}
    spots = [(c, j) for c in columns for j in range(len(QUARTILES))]
    ranks = {(c, j): _rank_positions(counts[c], QUARTILES[j])[:2] for c, j in spots}
    brackets = {(c, j): (points[c][2 * j], points[c][2 * j + 1]) for c, j in spots}
    found: dict[tuple[str, int, int], float] = {}
    todo = spots
    while todo:
        seen = _count(df, values, brackets, todo)
        held = []
        for spot in todo:
            lo, hi = brackets[spot]
            below, at_lo, inside, at_hi = seen[spot]
            wanted = [r for r in ranks[spot] if (*spot, r) not in found]
            if wanted[0] < below or wanted[-1] >= below + at_lo + inside + at_hi:
                brackets[spot] = (-math.inf, math.inf)  # the bound of the sketch did not hold: start over
                continue
            for r in wanted:
                if r < below + at_lo:
                    found[*spot, r] = lo
                elif r >= below + at_lo + inside:
                    found[*spot, r] = hi
            if any((*spot, r) not in found for r in wanted):
                held.append((spot, below + at_lo, inside))
        wide = [(spot, first, n) for spot, first, n in held if n > bracket_limit]
        narrow = [(spot, first) for spot, first, n in held if n <= bracket_limit]
        if narrow:
            found |= _pick(df, values, brackets, ranks, narrow)
        if wide:
            brackets |= _narrow(df, values, brackets, ranks, wide, accuracy)
        todo = [spot for spot in todo if any((*spot, r) not in found for r in ranks[spot])]
    quart = {c: [_between(found, counts[c], c, j) for j in range(len(QUARTILES))] for c in columns}
    edges = {c: fences(q[0], q[2], k) for c, q in quart.items()}
    row = df.agg(*[F.count_if(~values[c].between(*edges[c])) for c in columns]).first()
    # NaN sorts above every fence.
    return {c: Spread(not_null[c], *quart[c], *edges[c], n + not_null[c] - counts[c]) for c, n in zip(columns, row)}


def _between(found: dict, n: int, c: str, j: int) -> float:
    low, high, part = _rank_positions(n, QUARTILES[j])
    a, b = found[c, j, low], found[c, j, high]
    return a if a == b else a + (b - a) * part


def _count(df, values, brackets, spots) -> dict:
    """Values below a bracket, on its lower end, between its ends, and on its upper end."""
    aggs = []
    for spot in spots:
        v, (lo, hi) = values[spot[0]], brackets[spot]
        upper = F.count_if(v == hi) if hi > lo else F.lit(0)
        aggs += [F.count_if(v < lo), F.count_if(v == lo), F.count_if((v > lo) & (v < hi)), upper]
    row = df.agg(*[a.alias(f"n{i}") for i, a in enumerate(aggs)]).first()
    return {spot: tuple(row[4 * i : 4 * i + 4]) for i, spot in enumerate(spots)}


def _narrow(df, values, brackets, ranks, wide, accuracy) -> dict:
    """One more scan: cut each bracket at a grid of the values inside it and keep the cells around the target."""
    grid = [i / STEPS for i in range(STEPS + 1)]
    margin = 2 + math.ceil(2 * STEPS / accuracy)  # twice the error of the sketch
    aggs = []
    for i, (spot, _, _) in enumerate(wide):
        v, (lo, hi) = values[spot[0]], brackets[spot]
        aggs.append(F.percentile_approx(F.when((v > lo) & (v < hi), v), grid, accuracy).alias(f"grid{i}"))
    row = df.agg(*aggs).first()
    out = {}
    for i, (spot, start, inside) in enumerate(wide):
        low, high = ranks[spot]
        span = max(inside - 1, 1)
        first = min(STEPS, max(0, math.floor((low - start) / span * STEPS) - margin))
        last = max(0, min(STEPS, math.ceil((high - start) / span * STEPS) + margin))
        # The least and the greatest value inside are known only nearly: keep the old end beside them.
        lo, hi = brackets[spot]
        out[spot] = (row[f"grid{i}"][first] if first > 0 else lo, row[f"grid{i}"][last] if last < STEPS else hi)
    return out


def _pick(df, values, brackets, ranks, narrow) -> dict:
    """The values at the wanted ranks, counted among the values between the ends of their brackets."""
    rows = []
    for (c, j), start in narrow:
        low, high = ranks[c, j]
        rows.append((c, j, *brackets[c, j], low - start, high - start, low, high))
    ddl = "column string, j int, lo double, hi double, low long, high long, rank0 long, rank1 long"
    # At most one row per quartile of the columns of a chunk: a proven bound, safe to broadcast.
    marks = F.broadcast(small_frame(df.sparkSession, rows, ddl))
    used = sorted({c for (c, _), _ in narrow})
    inside = {
        c: reduce(lambda a, b: a | b, [(values[c] > brackets[s][0]) & (values[c] < brackets[s][1]) for s, _ in narrow if s[0] == c])
        for c in used
    }
    # Values outside all brackets of their column become null before they are spread over rows.
    kept = df.select(*[F.when(inside[c], values[c]).alias(c) for c in used])
    single = (
        kept.unpivot([], [f"`{c}`" for c in used], "column", "v")
        .where(F.col("v").isNotNull())
        .join(marks, "column")
        .where("v > lo AND v < hi")
        .groupBy("column", "j", "v", "low", "high", "rank0", "rank1")
        .agg(F.count("*").alias("n"))
    )
    # At most ``bracket_limit`` rows per quartile.
    upto = F.sum("n").over(Window.partitionBy("column", "j").orderBy("v"))
    placed = single.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("n"))
    picked = placed.select(
        "column", "j", "v", "rank0", "rank1",
        ((F.col("before") <= F.col("low")) & (F.col("low") < F.col("upto"))).alias("is0"),
        ((F.col("before") <= F.col("high")) & (F.col("high") < F.col("upto"))).alias("is1"),
    ).where("is0 OR is1").collect()
    out = {}
    for r in picked:
        for side in (0, 1):
            if r[f"is{side}"]:
                out[r["column"], r["j"], r[f"rank{side}"]] = r["v"]
    return out
