"""Pairwise association of columns: Pearson correlation and binned chi-square.

The number of pairs grows with the square of the columns, far beyond what one wide SQL
aggregate can hold. Each task therefore reduces its Arrow batches to small matrices
(moments, or bin counts of every pair) and emits them once; Spark adds them up. One scan
serves all pairs, and the shuffle carries a fixed number of rows per task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.parsing import as_number
from plumbline.session import small_frame

BINS = 10
#: A variance below this share of the second moment is rounding noise of a constant.
NOISE = 1e-13

Pair = tuple[str, str]
MOMENTS = ["n", "sx", "sy", "sxx", "syy", "sxy"]


def all_pairs(columns: list[str]) -> list[Pair]:
    return list(combinations(columns, 2))


def _matrix(batch: pa.RecordBatch, columns: list[int]) -> np.ndarray:
    """Columns of a batch as doubles; nulls and infinite values as NaN, which counts as missing."""
    raw = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in columns])
    return np.where(np.isfinite(raw), raw, np.nan)


def correlations(df: DataFrame, values: dict[str, Column], pairs: list[Pair]) -> dict[Pair, tuple[float, int]]:
    """Correlation over rows with both values, 0 where undefined, and the number of such rows."""
    if not pairs:
        return {}
    used = sorted({c for p in pairs for c in p})
    at = {c: i for i, c in enumerate(used)}
    raw = df.select(*[values[c].cast("double").alias(f"v{i}") for i, c in enumerate(used)])
    # Infinite values and NaN count as missing, or no moment would be finite.
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c))
    numbers = raw.select(*[finite(c).alias(c) for c in raw.columns])
    ends = numbers.agg(*[f(f"v{i}") for i in range(len(used)) for f in (F.min, F.max, F.avg)]).first()
    # Moments around the mean keep their digits; around the value itself for a constant column.
    shift = np.array(
        [0.0 if ends[3 * i] is None else ends[3 * i + (0 if ends[3 * i] == ends[3 * i + 1] else 2)] for i in range(len(used))]
    )
    rows = np.array([at[a] for a, _ in pairs])
    cols = np.array([at[b] for _, b in pairs])
    width = len(used)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(MOMENTS), width, width))
        for batch in batches:
            raw = _matrix(batch, list(range(width))) - shift
            there = ~np.isnan(raw)
            x, m = np.where(there, raw, 0.0), there.astype(float)
            square = x * x
            total += np.stack([m.T @ m, x.T @ m, m.T @ x, square.T @ m, m.T @ square, x.T @ x])
        picked = total[:, rows, cols]
        arrays = [pa.array(np.arange(len(rows), dtype="int32")), *[pa.array(p) for p in picked]]
        yield pa.RecordBatch.from_arrays(arrays, names=["pair", *MOMENTS])

    sums = (
        numbers.mapInArrow(moments, "pair int, " + ", ".join(f"{m} double" for m in MOMENTS))
        .groupBy("pair")
        .agg(*[F.sum(m).alias(m) for m in MOMENTS])
        .collect()
    )
    found = {p: (0.0, 0) for p in pairs}
    for r in sums:
        found[pairs[r["pair"]]] = (_r(r), int(r["n"]))
    return found


def _r(s) -> float:
    if s["n"] < 2:
        return 0.0
    vx, vy = s["sxx"] - s["sx"] ** 2 / s["n"], s["syy"] - s["sy"] ** 2 / s["n"]
    if vx <= NOISE * s["sxx"] or vy <= NOISE * s["syy"]:
        return 0.0
    return max(-1.0, min(1.0, (s["sxy"] - s["sx"] * s["sy"] / s["n"]) / math.sqrt(vx * vy)))


CHI_SCHEMA = "x string, y string, n long, chi2 double, p_value double"


def chi_squares(df: DataFrame, columns: list[str], pairs: list[Pair] | None = None, bins: int = BINS) -> DataFrame:
    """Chi-square over n and its approximate p of every pair, on equal-width bins over the joint
    range of the two columns, over rows with both values.

    Scan 1 finds the joint ranges, scan 2 counts at most bins x bins cells per pair.
    """
    spark: SparkSession = df.sparkSession
    pairs = all_pairs(columns) if pairs is None else pairs
    used = sorted({c for p in pairs for c in p})
    at = {c: i for i, c in enumerate(used)}
    left, right = [at[a] for a, _ in pairs], [at[b] for _, b in pairs]
    numbers = df.select(
        *[as_number(F.col(f"`{c}`"), df.schema[c].dataType).alias(f"v{i}") for i, c in enumerate(used)]
    )
    width = len(used)

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(pairs), dtype="int64")
        lo, hi = np.full(len(pairs), math.inf), np.full(len(pairs), -math.inf)
        for batch in batches:
            v = _matrix(batch, list(range(width)))
            for i, (a, b) in enumerate(zip(left, right)):
                x, y = _both(v[:, a], v[:, b])
                if len(x):
                    n[i] += len(x)
                    lo[i] = min(lo[i], x.min(), y.min())
                    hi[i] = max(hi[i], x.max(), y.max())
        arrays = [pa.array(np.arange(len(pairs), dtype="int32")), pa.array(n), pa.array(lo), pa.array(hi)]
        yield pa.RecordBatch.from_arrays(arrays, names=["pair", "n", "lo", "hi"])

    ends = {
        r["pair"]: (r["n"], r["lo"], r["hi"])
        for r in numbers.mapInArrow(ranges, "pair int, n long, lo double, hi double")
        .groupBy("pair")
        .agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .collect()
    }
    live = [i for i in range(len(pairs)) if i in ends and ends[i][0] >= 5 and ends[i][2] > ends[i][1]]
    dead = sorted({*range(len(pairs))} - {*live})
    flat = small_frame(
        spark,
        [(*pairs[i], ends[i][0] if i in ends else 0, 0.0, 1.0) for i in dead],
        CHI_SCHEMA,
    )
    if not live:
        return flat

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((len(live), bins * bins), dtype="int64")
        for batch in batches:
            v = _matrix(batch, list(range(width)))
            for k, i in enumerate(live):
                _, lo, hi = ends[i]
                x, y = _both(v[:, left[i]], v[:, right[i]])
                cell = _bin(x, lo, hi, bins) * bins + _bin(y, lo, hi, bins)
                seen[k] += np.bincount(cell, minlength=bins * bins)
        k, cell = np.nonzero(seen)
        arrays = [
            pa.array(np.array(live, dtype="int32")[k]),
            pa.array((cell // bins).astype("int32")),
            pa.array((cell % bins).astype("int32")),
            pa.array(seen[k, cell]),
        ]
        yield pa.RecordBatch.from_arrays(arrays, names=["pair", "bx", "by", "seen"])

    cells = (
        numbers.mapInArrow(counts, "pair int, bx int, by int, seen long")
        .groupBy("pair", "bx", "by")
        .agg(F.sum("seen").alias("seen"))
    )
    # At most bins x bins rows per pair from here on.
    total = F.sum("seen").over(Window.partitionBy("pair"))
    by_row, by_column = F.sum("seen").over(Window.partitionBy("pair", "bx")), F.sum("seen").over(Window.partitionBy("pair", "by"))
    scored = (
        cells.select("pair", "seen", (by_row * by_column / total).alias("expected"))
        .groupBy("pair")
        .agg(
            F.sum("seen").alias("n"),
            F.sum(F.pow(F.col("seen") - F.col("expected"), 2) / F.col("expected")).alias("stat"),
        )
    )
    names = small_frame(spark, [(i, *pairs[i]) for i in live], "pair int, x string, y string")
    p = F.when(F.col("stat") > 0, F.exp(-F.col("stat") / 2)).otherwise(1.0)
    return (
        scored.join(F.broadcast(names), "pair")
        .select("x", "y", "n", (F.col("stat") / F.col("n")).alias("chi2"), p.alias("p_value"))
        .unionByName(flat)
    )


def _both(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    there = ~(np.isnan(x) | np.isnan(y))
    return x[there], y[there]


def _bin(v: np.ndarray, lo: float, hi: float, bins: int) -> np.ndarray:
    return np.floor((v - lo) / (hi - lo) * (bins - 1)).astype("int64")
