"""Column-to-column edges found in the data, with strength and confidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.parsing import parse_number
from plumbline.operators.association import all_pairs, chi_squares, correlations
from plumbline.operators.overlap import overlaps
from plumbline.operators.profile import blank_to_null, inference_stats, is_flat
from plumbline.operators.quantiles import numeric_columns, numeric_value
from plumbline.session import at_once, small_frame

EDGE_SCHEMA = (
    "source string, target string, mechanism string, strength double, confidence double, "
    "delay_steps int, metrics map<string,double>"
)
# Thresholds and the parts of the confidence formulas.
OVERLAP_MIN = 0.60
CORRELATION_MIN = 0.70
CHI_MIN = 0.40
NULL_CORRELATION_MIN = 0.50
CASCADE_MIN = 0.50
BASE = 0.75
KEY_RATIO = 0.99
MIN_ROWS = 10


def _edge(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return small_frame(spark, rows, EDGE_SCHEMA)


Stats = dict[str, dict[str, tuple]]


def table_stats(tables: dict[str, DataFrame]) -> Stats:
    """Statistics of every column by table and column; take them once for several mechanisms."""
    found = at_once([lambda t=t, df=df: inference_stats(df, t) for t, df in tables.items()])
    return {t: {r[1]: r for r in rows} for t, rows in zip(tables, found)}


def foreign_keys(spark: SparkSession, tables: dict[str, DataFrame], stats: Stats | None = None) -> DataFrame:
    """Edges between tables, from the less unique column to the more unique one that shares its values."""
    rows = [(f"{t}.{c}", r[6]) for t, rs in (stats or table_stats(tables)).items() for c, r in rs.items()]
    ratio = small_frame(spark, rows, "node string, unique_ratio double")
    pairs = overlaps(spark, tables).where(F.col("overlap") >= OVERLAP_MIN)
    both = pairs.join(ratio.toDF("source", "ra"), "source").join(ratio.toDF("target", "rb"), "target")
    up = F.col("ra") < F.col("rb")
    a, b = F.least("ra", "rb"), F.greatest("ra", "rb")
    confidence = BASE + 0.2 * F.col("overlap") + 0.1 * (b - a)
    return both.where(F.col("ra") != F.col("rb")).select(
        F.when(up, F.col("source")).otherwise(F.col("target")).alias("source"),
        F.when(up, F.col("target")).otherwise(F.col("source")).alias("target"),
        F.lit("foreign_key").alias("mechanism"),
        F.least(F.lit(1.0), "overlap").alias("strength"),
        F.least(F.lit(0.99), confidence).alias("confidence"),
        F.lit(1).alias("delay_steps"),
        F.create_map(
            F.lit("overlap_ratio"), F.col("overlap"), F.lit("source_unique_ratio"), a, F.lit("target_unique_ratio"), b
        ).alias("metrics"),
    )


def _numbers(df: DataFrame) -> dict[str, Column]:
    """Number columns, and text columns read as numbers."""
    found = {c: numeric_value(df, c) for c in numeric_columns(df)}
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType):
            found[f.name] = parse_number(F.col(f"`{f.name}`"))
    return {c: found[c] for c in df.columns if c in found}


def transforms(spark: SparkSession, tables: dict[str, DataFrame], stats: Stats | None = None) -> DataFrame:
    """Edges within a table between strongly correlated numbers, from the smaller spread to the larger."""
    known = stats or table_stats(tables)
    rows = []
    for t, df in tables.items():
        stats = known[t]
        values = {c: v for c, v in _numbers(df).items() if stats[c][10] and stats[c][10] > 0}
        for (a, b), (r, n) in correlations(df, values, all_pairs(list(values))).items():
            if n >= 5 and abs(r) >= CORRELATION_MIN:
                sa, sb = stats[a][10], stats[b][10]
                src, dst, s1, s2 = (a, b, sa, sb) if sa < sb else (b, a, sb, sa)
                metrics = {"correlation": r, "source_stdev": s1, "target_stdev": s2}
                rows.append(
                    (f"{t}.{src}", f"{t}.{dst}", "etl_transform", abs(r), min(0.95, BASE + 0.15 * abs(r)), 1, metrics)
                )
    return _edge(spark, rows)


def dependencies(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """Edges within a table where the binned chi-square is large, from the earlier column to the later."""
    parts = []
    for t, df in tables.items():
        columns = [f.name for f in df.schema.fields if is_flat(f.dataType)]
        if len(columns) < 2:
            continue
        found = chi_squares(df, columns).where((F.col("n") >= MIN_ROWS) & (F.col("chi2") >= CHI_MIN))
        parts.append(
            found.select(
                F.concat(F.lit(f"{t}."), "x").alias("source"),
                F.concat(F.lit(f"{t}."), "y").alias("target"),
                F.lit("schema_dependency").alias("mechanism"),
                F.least(F.lit(1.0), "chi2").alias("strength"),
                F.least(F.lit(0.90), BASE + (1 - F.col("p_value")) * 0.15).alias("confidence"),
                F.lit(1).alias("delay_steps"),
                F.create_map(F.lit("chi_square"), F.col("chi2"), F.lit("p_value"), F.col("p_value")).alias("metrics"),
            )
        )
    return reduce(DataFrame.unionByName, parts) if parts else _edge(spark, [])


def quality_propagation(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """Edges within a table between columns that are missing together."""
    rows = []
    for t, df in tables.items():
        columns = [f.name for f in df.schema.fields if is_flat(f.dataType)]
        missing = {c: F.when(blank_to_null(df, c).isNull(), 1.0).otherwise(0.0) for c in columns}
        row = df.agg(F.count(F.lit(1)), *[F.avg(missing[c]) for c in columns]).first()
        if row[0] < MIN_ROWS:
            continue
        share = dict(zip(columns, row[1:]))
        # A column that never lacks a value has a constant mark, hence no correlation.
        columns = [c for c in columns if 0 < share[c] < 1]
        pairs = [(a, b) for a, b in all_pairs(columns) if share[a] > 0.1 or share[b] > 0.1]
        for (a, b), (r, _) in correlations(df, missing, pairs).items():
            if r >= NULL_CORRELATION_MIN:
                metrics = {"null_correlation": r, "source_null_pct": share[a], "target_null_pct": share[b]}
                rows.append(
                    (f"{t}.{a}", f"{t}.{b}", "quality_propagation", r, min(0.85, BASE + 0.1 * r), 1, metrics)
                )
    return _edge(spark, rows)


def cascades(spark: SparkSession, tables: dict[str, DataFrame], stats: Stats | None = None) -> DataFrame:
    """Edges from the key of a table to nearly unique columns that move with it."""
    known = stats or table_stats(tables)
    rows = []
    for t, df in tables.items():
        stats = known[t]
        key = next((c for c, s in stats.items() if s[6] > KEY_RATIO), None)
        values = _numbers(df)
        if key is None or key not in values:
            continue
        near = [c for c in values if c != key and 0.5 < stats[c][6] <= KEY_RATIO]
        for (_, c), (r, n) in correlations(df, values, [(key, c) for c in near]).items():
            if n >= MIN_ROWS and abs(r) > CASCADE_MIN:
                rows.append(
                    (
                        f"{t}.{key}",
                        f"{t}.{c}",
                        "cascading_failure",
                        abs(r) * 0.7,
                        min(0.80, BASE + abs(r) * 0.05),
                        1,
                        {"correlation": r},
                    )
                )
    return _edge(spark, rows)


def infer_edges(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """All mechanisms together, over one set of column statistics."""
    stats = table_stats(tables)
    parts = at_once(
        [
            lambda: foreign_keys(spark, tables, stats),
            lambda: transforms(spark, tables, stats),
            lambda: dependencies(spark, tables),
            lambda: quality_propagation(spark, tables),
            lambda: cascades(spark, tables, stats),
        ]
    )
    return reduce(DataFrame.unionByName, parts)


def name_keys(columns: DataFrame) -> DataFrame:
    """Foreign keys by name alone: ``x_id``/``x_key`` to another table's ``x_name`` or same column."""
    keys = columns.where(F.col("column").rlike("(_id|_key)$")).select(
        F.col("table").alias("t1"),
        F.col("column").alias("c1"),
        F.inline(
            F.array(
                F.struct(
                    F.concat(F.regexp_replace("column", "_id|_key", ""), F.lit("_name")).alias("wanted"),
                    F.lit(1.0).alias("strength"),
                    F.lit(0.8).alias("confidence"),
                ),
                F.struct(F.col("column").alias("wanted"), F.lit(0.9).alias("strength"), F.lit(0.7).alias("confidence")),
            )
        ),
    )
    other = columns.select(F.col("table").alias("t2"), F.col("column").alias("c2"))
    return keys.join(other, (F.col("wanted") == F.col("c2")) & (F.col("t1") != F.col("t2"))).select(
        F.concat_ws(".", "t1", "c1").alias("source"),
        F.concat_ws(".", "t2", "c2").alias("target"),
        F.lit("foreign_key").alias("mechanism"),
        "strength",
        "confidence",
        F.lit(1).alias("delay_steps"),
        F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>")).alias("metrics"),
    )
