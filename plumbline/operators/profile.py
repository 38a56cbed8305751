"""Column profiles: one long row per (table, column), from a fixed number of scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.parsing import parse_number
from plumbline.operators.quantiles import EMPTY, Spread, bracket_aggs, finish, numeric_columns, numeric_value, spreads
from plumbline.session import at_once, small_frame

PROFILE_SCHEMA = (
    "`table` string, `column` string, dtype string, row_count long, null_count long, null_pct double, "
    "distinct_count long, distinct_pct double, min string, max string, mean double, std double, "
    "q25 double, q75 double, outlier_count long, outlier_pct double"
)
STATS_SCHEMA = (
    "`table` string, `column` string, `count` long, null_count long, null_pct double, unique_count long, "
    "unique_ratio double, min double, max double, mean double, stdev double"
)
#: Columns per aggregate; a wider one leaves code generation and plans slowly.
CHUNK = 25


def is_flat(dtype: T.DataType) -> bool:
    return not isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType))


def chunks(items: list, size: int = CHUNK) -> list[list]:
    return [items[i : i + size] for i in range(0, len(items), size)]


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def distinct_counts(df: DataFrame, columns: list[str], exact: bool = True, one_pass: bool = False) -> dict[str, int]:
    """Distinct non-null values per column.

    Exact counts take a small job per column, which reads that column alone: together they read a
    columnar table once. Where a row is dear to come by, as from text files or behind joins,
    ``one_pass`` counts all columns in one reading.
    """
    if exact and one_pass:
        return _exact_counts(df, {c: _q(c) for c in columns})
    if exact:
        single = [lambda c=c: df.select(_q(c).alias("v")).where("v is not null").distinct().count() for c in columns]
        return dict(zip(columns, at_once(single)))
    found: dict[str, int] = {}
    for part in chunks(columns):
        row = df.agg(*[F.approx_count_distinct(_q(c)).alias(f"d{i}") for i, c in enumerate(part)]).first()
        found |= dict(zip(part, row))
    return found


def _exact_counts(df: DataFrame, values: dict[str, Column]) -> dict[str, int]:
    """Distinct non-null values of each expression, in one grouped pass.

    A value goes as its column's number and a hash of 128 bits, whatever its type and length, and
    is reduced per task before the shuffle; no row carries the other columns along.
    """
    found = dict.fromkeys(values, 0)
    for part in chunks(list(values)):
        one = [
            F.when(values[c].isNotNull(), F.struct(F.lit(i).alias("i"), F.xxhash64(values[c]).alias("a"), F.xxhash64(F.lit(1), values[c]).alias("b")))
            for i, c in enumerate(part)
        ]
        seen = df.select(F.explode(F.array(*one)).alias("v")).where("v is not null").select("v.i", "v.a", "v.b").distinct()
        found |= {part[r["i"]]: r["count"] for r in seen.groupBy("i").count().collect()}
    return found


def null_counts(df: DataFrame, columns: list[str] | None = None) -> tuple[int, dict[str, int]]:
    """Row count and null count of each column, in one scan."""
    columns = df.columns if columns is None else columns
    row = df.agg(F.count(F.lit(1)), *[F.count_if(_q(c).isNull()) for c in columns]).first()
    return row[0], dict(zip(columns, row[1:]))


def profile_rows(
    df: DataFrame,
    table: str,
    distinct: str = "exact",
    quantiles: str = "exact",
    min_outlier_values: int = 0,
    columns: list[str] | None = None,
) -> list[tuple]:
    """Statistics of every column as driver rows: as many rows as the table has columns."""
    names = columns or df.columns
    flat = [c for c in names if is_flat(df.schema[c].dataType)]
    stats: dict[str, dict] = {}
    spread: dict[str, Spread] = {}
    total = 0

    def scan(part: list[str]) -> None:
        nonlocal total
        numeric = [c for c in numeric_columns(df) if c in part]
        aggs = [F.count(F.lit(1)).alias("rows"), *bracket_aggs(df, numeric)]
        for i, c in enumerate(part):
            aggs.append(F.count(_q(c)).alias(f"n{i}"))
            if c in flat:
                aggs += [F.min(_q(c)).cast("string").alias(f"lo{i}"), F.max(_q(c)).cast("string").alias(f"hi{i}")]
            if c in numeric:
                v = numeric_value(df, c)
                aggs += [F.avg(v).alias(f"avg{i}"), F.stddev_samp(v).alias(f"std{i}")]
        row = df.agg(*aggs).first()
        total = row["rows"]
        known = row.asDict()
        for i, c in enumerate(part):
            stats[c] = {k: known.get(f"{k}{i}") for k in ("n", "lo", "hi", "avg", "std")}
        spread.update(finish(df, numeric, row, method=quantiles))

    exact = distinct == "exact"
    *_, uniques = at_once([*[lambda p=p: scan(p) for p in chunks(names)], lambda: distinct_counts(df, flat, exact)])
    rows = []
    for c in names:
        s, sp = stats[c], spread.get(c, EMPTY)
        outliers = sp.outliers if s["n"] > min_outlier_values else 0
        std = s["std"]
        if s["n"] == 1 and s["avg"] is not None:
            std = 0.0
        rows.append(
            (
                table,
                c,
                df.schema[c].dataType.simpleString(),
                total,
                total - s["n"],
                _share(total - s["n"], total),
                uniques.get(c, 0),
                _share(uniques.get(c, 0), total),
                s["lo"],
                s["hi"],
                s["avg"],
                std,
                sp.q25,
                sp.q75,
                outliers,
                _share(outliers, total),
            )
        )
    return rows


def _share(part: int, whole: int) -> float:
    return part / whole if whole else 0.0


QUICK_SCHEMA = "`table` string, `column` string, row_count long, null_pct double, outlier_pct double"


def quick_rows(df: DataFrame, table: str, quantiles: str = "exact") -> list[tuple]:
    """Null and outlier shares alone: no distinct values, no other statistics."""
    rows = []
    for part in chunks(df.columns):
        numeric = [c for c in numeric_columns(df) if c in part]
        nulls = [F.count(_q(c)).alias(f"n{i}") for i, c in enumerate(part)]
        row = df.agg(F.count(F.lit(1)).alias("rows"), *nulls, *bracket_aggs(df, numeric)).first()
        spread = finish(df, numeric, row, method=quantiles)
        total = row["rows"]
        rows += [
            (table, c, total, _share(total - row[f"n{i}"], total), _share(spread.get(c, EMPTY).outliers, total))
            for i, c in enumerate(part)
        ]
    return rows


def quick_profile(spark: SparkSession, tables: dict[str, DataFrame], **options) -> DataFrame:
    found = at_once([lambda n=n, df=df: quick_rows(df, n, **options) for n, df in tables.items()])
    return small_frame(spark, [row for rows in found for row in rows], QUICK_SCHEMA)


def profile(spark: SparkSession, tables: dict[str, DataFrame], **options) -> DataFrame:
    """Profile of all given tables, long form."""
    found = at_once([lambda n=n, df=df: profile_rows(df, n, **options) for n, df in tables.items()])
    return small_frame(spark, [row for rows in found for row in rows], PROFILE_SCHEMA)


def audit_profile(spark: SparkSession, tables: dict[str, DataFrame], **options) -> DataFrame:
    """Profile for the audit: outliers only where more than four values exist, shares rounded to 4 places."""
    found = profile(spark, tables, min_outlier_values=4, **options)
    shares = ["null_pct", "distinct_pct", "outlier_pct"]
    return found.withColumns({c: F.round(c, 4) for c in shares})


def clean_column(df: DataFrame, column: str, strategy: str = "median") -> DataFrame:
    """Fill the nulls of one column: median, mean or zero for numbers (median if unknown), a mark for text."""
    dtype = df.schema[column].dataType
    if isinstance(dtype, T.StringType):
        return df.withColumn(column, F.coalesce(_q(column), F.lit("UNKNOWN")))
    if not isinstance(dtype, T.NumericType):
        return df
    if strategy == "zero":
        fill = 0
    elif strategy == "mean":
        fill = df.agg(F.avg(numeric_value(df, column))).first()[0]
    else:
        fill = spreads(df, [column])[column].q50
    if fill is None:
        return df
    target = dtype if strategy == "zero" else T.DoubleType()
    return df.withColumn(column, F.coalesce(_q(column).cast(target), F.lit(fill).cast(target)))


def blank_to_null(df: DataFrame, name: str) -> Column:
    """Null or white space counts as missing in relationship inference."""
    c = _q(name)
    if isinstance(df.schema[name].dataType, T.StringType):
        return F.when(F.length(F.regexp_replace(c, r"(?U)\s+", "")) > 0, c)
    return c


def inference_stats(df: DataFrame, table: str) -> list[tuple]:
    """Counts, uniqueness over present values, and number statistics over the values that parse."""
    names = [c for c in df.columns if is_flat(df.schema[c].dataType)]
    rows = []
    for part in chunks(names):
        present = {c: blank_to_null(df, c) for c in part}
        number = {
            c: numeric_value(df, c)
            if c in numeric_columns(df)
            else (parse_number(present[c]) if isinstance(df.schema[c].dataType, T.StringType) else F.lit(None).cast("double"))
            for c in part
        }
        aggs = [F.count(F.lit(1)).alias("rows")]
        for i, c in enumerate(part):
            v = number[c]
            aggs += [
                F.count(present[c]).alias(f"n{i}"),
                F.min(v).alias(f"lo{i}"),
                F.max(v).alias(f"hi{i}"),
                F.avg(v).alias(f"avg{i}"),
                F.stddev_pop(v).alias(f"std{i}"),
            ]
        row, unique = at_once([lambda a=aggs: df.agg(*a).first(), lambda v=present: _exact_counts(df, v)])
        for i, c in enumerate(part):
            n, total = row[f"n{i}"], row["rows"]
            rows.append(
                (
                    table,
                    c,
                    n,
                    total - n,
                    1.0 if n == 0 else (total - n) / total,
                    unique[c],
                    unique[c] / n if n else 0.0,
                    *[row[f"{k}{i}"] for k in ("lo", "hi", "avg", "std")],
                )
            )
    return rows


def column_statistics(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    found = at_once([lambda n=n, df=df: inference_stats(df, n) for n, df in tables.items()])
    return small_frame(spark, [row for rows in found for row in rows], STATS_SCHEMA)
