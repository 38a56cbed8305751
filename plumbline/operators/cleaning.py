"""Named cleaning strategies, applied in order, each on the result of the one before.

A strategy that needs statistics takes them in one or two scans of the current result;
all others only extend the plan. Statistics come back as one row per table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from plumbline.functions.masking import strip_space
from plumbline.functions.parsing import parse_number
from plumbline.operators.ordered import last_known
from plumbline.operators.profile import null_counts
from plumbline.operators.quantiles import Spread, numeric_columns, numeric_value, spreads
from plumbline.session import at_once


@dataclass
class Options:
    """Arguments of the strategies that cannot guess them."""

    key: list[str] | None = None  # deduplicate; the first column when not given
    order: list[str] | None = None  # which duplicate counts as first; fill_null_forward
    dims: list[str] = field(default_factory=list)  # aggregate_*
    measures: list[str] | None = None
    quantiles: str = "exact"
    chunks: int | None = None  # ranges that fill_null_forward cuts the rows into


@dataclass
class Step:
    df: DataFrame
    modified: int = 0
    note: str | None = None


@dataclass
class Cleaned:
    df: DataFrame
    log: list[str]
    modified: int


Strategy = Callable[[DataFrame, Options], Step]
STRATEGIES: dict[str, tuple[str, Strategy]] = {}


def strategy(name: str, description: str) -> Callable[[Strategy], Strategy]:
    """Register a strategy; users add their own the same way."""

    def add(fn: Strategy) -> Strategy:
        STRATEGIES[name] = (description, fn)
        return fn

    return add


def strategy_list() -> dict[str, str]:
    return {name: text for name, (text, _) in STRATEGIES.items()}


def clean(df: DataFrame, names: list[str], options: Options | None = None) -> Cleaned:
    options = options or Options()
    log: list[str] = []
    modified = 0
    for name in names:
        if name not in STRATEGIES:
            log.append(f"unknown_strategy: {name} skipped")
            continue
        step = STRATEGIES[name][1](df, options)
        df, modified = step.df, modified + step.modified
        log.append(f"{name}: {step.note}" if step.note else name)
    return Cleaned(df, log, modified)


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def _count_where(df: DataFrame, condition: Column) -> int:
    return df.agg(F.count_if(condition)).first()[0]


# ---- nulls


def _fill(df: DataFrame, fills: dict[str, float | None], nulls: dict[str, int]) -> Step:
    known = {c: v for c, v in fills.items() if v is not None}
    done = df.withColumns({c: F.coalesce(_q(c).cast("double"), F.lit(float(v))) for c, v in known.items()})
    return Step(done, sum(nulls[c] for c in fills))


@strategy("fill_null_median", "nulls of number columns become the median")
def fill_null_median(df: DataFrame, options: Options) -> Step:
    numeric = numeric_columns(df)
    found, (_, nulls) = at_once(
        [lambda: spreads(df, numeric, method=options.quantiles), lambda: null_counts(df, numeric)]
    )
    return _fill(df, {c: found[c].q50 for c in numeric}, nulls)


@strategy("fill_null_mean", "nulls of number columns become the mean")
def fill_null_mean(df: DataFrame, options: Options) -> Step:
    numeric = numeric_columns(df)
    aggs = [F.avg(numeric_value(df, c)) for c in numeric] + [F.count_if(_q(c).isNull()) for c in numeric]
    row = df.agg(*aggs).first() if numeric else []
    return _fill(df, dict(zip(numeric, row)), dict(zip(numeric, row[len(numeric) :])))


@strategy("fill_null_zero", "nulls of number columns become 0")
def fill_null_zero(df: DataFrame, options: Options) -> Step:
    numeric = numeric_columns(df)
    _, nulls = null_counts(df, numeric)
    return Step(df.fillna(0, numeric), sum(nulls.values()))


@strategy("fill_null_forward", "nulls take the last known value of their key")
def fill_null_forward(df: DataFrame, options: Options) -> Step:
    if not options.key or not options.order:
        raise ValueError("fill_null_forward needs a key and an order")
    fixed = {*options.key, *options.order}
    columns = [c for c in (options.measures or df.columns) if c not in fixed]
    done = last_known(df, options.key, options.order, columns, options.chunks)
    (_, before), (_, after) = at_once([lambda: null_counts(df, columns), lambda: null_counts(done, columns)])
    return Step(done, sum(before.values()) - sum(after.values()))


@strategy("fill_null_text", "nulls of text columns become UNKNOWN")
def fill_null_text(df: DataFrame, options: Options) -> Step:
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    _, nulls = null_counts(df, text)
    return Step(df.fillna("UNKNOWN", text), sum(nulls.values()))


@strategy("drop_nulls", "rows with any null are removed")
def drop_nulls(df: DataFrame, options: Options) -> Step:
    whole = reduce(lambda a, b: a & b, [_q(c).isNotNull() for c in df.columns])
    removed = _count_where(df, ~whole)
    return Step(df.where(whole), removed, f"removed {removed} rows" if removed else None)


@strategy("flag_nulls", "a mark column for each column that has nulls")
def flag_nulls(df: DataFrame, options: Options) -> Step:
    _, nulls = null_counts(df)
    return Step(df.withColumns({f"{c}_is_null": _q(c).isNull() for c, n in nulls.items() if n}))


# ---- outliers


def in_bounds(c: Column, spread: Spread) -> Column:
    return c.between(spread.lower, spread.upper)


def outlier_bounds(df: DataFrame, options: Options) -> dict[str, Spread]:
    found = spreads(df, numeric_columns(df), method=options.quantiles)
    return {c: s for c, s in found.items() if s.known}


def inlier_mask(df: DataFrame, column: str, k: float = 1.5) -> Column:
    """Whether a value lies within k interquartile ranges of the quartiles; null stays null."""
    found = spreads(df, [column], k)[column]
    return in_bounds(_q(column).cast("double"), found) if found.known else F.lit(None).cast("boolean")


def _clipped(c: str, s: Spread) -> Column:
    v = _q(c).cast("double")
    return F.when(v.isNotNull(), F.greatest(F.least(v, F.lit(s.upper)), F.lit(s.lower)))


@strategy("outlier_clip", "values beyond the outlier bounds move to the bound, where a column has any")
def outlier_clip(df: DataFrame, options: Options) -> Step:
    hit = {c: s for c, s in outlier_bounds(df, options).items() if s.outliers}
    return Step(df.withColumns({c: _clipped(c, s) for c, s in hit.items()}), sum(s.outliers for s in hit.values()))


@strategy("outlier_winsorize", "every number column is limited to its outlier bounds")
def outlier_winsorize(df: DataFrame, options: Options) -> Step:
    return Step(df.withColumns({c: _clipped(c, s) for c, s in outlier_bounds(df, options).items()}))


@strategy("outlier_drop", "rows with a value beyond the bounds, or without a value to compare, are removed")
def outlier_drop(df: DataFrame, options: Options) -> Step:
    bounds = outlier_bounds(df, options)
    if not bounds:
        return Step(df)
    keep = reduce(lambda a, b: a & b, [in_bounds(_q(c).cast("double"), s) for c, s in bounds.items()])
    removed = _count_where(df, ~F.coalesce(keep, F.lit(False)))
    return Step(df.where(keep), removed, f"removed {removed} rows" if removed else None)


@strategy("outlier_flag", "a mark column for each column that has outliers")
def outlier_flag(df: DataFrame, options: Options) -> Step:
    hit = {c: s for c, s in outlier_bounds(df, options).items() if s.outliers}
    return Step(df.withColumns({f"{c}_is_outlier": ~in_bounds(_q(c).cast("double"), s) for c, s in hit.items()}))


# ---- duplicates


def first_rows(df: DataFrame, key: list[str], order: list[str] | None = None) -> DataFrame:
    """The first row of every key.

    A rank limit of one is applied in each task before the shuffle, so a key that holds
    a third of the rows sends one row per task.
    """
    rest = order or [c for c in df.columns if c not in key]
    by = Window.partitionBy(*[_q(c) for c in key]).orderBy(*[_q(c) for c in rest or key])
    return df.withColumn("_rank", F.row_number().over(by)).where("_rank = 1").drop("_rank")


@strategy("deduplicate", "the first row of every key stays")
def deduplicate(df: DataFrame, options: Options) -> Step:
    key = options.key or [df.columns[0]]
    kept = first_rows(df, key, options.order)
    groups = df.groupBy(*[_q(c) for c in key]).agg(F.count("*").alias("n"))
    removed = groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0))).first()[0]
    return Step(kept, removed, f"removed {removed} rows by {','.join(key)}" if removed else None)


@strategy("deduplicate_all", "equal rows stay once")
def deduplicate_all(df: DataFrame, options: Options) -> Step:
    return Step(df.dropDuplicates())


# ---- types and text


@strategy("trim_strings", "white space around text is removed")
def trim_strings(df: DataFrame, options: Options) -> Step:
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not text:
        return Step(df)
    row = df.agg(*[F.count_if(strip_space(_q(c)) != _q(c)) for c in text]).first()
    hit = {c: n for c, n in zip(text, row) if n}
    return Step(df.withColumns({c: strip_space(_q(c)) for c in hit}), sum(hit.values()))


def _adopt(df: DataFrame, parsed: dict[str, Column]) -> Step:
    """Take over a parsed column only if it has values and none is lost."""
    if not parsed:
        return Step(df)
    lost = [F.count_if(_q(c).isNotNull() & p.isNull()) for c, p in parsed.items()]
    kept = [F.count(p) for p in parsed.values()]
    row = df.agg(*lost, *kept).first()
    n = len(parsed)
    good = {c: p for i, (c, p) in enumerate(parsed.items()) if row[i] == 0 and row[n + i] > 0}
    return Step(df.withColumns(good), 0, ",".join(good) or None)


def _text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


@strategy("cast_datetime", "text columns that hold times become timestamps")
def cast_datetime(df: DataFrame, options: Options) -> Step:
    formats = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd"]
    return _adopt(
        df, {c: F.coalesce(*[F.try_to_timestamp(_q(c), F.lit(f)) for f in formats]) for c in _text_columns(df)}
    )


@strategy("cast_numeric", "text columns that hold numbers become doubles")
def cast_numeric(df: DataFrame, options: Options) -> Step:
    return _adopt(df, {c: parse_number(_q(c)) for c in _text_columns(df)})


# ---- roll-ups


def _rollup(name: str, fn: Callable[[Column], Column]) -> Strategy:
    def run(df: DataFrame, options: Options) -> Step:
        if not options.dims:
            raise ValueError(f"{name} needs dims")
        numeric = [c for c in numeric_columns(df) if c not in options.dims]
        measures = numeric if options.measures is None else options.measures
        return Step(df.groupBy(*options.dims).agg(*[fn(_q(c)).alias(c) for c in measures]))

    return run


strategy("aggregate_sum", "sums by dimension")(_rollup("aggregate_sum", F.sum))
strategy("aggregate_avg", "means by dimension")(_rollup("aggregate_avg", F.avg))


@strategy("aggregate_count", "row counts by dimension")
def aggregate_count(df: DataFrame, options: Options) -> Step:
    if not options.dims:
        raise ValueError("aggregate_count needs dims")
    return Step(df.groupBy(*options.dims).agg(F.count("*").alias("row_count")))

