"""Texts that carry records (JSON array or object, or CSV with a header) as rows, and rows as texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# While a text is cut, this character and a letter stand for a comma or a line break within quotes,
# and for the character itself, so that any text comes back as it was.
ESCAPE = "\ue000"
SHELTERED = {",": "c", "\n": "n", "\r": "r"}


def _unquote(c: Column) -> Column:
    inner = c
    for sign, letter in SHELTERED.items():
        inner = F.replace(inner, F.lit(ESCAPE + letter), F.lit(sign))
    inner = F.replace(inner, F.lit(ESCAPE + "x"), F.lit(ESCAPE))
    return F.regexp_replace(F.regexp_replace(F.trim(inner), r'^"|"$', ""), '""', '"')


def _sheltered(text: Column) -> Column:
    """The text with commas and line breaks within quotes replaced; every second part between quotes is inside."""

    def shelter(part: Column) -> Column:
        for sign, letter in SHELTERED.items():
            part = F.replace(part, F.lit(sign), F.lit(ESCAPE + letter))
        return part

    marked = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "x"))
    parts = F.transform(F.split(marked, '"'), lambda part, i: F.when(i % 2 == 1, shelter(part)).otherwise(part))
    return F.array_join(parts, '"')


def _csv_records(text: Column, fields: list[str]) -> Column:
    """Records of a CSV text by the names in its first line; null without a known name there."""
    lines = F.filter(F.split(_sheltered(text), r"\r?\n"), lambda x: F.trim(x) != "")
    header = F.transform(F.split(F.get(lines, F.lit(0)), ","), _unquote)

    def record(line: Column) -> Column:
        values = F.transform(F.split(line, ","), _unquote)

        def value(name: str) -> Column:
            at = F.array_position(header, F.lit(name))
            v = F.get(values, (at - 1).cast("int"))
            return F.when((at > 0) & (v != ""), v).alias(name)

        return F.struct(*[value(f) for f in fields])

    known = F.arrays_overlap(header, F.array(*[F.lit(f) for f in fields]))
    return F.when(known, F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), record))


def parse_payloads(df: DataFrame, column: str, fields: list[str], keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Records of every payload as text columns, and the payloads that are neither JSON nor CSV.

    JSON is tried first; a text that looks like JSON and is none is tried as CSV. All in one
    projection: no shuffle, no Python.
    """
    keep = keep or []
    record = T.StructType([T.StructField(f, T.StringType()) for f in fields])
    text = F.col(column)
    looks_json = F.trim(text).rlike(r"^[\[{]")
    as_json = F.when(looks_json, F.from_json(text, T.ArrayType(record)))
    records = F.coalesce(F.filter(as_json, lambda r: r.isNotNull()), _csv_records(text, fields))
    parsed = df.select(*keep, text.alias("_payload"), records.alias("_records"))
    good = parsed.where(F.col("_records").isNotNull()).select(*keep, F.inline("_records"))
    bad = parsed.where(F.col("_records").isNull()).select(*keep, F.col("_payload").alias(column))
    return good, bad


def serialize(df: DataFrame, fmt: str = "json") -> DataFrame:
    """Rows as text: ``json`` and ``csv`` give one line per row, ``records`` the rows themselves."""
    if fmt == "records":
        return df
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    if fmt == "json":
        return df.select(F.to_json(whole).alias("line"))
    if fmt == "csv":
        return df.select(F.to_csv(whole).alias("line"))
    raise ValueError(f"unknown format {fmt}")
