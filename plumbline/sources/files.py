"""Files: find, read by type, and ingest into layer tables."""

from __future__ import annotations

import hashlib

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.names import NAME_LENGTH, clean_name_text
from plumbline.operators.profile import null_counts
from plumbline.sources.tables import write_table
from plumbline.session import small_frame

SUFFIXES = ["csv", "json", "parquet"]
INGEST_SCHEMA = "file string, `table` string, status string, row_count long, column_count int, error string"
LINEAGE_SCHEMA = "`table` string, `column` string, source_file string, dtype string, null_pct double"


def _any_case(text: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" for c in text)


def scan_files(spark: SparkSession, folder: str) -> DataFrame:
    """Data files below a folder; only names and sizes are read.

    A folder named like its files, as Spark writes tables in parts, is one file with the size of all its parts.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.{" + ",".join(_any_case(x) for x in SUFFIXES) + "}")
        .load(folder)
        .select("path", "length")
    )
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    root = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString().rstrip("/") + "/"
    # Folders above the one that is scanned are no files, whatever their names.
    above = F.when(F.startswith("path", F.lit(root)), F.lit(root)).otherwise(F.lit(""))
    parts = F.split(F.substr("path", F.length("above") + 1), "/")
    kind = F.concat(F.lit("."), F.lower(F.element_at(F.split("path", r"\."), -1)))
    first = F.array_position(F.transform("parts", lambda p: F.endswith(F.lower(p), F.col("kind"))), True).cast("int")
    placed = files.withColumn("above", above).withColumns({"parts": parts, "kind": kind}).withColumn("parts", F.slice("parts", 1, first))
    whole = placed.groupBy(F.concat("above", F.array_join("parts", "/")).alias("path")).agg(F.sum("length").alias("length"))
    name = F.element_at(F.split("path", "/"), -1)
    return whole.select(
        name.alias("name"),
        "path",
        F.round(F.col("length") / 1024, 2).alias("size_kb"),
        F.concat(F.lit("."), F.element_at(F.split(name, r"\."), -1)).alias("suffix"),
    )


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | None = None, multi_line: bool | None = None
) -> DataFrame:
    """With a schema one scan suffices and bad lines are kept apart; without, types are inferred first.

    Quotes within quotes are doubled. Records may hold line breaks within quotes: a file
    with a line whose quotes are not in pairs is read as a whole; all others are split over
    tasks. ``multi_line`` says so beforehand and spares the look.
    """
    whole = has_open_quote(spark, path) if multi_line is None else multi_line
    options = {"header": True, "multiLine": whole, "quote": '"', "escape": '"'}
    if schema is None:
        return spark.read.csv(path, inferSchema=True, **options)
    kept = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.csv(path, schema=kept, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record", **options)


def has_open_quote(spark: SparkSession, path: str) -> bool:
    """Whether any line has an odd number of quotes, so that a record may go on in the next line."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(quotes % 2 == 1).isEmpty()


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None, lines: bool | None = None) -> DataFrame:
    """JSON lines split over tasks and suit large data; an array, or one object over several lines, is read as a whole.

    Without ``lines`` the first lines that are not blank tell which of the two it is. Records
    that do not parse are kept in ``_corrupt_record``, which with a schema is always there.
    """
    whole = not (is_json_lines(spark, path) if lines is None else lines)
    if schema is None:
        return spark.read.json(path, multiLine=whole)
    kept = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(kept).json(path, multiLine=whole, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")


def is_json_lines(spark: SparkSession, path: str) -> bool:
    """Whether a file has a record a line: it begins with no array, nor with an object that goes on in the next line."""
    first = [r["value"].lstrip("\ufeff").strip() for r in spark.read.text(path).where(F.trim("value") != "").take(2)]
    if not first or first[0].startswith("["):
        return not first
    return len(first) == 1 or not goes_on(*first)


def goes_on(line: str, following: str) -> bool:
    """Whether an object that ``line`` leaves open goes on in the line ``following``; if not, ``line`` is broken."""
    if not line.startswith("{"):
        return False
    held, quote, escaped = [], "", False
    for c in line:
        if quote:
            quote, escaped = ("" if c == quote and not escaped else quote), c == "\\" and not escaped
        elif c in "\"'":
            quote = c
        elif c in "{[":
            held.append(c)
        elif c in "}]" and held:
            held.pop()
    if quote or not held:
        return False
    # Within an object a name or its end comes next, and another object only as a value.
    return not following.startswith("{") or held[-1] == "[" or line.endswith(":")


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


READERS = {"csv": read_csv, "json": read_json, "parquet": read_parquet}


def read_file(spark: SparkSession, path: str) -> DataFrame:
    return READERS[path.rsplit(".", 1)[-1].lower()](spark, path)


def _short_hash(text: str) -> str:
    return hashlib.md5(text.encode()).hexdigest()[:8]


def table_name(layer: str, path: str) -> str:
    """``<layer>_<stem>`` cleaned; a name that would be cut ends in a hash of the whole one instead."""
    stem = path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]
    whole = f"{layer}_{stem}"
    if len(whole) <= NAME_LENGTH:
        return clean_name_text(whole)
    return f"{clean_name_text(whole)[: NAME_LENGTH - 9]}_{_short_hash(whole)}"


def table_names(layer: str, paths: list[str]) -> list[str]:
    """A name per path; paths whose names are equal get a hash of the path at the end."""
    names = [table_name(layer, p) for p in paths]
    return [
        n if len({q for q, m in zip(paths, names) if m == n}) == 1 else f"{n[: NAME_LENGTH - 9]}_{_short_hash(p)}"
        for p, n in zip(paths, names)
    ]


def lineage_rows(df: DataFrame, table: str, source_file: str) -> list[tuple]:
    """One row per column with its type and null share, from one aggregate."""
    total, nulls = null_counts(df)
    return [
        (table, f.name, source_file, f.dataType.simpleString(), nulls[f.name] / total if total else 0.0)
        for f in df.schema.fields
    ]


def ingest(
    spark: SparkSession, paths: list[str], layer: str, root: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Store each file as a table of the layer, replacing an older load.

    Returns status rows, where a failed file is recorded and does not stop the others,
    and the lineage rows of the loaded columns. Statistics are taken from the stored
    table, so a text source is parsed once. Files of one name in several folders become
    several tables (``table_names``).
    """
    status, lineage = [], []
    for path, table in zip(paths, table_names(layer, paths)):
        try:
            write_table(read_file(spark, path), table, f"{root}/{table}" if root else None)
            stored = spark.table(table)
            rows = lineage_rows(stored, table, path.rsplit("/", 1)[-1])
            status.append((path, table, "success", stored.count(), len(stored.columns), None))
            lineage += rows
        except (PySparkException, KeyError) as e:
            status.append((path, table, "error", 0, 0, type(e).__name__))
    return small_frame(spark, status, INGEST_SCHEMA), small_frame(spark, lineage, LINEAGE_SCHEMA)
