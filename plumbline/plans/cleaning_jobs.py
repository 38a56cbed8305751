"""Cleaning jobs: one source to many targets, and rule-driven cleaning."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.cleaning import Cleaned, Options, clean, first_rows
from plumbline.operators.profile import quick_profile
from plumbline.operators.rules import drop_failing, evaluate
from plumbline.operators.scoring import quick_scores
from plumbline.sources.tables import write_table
from plumbline.session import at_once, small_frame

METRICS_SCHEMA = (
    "source string, target string, before_count long, after_count long, removed_count long, modified_count long, "
    "score_before double, score_after double, improvement double, log array<string>, meets_threshold boolean"
)
LINEAGE_SCHEMA = (
    "ts timestamp, source_table string, source_column string, target_table string, target_column string, "
    "operation string, transformations array<string>"
)


@dataclass
class CleanJob:
    targets: dict[str, DataFrame]
    metrics: DataFrame
    lineage: DataFrame
    overall_score: float


def quick_score(spark: SparkSession, df: DataFrame, name: str, quantiles: str = "exact") -> tuple[int, float]:
    """Row count and quick score."""
    row = quick_scores(quick_profile(spark, {name: df}, quantiles=quantiles)).first()
    return row["row_count"], row["score"]


def clean_to_targets(
    spark: SparkSession,
    source: DataFrame,
    source_name: str,
    targets: list[dict],
    save: bool = False,
    options: Options | None = None,
) -> CleanJob:
    """Each target: ``name``, ``rules`` (strategy names), optional ``quality_threshold`` and ``options``.

    The source is read once into executor memory and disk; every target is a plan on top of it.
    """
    options = options or Options()
    source = source.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        before, score_before = quick_score(spark, source, source_name, options.quantiles)

        def one(t: dict) -> tuple[Cleaned, int, float]:
            done = clean(source, t.get("rules", []), replace(options, **t.get("options", {})))
            return done, *quick_score(spark, done.df, t["name"], options.quantiles)

        rows, lineage, results = [], [], {}
        for t, (done, after, score_after) in zip(targets, at_once([lambda t=t: one(t) for t in targets])):
            rows.append(
                (
                    source_name,
                    t["name"],
                    before,
                    after,
                    before - after,
                    int(done.modified),
                    score_before,
                    score_after,
                    score_after - score_before,
                    done.log,
                    score_after >= t.get("quality_threshold", 0.0),
                )
            )
            lineage += [
                (None, source_name, c, t["name"], c, f"ETL_clean:{t['name']}", t.get("rules", []))
                for c in done.df.columns
            ]
            if save:
                write_table(done.df, t["name"])
            results[t["name"]] = done.df
    finally:
        source.unpersist()
    metrics = small_frame(spark, rows, METRICS_SCHEMA)
    log = small_frame(spark, lineage, LINEAGE_SCHEMA).withColumn("ts", F.current_timestamp())
    overall = sum(r[7] for r in rows) / len(rows) if rows else 0.0
    return CleanJob(results, metrics, log, overall)


def clean_one(
    spark: SparkSession, source: DataFrame, source_name: str, target: str, names: list[str], save: bool = False
) -> CleanJob:
    return clean_to_targets(spark, source, source_name, [{"name": target, "rules": names}], save)


@dataclass
class RuleCleanJob:
    df: DataFrame
    violations: list[tuple]
    total_rows: int
    cleaned_rows: int

    @property
    def removed_rows(self) -> int:
        return self.total_rows - self.cleaned_rows

    @property
    def quality_score(self) -> float:
        """100 less the failed share of the remaining rows, not below 0; 100 when none remain."""
        if self.cleaned_rows == 0:
            return 100.0
        failed = sum(v[6] for v in self.violations)
        return max(0.0, 100.0 - failed / self.cleaned_rows * 100)


def clean_by_rules(
    df: DataFrame, rules: list[dict], table: str = "input", apply_fixes: bool = False, order: list[str] | None = None
) -> RuleCleanJob:
    """Check rules in order; with fixes, each rule sees what the fixes before it left.

    Rows without a value survive every fix except that of ``null_check``. Row rules that
    follow one another are counted and applied together in one scan.
    """
    total = df.count()
    if not apply_fixes:
        outcome = evaluate(df, rules, table, unique_rows=True)
        return RuleCleanJob(df, [r for r in outcome if r[5] in ("failed", "error")], total, total)
    found: list[tuple] = []
    row_rules: list[dict] = []
    for rule in [*rules, {"type": "uniqueness", "field": None}]:
        if rule.get("type") != "uniqueness":
            row_rules.append(rule)
            continue
        df, outcomes = drop_failing(df, row_rules, table)
        found += outcomes
        row_rules = []
        if rule.get("field") in df.columns:
            outcome = evaluate(df, [rule], table, unique_rows=True)[0]
            if outcome[5] == "failed":
                found.append(outcome)
                df = _keep_first(df, rule["field"], order)
    return RuleCleanJob(df, found, total, df.count())


def _keep_first(df: DataFrame, field: str, order: list[str] | None) -> DataFrame:
    """First row per value; rows without a value all stay and never meet in one group."""
    c = F.col(f"`{field}`")
    return first_rows(df.where(c.isNotNull()), [field], order).unionByName(df.where(c.isNull()))


def clean_table(
    spark: SparkSession, table: str, rules: list[dict], apply_fixes: bool = False, path: str | None = None
) -> RuleCleanJob:
    """Clean a stored table by rules and store the result as ``<table>_cleaned``."""
    job = clean_by_rules(spark.table(table), rules, table, apply_fixes)
    write_table(job.df, f"{table}_cleaned", path)
    return job

