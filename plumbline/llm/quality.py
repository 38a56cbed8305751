"""Quality scores from supervised subword embeddings, and the filter that uses them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import subword
from plumbline.llm.common import bring_back, set_aside

#: A document is kept from this probability of label 1 on.
THRESHOLD = 0.3
FOLDS = 5


def held_out(doc_id: str = "doc_id"):
    """Rows that no model may learn from: a fifth by checksum of the id; a null id counts as empty text."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % FOLDS == 0


def model(docs: DataFrame, labels: DataFrame, sample: int = subword.SAMPLE) -> subword.Model:
    """Learned from labelled rows that are not held out; only texts are inputs."""
    usable = labels.select("doc_id", F.col("quality").alias("label")).filter(~held_out())
    return subword.train(docs, usable, sample)


def score(docs: DataFrame, labels: DataFrame, sample: int = subword.SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every document.

    A null or empty text has the score of the model's constant. Without labels, or with one
    class only, all documents have that class's score, 0.5 if there is none. Rows that repeat
    a ``doc_id`` are scored each.
    """
    rows = _scored(docs.select("doc_id", "text"), model(docs, labels, sample), "score")
    return rows.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def _scored(docs: DataFrame, found: subword.Model, name: str) -> DataFrame:
    """``docs`` with the probability of label 1 as column ``name``."""
    if len(found.classes) == 1:
        return docs.withColumn(name, F.lit({"1": 1.0, "0": 0.0}.get(found.classes[0], 0.5)))
    names = [name if c == "1" else f"_p_{i}" for i, c in enumerate(found.classes)]
    return subword.scored(docs, found, names).select(*[F.col(f"`{c}`") for c in docs.columns], name)


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = subword.SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose texts are predicted to be good, with all columns.

    The score is worked out next to the row, so that no join with the documents is needed. Null
    and empty texts are judged by the model's constant, repeated rows each; an empty table stays empty.
    """
    held = set_aside(docs, "doc_id", "text")
    rows = _scored(held, model(held, labels, sample), "_quality_score")
    return bring_back(rows.filter(F.col("_quality_score") >= threshold).select("doc_id", "text", "others"), docs.columns)
