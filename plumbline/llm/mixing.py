"""Mixing to target weights with soft membership of domains.

A classifier learned from a labelled table gives every document a probability for each
domain. Document rates are then fitted by projected gradient descent on least squares, so
that the tokens expected in each domain match the targets. A rate depends on a document's
probabilities and on the steps taken so far alone, so it is worked out where it is needed:
each step is one sum over the documents, and the driver holds one number per domain and step.
"""

from __future__ import annotations

import logging
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import subword
from plumbline.llm.common import Scratch, bring_back, set_aside

#: Shares of the tokens that each domain should have.
TARGETS = {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}
#: Rates have no upper bound of their own: any would leave targets of rare domains out of reach.
MOST = math.inf
STEPS = 60
#: A share further from its target than this is logged.
OFF = 0.01
#: Steps end when no domain is further from its target than this share of all tokens, or nothing moves.
CLOSE = 1e-6


def posteriors(docs: DataFrame, labelled: DataFrame, domains: list[str], sample: int = subword.SAMPLE) -> DataFrame:
    """``docs`` with its words (``_words``) and one probability per domain (``_p0``, ``_p1``, ...).

    ``labelled`` has ``doc_id`` and ``label``; labels that are no domain are not learned from.
    A domain without labelled rows has probability 0. With no labelled row at all, every
    domain is equally likely. Names that begin with ``_p`` or are ``_words`` must be free.
    """
    model = subword.train(docs, labelled.filter(F.col("label").isin(domains)), sample)
    names = [f"_p{domains.index(c)}" if c in domains else "_pnone" for c in model.classes]
    found = subword.scored(docs, model, names)
    missing = 1.0 / len(domains) if names == ["_pnone"] else 0.0
    own = [f"_p{i}" for i in range(len(domains))]
    words = F.size(F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), r"\s+"), lambda w: w != "")).cast("bigint")
    return found.select(
        *[F.col(f"`{c}`") for c in docs.columns], words.alias("_words"), *[F.col(n) if n in names else F.lit(missing).alias(n) for n in own]
    )


def _rate(steps: list[np.ndarray], width: int, least: float, most: float) -> Column:
    """The rate after the given steps: 1, then moved and put back into its bounds, step by step."""
    if not steps:
        return F.lit(1.0)
    taken = F.array(*[F.array(*[F.lit(float(v)) for v in s]) for s in steps])

    def step(rate: Column, move: Column) -> Column:
        change = sum((F.col(f"_p{k}") * F.element_at(move, k + 1) for k in range(width)), F.lit(0.0))
        moved = F.greatest(F.lit(least), rate - change)
        return moved if math.isinf(most) else F.least(F.lit(most), moved)

    return F.aggregate(taken, F.lit(1.0), step)


def fit_rates(
    found: DataFrame, targets: list[float], least: float = 0.0, most: float = MOST, steps: int = STEPS, keep_all: bool = False
) -> tuple[DataFrame, list[float]]:
    """``found`` with a ``_rate`` per document, and the share of tokens that each domain then has.

    The loss is the sum of squared gaps between expected and wanted tokens per domain, each
    weighted by the domain's own curvature, so that a step of one never overshoots. The total
    wanted is that of the documents; with ``keep_all`` it is large enough for no domain to shrink.
    """
    width = len(targets)
    p = [F.col(f"_p{k}") for k in range(width)]
    t = F.col("_words").cast("double")
    wanted = np.array(targets) / sum(targets)
    sums = [F.sum(t * a * b) for i, a in enumerate(p) for b in p[i:]]
    first = found.agg(F.sum(t), *sums).first()
    total = first[0] or 0.0
    if not total:
        return found.withColumn("_rate", F.lit(1.0)), [0.0] * width
    curve = np.zeros((width, width))
    curve[np.triu_indices(width)] = [v or 0.0 for v in first[1:]]
    curve = curve + np.triu(curve, 1).T
    rows = curve.sum(axis=1)
    if keep_all:
        total = max(total, float(np.max(rows / wanted)))
    scale = np.where(rows > 0, 1 / np.where(rows > 0, rows, 1), 0.0)
    taken: list[np.ndarray] = []
    before = np.inf
    for _ in range(steps + 1):
        rate = _rate(taken, width, least, most)
        got = np.array([v or 0.0 for v in found.agg(*[F.sum(t * rate * a) for a in p]).first()])
        gap = got - total * wanted
        # Sums in another order differ in their last digits; a step is cut to ten.
        loss = float(np.sum(gap**2 * scale))
        if np.max(np.abs(gap)) < CLOSE * total or loss > before * (1 - 1e-9) or len(taken) == steps:
            break
        before = loss
        taken.append(np.array([float(f"{v:.9e}") for v in gap * scale]))
    return found.withColumn("_rate", rate), (got / max(got.sum(), 1e-300)).tolist()


def copies(rate: Column, *key: Column | str) -> Column:
    """Whole copies for a rate: its integer part, and one more for a share of keys equal to the rest."""
    dice = F.pmod(F.xxhash64(F.lit(11), *key), F.lit(1_000_003)) / F.lit(1_000_003.0)
    whole = F.floor(rate)
    return (whole + F.when(dice < rate - whole, 1).otherwise(0)).cast("int")


def mix_with_shares(
    docs: DataFrame, labelled: DataFrame, targets: dict[str, float] = TARGETS, least: float = 0.0, most: float = MOST, keep_all: bool = False,
    sample: int = subword.SAMPLE,
) -> tuple[DataFrame, dict[str, float]]:
    """``doc_id``, ``n_words``, a probability per domain (``p_<domain>``), ``rate`` and ``copies`` of every document;
    and the share of the tokens that each domain is expected to have at these rates.

    Null and empty texts have the classifier's constant as probabilities and no tokens, so
    they follow the rates but do not move them. Rows that repeat a ``doc_id`` are documents of
    their own with the same number of copies if their texts are equal. Copies are drawn by a
    hash of ``doc_id``, so runs agree. A share that misses its target is logged.
    """
    domains = sorted(targets)
    rated, shares = _rated(docs.select("doc_id", "text"), labelled, targets, least, most, keep_all, sample, ("text",))
    found = rated.select(
        "doc_id", F.col("_words").alias("n_words"), *[F.col(f"_p{k}").alias(f"p_{d}") for k, d in enumerate(domains)],
        F.col("_rate").alias("rate"), copies(F.col("_rate"), "doc_id").alias("copies"),
    )
    return found, shares


def mix(
    docs: DataFrame, labelled: DataFrame, targets: dict[str, float] = TARGETS, least: float = 0.0, most: float = MOST, keep_all: bool = False,
    sample: int = subword.SAMPLE,
) -> DataFrame:
    """The documents of ``mix_with_shares``."""
    return mix_with_shares(docs, labelled, targets, least, most, keep_all, sample)[0]


def _rated(
    docs: DataFrame, labelled: DataFrame, targets: dict[str, float], least: float, most: float, keep_all: bool, sample: int,
    without: tuple[str, ...] = (),
) -> tuple[DataFrame, dict[str, float]]:
    """``posteriors`` with a ``_rate``, written once and without the columns not needed again; and the shares reached."""
    domains = sorted(targets)
    found = Scratch(docs.sparkSession, "mixing").keep(posteriors(docs, labelled, domains, sample).drop(*without))
    rated, got = fit_rates(found, [targets[d] for d in domains], least, most, keep_all=keep_all)
    shares = dict(zip(domains, got))
    whole = sum(targets.values())
    missed = {d: (round(targets[d] / whole, 4), round(v, 4)) for d, v in shares.items() if abs(v - targets[d] / whole) > OFF}
    if missed:
        logging.getLogger(__name__).warning("shares off their targets (wanted, reached): %s", missed)
    return rated, shares


def repeat_with_shares(
    docs: DataFrame, labelled: DataFrame, targets: dict[str, float] = TARGETS, least: float = 1.0, most: float = MOST, keep_all: bool = True,
    sample: int = subword.SAMPLE,
) -> tuple[DataFrame, dict[str, float]]:
    """The rows of ``docs``, each as often as its rate says, with all columns; and the shares that the rates give.

    As it stands no document is left out: domains that have too few tokens are repeated.
    """
    held = set_aside(docs, "doc_id", "text")
    rated, shares = _rated(held, labelled, targets, least, most, keep_all, sample)
    times = rated.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), copies(F.col("_rate"), "doc_id"))))
    return bring_back(times.select("doc_id", "text", "others"), docs.columns), shares


def repeat(
    docs: DataFrame, labelled: DataFrame, targets: dict[str, float] = TARGETS, least: float = 1.0, most: float = MOST, keep_all: bool = True,
    sample: int = subword.SAMPLE,
) -> DataFrame:
    """The rows of ``repeat_with_shares``."""
    return repeat_with_shares(docs, labelled, targets, least, most, keep_all, sample)[0]
