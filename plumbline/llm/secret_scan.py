"""Secret scan: fixed patterns, and formats learned from what those patterns find.

Credentials found by the fixed patterns are labelled by their kind. For each kind a bounded
sample is put into a prefix tree of character classes, and states whose next symbols are
statistically alike are merged, which leaves a small probabilistic automaton of the format.
Every other token of the texts is then scored by its likelihood under each automaton; what
is at least as likely as nearly all credentials of a kind is reported too, as ``format``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch, record_batches, rows_of, texts

#: The base patterns, their least lengths, and the order of kinds.
KINDS = ["assign", "access", "hex", "format"]
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_VALUE, ACCESS_LENGTH = 12, 18
WORDS = ("passw", "secret", "token", "api")

#: Tokens that are scored: long enough, with a digit.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{12,}={0,2}")
DIGIT = re.compile(r"[0-9]")

#: Credentials of a kind that an automaton is learned from at most, by order of their hashes.
SAMPLE = 600
#: Confidence of the test that two states differ, and the visits a state needs for it.
ALPHA = 0.05
LEAST_VISITS = 10
#: Credentials of the sample that may score below the bound of their kind.
BELOW = 0.02
#: Share left for symbols that a state has never seen.
UNSEEN = 1e-4


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """Start, end, kind and value of the base patterns' matches, by start, then by kind."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [(m.start(), m.end(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_VALUE]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access", m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    found += [(m.start(), m.end(), "hex", m[0]) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def candidates(text: str, taken: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str]]:
    """Tokens outside the base spans that have a digit."""
    found = [(m.start(), m.end(), m[0]) for m in CANDIDATE.finditer(text) if DIGIT.search(m[0])]
    return [x for x in found if not any(x[0] < b and a < x[1] for a, b, _, _ in taken)]


# ---- automata

_CLASSES = [("d", "0123456789"), ("a", "abcdef"), ("g", "ghijklmnopqrstuvwxyz"), ("A", "ABCDEF"), ("G", "GHIJKLMNOPQRSTUVWXYZ")]
_SYMBOL = {c: name for name, members in _CLASSES for c in members}
_SIZE = {name: len(members) for name, members in _CLASSES}
END = ""


def symbols(value: str) -> list[str]:
    return [_SYMBOL.get(c, c) for c in value]


class PrefixTree:
    """Counts of symbols after each prefix; states are merged in place."""

    def __init__(self, values: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [{}]
        for value in values:
            state = 0
            for s in symbols(value):
                self.count[state][s] = self.count[state].get(s, 0) + 1
                if s not in self.next[state]:
                    self.next[state][s] = len(self.next)
                    self.next.append({})
                    self.count.append({})
                state = self.next[state][s]
            self.count[state][END] = self.count[state].get(END, 0) + 1

    def visits(self, state: int) -> int:
        return sum(self.count[state].values())

    def alike(self, a: int, b: int) -> bool:
        """Whether no share of a next symbol differs by more than chance allows, here or further on."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            na, nb = self.visits(a), self.visits(b)
            if min(na, nb) < LEAST_VISITS:
                continue
            bound = math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / math.sqrt(na) + 1 / math.sqrt(nb))
            for s in self.count[a].keys() | self.count[b].keys():
                if abs(self.count[a].get(s, 0) / na - self.count[b].get(s, 0) / nb) > bound:
                    return False
            todo += [(self.next[a][s], self.next[b][s]) for s in self.next[a].keys() & self.next[b].keys()]
        return True

    def fold(self, into: int, tree: int) -> None:
        """Add a subtree to a state: counts add up, equal symbols are followed together."""
        todo = [(into, tree)]
        while todo:
            into, tree = todo.pop()
            for s, n in self.count[tree].items():
                self.count[into][s] = self.count[into].get(s, 0) + n
            for s, target in self.next[tree].items():
                if s in self.next[into]:
                    todo.append((self.next[into][s], target))
                else:
                    self.next[into][s] = target


def learn(values: list[str]) -> dict:
    """The automaton of a kind: shares per state, its score bound and the lengths seen."""
    tree = PrefixTree(sorted(values))
    kept, fringe = [0], [(0, s) for s in sorted(tree.next[0])]
    while fringe:
        parent, symbol = fringe.pop(0)
        state = tree.next[parent][symbol]
        if state in kept:
            continue
        for other in kept:
            if tree.alike(other, state):
                tree.next[parent][symbol] = other
                tree.fold(other, state)
                break
        else:
            kept.append(state)
        fringe = [(k, s) for k in kept for s in sorted(tree.next[k]) if tree.next[k][s] not in kept]
    number = {state: i for i, state in enumerate(kept)}
    states = [
        {s: (n / tree.visits(k), number.get(tree.next[k].get(s, -1), 0)) for s, n in sorted(tree.count[k].items())} for k in kept
    ]
    model = {"states": states, "lengths": (min(map(len, values)), max(map(len, values))), "bound": -math.inf}
    scores = sorted(score(model, v) for v in values)
    model["bound"] = scores[int(BELOW * len(scores))]
    return model


def score(model: dict, value: str) -> float:
    """Mean log likelihood per character, end included; characters of a class are equally likely."""
    state, total = 0, 0.0
    for s in symbols(value):
        share, state = model["states"][state].get(s, (UNSEEN, state))
        total += math.log(max(share, UNSEEN) / _SIZE.get(s, 1))
    share, _ = model["states"][state].get(END, (UNSEEN, state))
    return (total + math.log(max(share, UNSEEN))) / (len(value) + 1)


def likely(models: dict[str, dict], value: str) -> bool:
    """Whether a token is as likely as a credential of any kind, at a length that the kind has."""
    return any(m["lengths"][0] <= len(value) <= m["lengths"][1] and score(m, value) >= m["bound"] for m in models.values())


# ---- jobs

_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("value", pa.string())])
_SPANS = "array<struct<start: bigint, end: bigint, kind: string, value: string>>"


def tokens(docs: DataFrame) -> DataFrame:
    """Base spans and scored tokens of every whole text: ``doc_id``, ``base``, ``others``."""
    schema = pa.schema([("doc_id", pa.int64()), ("base", pa.list_(_SPAN)), ("others", pa.list_(_SPAN))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for doc_id, text in rows_of(batches, "doc_id", "text"):
                base = base_spans(text)
                others = [(a, b, "format", v) for a, b, v in candidates(text, base)]
                yield doc_id, [_named(x) for x in base], [_named(x) for x in others]

        yield from record_batches(found(), schema)

    return texts(docs).mapInArrow(run, f"doc_id bigint, base {_SPANS}, others {_SPANS}")


def _named(span: tuple) -> dict:
    return dict(zip(("start", "end", "kind", "value"), span))


def models(found: DataFrame, sample: int = SAMPLE) -> dict[str, dict]:
    """Automata by kind, each learned from at most ``sample`` different credentials."""
    values = found.select(F.explode("base").alias("b")).select("b.kind", "b.value")
    out = {}
    for kind in KINDS[:3]:
        distinct = values.filter(F.col("kind") == kind).select("value").distinct()
        rows = distinct.orderBy(F.xxhash64("value"), "value").limit(sample).collect()
        if len(rows) >= LEAST_VISITS:
            out[kind] = learn([r["value"] for r in rows])
    return out


def scan(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """All spans of every document: ``doc_id``, ``spans`` of (start, end, kind, value), by start, then kind.

    Texts are read once; the automata come from the spans found and are applied to the
    tokens found. Null and empty texts have no spans, repeated rows are scanned each, and
    with fewer than ten different credentials of a kind no format is learned for it.
    """
    found = Scratch(docs.sparkSession, "secrets").keep(tokens(docs))
    learned = models(found, sample)
    schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(_SPAN))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for doc_id, base, others in rows_of(batches, "doc_id", "base", "others"):
                spans = base + [x for x in others if likely(learned, x["value"])]
                yield doc_id, sorted(spans, key=lambda x: (x["start"], KINDS.index(x["kind"])))

        yield from record_batches(rows(), schema)

    return found.mapInArrow(run, f"doc_id bigint, spans {_SPANS}")


def digests(found: DataFrame) -> DataFrame:
    """Counts, the digest of the base spans and all spans as text, per document."""
    part = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["kind"] != "format")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(k) for k in KINDS],
        F.sha2(F.array_join(F.transform(base, part), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", part), ",").alias("spans"),
    )
