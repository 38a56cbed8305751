"""Token counts by byte-pair merging on a linked list with a heap, without ids.

A text is cut where its tokenizer cuts it: at the strings of added tokens, each of which is one
token, and then into words by the byte-level pattern. A word's bytes are a linked list of
symbols; a heap holds its adjacent pairs by rank, and the pair of the lowest rank, the leftmost
of equal ones, is merged again and again. A word has as many tokens as it has bytes, less one
for each merge. Words repeat, so a task keeps the counts of short ones.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import record_batches, rows_of, texts

LIMIT = 1024
#: The words of a byte-level tokenizer: fixed, as published.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Words that a task remembers, and the characters of the longest one.
REMEMBERED, LONGEST = 1 << 18, 48
#: Texts of more characters are cut into words one by one, so that their words are not all in memory.
LONG_TEXT = 1 << 20
#: Stands for a word whose bounds depend on the version of Unicode; no text has so many tokens.
DOUBTFUL = -(1 << 60)


def merges(symbols: list, rank: Callable[[tuple], int | None]) -> int:
    """How many merges a word's symbols allow, lowest rank first."""
    n = len(symbols)
    symbols = list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (r := rank((symbols[i], symbols[j]))) is not None:
            heapq.heappush(heap, (r, i, symbols[i], symbols[j]))

    for i in range(n - 1):
        offer(i)
    done = 0
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i]
        if symbols[i] != left or j >= n or symbols[j] != right:
            continue  # one of the two has been merged since
        symbols[i], symbols[j] = left + right, None
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        done += 1
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    return done


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it can be seen, else one from 256 on."""
    seen = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(seen)]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Counter(dict):
    """Tokens of a word, worked out when first asked for; ``text`` counts whole texts."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        pairs = (m if isinstance(m, list) else m.split(" ") for m in told["model"]["merges"])
        self.rank = {tuple(m): i for i, m in enumerate(pairs)}.get
        self.letters = byte_letters()
        added = [re.escape(t["content"]) for t in told.get("added_tokens", [])]
        self.added = re.compile("|".join(sorted(added, key=len, reverse=True))) if added else None
        self.path, self.tokenizer = path, None

    def __missing__(self, word: str) -> int:
        if not word.isascii() and any(unicodedata.category(c) == "Cn" for c in word):
            return DOUBTFUL
        count = self.word(word)
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = count
        return count

    def word(self, word: str) -> int:
        symbols = [self.letters[b] for b in word.encode()]
        return len(symbols) - merges(symbols, self.rank)

    def _plain(self, text: str) -> int:
        found = WORDS.findall(text) if len(text) <= LONG_TEXT else (m.group() for m in WORDS.finditer(text))
        count = sum(map(self.__getitem__, found))
        if count >= 0:
            return count
        # Characters that are letters only in newer versions of Unicode: ask the tokenizer where its words end.
        if self.tokenizer is None:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.path)
        return sum(self.word(text[a:b]) for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text))

    def text(self, text: str) -> int:
        if self.added is None:
            return self._plain(text)
        parts = self.added.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))


def count_tokens(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens`` and ``over_limit`` of every document.

    ``tokenizer`` is the path of a byte-level tokenizer's file, at the same place on all machines.
    A null text counts as empty and has no tokens. Repeated rows and null ids give a row each.
    An empty table gives no rows. Further columns of ``docs`` are not looked at.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(tokenizer)
        rows = ((i, n, counter.text(t)) for i, n, t in rows_of(batches, "doc_id", "n_bytes", "text"))
        yield from record_batches(rows, schema)

    sized = texts(docs).withColumn("n_bytes", F.octet_length("text").cast("long"))
    counted = sized.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
