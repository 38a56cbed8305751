"""Packing: documents cut into windows, the rest placed by best fit, longest first.

A document is its token ids and one end id. A document longer than a window is first cut
into full windows; what is left of it, and every shorter document, is one piece. Pieces
are dealt into blocks of about ``BLOCK`` pieces; in each block they are taken by length,
longest first, and each goes into the open window with the least room that still holds
it. A segment tree over the room left finds that window in steps of the tree's height.

Blocks keep the memory of a task fixed and the padding independent of the input's size:
only lengths and checksums are shuffled, never texts or ids.
"""

from __future__ import annotations

import math
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch, one_thread, record_batches, rows_of, texts

WINDOW = 2048
END_ID = 1
BLOCK = 4096
TOKENIZER = "word_bpe_49k.json"
#: Words held by a task to spare encoding them again; emptied when full.
CACHED_WORDS = 800_000
#: Texts without any of these characters are lower-cased and cut alike by Python and by the
#: tokenizer: beyond U+024F, controls, numbers that are no digits, and a capital of two parts.
_OTHER = re.compile(r"[^\t\n\v\f\r\x20-\x7e\xa0-\u024f]|[\xb2\xb3\xb9\xbc-\xbe\u0130]")
#: Fixed value: the tokenizer's own rule for cutting a text, for such characters.
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, salt int"
PLACED = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
_PIECES_ARROW = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")] + [("salt", pa.int32())])


class _Words(dict):
    """Encoded bytes of the words seen; a word is encoded alone, as the tokenizer joins none."""

    def __init__(self, encode: Callable[[str], bytes]):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHED_WORDS:
            self.clear()
        ids = self.encode(word)
        if len(word) <= 64:
            self[word] = ids
        return ids


def _byte_names(level) -> dict[int, str]:
    """The character by which the vocabulary names each byte beyond ASCII, as the tokenizer gives it."""
    out = {}
    for code in range(0xA0, 0x250):
        raw = chr(code).encode()
        out.update(zip(raw, level.pre_tokenize_str(chr(code))[0][0]))
    return out


@lru_cache(maxsize=2)
def encoder(path: str, added: bool = False) -> Callable[[str], bytes]:
    """Token ids of a text as little-endian unsigned 32-bit integers; none are put around the text.

    With ``added``, as the tokenizer does by itself, an added token spelled out in the text is
    one id; without, it is text like any other.
    """
    one_thread()
    from tokenizers import Tokenizer, pre_tokenizers

    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = not added
    spelled = [t.content.lower() for t in whole.get_added_tokens_decoder().values()] if added else []
    model = whole.model
    names = _byte_names(pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False))

    def of_word(word: str) -> bytes:
        found = model.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(names))
        return struct.pack(f"<{len(found)}I", *[t.id for t in found])

    words = _Words(of_word)

    def encode(text: str) -> bytes:
        low = text.lower()
        if _OTHER.search(text) or any(t in low for t in spelled):
            return np.array(whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return b"".join(map(words.__getitem__, _PIECE.findall(low)))

    return encode


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where a public tokenizer's file is on this machine; it is installed on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _cut(encoded: bytes, window: int) -> Iterator[tuple[int, int, int]]:
    for start in range(0, len(encoded), 4 * window):
        part = encoded[start : start + 4 * window]
        yield start // 4, len(part) // 4, zlib.crc32(part)


def pieces(docs: DataFrame, window: int = WINDOW, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """Cut every document into full windows and a rest; one row per piece, without its ids."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path or tokenizer_path(), added=True)

        def rows():
            salt = 0
            for doc_id, text in rows_of(batches, "doc_id", "text"):
                ids = encode(text) + end
                for start, length, crc in _cut(ids, window):
                    salt = (salt + 1) & 0x7FFFFFFF
                    yield doc_id, start, length, crc, len(ids) // 4, salt

        yield from record_batches(rows(), _PIECES_ARROW)

    return texts(docs).mapInArrow(run, PIECES)


class OpenWindows:
    """Open windows by room left, with a segment tree that counts them."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.stacks: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, room: int, by: int) -> None:
        node, count = room + self.leaves, self.count
        while node:
            count[node] += by
            node >>= 1

    def put(self, which: int, room: int) -> None:
        if room:
            self.stacks[room].append(which)
            self._add(room, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """The window with the least room of at least ``length``, and that room; it leaves the tree."""
        node, count = length + self.leaves, self.count
        while not count[node]:
            while node & 1:  # a right child: nothing further right below this parent
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.leaves:
            node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._add(room, -1)
        return self.stacks[room].pop(), room


def best_fit(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """Window number and offset of each piece; ``lengths`` come longest first."""
    held = OpenWindows(window)
    which, offsets, opened = [], [], 0
    for length in lengths:
        found = held.take(length)
        if found is None:
            found = (opened, window)
            opened += 1
        number, room = found
        which.append(number)
        offsets.append(window - room)
        held.put(number, room - length)
    return which, offsets


def place(found: DataFrame, blocks: int, window: int = WINDOW) -> DataFrame:
    """Place pieces block by block. A block's number is the rest of its sequences' ids by ``blocks``."""
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    out = pa.schema([(c, pa.int64()) for c in [*columns, "sequence_id", "offset"]])

    def run(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        which, offsets = best_fit(group.column("length").to_pylist(), window)
        ids = np.array(which, dtype=np.int64) * blocks + key[0].as_py()
        arrays = [group.column(c).combine_chunks() for c in columns]
        return pa.Table.from_arrays([*arrays, pa.array(ids), pa.array(offsets, pa.int64())], schema=out)

    block = F.pmod(F.xxhash64("doc_id", "start", "salt"), F.lit(blocks)).cast("int")
    return found.withColumn("block", block).groupBy("block").applyInArrow(run, PLACED)


def pack(docs: DataFrame, window: int = WINDOW, end_id: int = END_ID, path: str | None = None, block: int = BLOCK) -> DataFrame:
    """Pieces of all documents with the sequence and offset that hold them.

    Null and empty texts are the end id alone. Each row of a repeated ``doc_id`` is a
    document of its own, and a null ``doc_id`` stays null. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "pack")
    found = scratch.keep(pieces(docs, window, end_id, path))
    return place(found, max(1, math.ceil(found.count() / block)), window)


def sequences(docs: DataFrame, packed: DataFrame, window: int = WINDOW, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """The ids of every sequence, pieces in order of their offsets.

    Documents are encoded once more and meet their places by (``doc_id``, ``start``), so
    here ``doc_id`` must be unique.
    """
    end = np.array([end_id], dtype="<u4").tobytes()
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path or tokenizer_path(), added=True)

        def rows():
            for doc_id, text in rows_of(batches, "doc_id", "text"):
                ids = np.frombuffer(encode(text) + end, dtype="<u4")
                for start in range(0, len(ids), window):
                    yield doc_id, start, ids[start : start + window].astype(np.int32)

        yield from record_batches(rows(), schema, 256)

    cut = texts(docs).mapInArrow(run, "doc_id bigint, start bigint, ids array<int>")
    joined = cut.join(packed.select("doc_id", "start", "sequence_id", "offset"), ["doc_id", "start"])
    held = joined.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return held.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))
