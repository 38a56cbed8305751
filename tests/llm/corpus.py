"""A small corpus with the odd cases, and plain versions of the operators to compare with."""

from __future__ import annotations

import random
import re
from collections import defaultdict

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Column names that operators use for results of their own.
CLASH = ["shard", "kept", "score", "rate", "copies", "node", "label", "key", "digest", "file", "row", "spans", "h", "line", "at", "run"]
CLASH += ["_kept", "_id", "_text", "_words", "_p0", "_rate", "_copy", "_quality_score", "_p_0", "others", "id"]


def prose(random_, n, alphabet="abcdefghijklmnopqrstuvwxyzéñü"):
    return " ".join("".join(random_.choice(alphabet) for _ in range(random_.randint(1, 8))) for _ in range(n))


def rows(seed=1, n=60):
    """Prose with exact copies, near copies, shared passages, an empty, a null and a very long text."""
    r = random.Random(seed)
    texts = [prose(r, r.choice([1, 3, 5, 20, 80, 200])) for _ in range(n)]
    passage = prose(r, 60)
    for i in range(0, n, 9):
        texts[i] = f"{prose(r, 12)} {passage} {prose(r, 30)}"
    for i in range(0, n, 7):
        texts.append(texts[i])
    for i in range(3, n, 8):
        w = texts[i].split(" ")
        w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
    texts += ["", None, "   \n\t ", "one two", "one two", prose(r, 30_000), "x" * 5000, None, "\U0001f600 emoji ́ mark"]
    langs = ["en", "de", "fr", None]
    out = [(i * 3, t, langs[i % 4], None if i % 5 == 0 else f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return out


def frame(spark, data, extra=True):
    df = spark.createDataFrame(data, SCHEMA)
    if extra:
        df = df.selectExpr("*", *[f"'x' AS `{c}`" for c in CLASH])
    return df.repartition(3)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, size=5):
    w = WORDS.findall(lower(text))
    if len(w) < size:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def near_components(data):
    """Size of the set and smallest linked id of each document, by comparing all pairs."""
    sets = {i: shingles(t) for i, t in data}
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for p, a in enumerate(ids):
        for b in ids[p + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def repeated_words(data, least=50):
    """Places of words that lie in a run of ``least`` words which another document has too."""
    owners, words = defaultdict(set), {}
    for i, t in data:
        words[i] = w = WORDS.findall(lower(t))
        for k in range(len(w) - least + 1):
            owners[tuple(w[k : k + least])].add(i)
    out = {}
    for i, w in words.items():
        found = {x for k in range(len(w) - least + 1) if len(owners[tuple(w[k : k + least])]) > 1 for x in range(k, k + least)}
        if found:
            out[i] = found
    return out


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def dropped_lines(data, least=16):
    """(place, line) of the lines that an earlier place has, or nearly has."""
    found = set()
    for d, t in data:
        for i, line in enumerate((t or "").split("\n")):
            if line.strip(" \t\r\v\f"):
                found.add(((d is not None, d or 0, i), line))
    out = set()
    for at, x in found:
        for other, y in found:
            if other < at and (x == y or (min(len(x), len(y)) >= least and one_edit(x, y))):
                out.add((at, x))
                break
    return out
