"""Phrases, token counts and the source audit against plain versions."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from plumbline.llm import collocations, divergence, token_counts
from tests.llm import corpus


@pytest.fixture(scope="module")
def data():
    rows = corpus.rows()
    return [*rows, rows[0], rows[5], (None, "No id here, no id.", "en", "s1", 18)]


@pytest.fixture(scope="module")
def docs(spark, data):
    return corpus.frame(spark, data).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


# Phrases


def plain_phrases(data, least, top):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in data:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", corpus.lower(text)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        kept = {w: a for w, a in counts.items() if len(w) > 1 and a >= least}
        inner = defaultdict(int)
        for w, a in kept.items():
            for k in range(2, len(w)):
                for i in range(len(w) - k + 1):
                    inner[w[i : i + k]] = max(inner[w[i : i + k]], a)
        rows = []
        for w, a in kept.items():
            if 100 * inner[w] >= 80 * a:
                continue
            score, k = min((2000000 * a // (counts[w[:k]] + counts[w[k:]]), k) for k in range(1, len(w)))
            rows.append((-score, -a, " ".join(w).encode(), counts[w[:k]], counts[w[k:]]))
        for rank, (s, a, w, x, y) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, w.decode(), -a, x, y, n[lang], -s))
    return sorted(out)


def phrase_rows():
    r = random.Random(3)
    words = ["a", "of", "the", "New", "york", "city", "é", "x\x00y", "\x01", "\x01\x02", "\x02", "\x0e", "Ünï", "stop"]
    texts = [" ".join(r.choice(words) + r.choice(["", "", "", ".", ",", "\n", "\t", "  "]) for _ in range(r.randint(0, 60))) for _ in range(200)]
    texts += ["the city that never sleeps by day. " * 40, "a a a a a a a a", "", None, "...", "end", "one two three. one two three"]
    return [(i, t, [None, "en", "de", "x\x01"][i % 4], "s", None) for i, t in enumerate(texts)]


@pytest.mark.parametrize("block", [1 << 24, 400])
def test_phrases_against_plain_version(spark, monkeypatch, block):
    monkeypatch.setattr(collocations, "BLOCK", block)
    rows = phrase_rows()
    found = collocations.mine(corpus.frame(spark, rows), least=3, top=40)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == plain_phrases(rows, 3, 40)


@pytest.mark.parametrize("cells", [1 << 7, 1 << 20])
def test_phrases_whatever_share_cells(spark, monkeypatch, cells):
    monkeypatch.setattr(collocations, "CELLS", cells)
    monkeypatch.setattr(collocations, "PART", cells // 4)
    rows = phrase_rows()
    assert sorted(map(tuple, collocations.mine(corpus.frame(spark, rows), least=5, top=60).collect())) == plain_phrases(rows, 5, 60)


def test_runs_too_rare_are_cut_to_ends(spark):
    r = random.Random(8)
    texts = [f"{' '.join(f'w{r.randrange(900)}' for _ in range(30))} the very same few words here" for _ in range(60)]
    rows = [(i, t, "en", "s", None) for i, t in enumerate(texts)]
    runs = collocations._paths(corpus.frame(spark, rows).coalesce(1), 30).collect()
    edges = [x for x in runs if bytes(x["run"]).count(b"\x00") >= 4]
    assert [bytes(x["run"]).split(b"\x00") for x in edges] == [b"en the very same few words here".split()]
    assert sum(x["times"] * max(1, bytes(x["run"]).count(b"\x00") - 3) for x in runs) == sum(len(t.split()) for t in texts)


def test_phrases_odd_inputs(data, docs, empty):
    found = collocations.mine(docs, least=2)
    assert sorted(map(tuple, found.collect())) == plain_phrases(data, 2, 2000)
    assert collocations.mine(empty).count() == 0
    assert collocations.mine(docs.withColumn("text", collocations.F.lit(None).cast("string"))).count() == 0


def test_paths_hold_every_edge_once():
    texts = [(t or "").encode() for _, t, *_ in phrase_rows()]
    paths, edges, ends = list(collocations.graph(texts)), Counter(), Counter()
    for run, times in paths:
        words = run.split(b"\x00")
        if len(words) < 4:
            ends[tuple(words)] += times
        for i in range(len(words) - 3):
            assert tuple(words[i : i + 4]) not in edges
            edges[tuple(words[i : i + 4])] = times
    want, want_ends = Counter(), Counter()
    for t in texts:
        for piece in re.split(rb"[.,;:!?\x0a-\x0d]", t.lower()):
            words = re.findall(rb"[^\x20\x09]+", collocations.escaped(piece))
            want.update(tuple(words[i : i + 4]) for i in range(len(words) - 3))
            want_ends.update(tuple(words[-k:]) for k in range(1, 4) if len(words) >= k)
    assert (edges, ends) == (want, want_ends)
    # A passage without branches is one path.
    text = b"begin " + b" ".join(b"w%d" % i for i in range(500)) + b" end"
    assert len([run for run, _ in collocations.graph([text] * 3) if run.count(b"\x00") > 2]) == 1


def test_flows_over_any_bounds():
    rows = sorted(("en\x00" + "\x00".join(w), c) for w, c in [("abcd", 3), ("abce", 2), ("abx", 4), ("b", 1), ("bc", 2), ("bcda", 30)])
    whole = {x[1]: x[3] for x in collocations.flows(iter(rows), 1)}
    assert whole["a b"] == 9 and whole["a b c"] == 5 and whole["b"] == 33 and whole[""] == 42
    for cut in range(1, len(rows)):
        parts = Counter()
        for part in (rows[:cut], rows[cut:]):
            for _, phrase, _, n in collocations.flows(iter(part), 30):
                parts[phrase] += n
        assert {p: n for p, n in parts.items() if n >= 30} == {p: n for p, n in whole.items() if n >= 30}


# Token counts


def token_texts():
    r = random.Random(5)
    signs = "abcdefghij KLMN  012 '\n\t.,!éüßñ漢字̀​\xa0\x85\x1c\U0001f600՘꟎\U00011b0a"
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 120))) for _ in range(400)]
    texts += ["", "<|endoftext|>", " <|endoftext|>  x<|endoftext|><|endoftext|>", "it's we'll IT'S", "x" * 5000, " " * 3000, "a\n\n  b  ", "the " * 999]
    return texts


def test_counts_equal_the_tokenizer(spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path("byte_bpe_50k.json"))
    counter = token_counts.Counter(path("byte_bpe_50k.json"))
    for text in token_texts():
        assert counter.text(text) == len(plain.encode(text, add_special_tokens=False).ids), text


def test_texts_of_any_length_are_cut_alike(monkeypatch):
    from public_tokenizers import path

    counter = token_counts.Counter(path("byte_bpe_50k.json"))
    want = [counter.text(t) for t in token_texts()]
    monkeypatch.setattr(token_counts, "LONG_TEXT", 10)
    monkeypatch.setattr(token_counts, "REMEMBERED", 5)
    again = token_counts.Counter(path("byte_bpe_50k.json"))
    assert [again.text(t) for t in token_texts()] == want


def test_merges_by_rank_then_place():
    rank = {("a", "a"): 0, ("aa", "b"): 1, ("b", "c"): 2, ("aa", "aa"): 3}.get
    assert token_counts.merges(list("aaab"), rank) == 1  # aa a b: what follows the first pair has no rank
    assert token_counts.merges(list("aabc"), rank) == 2  # aab c
    assert token_counts.merges(list("aaaa"), rank) == 3
    assert token_counts.merges([], rank) == token_counts.merges(["a"], rank) == 0


def test_token_counts_odd_inputs(data, docs, empty):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path("byte_bpe_50k.json"))
    want = Counter()
    for i, t, *_ in data:
        n = len(plain.encode(t or "", add_special_tokens=False).ids)
        want[i, len((t or "").encode()), n, n > 1024] += 1
    found = token_counts.count_tokens(docs)
    assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert Counter(map(tuple, found.collect())) == want
    assert token_counts.count_tokens(empty).count() == 0


# Sources


def plain_audit(data, least, top):
    blank = lambda x: "" if x is None else x
    df, counts, groups = Counter(), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, *_ in data:
        lang, source = blank(lang), blank(source)
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", corpus.lower(text))
        df.update((lang, t) for t in set(terms))
        counts[lang, source].update(terms)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for (x, t), d in df.items() if x == lang and d >= least]

        def shares(count):
            total = sum(count[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 1000000000 * (count[t] + 5) // total for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            terms = [(q[t] - p[s][t], t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, rows in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, x.decode(), -v, rank) for rank, (v, x) in enumerate(rows, 1)]
    return sorted(out)


def source_rows():
    r = random.Random(8)
    words = [corpus.prose(r, 1) for _ in range(60)] + ["Ünï", "Z", "漢字"]
    rows = [
        (i, " ".join(r.choices(words, range(1, len(words) + 1), k=r.randint(0, 40))), ["en", "de", None, "fr"][i % 4], f"s{r.randint(0, 9)}", None)
        for i in range(300)
    ]
    return [*rows, (900, "only once in it", "it", "a", 1), (901, None, "it", "b", 1), (902, "", "en", "silent", 0), (903, "x", "pt", None, 1)]


def test_audit_against_plain_version(spark):
    rows = source_rows()
    found = divergence.audit(corpus.frame(spark, rows), least=3, top=7)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, found.collect())) == plain_audit(rows, 3, 7)


def test_audit_flushes_and_odd_inputs(spark, monkeypatch, data, docs, empty):
    monkeypatch.setattr(divergence, "HELD", 20)
    monkeypatch.setattr(divergence, "HELD_PAIRS", 3)
    assert sorted(map(tuple, divergence.audit(docs, least=2).collect())) == plain_audit(data, 2, 50)
    assert divergence.audit(empty).count() == 0


def test_tree_and_sides_against_all_terms():
    r = random.Random(11)
    names, zero = "abcdef", {s: 5 + i for i, s in enumerate("abcdef")}
    terms = [tuple((s, n, 40 * n + zero[s], zero[s]) for s in names if (n := r.randint(0, 3))) for _ in range(300)]
    rows = sorted(Counter(t for t in terms if t).items())
    both, p = Counter(), [{s: x for s, _, x, _ in t} for t in terms]
    for _, s, t, change in divergence.tree_corrections((("en", row, n) for row, n in rows)):
        both[s, t] += change
    for i, s in enumerate(names):
        for t in names[i + 1 :]:
            want = sum(abs(x.get(s, zero[s]) - x.get(t, zero[t])) for x in p)
            got = len(terms) * abs(zero[s] - zero[t]) + both[s, t]
            for a, b in ((s, t), (t, s)):
                equal = sorted(Counter(x[a] for x in p if a in x).items())
                ps, times = (np.array(c, np.int64) for c in zip(*equal))
                got += int(divergence.side_changes(ps, times, zero[a], np.array([zero[b]]))[0])
            assert got == want
