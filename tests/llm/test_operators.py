"""Each corpus operator on a small corpus with odd cases, against a plain version."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import line_dedup, mixing, near_dedup, order_minhash, packing, quality, secret_scan, sharding, stream_dedup, subword, suffix_dedup
from plumbline.llm.common import among
from tests.llm import corpus


@pytest.fixture(scope="module")
def data():
    return corpus.rows()


@pytest.fixture(scope="module")
def docs(spark, data):
    return corpus.frame(spark, data).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


# ---- 1: order MinHash


def test_fingerprints_follow_edits():
    r = random.Random(2)
    text = corpus.prose(r, 300)
    found = lambda t: order_minhash.signature(order_minhash.code_points(t))
    half = text[: len(text) // 2]
    small = order_minhash.likeness(found(text), found(text[:900] + "#" + text[901:]))
    large = order_minhash.likeness(found(text), found(half + corpus.prose(r, 150)))
    swapped = order_minhash.likeness(found(text), found(text[len(half) :] + half))
    assert small > 0.8 > swapped > 0.2 and small > large and order_minhash.likeness(found(text), found(corpus.prose(r, 300))) < 0.1
    # Occurrence numbers make repeats count.
    assert order_minhash.likeness(found("abcdefgh " * 50), found("abcdefgh " * 100)) < 0.9


def test_chosen_kmers_equal_plain_version():
    codes = order_minhash.code_points(corpus.prose(random.Random(4), 60))
    x, at = order_minhash.numbered_kmers(codes)
    seen, plain = defaultdict(int), []
    for i in range(len(codes) - order_minhash.K + 1):
        k = tuple(codes[i : i + order_minhash.K])
        plain.append((k, seen[k]))
        seen[k] += 1
    assert sorted(at) == list(range(len(plain))) and len(set(x)) == len(plain)
    chosen = order_minhash._smallest(x, order_minhash._ODD[:8], 2)
    for row, odd in zip(chosen, order_minhash._ODD[:8]):
        assert set(row) == set(np.argsort(x * odd)[:2])
    long = order_minhash.code_points(corpus.prose(random.Random(4), 4000))
    y, _ = order_minhash.numbered_kmers(long)
    assert set(order_minhash._smallest(y, order_minhash._ODD[:3], 2)[2]) == set(np.argsort(y * order_minhash._ODD[2])[:2])


def test_compare_with_next(spark, data, docs, empty):
    got = {r["doc_id"]: r for r in order_minhash.compare_with_next(docs).collect()}
    assert len(got) == len(data)
    order = sorted(data)
    for (i, text, *_), (_, after, *_) in zip(order, order[1:] + order[:1]):
        text, after = text or "", after or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        a, b, c = (order_minhash.signature(order_minhash.code_points(t)) for t in (text, edited, after))
        assert (r["fingerprint"], r["edited_fingerprint"]) == (order_minhash.as_text(a), order_minhash.as_text(b))
        assert (r["near_edited"], r["near_next"]) == (order_minhash.likeness(a, b), order_minhash.likeness(a, c))
    assert order_minhash.compare_with_next(empty).count() == 0
    one = order_minhash.compare_with_next(docs.filter("doc_id = 9")).first()
    assert one["near_next"] == 1.0
    twice = docs.filter("doc_id < 6").union(docs.filter("doc_id = 0")).withColumn("doc_id", F.when(F.col("doc_id") > 0, F.col("doc_id")))
    assert sorted(str(r["doc_id"]) for r in order_minhash.compare_with_next(twice).collect()) == ["3", "None", "None"]
    assert {r["doc_id"]: r["fingerprint"] for r in order_minhash.fingerprints(docs).collect()} == {i: r["fingerprint"] for i, r in got.items()}


# ---- 2: shards


def test_shards_are_even_and_keep_copies_together(spark, data, docs, empty):
    many = docs.union(docs.withColumn("doc_id", F.col("doc_id") + 100_000)).union(docs.withColumn("doc_id", F.lit(None).cast("long")))
    found = sharding.shard_documents(many, 7).collect()
    sizes, slots = defaultdict(int), defaultdict(set)
    for r in found:
        sizes[r["shard"]] += 1
        slots[r["shard"]].add(r["slot"])
    n = 3 * len(data)
    assert len(found) == n and sorted(sizes) == list(range(7)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(slots[s] == set(range(sizes[s])) for s in sizes)
    texts = {i: t or "" for i, t, *_ in data}
    homes = defaultdict(set)
    for r in found:
        if r["doc_id"] is not None:
            t = texts[r["doc_id"] % 100_000]
            assert (r["size"], r["text_crc32"]) == (len(t.encode()) + 16, zlib.crc32(t.encode()))
            homes[t].add(r["shard"])
    assert np.mean([len(h) for h in homes.values()]) < 1.3  # a random assignment has 1.8
    assert sharding.shard_documents(empty).count() == 0


def test_a_hot_key_leaves_others_together(spark):
    nodes = spark.range(4000).withColumnRenamed("id", "node")
    links = nodes.select("node", F.when(F.col("node") < 1400, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.floor(F.col("node") / 2))).alias("key"))
    placed = sharding.shard(nodes, links, 10).join(links, "node")
    sizes = [r["count"] for r in placed.groupBy("shard").count().collect()]
    assert sizes == [400] * 10
    spread = placed.groupBy("key").agg(F.countDistinct("shard").alias("n")).collect()
    by = {r["key"]: r["n"] for r in spread}
    assert np.mean([n for k, n in by.items() if k != "hot"]) < 1.2


# ---- 3: packing


def ids_of(text):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    tok.encode_special_tokens = True
    return tok.encode(text or "", add_special_tokens=False).ids + [packing.END_ID]


def test_fast_encoding_equals_tokenizer(data):
    r = random.Random(8)
    safe = [chr(c) for c in [*range(32, 127), *range(0xA0, 0x250)] if not packing._OTHER.search(chr(c))] + list("\n\t''''  .._sstmdrvel") * 20
    odd = safe + ["²", "¼", "İ", "Σ", "日", "́", "\x85", "\x1c"] * 10
    texts = ["".join(r.choice(a) for _ in range(300)) for a in [safe] * 150 + [odd] * 50]
    texts += ["don't it's we'll I'D 's''s 'tis rock'n'roll _a_b__ <|endoftext|>", *[t for _, t, *_ in data if t and len(t) < 9000]]
    encode = packing.encoder(packing.tokenizer_path())
    for t in texts:
        assert np.frombuffer(encode(t), "<u4").tolist() == ids_of(t)[:-1], t


def test_best_fit_against_plain_version():
    r = random.Random(3)
    lengths = sorted((r.randint(1, 100) for _ in range(800)), reverse=True)
    which, offsets = packing.best_fit(lengths, 100)
    rooms, plain = [], []
    for n in lengths:
        fits = [(room, -i) for i, room in enumerate(rooms) if room >= n]
        room, i = min(fits) if fits else (100, 0)
        if not fits:
            rooms.append(100)
            i = 1 - len(rooms)
        plain.append(room)
        rooms[-i] -= n
    assert [100 - o for o in offsets] == plain and max(which) + 1 == len(rooms)
    assert packing.best_fit([], 8) == ([], [])


def test_pieces_cover_documents(data, docs, empty):
    packed = packing.pack(docs, block=16)
    found = packed.collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in found:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t, *_ in data:
        ids, at = np.array(ids_of(t), "<u4"), 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    small = docs.filter("doc_id < 40")
    whole = {r["sequence_id"]: r["ids"] for r in packing.sequences(small, packing.pack(small)).collect()}
    assert sorted(sum(whole.values(), [])) == sorted(x for i, t, *_ in data if i < 40 for x in ids_of(t))
    assert packing.pack(empty).count() == 0


def test_added_tokens_in_a_text_are_one_id(spark):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(packing.tokenizer_path())
    texts = ["hello <|endoftext|> world", "a<|startoftext|>b" * 1500, "<|EndOfText|> <|endoftext", "日<|endoftext|><|endoftext|>", "plain"]
    docs = corpus.frame(spark, [(i, t, None, None, 0) for i, t in enumerate(texts)])
    want = {i: own.encode(t, add_special_tokens=False).ids + [packing.END_ID] for i, t in enumerate(texts)}
    assert 49407 in want[0] and want[1][1] == 49406 and len(want[1]) > packing.WINDOW
    for r in packing.pack(docs).collect():
        ids = np.array(want[r["doc_id"]], "<u4")
        part = ids[r["start"] : r["start"] + r["length"]]
        assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(part.tobytes())
    made = packing.sequences(docs, packing.pack(docs)).collect()
    assert sorted(x for r in made for x in r["ids"]) == sorted(sum(want.values(), []))


# ---- 4: mixing


def domain_rows(n=400):
    r = random.Random(6)
    alphabets = {"en": "abcdefgh", "de": "ijklmnop", "fr": "qrstuvwx"}
    out = []
    for i in range(n):
        lang = r.choices(list(alphabets), [6, 3, 1])[0]
        out.append((i, corpus.prose(r, r.randint(5, 60), alphabets[lang]), lang, "s", 1))
    return [*out, (n, None, "en", None, None), (n + 1, "", None, None, 0), (None, "abc ijk", None, None, 7)]


def test_rates_meet_targets(spark):
    rows = domain_rows()
    docs = corpus.frame(spark, rows)
    labelled = docs.filter("doc_id < 200").selectExpr("doc_id", "lang AS label")
    targets = {"en": 0.3, "de": 0.4, "fr": 0.3}
    found = mixing.mix(docs, labelled, targets, most=9.0).collect()
    assert len(found) == len(rows) and all(r["rate"] >= 0 for r in found)
    weight = np.array([r["rate"] * r["n_words"] for r in found])
    for d, share in targets.items():
        assert np.dot(weight, [r[f"p_{d}"] for r in found]) / weight.sum() == pytest.approx(share, abs=1e-3)
    truth = {i: lang for i, _, lang, *_ in rows}
    good = [r[f"p_{truth[r['doc_id']]}"] for r in found if r["doc_id"] is not None and r["doc_id"] < 400]
    assert np.mean(np.array(good) > 0.5) > 0.97
    assert sum(r["copies"] for r in found) == pytest.approx(sum(r["rate"] for r in found), rel=0.1)


def test_rates_equal_plain_descent():
    r = np.random.default_rng(1)
    p = r.dirichlet([0.3, 0.3, 0.3], 50)
    t = r.integers(1, 100, 50).astype(float)
    wanted = np.array([0.5, 0.3, 0.2]) * t.sum()
    scale = 1 / (p.T * t).sum(axis=1)
    rate = np.ones(50)
    for _ in range(mixing.STEPS):
        rate = np.clip(rate - p @ ((p.T @ (t * rate) - wanted) * scale), 0, mixing.MOST)
    assert np.abs(p.T @ (t * rate) - wanted).max() < 0.02 * t.sum()
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    df = spark.createDataFrame([(int(w), *map(float, q)) for w, q in zip(t, p)], "_words long, _p0 double, _p1 double, _p2 double")
    got, shares = mixing.fit_rates(df, [0.5, 0.3, 0.2])
    # Documents without words follow the rates; the sums agree with the plain descent.
    assert shares == pytest.approx((p.T @ (t * rate) / (t @ rate)).tolist(), abs=0.01)
    assert got.count() == 50


def test_mixing_odd_inputs(spark, docs, empty):
    labelled = docs.selectExpr("doc_id", "lang AS label")
    assert mixing.mix(empty, labelled, {"en": 1.0}).count() == 0
    none = mixing.mix(docs, labelled.limit(0), {"en": 0.5, "de": 0.5})
    assert {(r["p_en"], r["rate"]) for r in none.collect()} == {(0.5, 1.0)}
    kept = mixing.repeat(docs, labelled, {"en": 0.5, "de": 0.5})
    assert kept.columns == docs.columns and kept.select("doc_id").distinct().count() == docs.count()


def test_registered_targets_are_met_when_one_language_holds_most(spark):
    import corpus_pipeline

    r = random.Random(16)
    alphabets = {"en": "abcdefg", "de": "hijklmn", "fr": "opqrstu", "es": "vwxyzñé"}
    langs = [lang for lang, n in {"en": 900, "de": 36, "fr": 34, "es": 30}.items() for _ in range(n)]
    docs = corpus.frame(spark, [(i, corpus.prose(r, 40, alphabets[lang]), lang, "s", 1) for i, lang in enumerate(langs)], extra=False)
    labelled = docs.selectExpr("doc_id", "lang AS label")
    found = mixing.mix(docs, labelled).collect()
    rate = {r["doc_id"]: r["rate"] for r in found}
    for lang, want in mixing.TARGETS.items():
        assert sum(v for i, v in rate.items() if langs[i] == lang) / sum(rate.values()) == pytest.approx(want, abs=0.01)
    mixed = mixing.repeat(docs, labelled, corpus_pipeline.TARGETS).groupBy("lang").count().collect()
    whole = sum(x["count"] for x in mixed)
    for x in mixed:
        assert x["count"] / whole == pytest.approx(corpus_pipeline.TARGETS[x["lang"]], abs=0.015)
    _, shares = mixing.mix_with_shares(docs, labelled, most=2.0)
    assert max(shares.values()) > 0.6  # a bound that binds can be seen


# ---- 5: quality


def test_quality_on_held_out_rows(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    found = quality.score(docs, labels)
    judged = found.join(labels, "doc_id").filter("held_out").collect()
    assert len(judged) > 50 and np.mean([r["predicted"] == r["quality"] for r in judged]) > 0.97
    ids = {r["doc_id"]: r["held_out"] for r in found.collect()}
    assert all(held == (zlib.crc32(str(i).encode()) % 5 == 0) for i, held in ids.items())
    # Labels of held-out rows change nothing.
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r["doc_id"]: r["score"] for r in quality.score(docs, flipped).collect()}
    assert again == {r["doc_id"]: r["score"] for r in found.collect()}


def test_folded_table_equals_the_network():
    r = random.Random(1)
    rows = [("1" if i % 3 else "0", *subword.weights(subword.features(corpus.prose(r, 20, "abcd" if i % 3 else "wxyz")))) for i in range(60)]
    model = subword.fit(rows)
    assert model.probabilities("abca dbca")[1] > 0.9 > 0.1 > model.probabilities("wxyz zyx")[1]
    assert model.probabilities("").sum() == pytest.approx(1) and model.probabilities("")[1] > 0.5
    assert subword.REPEATED in subword.features("again again") and len(subword.features(" \n")) == 0


def test_quality_odd_inputs(spark, docs, empty):
    labels = spark.createDataFrame([(0, 1, 0), (3, None, 0), (None, 0, 0), (6, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.score(docs, labels).collect()} == {1.0}
    assert {r["predicted"] for r in quality.score(docs, labels.limit(0)).collect()} == {1}
    assert quality.score(empty, labels).count() == 0
    mixed = spark.createDataFrame([(i * 3, i % 2) for i in range(40)], "doc_id long, quality int")
    found = quality.score(docs, mixed)
    assert found.count() == docs.count() and found.filter("score < 0 OR score > 1 OR score IS NULL").count() == 0
    kept = quality.keep_good(docs, mixed)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in found.filter("predicted = 1").collect())


# ---- 6: lines


def line_rows():
    r = random.Random(3)
    base = [corpus.prose(r, r.choice([3, 5, 8, 20, 90, 110, 130, 250]), "abcdeé") for _ in range(80)]

    def edited(s):
        for _ in range(r.choice([0, 0, 1, 1, 1, 2])):
            i, k = r.randrange(len(s) + 1), r.random()
            s = s[:i] + r.choice("abxñ") + s[i:] if k < 0.33 else s[: max(i - 1, 0)] + ("" if k < 0.66 else r.choice("abxñ")) + s[i:]
        return s

    short = ["", "  ", "short", "shart", "abcdefghijklmnop", "abcdefghijklmnoq", "abcdefghijklmno"]
    docs = [(d, "\n".join(edited(r.choice(base)) if r.random() < 0.9 else r.choice(short) for _ in range(r.randint(1, 12)))) for d in range(100)]
    return [*docs, (500, None), (501, ""), (None, base[0]), (0, docs[0][1]), (502, " \n "), (503, "y" * 30_000), (504, "y" * 29_999)]


def test_lines_against_all_pairs(spark):
    data = line_rows()
    gone = corpus.dropped_lines(data)
    docs = corpus.frame(spark, [(i, t, "en", None, 1) for i, t in data])
    got = defaultdict(list)
    for r in line_dedup.report(docs).collect():
        got[r["doc_id"]].append((r["n_lines"], r["n_dropped"], r["dropped"]))
    texts = defaultdict(list)
    for r in line_dedup.drop_lines(docs).collect():
        texts[r["doc_id"]].append((r["text"], r["n_chars"]))
    for i, t in data:
        split = (t or "").split("\n")
        drop = [k for k, x in enumerate(split) if ((i is not None, i or 0, k), x) in gone]
        assert (len(split), len(drop), ",".join(map(str, drop))) in got[i]
        left = [x for k, x in enumerate(split) if k not in drop]
        if not any(x.strip() for x in split):
            assert (t, 1) in texts[i]
        elif any(x.strip() for x in left):
            assert ("\n".join(left), len("\n".join(left))) in texts[i]
        else:
            assert i not in texts
    assert len(gone) > 100
    assert line_dedup.report(docs.limit(0)).count() == 0 == line_dedup.drop_lines(docs.limit(0)).count()
    assert line_dedup.drop_lines(docs).columns == docs.columns


# ---- 7: passages


def test_passages_against_all_runs(data, docs, empty):
    want = corpus.repeated_words([(i, t) for i, t, *_ in data])
    got = defaultdict(set)
    for r in suffix_dedup.repeats(docs).collect():
        assert r["n_words"] == r["end_word"] - r["start_word"] >= 50 and r["other_id"] != r["doc_id"]
        got[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
    assert got == want and len(want) > 10
    assert suffix_dedup.repeats(empty).count() == 0


def test_a_passage_that_very_many_documents_share(spark):
    r = random.Random(9)
    passage = corpus.prose(r, 70)
    rows = [(i, f"{corpus.prose(r, 5 + i % 7)} {passage} {corpus.prose(r, 9)}", None, None, 0) for i in range(300)]
    rows += [(1000, corpus.prose(r, 200), None, None, 0), (None, passage, None, None, 0), (7, passage, None, None, 0)]
    found = suffix_dedup.repeats(corpus.frame(spark, rows)).collect()
    assert {x["doc_id"] for x in found} == set(range(300))


def test_passages_that_end_or_begin_in_frequent_words(spark):
    r = random.Random(12)
    phrase, rare = corpus.prose(r, 40), lambda n: corpus.prose(r, n)
    rows = [f"{rare(15)} {phrase} {rare(15)}" for _ in range(300)]
    for k in range(24):
        own = rare(20) if k % 3 else rare(15)
        passage = (f"{own} {phrase}", f"{phrase} {own}", f"{phrase.split(' ', 20)[-1]} {own} {phrase}")[k % 3]
        rows += [f"{rare(12)} {passage} {rare(12)}" for _ in range(2)]
    r.shuffle(rows)
    want = corpus.repeated_words(list(enumerate(rows)))
    got = defaultdict(set)
    for x in suffix_dedup.repeats(corpus.frame(spark, [(i, t, None, None, 0) for i, t in enumerate(rows)])).collect():
        got[x["doc_id"]].update(range(x["start_word"], x["end_word"]))
    assert len(want) == 48 and got == want


def test_windows_that_are_open_have_a_bounded_size(spark):
    w = [f"{'w' * 30}{i}" for i in range(90)]
    ended = lambda some: "".join(f"{x} " for x in some).encode()
    suffix = [(1, 40, ended(w[40:90]), ended(w[40:50] + w[:40][::-1])), (2, 45, ended(w[40:90]), ended(w[40:50] + w[:40][::-1]))]
    suffixes = spark.createDataFrame(suffix, "doc_id long, pos int, after binary, before binary")
    wanted = spark.createDataFrame([(1, 40, 0, 40), (2, 45, 3, 9)], "doc_id long, pos int, low int, high int")
    rows = suffix_dedup._open_windows(suffixes, wanted).collect()
    found = {(r["doc_id"], r["start"]): bytes(r["words"]) for r in rows}
    assert len(rows) == 41 + 7 and {len(x) for x in found.values()} == {24}
    assert len({x for (i, _), x in found.items() if i == 1}) == 41
    assert all(found[2, 45 - k] == found[1, 40 - k] for k in range(3, 10))


def test_windows_are_asked_for_only_where_no_passage_covers_them(spark, monkeypatch):
    spans = spark.createDataFrame([(1, 0, 60, 2), (1, 100, 170, 3), (2, 0, 40, 1)], "doc_id long, start int, stop int, other long")
    rows = [(1, 20, 0, 20), (1, 110, 0, 10), (2, 60, 5, 9)]
    asking = spark.createDataFrame(rows, "doc_id long, pos int, low int, high int")
    # Windows that begin 20 to 10 words before the place end by word 60, and the second row's lie in a passage.
    assert sorted(map(tuple, suffix_dedup._not_covered(spans, asking).collect())) == [(1, 20, 0, 9), (2, 60, 5, 9)]

    r = random.Random(12)
    phrase, more = corpus.prose(r, 40), corpus.prose(r, 25)
    rows = [f"{corpus.prose(r, 15)} {phrase} {more} {corpus.prose(r, 15)}" for _ in range(200)]
    for k in range(24):
        own = corpus.prose(r, 20)
        passage = (f"{own} {phrase}", f"{phrase} {own}", f"{phrase.split(' ', 20)[-1]} {own} {phrase}")[k % 3]
        rows += [f"{corpus.prose(r, 12)} {passage} {corpus.prose(r, 12)}" for _ in range(2)]
    kept, keep = [], suffix_dedup.Scratch.keep
    monkeypatch.setattr(suffix_dedup.Scratch, "keep", lambda self, df, **k: kept.append(keep(self, df, **k)) or kept[-1])
    monkeypatch.setattr(suffix_dedup.Scratch, "drop", lambda *_: None)
    assert passages_of(spark, rows) == corpus.repeated_words(list(enumerate(rows)))
    laid_out = [x for x in kept if "words" in x.columns and "start" in x.columns]
    # Nearly all of the 200 documents are covered by their own passage and keep no window, whoever asks.
    assert laid_out and len({x["doc_id"] for x in laid_out[0].collect()} & set(range(200))) < 10


def test_equal_windows_of_a_task_are_one_row(spark, monkeypatch):
    w = corpus.prose(random.Random(4), 90).split()
    ended = lambda some: "".join(f"{x} " for x in some).encode()
    rows = [(i, 40, ended(w[40:90]), ended(w[40:50] + w[:40][::-1])) for i in range(200)]
    suffixes = spark.createDataFrame(rows, "doc_id long, pos int, after binary, before binary").coalesce(1)
    wanted = spark.range(200).selectExpr("id as doc_id", "40 as pos", "0 as low", "3 as high").coalesce(1)
    found = suffix_dedup._window_ends(suffixes, F.broadcast(wanted)).collect()
    assert len(found) == 4 == len({bytes(x["words"]) for x in found}) and {(x["a"], x["b"]) for x in found} == {(0, 199)}
    monkeypatch.setattr(suffix_dedup, "HELD", 3)
    assert len(suffix_dedup._window_ends(suffixes, F.broadcast(wanted)).collect()) > 200


def test_rows_whose_key_may_be_wanted(spark):
    rows, wanted = spark.range(20000).selectExpr("id", "encode(id, 'UTF-8') key"), spark.range(0, 20000, 100).selectExpr("encode(id, 'UTF-8') key")
    found = {x["id"] for x in among(rows, "key", wanted).collect()}
    assert found >= set(range(0, 20000, 100)) and len(found) < 2500
    assert among(rows, "key", wanted.limit(0)).count() == 0


def passages_of(spark, rows):
    got = defaultdict(set)
    for x in suffix_dedup.repeats(corpus.frame(spark, [(i, t, None, None, 0) for i, t in enumerate(rows)])).collect():
        assert x["n_words"] >= 50 and x["other_id"] != x["doc_id"]
        got[x["doc_id"]].update(range(x["start_word"], x["end_word"]))
    return got


def test_passages_over_the_bounds_of_many_ranges(spark):
    r = random.Random(21)
    pool = [corpus.prose(r, r.randint(8, 30)) for _ in range(14)]
    rows = [" ".join(r.choice(pool) if r.random() < 0.7 else corpus.prose(r, 6) for _ in range(r.randint(3, 12))) for _ in range(70)]
    rows += [" ".join([pool[0]] * 40), f"{'long' * 40} {pool[1]} {corpus.prose(r, 40, 'xyz')}"] + [rows[5]] * 9
    rows += [rows[-11].upper()]
    want = corpus.repeated_words(list(enumerate(rows)))
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")
    try:
        got = passages_of(spark, rows)
    finally:
        spark.conf.unset(coalesce)
    assert got == want and len(want) > 20


def test_passages_that_only_touch_are_two(spark):
    r = random.Random(22)
    one, two = corpus.prose(r, 50), corpus.prose(r, 50)
    rows = [f"{one} {two}", f"{corpus.prose(r, 9)} {one} {corpus.prose(r, 9)}", f"{corpus.prose(r, 9)} {two}"]
    found = suffix_dedup.repeats(corpus.frame(spark, [(i, t, None, None, 0) for i, t in enumerate(rows)])).collect()
    assert {(x["start_word"], x["end_word"], x["other_id"]) for x in found if x["doc_id"] == 0} == {(0, 50, 1), (50, 100, 2)}


def test_words_in_common():
    assert suffix_dedup.common_words(b"", b"a ") == 0
    assert suffix_dedup.common_words(b"ab cd e ", b"ab cde ") == 1
    assert suffix_dedup.common_words(b"ab cd ", b"ab cd ") == 2 == suffix_dedup.common_words(b"ab cd ", b"ab cd x ")


# ---- 8: exact copies by a stream


def plain_groups(data):
    of = defaultdict(list)
    for i, t in data:
        of[t or ""].append(i)
    return {t: (max(ids), len(ids)) for t, ids in of.items()}


def digest_by_length(text):
    return F.length(text).cast("string").cast("binary")


@pytest.mark.parametrize("digest", [stream_dedup.sha256, digest_by_length])
def test_stream_over_several_batches(spark, data, docs, tmp_path, digest):
    path = str(tmp_path / "documents.parquet")
    docs.write.parquet(path)
    found = stream_dedup.exact_groups(spark, path, digest, bytes_per_batch=1).collect()
    want = plain_groups([(i, t) for i, t, *_ in data])
    text = {i: t or "" for i, t, *_ in data}
    assert len(found) == len(data)
    for r in found:
        t = text[r["doc_id"]]
        assert (r["keep_id"], r["group_size"]) == want[t] and r["kept"] == (r["doc_id"] == r["keep_id"])
        assert r["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_stream_repeated_rows_and_empty(spark, tmp_path):
    rows = [(5, "a"), (5, "a"), (None, "a"), (1, None), (2, "")]
    path = str(tmp_path / "one.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(path)
    found = stream_dedup.exact_groups(spark, path).collect()
    assert sorted((str(r["doc_id"]), r["keep_id"], r["group_size"], r["kept"]) for r in found) == [
        ("1", 2, 2, False), ("2", 2, 2, True), ("5", 5, 3, False), ("5", 5, 3, True), ("None", 5, 3, False)
    ]
    none = str(tmp_path / "none.parquet")
    spark.createDataFrame([], "doc_id long, text string").coalesce(1).write.parquet(none)
    assert stream_dedup.exact_groups(spark, none).count() == 0


# ---- 9: near copies


def test_near_copies_against_all_pairs(data, docs, empty):
    want = corpus.near_components([(i, t) for i, t, *_ in data])
    found = near_dedup.groups(docs).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for _, i in want.values()}
    assert near_dedup.groups(empty).count() == 0


def test_rows_that_repeat_an_id_lose_no_text(spark):
    r = random.Random(31)
    a, b, c = (corpus.prose(r, 40) for _ in range(3))
    rows = [(5, a), (5, b), (3, b), (8, b), (8, b), (9, c), (None, b), (10, None)]
    kept = near_dedup.keep_one(corpus.frame(spark, [(i, t, None, None, 0) for i, t in rows])).collect()
    assert {(x["doc_id"], x["text"]) for x in kept} == {(5, a), (5, b), (3, b), (9, c), (None, b), (10, None)}


def test_a_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "DEAL", 16)
    r = random.Random(12)
    base = corpus.prose(r, 150).split(" ")
    rows = []
    for i in range(120):  # a chain: neighbours are alike, far ones are not
        w = list(base)
        for k in range(i):
            w[(k * 7) % 150] = f"w{k}"
        rows.append((i, " ".join(w)))
    rows += [(500, None), (501, "a b"), (502, "A  b"), (3, rows[3][1])]
    want = corpus.near_components(rows)
    found = near_dedup.groups(spark.createDataFrame([*rows, (None, rows[0][1])], "doc_id long, text string")).collect()
    assert len(found) == len(rows) + 1
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found if r["doc_id"] is not None} == want
    assert [(r["component_id"], r["kept"]) for r in found if r["doc_id"] is None] == [(None, True)]


def test_marks_leave_no_node_out(spark, monkeypatch):
    docs = spark.range(-3000, 3000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    docs = docs.union(spark.createDataFrame([(None, "y")], "doc_id long, text string"))
    nodes = spark.range(-3000, 3000, 7).withColumnRenamed("id", "node")
    want = {r["node"] for r in nodes.collect()}
    found = [r["doc_id"] for r in near_dedup._marked(docs, nodes).collect()]
    assert want <= set(found) and len(found) < len(want) + 300
    monkeypatch.setattr(near_dedup, "MOST_MARKS", 1)  # a full bitmap lets more through, and still all nodes
    assert want <= {r["doc_id"] for r in near_dedup._marked(docs, nodes).collect()}
    assert near_dedup._marked(docs, nodes.limit(0)).count() == 0


def test_sketch_estimates():
    r = np.random.default_rng(7)
    for share in (0.6, 0.75, 0.9):
        errors = []
        for _ in range(40):
            both = r.integers(0, 2**63, int(400 * share), dtype=np.uint64)
            rest = lambda: r.integers(0, 2**63, (400 - len(both)) // 2, dtype=np.uint64)
            a, b = (near_dedup.samples(np.concatenate([both, rest()])) for _ in range(2))
            bits = [np.unpackbits(np.frombuffer(near_dedup.sketch(x), np.uint8)) for x in (a, b)]
            errors.append(float(near_dedup.estimate(np.count_nonzero(bits[0] != bits[1]))) - share)
        assert abs(np.mean(errors)) < 0.04 and np.std(errors) < 0.12


# ---- 10: secrets

ASSIGN = re.compile(r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def plain_spans(text):
    found = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return ",".join(x for *_, x in sorted(found))


def secret_rows():
    r = random.Random(5)
    rows = []
    for i in range(120):
        t = corpus.prose(r, 30)
        if i % 3 == 0:
            t += f' ñ password = "{r.randbytes(9).hex()}" {corpus.prose(r, 5)}'
        if i % 4 == 0:
            t += " AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))
        if i % 5 == 0:
            t += f" {r.randbytes(8).hex()}ff token=passwd=abc Api_Key: x.y-zz/+0123456 toKen=abcdefghijklmnop"
        rows.append((i, t, None, None, None))
    hidden = "AKIB" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))
    return [*rows, (200, f"see {hidden} end", None, None, None), (201, None, None, None, None), (202, "", None, None, None), (None, "plain 1234", None, None, None)], hidden


def test_spans_and_formats(spark):
    rows, hidden = secret_rows()
    docs = corpus.frame(spark, rows)
    found = {r["doc_id"]: r for r in secret_scan.digests(secret_scan.scan(docs)).collect()}
    assert len(found) == len(rows)
    for i, t, *_ in rows:
        want = plain_spans(t or "")
        got = found[i]
        base = ",".join(x for x in got["spans"].split(",") if not x.startswith("format:"))
        assert base == want and got["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert sum(got[f"n_{k}"] for k in ("assign", "access", "hex")) == len([x for x in want.split(",") if x])
    assert found[200]["spans"] == f"format:4:{4 + len(hidden)}"
    assert sum(r["n_format"] for r in found.values()) == 1
    assert secret_scan.digests(secret_scan.scan(docs.limit(0))).count() == 0


def test_learned_automata_are_small_and_tell_formats():
    r = random.Random(7)
    model = secret_scan.learn([r.randbytes(10).hex() for _ in range(300)])
    assert len(model["states"]) < 40
    for state in model["states"]:
        assert sum(share for share, _ in state.values()) == pytest.approx(1)
    assert secret_scan.score(model, r.randbytes(10).hex()) > model["bound"] - 0.2 > secret_scan.score(model, "Zq+/Zq+/Zq+/Zq+/Zq+/")
