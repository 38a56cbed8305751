"""The as-of join against all pairs."""

import random
from collections import Counter

import pytest

from plumbline.operators.asof import as_of


def want(left, right, strict):
    out = Counter()
    for k, t, i, note in left:
        fits = [(s, v, w) for key, s, v, w in right if None not in (k, t, s) and key == k and (s < t or (not strict and s == t))]
        out[k, t, i, note, *(max(fits)[1:] if fits else (None, None))] += 1
    return out


@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("chunks", [1, 7])
def test_as_of_against_all_pairs(spark, strict, chunks):
    r = random.Random(4)
    key = lambda: "hot" if r.random() < 0.5 else r.choice(["a", "b", None])
    left = [(key(), None if i % 40 == 0 else r.randrange(60), i, f"n{i}") for i in range(250)]
    left.append(left[3])
    right = [(key(), None if i % 50 == 0 else r.randrange(60), i, None if i % 7 == 0 else i * 2) for i in range(200)]
    a = spark.createDataFrame(left, "k string, t int, i int, _found string").repartition(3)
    b = spark.createDataFrame(right, "k string, t int, v int, w int").repartition(3)
    found = as_of(a, b, ["k"], "t", ["v", "w"], "v", strict, chunks)
    assert found.columns == ["k", "t", "i", "_found", "v", "w"]
    assert Counter(map(tuple, found.collect())) == want(left, right, strict)


def test_as_of_without_rows(spark):
    a = spark.createDataFrame([("x", 1)], "k string, t int")
    b = spark.createDataFrame([], "k string, t int, v int")
    assert list(map(tuple, as_of(a, b, ["k"], "t", ["v"], "v").collect())) == [("x", 1, None)]
    assert as_of(a.limit(0), b, ["k"], "t", ["v"], "v").count() == 0
