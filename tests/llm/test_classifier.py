import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajspark.llm import quality_classifier as c


def brute_places(text):
    """One n-gram at a time, with Python integers."""
    from xxhash import xxh64_intdigest

    words, m = (text or b"").split(), 1 << 64
    w = [xxh64_intdigest(x.lower(), 1) for x in words]
    s = [0x9E3779B97F4A7C15 if i and words[i] == words[i - 1] else xxh64_intdigest(c.shape(x), 2) for i, x in enumerate(words)]
    mul = 0xBF58476D1CE4E5B9
    pair = lambda v, i: v[i] * mul % m ^ v[i - 1]
    n = range(len(words))
    grams = [[w[i] for i in n], [pair(w, i) for i in n[1:]], [s[i] for i in n], [pair(s, i) for i in n[1:]], [s[i] * mul * mul % m ^ pair(s, i - 1) for i in n[2:]]]
    return sorted({(g + k) % m * 0x94D049BB133111EB % m >> (64 - c.BITS) for k, x in enumerate(grams) for g in x})


@pytest.mark.parametrize("text", [None, b"", b" \n", b"One", b"One two", b"a a a B! 12 \xc3\xa9t\xc3\xa9 A%%% a", b"x y " * 90])
def test_places(text):
    f = c.Features()
    assert f(text).tolist() == brute_places(text) == f(text).tolist()


def test_shape():
    assert [c.shape(x) for x in (b"Hello", b"HELLO!!", b"a-1.25", b"\xc3\xa9t\xc3\xa9", b"")] == [b"Aa", b"A!", b"a-9.9", b"a", b""]


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(1)
    rows = [np.sort(rng.choice(40, 6, False)).astype(np.int32) for _ in range(200)]
    y = np.array([int((x < 14).sum() > 2) for x in rows])
    values = [np.ones(6) / np.sqrt(6) for _ in rows]
    w, b = c.dual_coordinate_descent(rows, values, y, np.ones(200), epochs=400)
    sign = 2 * y - 1

    def loss(w, b):
        margins = np.array([w[x] @ v + b for x, v in zip(rows, values, strict=True)])
        return 0.5 * (w @ w + b * b) + np.maximum(0, 1 - sign * margins).sum()

    at = loss(w, b)
    for _ in range(60):
        d = np.zeros_like(w)
        d[:40] = rng.normal(0, 0.05, 40)
        assert loss(w + d, b + rng.normal(0, 0.05)) > at - 1e-2


def make(spark):
    good = [f"A calm sentence about item {i} and its {i * 7 % 13} parts." for i in range(150)]
    bad = [f"BUY!! NOW!! {i} %%% $$$ {i * 3} CHEAP!!" for i in range(60)]
    texts = good + bad
    docs = spark.createDataFrame([*((i, t, "q") for i, t in enumerate(texts)), (500, None, "q"), (501, "", "q"), (None, good[0], "q"), (3, good[3], "q")], "doc_id bigint, text string, label string")
    labels = spark.createDataFrame([*((i, int(i < 150)) for i in range(210)), (1, 1), (None, 0), (2, None), (77777, 0)], "doc_id bigint, quality int")
    return docs, labels


def test_scores_on_rows_held_out(spark):
    docs, labels = make(spark)
    got = c.score_documents(docs, c.fit(docs, labels)).collect()
    assert len(got) == docs.count()
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
        if r.doc_id is not None and r.doc_id < 500 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0:
            assert r.predicted == (r.doc_id < 150)


def test_labels_of_held_out_rows_have_no_effect(spark):
    docs, labels = make(spark)
    turned = labels.withColumn("quality", F.when(c.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(map(str, c.score_documents(docs, c.fit(docs, x)).collect())) for x in (labels, turned.repartition(3)))
    assert a == b


def test_one_class_no_labels_no_rows(spark):
    docs, labels = make(spark)
    assert {r.score > 0.5 for r in c.score_documents(docs, c.fit(docs, labels.where("quality = 1"))).collect()} == {True}
    assert {r.score for r in c.score_documents(docs, c.fit(docs, labels.limit(0))).collect()} == {0.5}
    assert c.score_documents(docs.limit(0), c.fit(docs.limit(0), labels)).collect() == []
