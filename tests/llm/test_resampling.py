import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from trajspark.llm import queries, resampling as r

SCHEMA = "doc_id bigint, text string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lower)
    return words, [*words, *map(" ".join, zip(words, words[1:], strict=False))]


def brute(docs, target, buckets=10_000, least=20, percent=25):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in texts for f in features(x)[1]) for texts in ([x for _, x in docs], target))
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in s}
    rows = []
    for i, x in docs:
        words, f = features(x)
        weight = sum(gain[bucket(g)] for g in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(words)])
    may = sorted((x for x in rows if x[4] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    ranks = {id(x): k + 1 for k, x in enumerate(may[: percent * len(may) // 100])}
    return sorted(((*x[:4], ranks.get(id(x))) for x in rows), key=repr)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_interning_compares_bytes():
    grams = [b"a", b"b", b"a", b"c", b"b", b"a", b""]
    slots, held = r.intern(grams, np.array([5, 5, 5, 21, 5, 5, 5], np.uint64))
    assert [grams[held[s]] for s in slots] == grams and len(held) == 4
    assert [x.tolist() for x in r.intern([], np.empty(0, np.uint64))] == [[], []]


@pytest.mark.parametrize("occurrences", [3, 50, 1 << 18])
def test_as_brute_force(spark, monkeypatch, occurrences):
    monkeypatch.setattr(r, "OCCURRENCES", occurrences)
    rng = np.random.default_rng(0)
    vocab = ["alpha", "Beta", "ÉTÉ", "x1", "42", "wort", "ça", "Z"]
    docs = [(i, ", ".join(rng.choice(vocab, rng.integers(0, 60)))) for i in range(80)]
    docs += [(200, None), (201, ""), (202, "--- !"), (203, "one"), (3, docs[3][1]), (None, docs[5][1])]
    target = ["alpha beta alpha beta x1", None, "42 wort 42", ""]
    df = spark.createDataFrame(docs, SCHEMA).repartition(4)
    got = r.importance_ranks(df, spark.createDataFrame([(x,) for x in target], "text string"))
    assert rows_of(got) == brute(docs, target)


def test_long_text_in_pieces(spark):
    text = " ".join(f"w{i % 991}" for i in range(500_000))
    docs = [(1, text), (2, "w1 w2"), (3, text[:3_000_000])]
    got = r.importance_ranks(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([("w5 w6 w7",)], "text string"))
    assert rows_of(got) == brute(docs, ["w5 w6 w7"])


def test_one_score_for_all_is_ranked_by_id(spark):
    docs = spark.createDataFrame([(i, "word " * 30) for i in range(100)], SCHEMA).selectExpr("doc_id", "text", "'x' AS key", "1 AS rank")
    scored = r.score_documents(docs, np.zeros(100, np.int64)).withColumn("score", r.F.lit(5).cast("bigint"))
    got = r._ranked(scored, 20, 25)
    assert {x.id: x.rank for x in got.collect() if x.rank} == {i: i + 1 for i in range(25)}


def test_drawn_documents_keep_clashing_columns(spark):
    rng = np.random.default_rng(4)
    data = [(i, " ".join(rng.choice(["a", "b", "c", "d"], 25)), i * 7, None) for i in range(40)] * 2
    docs = spark.createDataFrame(data, "doc_id bigint, text string, key int, row string")
    target = spark.createDataFrame([("a a a b",)], "text string")
    ranks = r.importance_ranks(docs, target).where("rank is not null").collect()
    got = r.resample(docs, target)
    assert got.columns == docs.columns and sorted(x.doc_id for x in got.collect()) == sorted(x.doc_id for x in ranks)
    assert all(x.key == 7 * x.doc_id for x in got.collect())
    assert r.resample(docs.where("false"), target).count() == 0


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([(1, "a b " * 12), (2, None)], SCHEMA)
    assert r.importance_ranks(empty, some).count() == 0
    assert rows_of(r.importance_ranks(some, empty, percent=100)) == brute([(1, "a b " * 12), (2, None)], [], percent=100)


def test_query_on_whole_tables(spark):
    sf = "/root/testdata/sf0.01"
    docs = [tuple(x) for x in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    target = [x.text for x in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert rows_of(queries.op12_importance_resampling(spark, sf)) == brute(docs, target)
