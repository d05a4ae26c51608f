import random
import re
import time

import pytest

from trajspark.llm import decontaminate as d

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, n=10):
    out = []
    for i, text in docs:
        w, hit, names = words(text), set(), set()
        for item, t in items:
            x = words(t)
            m = min(n, len(x))
            for k in range(len(x) - m + 1 if m else 0):
                for p in range(len(w) - m + 1):
                    if w[p : p + m] == x[k : k + m]:
                        hit |= set(range(p, p + m))
                        names.add(item)
        out.append((i, len(w), len(hit), sorted(str(x) for x in names if x is not None), bool(hit)))
    return sorted(out, key=str)


BASE = [f"w{i}" for i in range(40)]
ITEMS = [(1, " ".join(BASE[:14])), (12, " ".join(BASE[4:20]).upper()), (3, "Short one"), (4, ""), (5, None), (6, "..."), (None, "lost item"), (3, "short one")]
DOCS = [
    (1, "pre, " + "; ".join(BASE[:14]) + " post"), (2, "x " + " ".join(BASE[2:11])), (3, "a SHORT (one) and short one"), (4, None), (5, ""), (6, "!!! ???"),
    (7, " ".join(BASE) + " " + " ".join(BASE)), (7, " ".join(BASE) + " " + " ".join(BASE)), (None, "the lost item"), (9, "É " + " ".join(BASE[6:17]) + "é"), (10, "short  ones"), (11, "clean words only"),
]


@pytest.mark.parametrize("bound", [0, 10**6])
def test_report(spark, bound, monkeypatch):
    monkeypatch.setattr(d.contamination, "__defaults__", (*d.contamination.__defaults__[:-1], bound))
    docs = spark.createDataFrame([(*r, 7) for r in DOCS], "doc_id bigint, text string, n_hit int")
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    got = sorted((tuple(r) for r in d.contamination_report(docs, bench).collect()), key=str)
    assert got == brute(DOCS, ITEMS)


def test_removal(spark):
    docs = spark.createDataFrame([(*r, 7) for r in DOCS], "doc_id bigint, text string, __x int")
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    kept = d.decontaminate(docs, bench).collect()
    assert sorted(r.doc_id for r in kept) == [2, 4, 5, 6, 10, 11] and kept[0].asDict().keys() == {"doc_id", "text", "__x"}
    spans = {r.doc_id: r.text for r in d.decontaminate(docs, bench, remove="spans").collect()}
    assert spans[1] == "pre post" and spans[3] == "a) and" and spans[4] is None and spans[11] == "clean words only"
    assert not any(r.contaminated for r in d.contamination_report(spark.createDataFrame(list(spans.items()), "doc_id bigint, text string"), bench).collect())


def test_names_that_clash(spark):
    names = ["text_sha", "spans", "items", "row", "__key", "__spans", "words", "h", "pos"]
    docs = spark.createDataFrame([(*r, *names) for r in DOCS], "doc_id bigint, text string, " + ", ".join(f"`{n}` string" for n in names))
    bench = spark.createDataFrame([(*r, "x") for r in ITEMS], "item_id bigint, text string, words string")
    for how in ("documents", "spans"):
        out = d.decontaminate(docs, bench, remove=how)
        assert out.columns == docs.columns and all(list(r)[2:] == names for r in out.collect())
    assert sorted((tuple(r) for r in d.contamination_report(docs, bench).collect()), key=str) == brute(DOCS, ITEMS)


@pytest.mark.parametrize("bound", [0, 10**6])
def test_random_texts(spark, bound, monkeypatch):
    monkeypatch.setattr(d.contamination, "__defaults__", (*d.contamination.__defaults__[:-1], bound))
    rng = random.Random(3)
    some = lambda n: " ".join(rng.choice(["a", "B", "b", "É", "é", "x-y"]) for _ in range(n))
    items = [(k, some(rng.randint(1, 16))) for k in range(12)]
    docs = [(k, some(rng.randint(0, 200)) + " " + rng.choice(items)[1]) for k in range(60)]
    got = d.contamination_report(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, items)


def test_a_document_of_a_million_words(spark):
    rng = random.Random(4)
    text = [f"w{rng.randint(0, 10**6)}" for _ in range(1_000_000)]
    item = " ".join(BASE[:12])
    for at in range(0, 1_000_000, 1000):
        text[at : at + 12] = BASE[:12]
    docs = spark.createDataFrame([(1, " ".join(text)), (2, "clean")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, item), (2, "a b c")], "item_id bigint, text string")
    start = time.time()
    got = {r.doc_id: (r.n_words, r.n_hit, r.items) for r in d.contamination_report(docs, bench).collect()}
    assert got == {1: (1_000_000, 12_000, ["1"]), 2: (1, 0, [])}
    assert d.decontaminate(docs.where("doc_id = 1"), bench, remove="spans").first().text.count("w0 ") < 10
    assert time.time() - start < 90


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id bigint, text string")
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert d.contamination_report(docs.limit(0), bench).collect() == []
    assert {r.n_hit for r in d.contamination_report(docs, bench.limit(0)).collect()} == {0}
    assert d.decontaminate(docs, bench.limit(0)).count() == len(DOCS)
