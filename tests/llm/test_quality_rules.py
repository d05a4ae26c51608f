import re
from collections import Counter

import numpy as np
import pytest

from trajspark.llm import quality_rules as q

GOOD = [f"This is a fairly plain text number {i}. " + " ".join(f"word{(i * 31 + k * k) % 997}" for k in range(60 + i % 40)) for i in range(120)]


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    marked = {k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dups = sum(x in lines[:k] for k, x in enumerate(lines))
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dups, len(marked)]


@pytest.mark.parametrize(
    "text", [None, "", " \n\t", "a", "a b", "a b c", "a a a", "a a a a", "a b c a b c", "x y z\nx y z\n\nx y z ", "é日🙂 #é\xa0é | *", "a\x0bb\x0cc\rd", "k " * 500, GOOD[0]]
)
def test_counts(text):
    assert q.statistics(None if text is None else text.encode())[0] == brute(text)


def test_forest_sets_apart_what_the_sample_lacks():
    rng = np.random.default_rng(0)
    rows = np.c_[rng.uniform(0, 0.1, 500), np.zeros(500)]
    f = q.Forest.grow(rows, np.zeros(2), np.ones(2))
    near, far = f.score(rows), f.score(np.array([[0.9, 0], [0.05, 0.8], [0.9, 0.9]]))
    assert far.min() > near.max() and ((near > 0) & (near < 1)).all()
    assert len(q.Forest.grow(rows[:0], np.zeros(2), np.zeros(2)).score(rows)) == 500


def make(spark):
    junk = ["%%% ".join(GOOD[k].split()) for k in range(8)] + [GOOD[k].upper() for k in range(8, 14)] + ["same " * 90, "too few words", None, ""]
    texts = GOOD + junk
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, GOOD[3], "x"), (5, GOOD[5], "x")], "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(i, int(i < len(GOOD))) for i in range(0, len(texts), 2)] + [(4, 1), (None, 1), (9999, 1), (7, None)], "doc_id bigint, quality int")
    return docs, labels, len(GOOD)


def test_judge_and_filter(spark):
    docs, labels, n = make(spark)
    got = q.judge(docs, labels).collect()
    assert len(got) == docs.count()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in got:
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == brute(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (r.doc_id is None or r.doc_id < n)
    kept = q.filter_documents(docs, labels)
    assert kept.columns == docs.columns and sorted(kept.collect(), key=str) == sorted([r for r in docs.collect() if r.doc_id is None or r.doc_id < n], key=str)


def test_without_labels_and_rows(spark):
    docs, labels, _ = make(spark)
    assert all(r.kept != r.base_failed for r in q.judge(docs, labels.limit(0)).collect())
    assert q.judge(docs.limit(0), labels).collect() == []
    assert q.filter_documents(docs.limit(0), labels).collect() == []


def test_paths_against_brute_force():
    rng = np.random.default_rng(2)
    rows = np.round(rng.uniform(0, 1, (400, 3)), 2)
    f = q.Forest.grow(rows, rows.min(0), rows.max(0), trees=20, rows_per_tree=64, seed=5)

    def path(t, x):
        """One node after another; where a tree ends, the split is infinite and leads left."""
        node = depth = 0
        while depth < q.DEPTH:
            node, depth = 2 * node + (1 if x[f.feature[t, node]] <= f.split[t, node] else 2), depth + 1
        return f.path[t, node]

    def walk(t, x):
        """The path from the splits alone: their number, and the expected rest for the sample's rows in the leaf."""
        sample = rows[np.random.default_rng(5).permutation(len(rows))[:64]] if t == 0 else None
        node = depth = 0
        while depth < q.DEPTH and np.isfinite(f.split[t, node]):
            left = x[f.feature[t, node]] <= f.split[t, node]
            if sample is not None:
                sample = sample[(sample[:, f.feature[t, node]] <= f.split[t, node]) == left]
            node, depth = 2 * node + (1 if left else 2), depth + 1
        return depth, None if sample is None else depth + q.expected_path(len(sample))

    for x in rows[:60]:
        total = sum(path(t, x) for t in range(20))
        assert np.isclose(f.score(x[None])[0], 2 ** (-total / 20 / f.expected))
        assert all(path(t, x) >= walk(t, x)[0] for t in range(20)) and np.isclose(path(0, x), walk(0, x)[1])


def test_names_that_clash(spark):
    docs, labels, n = make(spark)
    docs = docs.selectExpr("*", "'a' as row", "'b' as id", "7 as n_words", "'c' as symbols", "'d' as `a.b`")
    kept = q.filter_documents(docs, labels)
    assert kept.columns == docs.columns and {tuple(r)[3:] for r in kept.collect()} == {("a", "b", 7, "c", "d")}


def test_a_very_long_text():
    text = ("all work and no play " * 200_000 + "#").encode()
    assert q.statistics(text)[0] == [1_000_001, 16 * 200_000 + 1, 1, 0, 1_000_000]
