import hashlib
import random

import numpy as np
import pytest

from trajspark.llm import bpe

PATH = bpe.default_path()
TEXTS = [None, "", " ", "  ", "a", " a", "a ", "a  b", "one two", "one\n two", "x \n\n y", "it's 'll 123 4", "<|endoftext|>", "a <|endoftext|>b c", "日本語 テキスト", "é \x1c \xa0 　 z", "🙂 🙂", "tab\tsep"]


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_small_texts_as_the_library():
    c, t = bpe.Codec(PATH), library()
    for x, ids in zip(TEXTS, c.encode_batch(TEXTS), strict=True):
        want = t.encode(x or "", add_special_tokens=False).ids
        assert ids.tolist() == want
        assert c.decode(ids).decode() == t.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("kind", ["letters", "hex", "runs", "one", "mixed"])
def test_tree_concatenation_is_exact(kind):
    rng, c, t = random.Random(kind), bpe.Codec(PATH), library()
    for n in (600, 1023, 5000, 40_000):
        text = {
            "letters": lambda n=n: "".join(rng.choices("etaoinshrdlu", k=n)),
            "hex": lambda n=n: "".join(rng.choices("0123456789abcdef", k=n)),
            "runs": lambda n=n: "".join(rng.choice("abc") * rng.randint(1, 90) for _ in range(n // 40)),
            "one": lambda n=n: "a" * n,
            "mixed": lambda n=n: "".join(rng.choices(["the", "ing", "日本", "é", "zz", "qx", "ation"], k=n // 3)),
        }[kind]()
        for x in (text, f"go {text} on", f"{text}<|endoftext|>{text[:700]}"):
            assert c.encode_batch([x])[0].tolist() == t.encode(x, add_special_tokens=False).ids


def test_words_and_punctuation_as_the_library():
    rng, c, t = random.Random(5), bpe.Codec(PATH), library()
    words = ["the", "Élan", "Straße", "слово", "λόγος", "don't", "it's", "'s", "x1", "12", "ªº", "ſ", "日本", "ԱԲ", "e\u0301", "<|endoftext|>", "_", "a_b", "", "naïve"]
    tails = ["", ".", ",", "...", "'", "')", '"', "!?", "_", "***", "…", "\n", ".\n", "\n\n", "\t", "'ll", "\r\n"]
    texts = ["".join(rng.choice(words) + rng.choice(tails) + rng.choice(["", " ", " ", "\n", "  "]) for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    got = [x.tolist() for k in range(0, 3000, 500) for x in c.encode_batch(texts[k : k + 500])]
    assert got == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_documents_as_the_library(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    c, t = bpe.Codec(PATH), library()
    assert [x.tolist() for x in c.encode_batch(texts)] == [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_long_runs_on_spark_go_through_the_tree(spark):
    rng, t = random.Random(8), library()
    runs = ["".join(rng.choices("etaoinshrdlu", k=n)) for n in (513, 3000, 20_000)] + ["-" * 2000, "日本語の文" * 400, "7" * 1500]
    rows = [(i, x, None) for i, x in enumerate([*runs, *(f"before {r} after it" for r in runs), " ".join(runs)])]
    c, calls = bpe.Codec(PATH), []
    tree, c.tree = c.tree, lambda x: calls.append(len(x)) or tree(x)
    c.encode_batch([x for _, x, _ in rows])
    assert sum(n > bpe.LONG for n in calls) >= 12
    got = {r.doc_id: r.ids_sha256 for r in bpe.encode_digests(spark.createDataFrame(rows, "doc_id bigint, text string, id string")).collect()}
    assert got == {i: hashlib.sha256(",".join(map(str, t.encode(x, add_special_tokens=False).ids)).encode()).hexdigest() for i, x, _ in rows}


def test_bytes_that_are_no_text():
    c, t = bpe.Codec(PATH), library()
    ids = t.encode("日本語🙂", add_special_tokens=False).ids
    for cut in range(len(ids)):
        assert c.decode(np.array(ids[cut:], np.uint32)).decode() == t.decode(ids[cut:], skip_special_tokens=False)


def test_digests(spark):
    t = library()
    rows = [(i, x, 1) for i, x in enumerate(TEXTS)] + [(None, "no id", 2), (3, TEXTS[3], 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_digests(docs).collect()}
    want = set()
    for i, x, _ in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.add((i, len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
    assert got == want
    full = bpe.encode_decode(docs).collect()
    assert len(full) == len(rows) and {r.decoded for r in full} == {x or "" for _, x, _ in rows}
    assert bpe.encode_digests(docs.limit(0)).collect() == []


@pytest.mark.parametrize("leaf", [1, 2, 5, 16, 61])
def test_trees_over_whole_texts_are_exact(monkeypatch, leaf):
    """Cut anywhere: in words, contractions, white space, digits, characters' neighbours and added tokens."""
    monkeypatch.setattr(bpe, "LONG_TEXT", leaf)
    monkeypatch.setattr(bpe, "LEAF_TEXT", leaf)
    rng, c, t = random.Random(leaf), bpe.Codec(PATH), library()
    words = ["the", "Élan", "слово", "λόγος", "don't", "it's", "we'll", "12345", "日本語の文字", "🙂🙃", "e\u0301", "<|endoftext|>", "a_b", "", "x" * 40]
    gaps = [" ", " ", " ", "  ", "\n", " \n\n ", "\t", "\xa0", "\u3000", "", ". ", ", "]
    texts = ["".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randint(1, 60))) for _ in range(150)] + ["a" * 700, " " * 333, "\n \n" * 99]
    for x, ids in zip(texts, c.encode_batch(texts), strict=True):
        assert ids.tolist() == t.encode(x, add_special_tokens=False).ids
    assert c.joins > 150


def test_long_documents_of_the_table_go_through_trees(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect() if r.text and len(r.text) > bpe.LONG_TEXT]
    c, t = bpe.Codec(PATH), library()
    got = c.encode_batch(texts)
    assert texts and c.joins >= sum(len(x) // bpe.LEAF_TEXT - 1 for x in texts) >= len(texts)
    assert [x.tolist() for x in got] == [t.encode(x, add_special_tokens=False).ids for x in texts]
