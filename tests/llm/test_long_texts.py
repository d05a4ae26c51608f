"""Very long texts pass whole through operators that have no test of their own for them."""

import numpy as np
import zlib

from trajspark.llm import bpe, quality_classifier, token_files


def test_token_files(spark):
    from tokenizers import Tokenizer

    long = " ".join(f"word{i % 977} and" for i in range(250_000))
    docs = spark.createDataFrame([(2, long), (1, "short"), (3, long[:-9])], "doc_id bigint, text string")
    got = {r.doc_id: r for r in token_files.token_file_digests(docs).collect()}
    library, start = Tokenizer.from_file(bpe.default_path()), 0
    for i, text in ((1, "short"), (2, long), (3, long[:-9])):
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 0], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_classifier(spark):
    good, bad = "a calm and well made sentence of some length ", "buy now !!! $$$ click "
    docs = [(i, (good if i % 2 else bad) * (1 + i % 5)) for i in range(60)] + [(100, good * 60_000), (101, bad * 60_000), (102, "x" * 3_000_000)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, quality int")
    got = {r.doc_id: r.score for r in quality_classifier.score_documents(df, quality_classifier.fit(df, labels)).collect()}
    assert got[100] > 0.5 > got[101] and 0 <= got[102] <= 1
