import zlib

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from trajspark.llm import bpe, token_files


@pytest.mark.parametrize("n,top", [(0, 0), (1, 0), (1, 10**6), (5, 3), (1000, 40), (3000, 10**7), (700, 700)])
def test_elias_fano_round_trip(n, top):
    values = np.sort(np.random.default_rng(n).integers(0, top + 1, n))
    ef = token_files.EliasFano.of(values)
    assert ef.select_many(np.arange(n)).tolist() == values.tolist() and ef.select_many(np.arange(0, n, 7)).tolist() == values[::7].tolist()
    assert [ef.select(i) for i in range(n)] == values.tolist()
    with pytest.raises(IndexError):
        ef.select(n)


def test_space_is_near_minimal():
    ends = np.cumsum(np.random.default_rng(0).integers(1, 800, 5000))
    ef = token_files.EliasFano.of(ends)
    bits = 8 * (len(ef.low) + len(ef.high) + len(ef.samples)) / 5000
    assert bits <= 2.2 + np.log2(ends[-1] / 5000)


def brute(rows):
    from tokenizers import Tokenizer

    t, at, out = Tokenizer.from_file(bpe.default_path()), 0, []
    encoded = [(i, [*t.encode(x or "", add_special_tokens=False).ids, 0]) for i, x in rows]
    for i, ids in sorted(encoded, key=lambda r: (r[0] is not None, r[0] or 0, xxh64_intdigest(np.array(r[1], "<u2").tobytes()))):
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("segment_ids", [1, 64, 1 << 20])
def test_files_read_back(spark, tmp_path, segment_ids):
    rows = [(i * 7 % 50, f"text number {i} " * (i % 9)) for i in range(50)] + [(None, "no id"), (60, None), (61, ""), (61, "same id"), (62, "x" * 5000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, start int")
    out = str(tmp_path / "ids")
    token_files.write_token_ids(docs, out, segment_ids=segment_ids)
    got = [tuple(r) for r in token_files.read_token_ids(spark, out).orderBy("start").collect()]
    assert got == brute(rows)


def test_no_documents(spark):
    assert token_files.token_file_digests(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


@pytest.mark.parametrize("hot", [None, 5])
def test_an_id_with_most_rows_is_dealt_to_several_parts(spark, tmp_path, hot):
    rows = [(hot, f"number {i}") for i in range(300)] + [(i, f"other {i}") for i in range(40)]
    docs, out = spark.createDataFrame(rows, "doc_id bigint, text string"), str(tmp_path / "ids")
    token_files.write_token_ids(docs, out)
    assert [tuple(r) for r in token_files.read_token_ids(spark, out).orderBy("start").collect()] == brute(rows)
    sizes = [len(r.doc_ids) for r in spark.read.parquet(out).select("doc_ids").collect()]
    assert len(sizes) == 8 and max(sizes) < 100
