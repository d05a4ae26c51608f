from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from trajspark.llm import shard_mixture
from trajspark.llm.common import row_digest


def make(spark, n=1200):
    rows = [(i, None if i % 17 == 0 else "hot" if i % 3 else f"s{i % 5}", i) for i in range(n)]
    return spark.createDataFrame([*rows, (None, "hot", -1), (5, "hot", 5), (5, "hot", 5)], "doc_id bigint, source string, slot bigint")


@pytest.mark.parametrize("shards", [1, 7, 8])
def test_as_a_sort_by_fractional_rank(spark, shards):
    docs = make(spark)
    got = shard_mixture.shard_documents(docs, shards, seed=3)
    assert sorted(got.columns) == ["doc_id", "shard", "slot", "source"]
    hashed = [(r[0], r[1], r[2]) for r in docs.select("doc_id", "source", row_digest(docs.drop("slot"), 3)).collect()]
    ranked = []
    for s in {r[1] for r in hashed}:
        own = sorted((h, i is not None, i or 0) for i, t, h in hashed if t == s)
        ranked += [(Fraction(2 * k + 1, 2 * len(own)), "n" if s is None else "s" + s, k, i if some else None) for k, (_, some, i) in enumerate(own)]
    want, n = {}, len(ranked)
    for g, (_, _, _, i) in enumerate(sorted(ranked, key=lambda r: r[:3])):
        shard = g * shards // n
        want.setdefault(i, []).append((shard, g - -(-shard * n // shards)))
    found = {}
    for r in got.collect():
        found.setdefault(r.doc_id, []).append((r.shard, r.slot))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}


def test_counts_slots_and_mixture(spark):
    docs = make(spark)
    rows = shard_mixture.shard_documents(docs).collect()
    by = Counter(r.shard for r in rows)
    assert len(rows) == docs.count() and set(by) == set(range(8)) and max(by.values()) - min(by.values()) <= 1
    for s in by:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(by[s]))
    for source, n in Counter(r.source for r in rows).items():
        for s in by:
            assert abs(sum(r.source == source and r.shard == s for r in rows) - n / 8) <= 6  # the number of strata


def test_fewer_rows_than_shards_and_none(spark):
    docs = make(spark).where("doc_id in (1, 2, 3)")
    assert sorted(r.slot for r in shard_mixture.shard_documents(docs).collect()) == [0, 0, 0]
    assert shard_mixture.shard_documents(docs.limit(0)).collect() == []


def test_written_shards(spark, tmp_path):
    out = shard_mixture.shard_documents(make(spark), 4)
    shard_mixture.write_shards(out, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == out.count() and back.select("shard").distinct().count() == 4


def test_repeated_and_null_ids_clashing_names_and_any_number_of_buckets(spark):
    columns = ["s", "h", "b", "c", "r", "n", "g", "row", "total", "start"]
    rows = [(None if i % 3 else 7, "hot", i, {"k": i}, *map(str, range(len(columns)))) for i in range(400)] + [(7, None, 1, None, *columns)] * 3
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, v int, m map<string, int>, " + ", ".join(f"`{c}` string" for c in columns))
    found = [shard_mixture.shard_documents(docs, 3, bucket_bits=k).select("v", "source", "shard", "slot") for k in (0, 3, 9)]
    first, *rest = [sorted(map(tuple, f.collect()), key=str) for f in found]
    assert rest == [first, first] and len(first) == 403
    assert shard_mixture.shard_documents(docs).columns == [*docs.columns, "shard", "slot"]


def test_ten_thousand_sources(spark):
    docs = spark.range(30_000).selectExpr("id AS doc_id", "cast(pow(id, 1.7) AS bigint) % 10000 AS source")
    got = shard_mixture.shard_documents(docs, 8, bucket_bits=14)
    rows = got.collect()
    sizes = [sum(r.shard == k for r in rows) for k in range(8)]
    assert len(rows) == 30_000 and max(sizes) - min(sizes) <= 1
    assert all(sorted(r.slot for r in rows if r.shard == k) == list(range(sizes[k])) for k in range(8))
    assert "sequence" not in got._jdf.queryExecution().optimizedPlan().toString()
