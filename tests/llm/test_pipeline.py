import hashlib

import corpus_pipeline
from trajspark.llm import bpe, pii_surrogates
from test_decontaminate import brute as brute_contamination
from test_quality_rules import brute as brute_counts
from test_simhash import brute_fingerprint, brute_groups

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    columns, before = docs.columns, docs.collect()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, spark.createDataFrame(before, docs.schema), SF)
        assert out.columns == columns
        after = out.collect()
        kept, ids = {r.doc_id: r for r in after}, {r.doc_id: r for r in before}
        assert len(kept) == len(after) > 0 and kept.keys() <= ids.keys()
        if name == "quality rules":
            for i, r in ids.items():
                n, _, _, _, repeats = brute_counts(r.text)
                if n < 50 or 100 * repeats > 50 * n:
                    assert i not in kept
                elif labels.get(i) == 1:
                    assert i in kept
                elif labels.get(i) == 0:
                    assert i not in kept
        elif name == "near dedup":
            groups = brute_groups([(i, brute_fingerprint(r.text)) for i, r in ids.items()])
            assert kept.keys() == set(groups.values())
        elif name == "decontamination":
            bad = {r[0] for r in brute_contamination([(i, r.text) for i, r in ids.items()], items) if r[-1]}
            assert kept.keys() == ids.keys() - bad
        else:
            assert kept.keys() == ids.keys()
            for i, r in ids.items():
                found = pii_surrogates.entities(r.text)
                if not found:
                    assert kept[i] == r
                assert not any(r.text[b:e] in kept[i].text for b, e, _ in found)
        before = after
    t = Tokenizer.from_file(bpe.default_path())
    want = {(r.doc_id, hashlib.sha256(",".join(map(str, t.encode(r.text, add_special_tokens=False).ids)).encode()).hexdigest()) for r in before}
    assert {(r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, SF).collect()} == want


def test_no_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.collect() == []
