"""One query for each operator, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajspark.llm import bpe, decontaminate, html_extract, lm_scoring, pii_surrogates, quality_classifier, quality_rules, resampling, shard_mixture, signature_join, simhash_dedup, token_files, whitening
from trajspark.llm.common import table


#: The key for the surrogates of the given tables, whose persons are invented. Real corpora need a secret one.
PII_KEY = b"a key for invented persons"


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.simhash_groups(table(spark, sf_dir, "documents"))


def op2_shard_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    slim = table(spark, sf_dir, "documents").select(
        "doc_id", "source", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    return shard_mixture.shard_documents(slim).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source"
    )


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op5_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_digests(table(spark, sf_dir, "documents"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lm_scoring.score_documents(docs, lm_scoring.train(docs))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality_classifier.score_documents(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality_classifier.held_out("doc_id").alias("held_out"), "score", "predicted")


def op8_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii_surrogates.replace_pii(docs, PII_KEY, kinds_col="kinds")
    return found.select("doc_id", "text", F.size("kinds").cast("long").alias("n_entities"), F.array_join(F.array_sort(F.array_distinct("kinds")), ",").alias("kinds"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    found = whitening.whiten(vectors, whitening.fit(vectors), "vec_id")
    return found.withColumn("deviation", F.col("deviation").try_cast("bigint"))  # null where a long cannot hold it


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.importance_ranks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signature_join.jaccard_components(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_shard_mixture": op2_shard_mixture,
    "op3_html_extraction": op3_html_extraction,
    "op4_decontamination": op4_decontamination,
    "op5_token_id_output": op5_token_id_output,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_bpe_encode_decode": op8_bpe_encode_decode,
    "op9_quality_rules": op9_quality_rules,
    "op10_pii_surrogates": op10_pii_surrogates,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_ngram_jaccard_join": op13_ngram_jaccard_join,
}

_WORDS = """list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"""

OP4_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, len, array_to_string(w[i:i + len - 1], ' ') AS win FROM (
    SELECT item_id, w, least(len(w), 10) AS len, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len FROM bw),
dw AS (SELECT row_id, i, len, array_to_string(w[i:i + len - 1], ' ') AS win FROM (
    SELECT row_id, w, lens.len AS len, unnest(range(1, len(w) - lens.len + 2)) AS i FROM d, lens WHERE len(w) >= lens.len)),
hits AS (SELECT dw.row_id, dw.i, dw.len, bw.item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.len = bw.len),
hw AS (SELECT row_id, count(DISTINCT p) AS n_hit FROM (SELECT row_id, unnest(range(i, i + len)) AS p FROM hits) GROUP BY row_id),
it AS (SELECT row_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT row_id, item_id::VARCHAR AS item FROM hits) GROUP BY row_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (row_id) LEFT JOIN it USING (row_id)
"""

#: CRC-32 byte by byte; its table is the polynomial applied eight times to each byte.
_CRC_STEP = "CASE WHEN {0} & 1 = 1 THEN xor(3988292384::BIGINT, {0} >> 1) ELSE {0} >> 1 END"
_BYTES = "list_transform(range(0, octet_length(encode(x))), lambda i: ('0x' || substr(hex(encode(x)), 2 * i + 1, 2))::BIGINT)"
OP2_SQL = f"""
WITH RECURSIVE step(i, k, c) AS (SELECT i, 0, i FROM (SELECT unnest(range(256)) AS i) UNION ALL SELECT i, k + 1, {_CRC_STEP.format("c")} FROM step WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8),
texts AS (SELECT DISTINCT coalesce(text, '') AS x FROM documents),
sums AS (SELECT x, xor(list_reduce(list_prepend(4294967295::BIGINT, {_BYTES}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) AS text_crc32 FROM texts, crc),
d AS (SELECT doc_id, source, octet_length(encode(x)) + 1 AS size, text_crc32 FROM documents JOIN sums ON coalesce(text, '') = x),
h AS (SELECT *, coalesce('s' || source, 'n') AS s, md5(concat_ws(chr(31), '20', coalesce(doc_id::VARCHAR, '\\N'), coalesce(source, '\\N'), size::VARCHAR, text_crc32::VARCHAR)) AS h FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY h) AS r, count(*) OVER (PARTITION BY s) AS n FROM h),
g AS (SELECT *, row_number() OVER (ORDER BY (2 * r - 1)::DOUBLE / n, s, r) - 1 AS g, count(*) OVER () AS total FROM r),
p AS (SELECT *, (g * 8 // total)::INTEGER AS shard FROM g)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, shard, (g - (shard * total + 7) // 8)::BIGINT AS slot, NULL::INTEGER AS grown_shard, source FROM p
"""

OP12_SQL = f"""
WITH RECURSIVE step(i, k, c) AS (SELECT i, 0, i FROM (SELECT unnest(range(256)) AS i) UNION ALL SELECT i, k + 1, {_CRC_STEP.format("c")} FROM step WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8),
d AS (SELECT row_number() OVER () AS row_id, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT row_number() OVER () AS row_id, {_WORDS} AS w FROM benchmark),
f AS (SELECT TRUE AS own, row_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS x FROM d
    UNION ALL SELECT FALSE, row_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) FROM b),
fx AS (SELECT DISTINCT x FROM f),
fb AS (SELECT x, xor(list_reduce(list_prepend(4294967295::BIGINT, {_BYTES}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % 10000 AS bucket FROM fx, crc),
n AS (SELECT bucket, count(*) FILTER (own) AS s, count(*) FILTER (NOT own) AS t FROM f JOIN fb USING (x) GROUP BY bucket),
a AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM n),
g AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000)::DOUBLE / ((s + 1)::DOUBLE * (t_all + 10000)::DOUBLE)))::BIGINT AS gain FROM n, a),
w AS (SELECT row_id, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM f JOIN fb USING (x) JOIN g USING (bucket) WHERE own GROUP BY row_id),
e AS (SELECT row_id, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    ('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN w USING (row_id)),
sc AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM e),
r AS (SELECT row_id, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS r, count(*) OVER () AS n FROM sc WHERE n_words >= 20)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN r <= 25 * n // 100 THEN r END AS rank FROM sc LEFT JOIN r USING (row_id)
"""

_SHINGLE_WORDS = """list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"""
#: Components by the smallest id of each row's neighbours, again and again; one row stands for each set.
OP13_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_SHINGLE_WORDS} AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE
    list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END)) AS s FROM d WHERE len(w) > 0),
c AS (SELECT s, min(doc_id) AS c, len(s) AS n FROM s GROUP BY s),
t AS (SELECT c, n, unnest(s) AS x FROM c),
o AS (SELECT a.c AS a, b.c AS b, a.n AS na, b.n AS nb, count(*) AS o FROM t a JOIN t b ON a.x = b.x AND a.c < b.c GROUP BY ALL),
l AS (SELECT a, b FROM o WHERE 100 * o >= 85 * (na + nb - o)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT c, c FROM c UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a AS c, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(c.n, 0)::BIGINT AS n_shingles, coalesce(m.component_id, d.doc_id) AS component_id
FROM d LEFT JOIN s USING (doc_id) LEFT JOIN c ON s.s = c.s LEFT JOIN m ON m.c = c.c
"""

ORACLES: dict[str, str] = {"op2_shard_mixture": OP2_SQL, "op4_decontamination": OP4_SQL, "op12_importance_resampling": OP12_SQL, "op13_ngram_jaccard_join": OP13_SQL}
