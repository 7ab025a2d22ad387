"""The registered queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, convtrie, decontam, licenses, linededup, lm, mixing, ngramjoin, packing, quality, sharding, urlfilter, whiten
from .common import remainder
from .templates import TEMPLATES

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.layout(table(spark, sf_dir, "documents"), ["doc_id"], "text", 40)


#: Shards by digests as above; crc32 byte by byte from its table; slots follow the table's order.
SQL["op1_sharding"] = r"""
WITH RECURSIVE step(n, v, k) AS (
  SELECT n, n::BIGINT, 0 FROM range(256) t(n)
  UNION ALL
  SELECT n, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM step WHERE k < 8),
crc AS (SELECT list(v ORDER BY n) AS t FROM step WHERE k = 8),
costs AS (
  SELECT doc_id, s, -ln((CAST('0x' || substr(md5(coalesce('=' || doc_id::VARCHAR, '~') || '#' || s::VARCHAR), 1, 13)
                              AS BIGINT) + 0.5) / 4503599627370496.0) AS cost
  FROM documents, range(41) r(s)),
best AS (
  SELECT doc_id, arg_min(s, (cost, s)) FILTER (WHERE s < 40) AS shard, arg_min(s, (cost, s)) AS grown_shard
  FROM costs GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) + 16 AS size,
       CASE WHEN d.text IS NOT NULL THEN xor(4294967295, list_reduce(
         list_prepend(4294967295::BIGINT, list_transform(range(n), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
         lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8))) END AS text_crc32,
       'key' AS law, b.shard::INT AS shard,
       row_number() OVER (PARTITION BY b.shard ORDER BY d.doc_id) - 1 AS slot, b.grown_shard::INT AS grown_shard
FROM (SELECT *, octet_length(encode(text)) AS n, hex(encode(text)) AS h FROM documents) d JOIN best b USING (doc_id), crc
"""


@query
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"), ["doc_id"], "source", "text")


#: The contract's rules: host, path, verdict.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


@query
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = spark.createDataFrame(urlfilter.labelled_rows(), "url string, blocked int")
    return urlfilter.judge(table(spark, sf_dir, "pages"), ["page_id"], "url", URL_RULES, labelled)


@query
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(
        table(spark, sf_dir, "documents"), ["doc_id"], "text", table(spark, sf_dir, "benchmark"), window=10
    )


@query
def op6_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 100 == 0)


@query
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, "doc_id", "text", table(spark, sf_dir, "labels"), "quality", remainder("doc_id", 3) != 1)
    return quality.score(docs, "text", model, keep=["doc_id"]).select(
        "doc_id",
        F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


@query
def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.report(table(spark, sf_dir, "documents"), "doc_id", "text", k=3, percent=90)


@query
def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = lm.score(docs, ["doc_id"], "text", remainder("doc_id", 5) != 1)
    return got.withColumn("held_out", F.coalesce(remainder("doc_id", 5) == 1, F.lit(False)))


@query
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(table(spark, sf_dir, "documents"), ["doc_id"], "text", TEMPLATES)


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(table(spark, sf_dir, "documents"), "doc_id", "text")


@query
def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convtrie.report(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")


#: Prefixes as lists of turn digests; crc32 byte by byte from its table; subtree sums by meeting every ancestor.
SQL["op11_conversation_trie"] = r"""
WITH RECURSIVE step(n, v, k) AS (
  SELECT n, n::BIGINT, 0 FROM range(256) t(n)
  UNION ALL
  SELECT n, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM step WHERE k < 8),
crc AS (SELECT list(v ORDER BY n) AS t FROM step WHERE k = 8),
turns AS (
  SELECT conv_id AS c, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
named AS (
  SELECT c, turn, md5(length(r)::VARCHAR || ':' || r || x) AS t, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS w FROM turns),
own AS (SELECT c, list({'t': t, 'w': w} ORDER BY turn NULLS FIRST, t) AS s FROM named GROUP BY c),
h AS (
  SELECT c, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(length(c::VARCHAR)), lambda i: ascii(substr(c::VARCHAR, i::INT + 1, 1))::BIGINT)),
    lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8))) % 4 AS h
  FROM own, crc),
seq AS (
  SELECT o.c, list_concat(coalesce(b.s, [])[1:h.h], o.s[h.h + 1:]) AS s
  FROM own o JOIN h USING (c) LEFT JOIN own b ON b.c = o.c - o.c % 20),
path AS (
  SELECT c, len(s) AS m, d, list_transform(s[1:d], lambda x: x.t) AS k, CASE WHEN d > 0 THEN s[d].w ELSE 0 END AS w
  FROM (SELECT *, unnest(range(len(s) + 1)) AS d FROM seq)),
node AS (
  SELECT k, d, min(c) AS conv_id, count(*) AS n, max(w) AS w,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE m = d), '')) AS ends
  FROM path GROUP BY k, d),
child AS (SELECT k[1:d - 1] AS k, count(*) AS n FROM node WHERE d > 0 GROUP BY 1),
full_node AS (SELECT node.*, coalesce(child.n, 0) AS kids FROM node LEFT JOIN child USING (k)),
below AS (
  SELECT k[1:a] AS k, sum(CASE WHEN kids = 0 THEN 1 ELSE 0 END) AS leaves, sum((n - 1) * w) AS saved
  FROM (SELECT *, unnest(range(d + 1)) AS a FROM full_node) GROUP BY 1)
SELECT f.conv_id, f.d::BIGINT AS depth, p.conv_id AS parent_conv_id, f.n::BIGINT AS n_convs, f.kids::BIGINT AS n_children,
       leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, f.ends AS ends_sha256
FROM full_node f JOIN below USING (k) LEFT JOIN node p ON f.d > 0 AND p.k = f.k[1:f.d - 1]
"""


@query
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.report(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


#: The vocabulary file of the packing query.
TOKENIZER = "byte_bpe_50k.json"


@query
def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.report(table(spark, sf_dir, "documents"), ["doc_id"], "text", public_tokenizers.path(TOKENIZER))
