"""Text classification queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import classify as C
from ..sources import adapters as A
from .registry import query
from .rules import RULES
from .views import VIEWS


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _norm_sql(text: str) -> str:
    src, dst, _ = tx.fold_tables(True)
    for a, b in tx.LIGATURES.items():
        text = f"replace({text}, {q(a)}, {q(b)})"
    return (f"regexp_replace(regexp_replace(lower(translate({text}, {q(src)}, {q(dst)})), "
            r"'[^a-z0-9()*+\-\\/.,;:_\s]', ' ', 'g'), '\s+', ' ', 'g')")


def _fold_sql(text: str) -> str:
    src, dst, _ = tx.fold_tables(False)
    return f"translate({text}, {q(src)}, {q(dst)})"


VIEWS["v_norm"] = ("", f"SELECT doc_id, lang, source, text, {_norm_sql('text')} AS norm FROM documents")
VIEWS["v_rules"] = ("", "SELECT * FROM (VALUES "
                    + ", ".join(f"({q(s)}, {q(p)}, {w})" for s, p, w in RULES) + ") r(slug, pattern, weight)")
VIEWS["v_scores"] = ("v_norm v_rules", """SELECT doc_id, slug,
    sum(weight * least(3, len(regexp_extract_all(norm, pattern))))::INT AS score
  FROM v_norm CROSS JOIN v_rules GROUP BY ALL HAVING score > 0""")
VIEWS["v_ranked"] = ("v_scores", """SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, slug) AS r,
    max(score) OVER (PARTITION BY doc_id) AS best FROM v_scores""")
VIEWS["v_classified"] = ("v_ranked", """SELECT doc_id,
    coalesce(string_agg(slug, '+' ORDER BY r) FILTER (best >= 3 AND r <= 3 AND score >= greatest(3, best * 0.6::DOUBLE)), '') AS topics,
    coalesce(string_agg(slug || '=' || score, ',' ORDER BY r), '') AS scores
  FROM documents LEFT JOIN v_ranked USING (doc_id) GROUP BY doc_id""")


def docs(spark, d):
    return A.spread(A.table(spark, d, "documents"))


def classified(spark, d):
    return C.classify(docs(spark, d), RULES)


@query("normalize_text", "v_norm", "SELECT doc_id, norm FROM v_norm")
def normalize_text(spark, d):
    return C.normalized(docs(spark, d)).select("doc_id", "norm")


def _usable_sql(text: str, norm: str) -> str:
    dense = f"regexp_replace(lower({_fold_sql(f'trim({text}, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))')}), '\\s', '', 'g')"
    stop = q(r"\b(?:" + "|".join(tx.STOPWORDS) + r")\b")
    blanks = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""CASE WHEN length(trim({text}, {blanks})) < 50 THEN FALSE WHEN length({dense}) = 0 THEN FALSE
      WHEN length(regexp_replace({dense}, '[^\\x20-\\x7e]', '', 'g')) / length({dense}) < 0.8::DOUBLE THEN FALSE
      WHEN length({dense}) < 250 THEN TRUE ELSE len(regexp_extract_all({norm}, {stop})) >= 2 END"""


@query("text_quality", "v_norm", f"SELECT doc_id, {_usable_sql('text', 'norm')} AS usable FROM v_norm")
def text_quality(spark, d):
    return C.usable(docs(spark, d), "text").select("doc_id", "usable")


# conversation turns as the text layer (many are short), their marked text as the fallback
VIEWS["v_turns"] = ("", f"""SELECT conv_id, turn, CASE WHEN ok THEN text ELSE 'ocr: ' || text END AS text,
    CASE WHEN ok THEN 'pdf' ELSE 'ocr' END AS source
  FROM (SELECT *, {_usable_sql('text', _norm_sql('text'))} AS ok FROM conversations)""")


def turns(spark, d):
    t = A.spread(A.table(spark, d, "conversations")).withColumnRenamed("text", "layer")
    return C.choose_text(t.withColumn("fallback", F.concat(F.lit("ocr: "), "layer")), "layer", "fallback").select(
        "conv_id", "turn", "text", "source"
    )


@query("text_source", "v_turns", "SELECT * FROM v_turns")
def text_source(spark, d):
    return turns(spark, d)


@query("source_counts", "v_turns", "SELECT source, count(*) AS n FROM v_turns GROUP BY source")
def source_counts(spark, d):
    return turns(spark, d).groupBy("source").agg(F.count("*").alias("n"))


@query("topic_scores", "v_scores", "SELECT * FROM v_scores")
def topic_scores(spark, d):
    return C.score_rows(docs(spark, d), RULES)


# a rule table as large as a real one, from the words of the benchmark: each word, and the beginnings of the longer ones
VIEWS["v_word_rules"] = ("", r"""SELECT 'w' || substr(w, 1, 1) AS slug, '\b' || w || '\b' AS pattern, 1 + length(w) % 3 AS weight, w AS must FROM (
    SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9]{3,}')) AS w FROM benchmark)
  UNION ALL SELECT DISTINCT 'p' || substr(w, 1, 1), '\b' || substr(w, 1, 5) || '\w{2,}', 1, substr(w, 1, 5) FROM (
    SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]{7,}')) AS w FROM benchmark)""")


def word_rules(spark, d):
    b = A.table(spark, d, "benchmark").select(F.lower("text").alias("t"))
    w = b.select(F.explode(F.regexp_extract_all("t", F.lit("[a-z0-9]{3,}"), F.lit(0))).alias("w")).distinct()
    whole = w.select(F.concat(F.lit("w"), F.substring("w", 1, 1)).alias("slug"), F.concat(F.lit(r"\b"), "w", F.lit(r"\b")).alias("pattern"),
                     (F.length("w") % 3 + 1).alias("weight"))
    long = b.select(F.explode(F.regexp_extract_all("t", F.lit("[a-z0-9]{7,}"), F.lit(0))).alias("w")).select(F.substring("w", 1, 5).alias("b")).distinct()
    begin = long.select(F.concat(F.lit("p"), F.substring("b", 1, 1)), F.concat(F.lit(r"\b"), "b", F.lit(r"\w{2,}")), F.lit(1))
    return whole.union(begin)


@query("topic_scores_indexed", "v_norm v_word_rules", """
SELECT doc_id, slug, sum(weight * least(3, len(regexp_extract_all(norm, pattern))))::INT AS score
FROM v_norm JOIN v_word_rules ON contains(norm, must) GROUP BY ALL HAVING score > 0""")
def topic_scores_indexed(spark, d):
    return C.score_indexed(docs(spark, d), word_rules(spark, d), ["doc_id"])


def _flat(df, *keep):
    scores = F.transform("scores", lambda s: F.concat(s["slug"], F.lit("="), s["score"].cast("string")))
    return df.select("doc_id", *keep, F.concat_ws("+", "topics").alias("topics"), F.concat_ws(",", scores).alias("scores"))


@query("classify_docs", "v_classified", "SELECT * FROM v_classified")
def classify_docs(spark, d):
    return _flat(classified(spark, d))


@query("classified_dump", "v_classified", """
SELECT doc_id, source, text, topics, scores FROM documents JOIN v_classified USING (doc_id)""")
def classified_dump(spark, d):
    return _flat(classified(spark, d), "source", "text")


@query("tag_bank", "v_classified", """
SELECT doc_id, quality, coalesce(topics, '') AS topics FROM labels LEFT JOIN (
  SELECT * FROM v_classified) USING (doc_id)""")
def tag_bank(spark, d):
    c = C.classify(docs(spark, d), RULES)
    bank = A.table(spark, d, "labels").select("doc_id", "quality")
    return C.tag_bank(bank, c, "doc_id").withColumn("topics", F.concat_ws("+", "topics"))


@query("text_orphans", "", "SELECT doc_id, source FROM documents ANTI JOIN labels USING (doc_id)")
def text_orphans(spark, d):
    return C.orphans(docs(spark, d).select("doc_id", "source"), A.table(spark, d, "labels"), "doc_id")


@query("topic_report_docs", "v_classified v_ranked v_rules", """
WITH t AS (SELECT doc_id, unnest(string_split(topics, '+')) AS slug, unnest(range(len(string_split(topics, '+')))) AS tpos
  FROM v_classified WHERE topics <> '')
SELECT r.slug, count(*) FILTER (tpos = 0) AS primary_count, count(t.slug) AS any_count,
  100 * count(*) FILTER (tpos = 0) / (SELECT count(*) FROM documents) AS pct
FROM (SELECT DISTINCT slug FROM v_rules) r LEFT JOIN t USING (slug) GROUP BY r.slug""")
def topic_report_docs(spark, d):
    rows = C.topic_rows(classified(spark, d))
    total = docs(spark, d).agg(F.count("*")).scalar()
    counts = rows.groupBy("slug").agg(F.count_if(F.col("tpos") == 0).alias("primary_count"), F.count("*").alias("any_count"))
    slugs = spark.createDataFrame([(r,) for r in sorted({slug for slug, _, _ in RULES})], "slug string")
    counts = slugs.join(counts, "slug", "left").fillna(0, ["primary_count", "any_count"])
    return counts.withColumn("pct", 100 * F.col("primary_count") / total)
