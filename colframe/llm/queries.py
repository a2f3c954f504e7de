"""The registered queries of the operators, each over its whole table, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colframe.llm import ann, classlm, decontam, jaccard_join, langid, licenses, packing, paragraphs, tokencounts, toxicity
from colframe.llm.bpe import vocabulary
from colframe.llm.common import fold, table


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(spark, table(spark, sf_dir, "documents"), k=4, share=(85, 100))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)))
    model = toxicity.train(spark, docs.where(~F.col("held_out")), table(spark, sf_dir, "labels").where(fold("doc_id", 3) != 1))
    scored = toxicity.score(spark, docs.select("doc_id", "held_out", "text"), model)
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"), "n_sentences", F.size("offending").cast("long").alias("n_offending"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(spark, table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10, k=5)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.duplicates(spark, table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)))
    model = langid.train(spark, docs.where(~F.col("held_out") & F.col("doc_id").isNotNull()))
    return langid.identify(spark, docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score", "coverage")


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(spark, vectors.where(F.col("vec_id") % 100 == 0), vectors, k=10)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, table(spark, sf_dir, "documents"), vocabulary(), end_id=0, capacity=2048)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.length_table(spark, table(spark, sf_dir, "documents"), vocabulary())


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(fold("doc_id", 10) == 0, F.lit(False)))
    return classlm.score(spark, docs)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ngram_jaccard_join, op2_toxicity, op3_license_scan, op4_decontamination, op5_substring_dedup, op6_language_id, op7_nearest_neighbours, op8_best_fit_packing, op9_token_counts, op10_lm_scoring)}


_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = f"list_filter(string_split_regex({_FOLD}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
_SOLID = f"list_filter(string_split_regex({_FOLD}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

OP1 = f"""
WITH RECURSIVE t AS (SELECT doc_id, {_SOLID} AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM t UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id)
SELECT t.doc_id, coalesce(n.n, 0)::bigint AS n_shingles, (SELECT min(c) FROM r WHERE r.doc_id = t.doc_id) AS component_id FROM t LEFT JOIN n USING (doc_id)
"""

OP4 = f"""
WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
i AS (SELECT item_id, w, least(len(w), 10) AS n FROM (SELECT item_id, {_ALNUM} AS w FROM benchmark) WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[s + 1:s + n], ' ') AS win FROM (SELECT *, unnest(range(0, len(w) - n + 1)) AS s FROM i)),
dw AS (SELECT doc_id, n, s, array_to_string(w[s + 1:s + n], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(0, greatest(len(w) - n + 1, 0))) AS s FROM d, (SELECT DISTINCT n FROM i))),
m AS (SELECT doc_id, n, s, item_id FROM dw JOIN iw USING (n, win)),
h AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS place FROM m) GROUP BY 1),
x AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(k, ',' ORDER BY k)) AS h FROM (SELECT DISTINCT doc_id, item_id::varchar AS k FROM m) GROUP BY 1)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items, coalesce(x.h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN x USING (doc_id)
"""

OP7 = """
WITH v AS (SELECT vec_id, embedding::double[] AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, t.vec_id, list_distance(q.x, t.x) AS score FROM v q, v t WHERE q.vec_id % 100 = 0 AND q.vec_id <> t.vec_id)
SELECT query_id, rank::int AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM p) WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard_join": OP1, "op4_decontamination": OP4, "op7_nearest_neighbours": OP7}
