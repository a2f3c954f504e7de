"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

1. language_id drops documents without a letter and those whose n-grams no learned language contains.
2. ngram_jaccard_join keeps one document, the smallest doc_id, of each group of near copies.
3. substring_dedup cuts lines and passages that occurred before.
4. benchmark_decontamination drops documents that hold a window of a benchmark item.
5. best_fit_packing packs what is left into sequences of 2048 tokens.

Every stage works on whatever table it gets and decides on that table alone. All but the last return the columns of
documents. Defined results of odd rows: a null or blank text is dropped by stage 1; rows with a null doc_id are kept
and left unchanged by stages 2 and 3; of rows that repeat a doc_id, stage 2 keeps one for each distinct row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colframe.llm import decontam, jaccard_join, langid, packing, paragraphs
from colframe.llm.bpe import vocabulary
from colframe.llm.common import Scratch, fold
from colframe.llm.linking import BOUND

#: Share of a text's trigrams that its language must contain; prose has 0.5 and more, other matter next to none.
LEAST_COVERAGE = 0.25


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is in gone, whose ids are broadcast only up to a number."""
    few = gone.count() <= BOUND
    return docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known."""
    model = langid.train(spark, docs.where(F.coalesce(fold("doc_id", 4) != 2, F.lit(False))))
    out = langid.identify(spark, docs, model)
    return out.where((F.col("lang_pred") != "und") & (F.col("coverage") >= LEAST_COVERAGE)).select(*docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more)."""
    groups = jaccard_join.join(spark, docs, k=5, share=(4, 5))
    gone = groups.where("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("first")).where("first <> doc_id").select("doc_id")
    out = without(docs, Scratch(spark, "copies").save(gone))
    twice = Scratch(spark, "repeated").save(groups.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if not twice.limit(1).count():
        return out
    return without(out, twice).unionByName(out.join(twice, "doc_id", "left_semi").select(*docs.columns).distinct())


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the paragraphs and passages that an earlier document, or an earlier place, holds."""
    found = Scratch(spark, "cuts").save(paragraphs.duplicates(spark, docs))
    return paragraphs.remove(spark, docs, found)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    marked = decontam.decontaminate(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = marked.where("contaminated and doc_id is not null").select("doc_id").distinct()
    return without(docs, Scratch(spark, "leaks").save(gone))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequence and offset."""
    return packing.pack(spark, docs, vocabulary(), end_id=0, capacity=2048)


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can't express training, MinHash or byte-pair encoding; tests/llm/test_pipeline.py checks the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents."""
    scratch, out = Scratch(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        out = scratch.save(stage(spark, out, sf_dir))
    return STAGES[-1][1](spark, out, sf_dir)
