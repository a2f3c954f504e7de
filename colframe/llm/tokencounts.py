"""Exact token counts: a histogram of encoded lengths whose suffix sums answer every context limit."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colframe.llm.bpe import encoder
from colframe.llm.common import Scratch, ship, slices

BLOCK = 1024


def lengths(docs: DataFrame, tokenizer: str) -> DataFrame:
    """n_tokens of each row's whole text (null or empty: 0)."""

    def count(batches):
        enc = encoder(tokenizer)
        for whole in batches:
            for batch in slices(whole, "text"):
                n = [len(enc.encode(t.as_py() or "")) // 4 for t in batch.column(0)]
                yield pa.RecordBatch.from_arrays([pa.array(np.array(n, np.int64))], ["n_tokens"])

    return docs.select("text").mapInArrow(count, "n_tokens long")


def length_table(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    """For each length L that occurs: what the corpus is at a context limit of L tokens.

    n_tokens L; n_docs of exactly that length; docs_at_most, docs_longer; total_tokens of the documents of at most L;
    truncated_total = sum of min(length, L) over all documents (the suffix sum: every longer document adds L);
    quantile = share of documents of at most L. A limit between two lengths L < M gives
    truncated_total(L) + (limit - L) * docs_longer(L), so the table answers all limits exactly.
    Repeated rows count each; null and empty texts have 0 tokens; an empty table gives no rows; columns other than
    text are not read. The corpus is encoded once, into a saved histogram. Sums run in blocks of lengths: window
    partitions stay small and only one row a block is summed globally.
    """
    ship(spark)
    h = Scratch(spark, "lengths").save(lengths(docs, tokenizer).groupBy("n_tokens").agg(F.count("*").alias("n_docs")))
    h = h.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("tokens").alias("bt"))
    upto, all_ = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0)
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("bd").over(upto), zero).alias("d0"),
        F.coalesce(F.sum("bt").over(upto), zero).alias("t0"),
        F.sum("bd").over(all_).alias("docs"),
    )
    w = Window.partitionBy("block").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    out = h.select("block", "n_tokens", "n_docs", F.sum("n_docs").over(w).alias("d"), F.sum("tokens").over(w).alias("t")).join(blocks, "block")
    d, t = F.col("d0") + F.col("d"), F.col("t0") + F.col("t")
    return out.select(
        "n_tokens",
        "n_docs",
        d.alias("docs_at_most"),
        (F.col("docs") - d).alias("docs_longer"),
        t.alias("total_tokens"),
        (t + F.col("n_tokens") * (F.col("docs") - d)).alias("truncated_total"),
        (d / F.col("docs")).alias("quantile"),
    )
