"""Tokenizers and vectorizers. Per-word work runs once per distinct word and is joined back to the occurrences."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colframe.operators.ordered import numbered
from colframe.shipping import ship
from colframe.sources.scratch import Scratch

UNKNOWN = "[UNK]"


def whitespace_tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def word_tokens(text: Column) -> Column:
    """Lower-cased runs of two letters, digits or underscores and more."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]{2,})"), 1)


def vocabulary(words: DataFrame, first: int = 0) -> DataFrame:
    """(word, id) of the distinct words in sorted order, ids from ``first``, numbered inside range partitions."""
    return numbered(words.select("word").distinct(), "word", "id", first).select("word", "id")


def occurrences(df: DataFrame, key: str, tokens: Column) -> DataFrame:
    """(key, pos, word) of all tokens."""
    return df.select(key, F.posexplode(tokens).alias("pos", "word"))


def collect_ids(found: DataFrame, key: str) -> DataFrame:
    """Ordered ids and tokens of each text."""
    rows = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "_id", "word"))).alias("r"))
    return rows.select(key, F.transform("r", lambda x: x["_id"]).alias("ids"), F.transform("r", lambda x: x["word"]).alias("tokens"))


class WhitespaceTokenizer:
    """Sorted vocabulary of white-space tokens from id 1; id 0 is unknown."""

    def fit(self, df: DataFrame, text: str) -> WhitespaceTokenizer:
        self.vocab = vocabulary(df.select(F.explode(whitespace_tokens(F.col(text))).alias("word")), 1)
        return self

    def encode(self, df: DataFrame, key: str, text: str) -> DataFrame:
        found = occurrences(df, key, whitespace_tokens(F.col(text))).join(self.vocab.toDF("word", "_id"), "word", "left")
        return collect_ids(found.withColumn("_id", F.coalesce("_id", F.lit(0))), key)

    def decode(self, df: DataFrame, key: str, ids: str) -> DataFrame:
        rows = df.select(key, F.posexplode(ids).alias("pos", "_id")).join(self.vocab.toDF("word", "_id"), "_id", "left").withColumn("word", F.coalesce("word", F.lit(UNKNOWN)))
        return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("text"))


class MergeTokenizer:
    """Byte-pair encoding from an ordered list of merges: each merge, in order, joins adjacent pairs left to right.

    Ids: unknown 0, then the parts and the whole of each merge as they first occur.
    """

    def __init__(self, merges: list[tuple[str, str]]):
        self.merges, self.ids = merges, {UNKNOWN: 0}
        for a, b in merges:
            for t in (a, b, a + b):
                self.ids.setdefault(t, len(self.ids))

    def pieces(self, word: str) -> list[str]:
        parts = list(word)
        for a, b in self.merges:
            out: list[str] = []
            i = 0
            while i < len(parts):
                if i + 1 < len(parts) and parts[i] == a and parts[i + 1] == b:
                    out.append(a + b)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def decode(self, ids: Column) -> Column:
        names = F.array(*map(F.lit, self.ids))
        return F.array_join(F.transform(ids, lambda i: F.coalesce(F.get(names, i), F.lit(UNKNOWN))), "")


class WordPieceTokenizer:
    """Greedy longest match from a vocabulary whose continuations begin with ##; long or failing words are unknown."""

    def __init__(self, tokens: list[str], longest: int = 100):
        self.ids, self.longest = {}, longest
        for t in [UNKNOWN, *tokens]:
            self.ids.setdefault(t, len(self.ids))

    def pieces(self, word: str) -> list[str]:
        if len(word) > self.longest:
            return [UNKNOWN]
        out, at = [], 0
        while at < len(word):
            for end in range(len(word), at, -1):
                piece = ("##" if at else "") + word[at:end]
                if piece in self.ids:
                    out.append(piece)
                    at = end
                    break
            else:
                return [UNKNOWN]
        return out

    def decode(self, tokens: Column) -> Column:
        return F.ltrim(F.regexp_replace(F.array_join(tokens, " "), " ##", ""))


def encode_words(df: DataFrame, key: str, text: str, tokenizer) -> DataFrame:
    """Ids and tokens of each text; a word's pieces are computed once for each distinct word."""
    ship(df.sparkSession)

    @F.pandas_udf("array<struct<id:int,piece:string>>")
    def split(words: pd.Series) -> pd.Series:
        return words.map(lambda w: [{"id": tokenizer.ids.get(p, 0), "piece": p if p in tokenizer.ids else UNKNOWN} for p in tokenizer.pieces(w)])

    found = occurrences(df, key, whitespace_tokens(F.col(text)))
    known = found.select("word").distinct().withColumn("pieces", split("word"))
    rows = found.join(known, "word").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "pieces"))).alias("r"))
    flat = F.flatten(F.transform("r", lambda x: x["pieces"]))
    return rows.select(key, F.transform(flat, lambda p: p["id"]).alias("ids"), F.transform(flat, lambda p: p["piece"]).alias("tokens"))


def murmur3(words: np.ndarray | list[str], seed: int = 0) -> np.ndarray:
    """MurmurHash3 x86_32 of UTF-8 words as signed integers, vectorised over words by their 4-byte blocks."""
    raw = [w.encode() for w in words]
    n = np.array([len(r) for r in raw], np.uint32)
    width = (int(n.max(initial=0)) + 3) // 4 * 4 or 4
    block = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in raw), "<u4").reshape(len(raw), -1) if raw else np.zeros((0, 1), np.uint32)
    c1, c2 = np.uint32(0xCC9E2D51), np.uint32(0x1B873593)

    def rotate(x, r):
        return (x << np.uint32(r)) | (x >> np.uint32(32 - r))

    with np.errstate(over="ignore"):
        h = np.full(len(raw), seed, np.uint32)
        for j in range(block.shape[1]):
            k = rotate(block[:, j] * c1, 15) * c2
            whole, part = n >= 4 * (j + 1), (n > 4 * j) & (n < 4 * (j + 1))
            h = np.where(whole, rotate(h ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64), np.where(part, h ^ k, h))
        h ^= n
        for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
            h = (h ^ (h >> np.uint32(shift))) * np.uint32(factor)
        return (h ^ (h >> np.uint32(16))).view(np.int32)


def count_vectors(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(counts (key, id, n), vocabulary (word, id)) of word tokens over the sorted vocabulary."""
    found = df.select(key, F.explode(word_tokens(F.col(text))).alias("word")).groupBy(key, "word").agg(F.count("*").alias("n"))
    found = Scratch(df.sparkSession, "words").save(found)
    vocab = vocabulary(found)
    return found.join(vocab, "word").select(key, "id", "n"), vocab


def hash_vectors(df: DataFrame, key: str, text: str, features: int = 1 << 20) -> DataFrame:
    """(key, feature, value): signed counts at |hash| mod features; each distinct word is hashed once."""
    if key in ("feature", "value"):
        raise ValueError(f"the key column may not be named {key}")
    ship(df.sparkSession)

    @F.pandas_udf("int")
    def hashed(words: pd.Series) -> pd.Series:
        return pd.Series(murmur3(words.tolist()))

    found = df.select(key, F.explode(word_tokens(F.col(text))).alias("_word")).groupBy(key, "_word").agg(F.count("*").alias("_n"))
    found = Scratch(df.sparkSession, "words").save(found)
    known = found.select("_word").distinct().withColumn("_h", hashed("_word"))
    h = F.col("_h").cast("bigint")
    sign = F.when(h >= 0, 1.0).otherwise(-1.0)
    return found.join(known, "_word").groupBy(key, (F.abs(h) % features).alias("feature")).agg(F.sum(F.col("_n") * sign).alias("value"))


def vocabulary_frame(spark: SparkSession, words: list[str], first: int = 0) -> DataFrame:
    """A given vocabulary as a relation."""
    return spark.createDataFrame([(w, i) for i, w in enumerate(words, first)], "word string, id long")
