"""Benchmark decontamination by winnowing, with DataFrame functions only.

Of the hashes of all k-word grams, the smallest of each run of w consecutive ones is a fingerprint. Two texts that
share k + w - 1 consecutive words share a fingerprint. Documents are joined with the benchmark on fingerprints, and
the hits are extended: in documents with a hit every word window is compared, as text, with the items' windows.
Windows of k + w - 1 = 10 words are thus all found. Items shorter than a window are windows of their own length; for
each such length w is 1, which keeps every gram.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colframe.llm.common import LOWER, UPPER, Scratch

#: Runs of characters that separate words, once A-Z are lower case.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows of benchmark fingerprints or windows, and of document keys, that may be broadcast.
BOUND = 400_000


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; an empty array for null."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(low, BREAK), "")


def _runs(array: str, n: int, f) -> Column:
    """f(entries i, i+1 .. i+n-1) for each run of n entries of the array column."""
    each = F.transform(F.col(array), lambda x, i: f(x, *[F.get(F.col(array), i + d) for d in range(1, n)])) if n > 1 else F.transform(F.col(array), lambda x: f(x))
    return F.slice(each, F.lit(1), F.greatest(F.size(array) - (n - 1), F.lit(0)))


def with_fingerprints(df: DataFrame, name: str, k: int, w: int) -> DataFrame:
    """Adds the distinct smallest hashes of runs of w k-gram hashes, all of them where there are fewer than w.

    df has ws, the words, and hs, their hashes. Each array is a column of its own, so none is computed twice.
    """
    df = df.withColumn("grams", _runs("hs", k, F.xxhash64))
    if w > 1:
        df = df.withColumn("mins", F.when(F.size("grams") < w, F.col("grams")).otherwise(_runs("grams", w, F.least)))
    return df.withColumn(name, F.array_distinct("mins" if w > 1 else "grams"))


def windows(ws: Column, n: int) -> Column:
    """(start, words joined by spaces) of each run of n words."""
    start = F.sequence(F.lit(1), F.size(ws) - n + 1)
    return F.when(F.size(ws) >= n, F.transform(start, lambda i: F.struct((i - 1).alias("start"), F.array_join(F.slice(ws, i, n), " ").alias("window"))))


def _with_size_bound(small: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint where the counted rows allow it; otherwise the join shuffles."""
    return F.broadcast(small) if rows <= BOUND else small


def decontaminate(spark: SparkSession, docs: DataFrame, items: DataFrame, window: int = 10, k: int = 5) -> DataFrame:
    """Marks the words of docs(doc_id, text) inside occurrences of windows of items(item_id, text).

    Returns doc_id, n_words, n_hit, n_items, items_sha256, contaminated, one row for each row of docs. Rows with the
    same doc_id and text get the same result; same doc_id with another text is another document. A null or empty text
    has no words; items without words are nowhere; rows of items with a null item_id count as hits but have no id.
    """
    scratch = Scratch(spark, "decontam")
    items = items.select("item_id", words(F.col("text")).alias("ws")).withColumn("n", F.least(F.size("ws"), F.lit(window)))
    items = scratch.save(items).where("n > 0")
    lengths = sorted(r.n for r in items.select("n").distinct().collect())  # at most `window` values
    keyed = docs.select(F.struct("doc_id", F.xxhash64("text").alias("text")).alias("doc"), "text")  # a struct's null fields are equal
    classes = [(n, k, n - k + 1) if n == window else (n, n, 1) for n in lengths]  # window length, k, w

    def prints(df: DataFrame, *keep: str) -> DataFrame:
        """Fingerprints (n, fp) of each class of lengths."""
        df = df.withColumn("hs", F.transform("ws", lambda x: F.xxhash64(x)))
        found = [F.array().cast("array<struct<n:int,fp:bigint>>")]
        for n, kk, w in classes:
            df = with_fingerprints(df, f"fp{n}", kk, w)
            found.append(F.transform(f"fp{n}", tagged(n)))
        return df.select(*keep, F.concat(*found).alias("prints"))

    def tagged(n: int):
        return lambda x: F.struct(F.lit(n).alias("n"), x.alias("fp"))

    # saved first: a filter that explode() infers would else be pushed below and compute the arrays anew per element
    own = scratch.save(prints(items.select(F.col("n").alias("own"), "ws"), "own"))
    own = scratch.save(own.select("own", F.explode("prints").alias("p")).where("p.n = own").select("p.n", "p.fp").distinct())
    item_windows = items.select(
        "item_id", "n", F.explode(reduce(lambda c, n: c.when(F.col("n") == n, windows(F.col("ws"), n)), lengths, F.when(F.lit(False), windows(F.col("ws"), window)))).alias("w")
    )
    item_windows = scratch.save(item_windows.select("item_id", "n", "w.window").distinct())
    some = scratch.save(item_windows.select("n", "window").distinct())
    n_own, n_some, n_pairs = own.count(), some.count(), item_windows.count()

    base = keyed.select("doc", words(F.col("text")).alias("ws")).withColumn("n_words", F.size("ws").cast("long"))
    base = scratch.save(prints(base, "doc", "n_words"))
    hits = base.select("doc", F.explode("prints").alias("p")).select("doc", "p.n", "p.fp")
    hits = hits.join(_with_size_bound(own, n_own), ["n", "fp"], "left_semi").select("doc").distinct()
    hits = scratch.save(hits)
    suspects = keyed.join(_with_size_bound(hits, hits.count()), "doc", "left_semi")
    suspects = scratch.save(suspects.select("doc", words(F.col("text")).alias("ws")))
    none = F.array().cast("array<struct<n:int,start:int,window:string>>")

    def sized(n: int) -> Column:
        return F.coalesce(F.transform(windows(F.col("ws"), n), lambda x: F.struct(F.lit(n).alias("n"), x.start.alias("start"), x.window.alias("window"))), none)

    every = reduce(lambda a, b: F.concat(a, b), map(sized, lengths), none)
    found = suspects.select("doc", F.explode(every).alias("w")).select("doc", "w.*").join(_with_size_bound(some, n_some), ["n", "window"])
    found = scratch.save(found)

    spans = F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("end"))))
    covered = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("to"), F.lit(0).alias("sum")),
        lambda a, x: F.struct(F.greatest(a.to, x.end).alias("to"), (a["sum"] + F.greatest(x.end - F.greatest(x.start, a.to), F.lit(0))).alias("sum")),
        lambda a: a["sum"].cast("long"),
    )
    hit = found.groupBy("doc").agg(covered.alias("n_hit"))
    ids = found.select("doc", "n", "window").distinct().join(_with_size_bound(item_windows, n_pairs), ["n", "window"]).groupBy("doc").agg(F.collect_set("item_id").alias("ids"))
    text = F.array_join(F.array_sort(F.transform("ids", lambda x: x.cast("string"))), ",")
    hit = hit.join(ids, "doc").select("doc", "n_hit", F.size("ids").cast("long").alias("n_items"), text.alias("list"))
    out = base.join(hit, "doc", "left")
    zero = F.lit(0).cast("long")
    return out.select(
        "doc.doc_id",
        "n_words",
        F.coalesce("n_hit", zero).alias("n_hit"),
        F.coalesce("n_items", zero).alias("n_items"),
        F.sha2(F.coalesce("list", F.lit("")).cast("binary"), 256).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )
