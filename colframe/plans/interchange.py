"""Queries that write and read formats, and the streaming form of resampling."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from colframe.plans.catalog import register
from colframe.plans.relational import T
from colframe.sources import arrow_ipc, csvio
from colframe.sources.scratch import shared_dir


@register("csv_roundtrip", "SELECT s_suppkey, s_name, s_nationkey::bigint AS s_nationkey, CASE WHEN s_suppkey % 3 <> 0 THEN s_acctbal END AS s_acctbal, s_suppkey % 2 = 0 AS even FROM supplier")
def _(spark, d):
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    s = T(spark, d, "supplier")
    csvio.write(s.select("s_suppkey", "s_name", "s_nationkey", F.when(F.col("s_suppkey") % 3 != 0, F.col("s_acctbal")).alias("s_acctbal"), (F.col("s_suppkey") % 2 == 0).alias("even")), path)
    return csvio.read(spark, path)


@register("parquet_roundtrip", "SELECT * FROM nation")
def _(spark, d):
    path = f"{shared_dir(spark)}/parquet-{uuid.uuid4().hex}"
    T(spark, d, "nation").write.parquet(path)
    return spark.read.parquet(path)


def _ipc(kind):
    @register(f"arrow_{kind}_roundtrip", "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate FROM orders")
    def _(spark, d):
        o = T(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
        return arrow_ipc.decode(arrow_ipc.encode(o, kind), "payload", o.schema)


_ipc("stream")
_ipc("file")
