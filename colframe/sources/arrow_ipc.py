"""Arrow IPC streams and files, through Spark's own readers so that any store works.

Reading: files are Spark binary rows, decoded to record batches on executors. Writing: each partition becomes one or
more IPC payloads, stored as binary rows of a Parquet table or returned as a column.
"""

from __future__ import annotations

import io

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from colframe.shipping import ship

MAGIC = b"ARROW1"


def _batches(raw: bytes):
    reader = pa.ipc.open_file(io.BytesIO(raw)) if raw[:6] == MAGIC else pa.ipc.open_stream(io.BytesIO(raw))
    if hasattr(reader, "num_record_batches"):
        for i in range(reader.num_record_batches):
            yield reader.get_batch(i)
    else:
        yield from reader


def _plain(batch: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    """Dictionaries become text; types are cast to those of the table."""
    columns = [c.dictionary_decode() if pa.types.is_dictionary(c.type) else c for c in batch.columns]
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)


def schema_of(raw: bytes):
    """Spark schema of a payload."""
    first = (pa.ipc.open_file if raw[:6] == MAGIC else pa.ipc.open_stream)(io.BytesIO(raw)).schema
    fields = [pa.field(f.name, f.type.value_type if pa.types.is_dictionary(f.type) else pa.timestamp("us") if pa.types.is_timestamp(f.type) and f.type.tz is None else f.type) for f in first]
    return from_arrow_schema(pa.schema(fields))


def decode(df: DataFrame, column: str, schema) -> DataFrame:
    """Rows of all payloads in a binary column."""
    ship(df.sparkSession)
    arrow = to_arrow_schema(schema)

    def run(batches):
        for b in batches:
            for raw in b.column(0):
                for found in _batches(raw.as_py()):
                    yield _plain(found, arrow)

    return df.select(column).mapInArrow(run, schema)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Reads IPC files or streams under a path; the schema is that of the first file."""
    files = spark.read.format("binaryFile").load(path)
    return decode(files, "content", schema_of(files.select("content").first()[0]))


def encode(df: DataFrame, kind: str = "stream") -> DataFrame:
    """One binary payload (a stream or a file) for each batch of rows."""
    ship(df.sparkSession)

    def run(batches):
        for b in batches:
            out = io.BytesIO()
            with (pa.ipc.new_file if kind == "file" else pa.ipc.new_stream)(out, b.schema) as w:
                w.write_batch(b)
            yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], ["payload"])

    return df.mapInArrow(run, "payload binary")


def from_table(spark: SparkSession, table: pa.Table) -> DataFrame:
    return spark.createDataFrame(table)


def to_table(df: DataFrame) -> pa.Table:
    """The whole result on the driver; for results known to be small."""
    return df.toArrow()
