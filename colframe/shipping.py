"""Makes this package importable in Python workers that lack it."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Bytes of a batch between executors and Python workers; both sides hold whole batches, in memory outside the heap.
BATCH = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's bytes of an Arrow batch to BATCH; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None)
    digits, unit = (now or "").strip("bB"), 1
    if digits[-1:].lower() in ("k", "m", "g"):
        digits, unit = digits[:-1], 1 << 10 * (1 + "kmg".index(digits[-1].lower()))
    if not digits.isdigit() or int(digits) * unit > BATCH:
        spark.conf.set(name, f"{BATCH}b")


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, once per application, and bounds its batches.

    Functions are pickled by reference, so workers need the modules; on a cluster they may have no copy.
    """
    bound_batches(spark)
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    name = os.path.basename(root)
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join(name, os.path.relpath(full, root)))
    path = os.path.join(tempfile.mkdtemp(prefix="colframe-"), "colframe_pkg.zip")
    with open(path, "wb") as out:
        out.write(buffer.getvalue())
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)
