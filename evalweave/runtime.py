"""Bring this package to the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Rows and bytes of an Arrow batch, where the session has Spark's defaults: texts may be long, and a worker's memory follows its batches.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": (None, "16m")}


def ship(spark: SparkSession) -> None:
    """Add the package's sources to the session once, so that executors without a checkout can import it."""
    context = spark.sparkContext
    for name, (default, value) in BATCH.items():
        if spark.conf.get(name, None) in (default, None):
            spark.conf.set(name, value)
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="evalweave-src-")) / "evalweave_src.zip"
    with zipfile.ZipFile(target, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)
