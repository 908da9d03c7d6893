"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()

#: Bytes of an Arrow batch between the JVM and a Python worker, where the session has Spark's default of 64 MB.
ARROW_BATCH_BYTES = 4 << 20


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once, so that workers can import it anywhere."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        _shipped.add(context.applicationId)
        root = Path(__file__).resolve().parent
        archive = os.path.join(tempfile.mkdtemp(prefix="cladeframe-"), "cladeframe.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        context.addPyFile(archive)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("64m", "64MB", "67108864", "67108864b"):
        spark.conf.set(key, str(ARROW_BATCH_BYTES))
    return spark
