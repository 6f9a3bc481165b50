"""Sends this package to the executors, so that Python workers can import it wherever they run."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Once for each application: a zip of the package's sources, fetched from the driver by Spark itself."""
    sc = spark.sparkContext
    if sc.applicationId not in _SENT:
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="tidewave-code-")).resolve() / "tidewave.zip"
        with zipfile.ZipFile(target, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f"{root.name}/{f.relative_to(root)}")
        sc.addPyFile(str(target))
        _SENT.add(sc.applicationId)
    return spark
