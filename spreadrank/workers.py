"""The package on the Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for a session, since its functions must be
    importable there. Spark fetches the archive from the driver for each executor."""
    sc = spark.sparkContext
    if getattr(sc, "_spreadrank_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp()) / "spreadrank_workers.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for module in sorted(package.rglob("*.py")):
            out.write(module, module.relative_to(package.parent))
    sc.addPyFile(str(archive))
    sc._spreadrank_shipped = True
