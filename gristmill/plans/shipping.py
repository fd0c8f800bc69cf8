"""Makes this package importable in Python workers, wherever they run."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Hand the package to the session's workers, once for each context."""
    sc = spark.sparkContext
    if getattr(sc, "_gristmill_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="gristmill-ship-")) / "gristmill_package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    path = Path(folder, name)
                    z.write(path, path.relative_to(top.parent))
    sc.addPyFile(str(archive))
    sc._gristmill_shipped = True
