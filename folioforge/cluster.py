"""Getting this package to the Python workers."""

from __future__ import annotations

import io
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Send this package's source to all Python workers, once a context; Spark's own file server carries it."""
    sc = spark.sparkContext
    if getattr(sc, "_folioforge_shipped", False):
        return
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(ROOT.rglob("*.py")):
            z.write(p, p.relative_to(ROOT.parent))
    path = Path(tempfile.mkdtemp(prefix="folioforge-")) / "folioforge.zip"
    path.write_bytes(data.getvalue())
    sc.addPyFile(str(path))
    sc._folioforge_shipped = True


def map_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """mapInArrow of a function that may use this package."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)
