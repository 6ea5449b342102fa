"""Give this package to Python workers that can't import it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Send the package to the executors through Spark, once for a context, unless their path has it already."""
    context = spark.sparkContext
    if str(_ROOT.parent) in os.environ.get("PYTHONPATH", "").split(":") or any("veraframe-package" in f for f in context.listFiles):
        return
    target = Path(tempfile.mkdtemp()) / "veraframe-package.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(_ROOT.rglob("*.py")):
            z.write(f, f.relative_to(_ROOT.parent))
    context.addPyFile(str(target))


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run
