"""Getting this package to the executors' Python workers, whose import path may not hold it."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

PACKAGE = os.path.dirname(os.path.abspath(__file__))
_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package as a zip file, once an application, unless the import path that workers inherit already holds it."""
    app = spark.sparkContext.applicationId
    above = os.path.dirname(PACKAGE)
    if app in _sent or above in map(os.path.abspath, os.environ.get("PYTHONPATH", "").split(os.pathsep)):
        return
    out = os.path.join(tempfile.mkdtemp(prefix="tallyframe-"), "tallyframe.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(PACKAGE):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, above))
    spark.sparkContext.addPyFile(out)
    _sent.add(app)


def shipped(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query f, with the package sent before it runs."""

    @functools.wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    return run
