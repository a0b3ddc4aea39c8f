"""Making the package importable on executors."""

from __future__ import annotations

import atexit
import functools
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's source to the executors, once an application.

    The archive is made beside the driver and handed out by Spark's file server, so executors need
    neither a shared folder nor the driver's module path.
    """
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    place = tempfile.mkdtemp(prefix="meshlark-src-")
    atexit.register(shutil.rmtree, place, ignore_errors=True)
    path = os.path.join(place, "meshlark_src.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(ROOT, "meshlark")):
            for name in sorted(names):
                if name.endswith(".py"):
                    at = os.path.join(folder, name)
                    z.write(at, os.path.relpath(at, ROOT))
        if os.path.exists(at := os.path.join(ROOT, "corpus_pipeline.py")):
            z.write(at, "corpus_pipeline.py")
    spark.sparkContext.addPyFile(path)
    _sent.add(app)


def shipped(query):
    """A function of a session that sees to it that executors can import the package."""

    @functools.wraps(query)
    def run(spark: SparkSession, *args, **kwargs):
        ship(spark)
        return query(spark, *args, **kwargs)

    return run
