"""Giving the executors' Python workers this package, wherever the driver imports it from."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package as a zip to the session's Python files, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if not os.path.isdir(root):  # imported from a zip already
        return
    path = os.path.join(tempfile.mkdtemp(prefix="graphloom-"), "graphloom_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    f = os.path.join(d, n)
                    z.write(f, os.path.join("graphloom", os.path.relpath(f, root)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def shipped(f: Callable) -> Callable:
    """A query that ships the package first."""

    @functools.wraps(f)
    def run(spark, *args):
        ship(spark)
        return f(spark, *args)

    return run
