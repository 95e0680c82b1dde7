"""Shipping the package to executors that do not have it installed."""

from __future__ import annotations

import os
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give every executor this package, once an application; functions are pickled by reference to it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(os.path.realpath(context._temp_dir), "flowsift.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.join("flowsift", os.path.relpath(path, root)))
    context.addPyFile(target)
    _shipped.add(context.applicationId)
