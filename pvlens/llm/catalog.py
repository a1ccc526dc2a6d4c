"""Queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


@functools.lru_cache(maxsize=8)
def _ship(application: str, add) -> None:
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    to = os.path.join(tempfile.mkdtemp(prefix="pvlens-"), "pvlens.zip")
    with zipfile.ZipFile(to, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    path = os.path.join(folder, n)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    add(to)


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors, once for an application (what
    ``--py-files`` does), so that their Python workers can import it."""
    _ship(spark.sparkContext.applicationId, spark.sparkContext.addPyFile)


def register(name: str, sql: str | None = None):
    def deco(fn):
        @functools.wraps(fn)
        def run(spark, sf_dir):
            ship(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
