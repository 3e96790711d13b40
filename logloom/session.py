"""The session's shared folder, and the package on the Python workers, wherever the driver found it."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def shared_folder(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; only where it is unset and the master is local (tests) a folder of our own."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.logloom.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="logloom-")
        spark.conf.set("spark.logloom.checkpoint.dir", where)
    return where.rstrip("/")


def ensure_importable(spark: SparkSession) -> None:
    """Adds the package's parent folder to the workers' PYTHONPATH. On a cluster it is installed there, or shipped with ``--py-files``."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])
