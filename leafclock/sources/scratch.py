"""Shared working folders."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Where working tables go if the cluster names no checkpoint folder.
WORKDIR = "spark.leafclock.workdir"

_local: list[tempfile.TemporaryDirectory] = []


def use_local_workdir(spark: SparkSession) -> None:
    """Give a local session without any working folder one that goes when Python ends.

    Its Python workers also get this package on their path, wherever Python was started.
    For tests, the bench and the driver's contract; on a cluster it does nothing.
    """
    if not spark.sparkContext.master.startswith("local["):
        return
    home = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if home not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [home, env.get("PYTHONPATH")]))
    conf = spark.conf
    if not (conf.get("spark.checkpoint.dir", None) or conf.get(WORKDIR, None)):
        if not _local:
            _local.append(tempfile.TemporaryDirectory(prefix="leafclock-", ignore_cleanup_errors=True))
        conf.set(WORKDIR, _local[0].name)


def scratch_dir(spark: SparkSession, name: str = "run") -> str:
    """A fresh folder under ``spark.checkpoint.dir``, else ``spark.leafclock.workdir``.

    All executors must share it; without either setting this fails, in every mode.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(WORKDIR, None)
    if not base:
        raise ValueError(f"set spark.checkpoint.dir or {WORKDIR} to a folder all executors share")
    return f"{base.rstrip('/')}/leafclock-{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """The rows written once as a table in a fresh working folder, and read back.

    Used where a result feeds several branches: it is computed once, survives the
    loss of executors, and its true size is known when joins are planned.
    """
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
