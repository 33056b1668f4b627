"""Cutting lineage where iterations would make plans grow, and the folder that driver and executors share."""

from __future__ import annotations

import functools
import tempfile

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _temporary(application: str) -> str:
    return tempfile.mkdtemp(prefix="saldo-")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset: a temporary one in local mode, an error on a cluster."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir")
    if not at and not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (at or _temporary(sc.applicationId)).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
