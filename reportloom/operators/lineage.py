"""Lineage cuts for operators that iterate."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: With this, shuffle files go when the frame that made them has run, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors share; only a local master that names none gets a temporary one."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    named = named or "file://" + tempfile.mkdtemp(prefix="reportloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    held = df.persist()  # else the plan runs once for the result and once for its files
    try:
        return held.checkpoint(eager=True)
    finally:
        held.unpersist()


def cut_small(df: DataFrame) -> DataFrame:
    """A checkpoint of a small table that large ones make, whose shuffle files go at once. Its plan's last stage runs twice, once for the files."""
    conf = df.sparkSession.conf
    shared_dir(df.sparkSession)
    before = conf.get(CLEANUP)
    try:
        conf.set(CLEANUP, "true")
        return df.select("*").checkpoint(eager=True)
    finally:
        conf.set(CLEANUP, before)
