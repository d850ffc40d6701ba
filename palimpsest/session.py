"""A session with the settings that the operators rely on."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "palimpsest", **settings: str) -> SparkSession:
    """UTC, adaptive execution and skew joins; everything else is the cluster's."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with files in the folder that the session names in ``spark.checkpoint.dir``.

    Only a local session may leave it unset; it gets a folder of its own.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="palimpsest-checkpoints-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
