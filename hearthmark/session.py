"""Session settings the operators rely on."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app: str = "hearthmark", master: str | None = None, **conf: str) -> SparkSession:
    """Session with UTC time, AQE (incl. skew join) and dynamic partition overwrite."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # small rows may be expensive ones (cell joins, JSON): do not merge them into one task,
        # and leave shuffles to the planner so that AQE can still split skewed partitions
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16KB",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    if master and master.startswith("local"):
        settings["spark.sql.shuffle.partitions"] = "8"
        settings["spark.driver.memory"] = "12g"
    settings.update(conf)
    for k, v in settings.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder that driver and executors share: the one ``spark.checkpoint.dir`` names.

    Only a single-process session (tests, a laptop) may do without the setting; it gets a folder of
    its own, which goes when the process ends. On a cluster a missing setting is an error.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share (master is {master})")
    own = tempfile.mkdtemp(prefix="hearthmark-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(own)
    return own


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder, written at once.

    The frame is kept while it is written, so that its source is evaluated once and not again for the files.
    """
    shared_folder(df.sparkSession)
    df.persist(StorageLevel.DISK_ONLY)
    try:
        return df.checkpoint(eager=True)
    finally:
        df.unpersist()


@contextmanager
def held(df: DataFrame) -> Iterator[DataFrame]:
    """The frame, evaluated once for all that runs inside the block and kept on the executors' disks, not in the shared folder.

    For frames that nothing lazy reads after the block. Parts that an executor loses are evaluated anew.
    """
    df.persist(StorageLevel.DISK_ONLY)
    try:
        yield df
    finally:
        df.unpersist()
