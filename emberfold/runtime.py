"""Checkpoints and size-checked broadcasts, for operators that run several jobs."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a slim table (ids, short strings) is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000
#: Bytes up to which a table whose rows hold arrays or texts is broadcast.
BROADCAST_BYTES = 8 << 20


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; only where it names none and all runs in one JVM, one of our own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def shared_folder(spark: SparkSession, name: str) -> str:
    """The name of a new folder that all executors share, below the checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` by a reliable checkpoint in the folder that the session names.

    Shuffle files of the work so far are dropped once the checkpoint is written: nothing reads them again.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        # the setting holds for plans made from now on
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.set(key, before)


def wide(df: DataFrame) -> DataFrame:
    """``df`` marked so that a join of it shuffles both sides.

    The optimizer takes what an explode makes of a row for one row, so that it would broadcast slim tables that become a
    hundred times as large.
    """
    return df.hint("merge")


def small(df: DataFrame, rows: int = BROADCAST_ROWS, weigh: Column | None = None) -> DataFrame:
    """``df`` marked for broadcast if it is small enough; otherwise as it is, for a shuffled join.

    Small is at most ``rows`` rows of a few short columns. Where rows hold arrays or texts, ``weigh`` is the bytes of one, and
    the sum is at most BROADCAST_BYTES. Call it on settled or otherwise cheap tables: without ``weigh`` it counts up to
    ``rows + 1`` rows, with it all of them.
    """
    if weigh is None:
        return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
    n, total = df.agg(F.count(F.lit(1)), F.sum(weigh)).first()
    return F.broadcast(df) if n <= rows and (total or 0) <= BROADCAST_BYTES else df
