"""Cutting lineage where a loop would let it grow."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shared_folder(df: DataFrame) -> str:
    """The folder of spark.checkpoint.dir, which all executors share.

    Only on one machine (a local master) a temporary folder is made where that is unset; on a cluster no executor could read
    another one's, so that it is an error there.
    """
    context = df.sparkSession.sparkContext
    if not context.getConf().get("spark.checkpoint.dir") and context.getCheckpointDir() is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="cliquora-"))
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """df in the shared folder. spark.cleaner.referenceTracking.cleanCheckpoints removes what is no longer used."""
    shared_folder(df)
    return df.checkpoint(eager=True)


def looped(df: DataFrame) -> DataFrame:
    """df as a table written to the shared folder, for loops that join a table with itself.

    A checkpoint keeps the size that Spark has reckoned, a join's being the product of its sides': its digits double with every join, and
    after some ten rounds planning takes longer than the work. A table is as large as its files.
    """
    path = f"{shared_folder(df)}/looped-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a few numbers each that a task groups, about.
SHARE = 100_000


def dealt(rows: DataFrame, n: int, *keys: str, share: int = SHARE) -> DataFrame:
    """rows (n of them, about) by their keys, in as many parts as give a task about `share` rows.

    Spark's own number of partitions is fixed, so that what a task sorts and groups grows with the input.
    """
    return rows.repartition(1 + n // share, *keys)


#: Rows of a few numbers each that are sent to all tasks at most.
MAX_BROADCAST = 1_000_000


def sized(rows: DataFrame) -> DataFrame:
    """rows (written ones: they are counted) with a hint to send them to all tasks, where they are few enough."""
    return F.broadcast(rows) if rows.count() <= MAX_BROADCAST else rows
