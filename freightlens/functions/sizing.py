"""Baselines whose size is known before they are joined, and rows dealt out before costly work."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..session import shared_folder


def sized(small: DataFrame) -> DataFrame:
    """A baseline ready to be joined: computed once, written to the shared folder and read back.

    The fact table is not read again for it, and its size in bytes is known, so Spark broadcasts it below
    ``spark.sql.autoBroadcastJoinThreshold`` and shuffles beyond it, with AQE splitting hot keys.
    """
    path = f"{shared_folder(small.sparkSession)}/freightlens/baseline-{uuid.uuid4().hex}"
    small.write.parquet(path)
    return small.sparkSession.read.schema(small.schema).parquet(path)


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` dealt out by a hash of ``keys``, for work that costs much per row.

    A file of few row groups is read by as few tasks, and all that follows a scan runs in them. What lies below, views
    included, should be cheap, as it stays there.
    """
    session = rows.sparkSession
    tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism)
    return rows.repartition(tasks, *keys)
