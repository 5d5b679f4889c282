"""A fresh folder every executor can reach."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from ..session import shared_folder


def scratch(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/freightlens/{label}-{uuid.uuid4().hex}"
