"""What the operators of this subpackage share: the shared folder, reading tables, fresh column names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A folder that the driver and every executor reach.

    ``spark.checkpoint.dir`` where the session names one, else a folder beside the warehouse tables.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (named or f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared").rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back.

    Later steps read the files instead of computing it again, also after executors are lost.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(df: DataFrame) -> list[str]:
    """The columns of ``df`` as names that ``select`` takes literally, also with dots or backquotes in them."""
    return ["`" + c.replace("`", "``") + "`" for c in df.columns]


def spelled(df: DataFrame, name: str) -> str:
    """How ``df`` spells a column: Spark compares names without case, Arrow batches in a worker do not."""
    return next((c for c in df.columns if c.lower() == name.lower()), name)


def plain(df: DataFrame) -> DataFrame:
    """``df`` with names that ``mapInArrow`` can look up, by place; ``toDF`` gives the old ones back."""
    names: list[str] = []
    for i, c in enumerate(df.columns):
        odd = "." in c or "`" in c
        names.append(unused(df, f"column_{i}") if odd else c)
    return df.toDF(*names)
