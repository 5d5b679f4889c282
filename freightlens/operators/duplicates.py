"""First-seen questions answered with mergeable minima and a join, so a hot id never fills one task.

``order`` is an explicit, unique arrival key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_seen(rows: DataFrame, key: str, order: str = "src_row", carry: str | None = None) -> DataFrame:
    """Rows whose key occurred earlier, with the first row's order key (and one carried value)."""
    aggs = [F.min(order).alias("first_order"), F.count("*").alias("key_rows")]
    if carry:
        aggs.append(F.min_by(carry, order).alias(f"first_{carry}"))
    firsts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(*aggs).where("key_rows > 1").drop("key_rows")
    return rows.join(firsts, key).where(F.col(order) > F.col("first_order"))


def keep_first(rows: DataFrame, key: str, order: str = "src_row") -> DataFrame:
    """One row per key, the earliest one."""
    return (
        rows.groupBy(key)
        .agg(F.min_by(F.struct(*[x for x in rows.columns if x != key]), order).alias("r"))
        .select(key, "r.*")
        .select(*rows.columns)
    )


def earlier_twin(rows: DataFrame, key: str, same: list[str], order: str = "src_row") -> DataFrame:
    """Rows preceded by a row that agrees on ``same`` but has another key; adds ``related``.

    The earliest two distinct keys of a group decide every row in it: a row whose key is not the
    group's first looks at the first, a row with the first key looks at the second.
    """
    per_key = rows.dropna(subset=same).groupBy(*same, key).agg(F.min(order).alias("first_order"))
    w = Window.partitionBy(*same).orderBy("first_order")
    two = (
        per_key.withColumn("rn", F.row_number().over(w))
        .where("rn <= 2")
        .groupBy(*same)
        .agg(
            F.max(F.when(F.col("rn") == 1, F.col(key))).alias("key_1"),
            F.max(F.when(F.col("rn") == 1, F.col("first_order"))).alias("order_1"),
            F.max(F.when(F.col("rn") == 2, F.col(key))).alias("key_2"),
            F.max(F.when(F.col("rn") == 2, F.col("first_order"))).alias("order_2"),
        )
        .where("key_2 IS NOT NULL")
    )
    own_first = F.col(key) == F.col("key_1")
    return (
        rows.join(two, same)
        .withColumn("related", F.when(own_first, F.col("key_2")).otherwise(F.col("key_1")))
        .withColumn("related_order", F.when(own_first, F.col("order_2")).otherwise(F.col("order_1")))
        .where(F.col(order) > F.col("related_order"))
        .drop("key_1", "order_1", "key_2", "order_2", "related_order")
    )
