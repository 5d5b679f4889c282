"""First, latest and top-n per group. Rank filters let Spark cut each group before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import risk_band_3


def top_per_group(rows: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def latest_per_entity(events: DataFrame, tie: str = "event_id") -> DataFrame:
    """The newest event of each entity."""
    return top_per_group(events, ["entity_id"], [F.desc("ts"), F.col(tie)], 1).drop("rank")


def varied_sample(anomalies: DataFrame, quota=(("high", 2), ("medium", 2), ("low", 1)), at_least: int = 3, tie: str = "id") -> DataFrame:
    """A few of each band, filled up with the next ones when that gives too few rows."""
    limits = dict(quota)
    order = [F.desc("risk_score"), F.desc("ts"), F.col(tie)]
    most = max(max(limits.values()), at_least)
    rows = anomalies.withColumn("band", risk_band_3("risk_score"))
    # at most `most` rows per band leave this step: a dozen rows, whatever the input
    few = top_per_group(rows, ["band"], order, most, "band_rank")
    quota_col = F.create_map(*[x for b, n in limits.items() for x in (F.lit(b), F.lit(n))])[F.col("band")]
    taken = F.col("band_rank") <= quota_col
    w = Window.orderBy(F.desc("taken"), *order)
    return (
        few.withColumn("taken", taken)
        .withColumn("pos", F.row_number().over(w))
        .where(F.col("taken") | (F.col("pos") <= at_least))
        .drop("taken", "pos", "band_rank")
    )
