"""Link counts of a growing event log, kept as additive deltas per batch.

Files below one folder: ``log/batch=B/day=D`` holds the events that batch B brought first, ``deltas/batch=B`` what the batch
adds to the counts of its own and of earlier events. A batch that is tried again writes its own folders anew and
reads those of smaller numbers only, so it counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import refdata as ref
from ..functions.sizing import sized
from ..operators import causal
from ..sources.readers import read_or_none
from .feeds import each_batch

COLUMNS = ["event_id", "event_type", "entity_id", "entity_type", "description", "ts"]


def _days(rules) -> int:
    """Days that the longest window of a rule touches on either side."""
    return max(window for _, _, window, _ in rules) // ref.DAY + 1


def near(log: DataFrame, batch: DataFrame, rules) -> DataFrame:
    """Events of the log on the days that links of the batch can touch; other days are not read."""
    span = _days(rules)
    touched = batch.select(F.explode(F.sequence(F.col("day") - span, F.col("day") + span)).alias("day")).distinct()
    return log.join(touched, "day", "left_semi")


def delta(before: DataFrame, batch: DataFrame, rules_table: DataFrame) -> DataFrame:
    """What ``batch`` adds: links per event after it less those before it, for events of any age.

    Both sides hold the same older events, so links among these cancel out, and a link to an older event of any
    distance in time is counted at both of its ends.
    """
    old = causal.link_stats(before, rules_table).select("event_id", F.col("links").alias("had"), F.col("near_driver_risk").alias("was"))
    now = causal.link_stats(before.unionByName(batch), rules_table).join(old, "event_id", "left")
    more = (F.col("links") - F.coalesce("had", F.lit(0))).alias("links")
    return now.select("event_id", more, "near_driver_risk").where("links > 0")


def add_batch(batch: DataFrame, number: int, path: str, rules=ref.CAUSAL_RULES) -> None:
    """Stores the events of a batch that are new and what they add. An event that comes again changes nothing."""
    spark = batch.sparkSession
    day = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (ref.DAY * causal.US)).cast("int")
    # an event without a time links to nothing and belongs to no day
    fresh = batch.select(*COLUMNS, day.alias("day")).where("event_id IS NOT NULL AND day IS NOT NULL").dropDuplicates(["event_id"])
    stored = read_or_none(spark, f"{path}/log")
    stored = fresh.limit(0) if stored is None else stored.where(F.col("batch") < number).select(*COLUMNS, "day")
    around = near(stored, fresh, rules)
    fresh = sized(fresh.join(around.select("event_id"), "event_id", "left_anti").select(*COLUMNS, "day"))
    fresh.write.mode("overwrite").partitionBy("day").parquet(f"{path}/log/batch={number}")
    added = delta(sized(around.drop("day")), fresh.drop("day"), causal.link_rules(spark, rules))
    added.write.mode("overwrite").parquet(f"{path}/deltas/batch={number}")


def keep(events: DataFrame, path: str, checkpoint: str, rules=ref.CAUSAL_RULES) -> StreamingQuery:
    """Runs a stream of events into the store."""
    return each_batch(events, lambda batch, number: add_batch(batch, number, path, rules), checkpoint)


def stats(spark: SparkSession, path: str) -> DataFrame:
    """``causal.link_stats`` of all stored events, as sums of the deltas."""
    rows = spark.read.parquet(f"{path}/deltas")
    return rows.groupBy("event_id").agg(F.sum("links").alias("links"), F.bool_or("near_driver_risk").alias("near_driver_risk"))


def levels(spark: SparkSession, path: str) -> DataFrame:
    """Every stored event with its risk level as of the last batch."""
    events = spark.read.parquet(f"{path}/log").select(*COLUMNS)
    return events.join(stats(spark, path), "event_id", "left").withColumn("level", causal.risk_level()).select(*COLUMNS, "level")
