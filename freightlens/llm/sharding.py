"""Sharding by longest-processing-time scheduling.

Rows of one group stay together. Groups are taken by falling size and each goes to the shard that holds
least so far, which a heap finds. A group is scheduled by itself when its size is at least
``1 / (shards * UNITS)`` of the total; there are at most ``shards * UNITS`` of those, whatever the data.
The smaller ones are first gathered by hash into as many bundles, and a bundle is scheduled like a group.
So the heap sees a bounded number of items, and since bundles are small against a shard, the loads end
within about one bundle of each other unless a single group exceeds a shard's share.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, table

UNITS = 256  # units per shard, the resolution of the schedule
SLOT_ROWS = 50_000  # rows numbered by one task


def schedule(loads: list[tuple], shards: int) -> list[tuple]:
    """(unit, load) pairs to (unit, shard) pairs, largest first onto the least loaded shard.

    Ties go by the unit's name and the shard's number, so a rerun gives the same schedule.
    """
    heap = [(0, s) for s in range(shards)]
    out = []
    for unit, load in sorted(loads, key=lambda x: (-x[1], x[0])):
        filled, shard = heapq.heappop(heap)
        out.append((unit, shard))
        heapq.heappush(heap, (filled + load, shard))
    return out


def assign(rows: DataFrame, group: str, size: str, shards: int, units: int = UNITS) -> DataFrame:
    """``rows`` with ``shard``. ``group`` is a string without nulls, ``size`` a non-negative long.

    ``rows`` is read twice and should be a stored table. Empty input gives no rows.
    """
    spark = rows.sparkSession
    limit = shards * units
    total = rows.agg(F.sum(size)).first()[0] or 0
    floor = max(1, -(-total // limit))
    bundle = F.pmod(F.xxhash64(group), F.lit(limit)).cast("string")
    groups = rows.groupBy(group).agg(F.sum(size).alias("_load"))
    # a lone group is named by its key, a bundle by its number; the first letter keeps them apart
    unit = F.when(F.col("_load") >= floor, F.concat(F.lit("g"), group)).otherwise(F.concat(F.lit("b"), bundle))
    loads = groups.groupBy(unit.alias("unit")).agg(F.sum("_load").alias("load"))
    planned = schedule([(r["unit"], r["load"]) for r in loads.collect()], shards)  # at most 2 * limit rows
    plan = spark.createDataFrame(planned, "_unit string, _shard int")
    alone = plan.filter(F.col("_unit").startswith("g")).select(F.expr("substr(_unit, 2)").alias(group), F.col("_shard").alias("_alone"))
    bundled = plan.filter(F.col("_unit").startswith("b")).select(
        F.expr("substr(_unit, 2)").alias("_bundle"), F.col("_shard").alias("_bundled")
    )
    return (
        rows.withColumn("_bundle", bundle)
        .join(F.broadcast(alone), group, "left")
        .join(F.broadcast(bundled), "_bundle", "left")
        .withColumn("shard", F.coalesce("_alone", "_bundled"))
        .drop("_bundle", "_alone", "_bundled")
    )


def number(rows: DataFrame, shard: str, keys: list[str], block_rows: int = SLOT_ROWS) -> DataFrame:
    """``rows`` with ``slot``: 0, 1, 2 .. within each shard, without one task holding a whole shard.

    Rows of a shard are dealt into blocks by a hash of ``keys``; a block starts where the ones before
    it end. Rows that agree in all keys are interchangeable.
    """
    blocks = max(1, -(-rows.count() // block_rows))
    dealt = rows.withColumn("_block", F.pmod(F.xxhash64(*keys), F.lit(blocks)))
    counts = dealt.groupBy(shard, "_block").count()
    before = Window.partitionBy(shard).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(shard, "_block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(shard, "_block").orderBy(*keys)
    return (
        dealt.withColumn("_place", F.row_number().over(within))
        .join(starts, [shard, "_block"])
        .withColumn("slot", (F.col("_start") + F.col("_place") - 1).cast("long"))
        .drop("_block", "_place", "_start")
    )


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Places every document in a shard so that shard sizes are near equal and equal texts stay together.

    Returns doc_id, size (UTF-8 bytes plus 16 for the row), text_crc32, law (``bytes``), shard, slot,
    grown_shard (null: this law moves rows freely when a shard is added).
    Null texts count 16 bytes, have crc32 0 and form one group, apart from the empty text. Repeated rows
    are placed one by one with their group. A null doc_id is a value like any other. Other columns are ignored.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16).alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(F.md5("text"), F.lit("none")).alias("grp"),
    )
    placed = assign(stored(rows, "shard-rows"), "grp", "size", shards)
    placed = number(stored(placed, "shard-placed"), "shard", ["doc_id", "text_crc32", "size", "grp"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op2_sharding(spark, sf_dir):
    return shard_documents(table(spark, sf_dir, "documents"))
