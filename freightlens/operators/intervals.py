"""Range joins on time as equi joins on time buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(ts: str | Column) -> Column:
    """Microseconds since the epoch of a timestamp with or without time zone."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def within(left: DataFrame, right: DataFrame, on: list[str], left_us: str, right_us: str, reach_us: str) -> DataFrame:
    """Pairs with equal ``on`` and 0 <= right_us - left_us <= reach_us, a column of the left side.

    ``reach_us`` must be a function of ``on`` and present on both sides. A left row is written to its
    own bucket and the next, a right row to its own; buckets are one reach wide, so each pair meets
    exactly once and a busy key is spread over many buckets.
    """
    width = F.greatest(F.col(reach_us), F.lit(1))
    l_rows = left.withColumn("_own", F.floor(F.col(left_us) / width).cast("bigint"))
    l_rows = l_rows.withColumn("_bucket", F.explode(F.array("_own", F.col("_own") + 1))).drop("_own")
    r_rows = right.withColumn("_bucket", F.floor(F.col(right_us) / width).cast("bigint")).drop(reach_us)
    gap = F.col(right_us) - F.col(left_us)
    return l_rows.join(r_rows, [*on, "_bucket"]).where((gap >= 0) & (gap <= F.col(reach_us))).drop("_bucket")


def count_near(points: DataFrame, events: DataFrame, window_s: int, point_us: str = "point_us", event_us: str = "event_us", step_s: int = 600) -> DataFrame:
    """Points with ``near``: how many events lie within +-window of each, without making the pairs.

    Running totals up to the end of each window minus those before its start.
    """
    reach, at = F.lit(window_s * 1_000_000), F.col("_pid")
    one = F.lit(0).alias("_all")
    keyed = points.withColumn("_pid", F.col(point_us))
    ends = F.array(
        F.struct((at + reach).alias("us"), F.lit(False).alias("before"), F.lit(1).alias("weight")),
        F.struct((at - reach).alias("us"), F.lit(True).alias("before"), F.lit(-1).alias("weight")),
    )
    asked = keyed.select("_pid").distinct().select(one, "_pid", F.explode(ends).alias("e")).select("_all", "_pid", "e.*")
    counted = up_to(asked, events.select(one, F.col(event_us).alias("us"), F.lit(True).alias("tag")), ["_all"], step_s)
    totals = counted.groupBy("_pid").agg(F.sum(F.col("n") * F.col("weight")).alias("near"))
    return keyed.join(totals, "_pid").drop("_pid")


def up_to(points: DataFrame, marks: DataFrame, keys: list[str], step_s: int = 60) -> DataFrame:
    """For every point the number of marks of its key up to its moment, and the last of them.

    ``marks`` are (keys, us, tag), ``points`` are (keys, us, before, *anything); with ``before`` a mark at
    the same moment does not count. Added are ``n`` and ``last``, the struct (us, tag) of the last mark or
    null. No pairs are made: within a time step marks and points lie in one order, and what came in earlier
    steps is a running total over steps. A key that holds most rows is spread over its steps.
    """
    step = F.floor(F.col("us") / (step_s * 1_000_000)).cast("bigint")
    extra = [c for c in points.columns if c not in (*keys, "us", "before")]
    mark = F.struct("us", "tag")
    lined = marks.select(*keys, "us", F.lit(1).alias("_order"), mark.alias("_mark"), *[F.lit(None).cast(points.schema[c].dataType).alias(c) for c in extra])
    asked = points.select(
        *keys, "us", F.when(F.col("before"), 0).otherwise(2).alias("_order"), F.lit(None).cast(lined.schema["_mark"].dataType).alias("_mark"), *extra
    )
    rows = lined.unionByName(asked).withColumn("_step", step)
    within_step = Window.partitionBy(*keys, "_step").orderBy("us", "_order").rowsBetween(Window.unboundedPreceding, 0)
    steps = rows.groupBy(*keys, "_step").agg(F.count("_mark").alias("_n"), F.max("_mark").alias("_last"))
    # one row per occupied step of a key: the calendar, not the log
    earlier = Window.partitionBy(*keys).orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)
    before = steps.select(*keys, "_step", F.sum("_n").over(earlier).alias("_n0"), F.max("_last").over(earlier).alias("_last0"))
    own = rows.withColumn("_n1", F.count("_mark").over(within_step)).withColumn("_last1", F.max("_mark").over(within_step))
    return own.where("_order <> 1").join(before, [*keys, "_step"]).select(
        *keys, "us", *extra,
        (F.col("_n1") + F.coalesce("_n0", F.lit(0))).alias("n"), F.coalesce("_last1", "_last0").alias("last"),
    )


def best_within(points: DataFrame, marks: DataFrame, keys: list[str], reach: str) -> DataFrame:
    """(keys, us, best): for every moment of ``points`` the largest tag of the marks of its key with
    0 <= point - mark <= reach.

    ``points`` are (keys, us, reach), ``marks`` (keys, us, reach, tag); the reach is a function of the keys, which
    meet only where they are not null. Time is cut into blocks one reach wide, so the window of a point is the end of
    one block and the start of its own, and running maxima from the front and from the back of a block answer both.
    A busy key is spread over its blocks, and no pairs are made.
    """
    usable = " AND ".join([f"{reach} >= 0", "us IS NOT NULL", *[f"{k} IS NOT NULL" for k in keys]])
    us, width = F.col("us"), F.col(reach) + 1
    block = F.floor(us / width).cast("bigint")

    def placed(front: Column, back: Column, shift: int) -> Column:
        one = lambda at, far: F.struct((block - shift * int(far)).alias("_block"), F.lit(far).alias("_back"), at.alias("_at"))
        return F.explode(F.array(one(front, False), one(back, True))).alias("_p")

    seen = marks.where(usable).groupBy(*keys, reach, "us").agg(F.max("tag").alias("_tag"))
    seen = seen.select(*keys, "_tag", F.lit(None).cast("bigint").alias("_us"), placed(us, -us, 0))
    asked = points.where(usable).select(*keys, reach, "us").distinct()
    asked = asked.select(*keys, F.lit(None).cast(seen.schema["_tag"].dataType).alias("_tag"), us.alias("_us"), placed(us, F.col(reach) - us, 1))
    # a mark at the very moment counts, so marks come before points
    w = Window.partitionBy(*keys, "_p._block", "_p._back").orderBy("_p._at", F.col("_us").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    met = seen.unionByName(asked).withColumn("_best", F.max("_tag").over(w)).where("_us IS NOT NULL AND _best IS NOT NULL")
    return met.groupBy(*keys, F.col("_us").alias("us")).agg(F.max("_best").alias("best"))
