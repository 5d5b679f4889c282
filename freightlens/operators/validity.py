"""Slowly changing rules: validity ranges per key, and records met by the rule in force on their date."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sizing import sized


def ranges(versions: DataFrame, key: str, effective: str, order: str, until: str | None = None) -> DataFrame:
    """Versions with ``valid_from`` (included) and ``valid_to`` (excluded, null: open).

    A version holds until the next one of its key takes effect or, if sooner, until its own ``until`` date; after
    that nothing holds, which is a gap. Of versions that take effect on one day the largest ``order`` counts. Versions
    without a key or a date hold never, as do those that end before they begin.
    """
    rest = [c for c in versions.columns if c not in (key, effective)]
    dated = versions.where(F.col(key).isNotNull() & F.col(effective).isNotNull())
    one = dated.groupBy(key, effective).agg(F.max_by(F.struct(*rest), order).alias("_v")).select(key, effective, "_v.*")
    following = F.lead(effective).over(Window.partitionBy(key).orderBy(effective))
    end = F.least(following, F.col(until)) if until else following
    out = one.withColumn("valid_to", end).withColumnRenamed(effective, "valid_from")
    return out.where("valid_to IS NULL OR valid_to > valid_from")


def as_of(records: DataFrame, versions: DataFrame, on: str, date: str) -> DataFrame:
    """Records with the columns of the version of their ``on`` that is valid on ``date``; nulls where none is.

    The ranges of a key do not overlap, so a record meets one at most and none is repeated. The ranges are written
    once: their size decides between broadcast and shuffle, and AQE splits a busy key.
    """
    known = sized(versions.withColumnRenamed(on, "_key"))
    inside = (F.col(date) >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col(date) < F.col("valid_to")))
    return records.join(known, (F.col(on) == F.col("_key")) & inside, "left").drop("_key")
