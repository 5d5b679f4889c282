"""Streams of the same rows the batch operators take, with the same column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators import filters, render, summaries
from ..operators.causal import normal_type, strength
from ..operators.intervals import micros
from ..schemas import DRIVER, INVOICE, SHIPMENT, all_text
from ..sources.readers import foreign_csv, read_csv_by_name, read_or_none, typed


# --- sources --------------------------------------------------------------------------------


def csv_stream(spark: SparkSession, folder: str, ddl: str) -> DataFrame:
    """New CSV files of a watched folder, cast like the batch reader does."""
    raw = spark.readStream.schema(all_text(ddl)).option("header", True).option("mode", "PERMISSIVE").csv(folder)
    return typed(raw, ddl)


def records_by_name(spark: SparkSession, folder: str, ddl: str, id_col: str, out: str, checkpoint: str, rejected: str | None = None, files: int = 1000) -> StreamingQuery:
    """CSV files of any header that arrive in a folder, appended to ``out`` as records (and file, batch).

    Spark's file source keeps which files came already and hands on at most ``files`` paths per batch; a batch reads
    them by their own headers. A batch that is tried again replaces what it wrote. Files without ``id_col`` go to
    ``rejected`` as (file, line).
    """
    found = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary")
    found = found.option("recursiveFileLookup", True).option("maxFilesPerTrigger", files).load(folder).where("length > 0").select("path")

    def read(batch: DataFrame, number: int) -> None:
        paths = [r["path"] for r in batch.collect()]  # at most ``files``
        if not paths:
            return
        read_csv_by_name(spark, paths, ddl, id_col).write.mode("overwrite").parquet(f"{out}/batch={number}")
        if rejected:
            foreign_csv(spark, paths, id_col).write.mode("overwrite").parquet(f"{rejected}/batch={number}")

    return found.writeStream.foreachBatch(read).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def text_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New text files, one row each."""
    rows = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(folder)
    return rows.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("last_modified"), F.col("value").alias("content")
    )


def table_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New parquet files of a folder with a known schema."""
    return spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)


def ingest(spark: SparkSession, root: str, upload_ddl: str) -> DataFrame:
    """The five watched folders under ``root`` as one stream of updates."""
    return render.unify(
        render.driver_updates(csv_stream(spark, f"{root}/drivers", DRIVER)),
        render.invoice_updates(csv_stream(spark, f"{root}/invoices", INVOICE)),
        render.shipment_updates(csv_stream(spark, f"{root}/shipments", SHIPMENT)),
        render.policy_updates(text_stream(spark, f"{root}/policies").select("file", "content")),
        render.upload_updates(csv_stream(spark, f"{root}/uploads", upload_ddl)),
    )


# --- sinks ----------------------------------------------------------------------------------


def append_to(rows: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", poll: str | None = None, compression: str | None = None) -> StreamingQuery:
    """Append sink; ``poll`` keeps it running, without it everything there is gets processed once. Files of text, which
    repeat every field's name in every row, are a fraction as large with a ``compression`` such as gzip."""
    writer = rows.writeStream.format(fmt).outputMode("append").option("checkpointLocation", checkpoint)
    writer = writer.option("compression", compression) if compression else writer
    writer = writer.trigger(processingTime=poll) if poll else writer.trigger(availableNow=True)
    return writer.start(path)


def replace_each_batch(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Complete-mode result that replaces what stood there; writing a batch twice changes nothing."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return (
        rows.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    )


def each_batch(rows: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def finish(query: StreamingQuery) -> None:
    """Wait for a run over everything available; errors of the stream are raised here."""
    query.awaitTermination()


# --- transformations ------------------------------------------------------------------------


def indexed(updates: DataFrame) -> DataFrame:
    """Updates with the time they were indexed."""
    return updates.withColumn("index_timestamp", F.current_timestamp())


def running_stats(updates: DataFrame, kind: str, ts: str, scenario: str) -> DataFrame:
    """Count, newest time and latest scenario per kind, kept up to date."""
    return summaries.doc_stats(updates, kind, ts, scenario)


def once_per_key(rows: DataFrame, key: str, path: str, checkpoint: str) -> StreamingQuery:
    """Stores the first row of each key, a null key included, whenever it arrives and whatever date it carries.

    Each batch meets the stored keys in an anti join, so nothing is held in state, no key is forgotten and a
    batch that is tried again adds nothing.
    """

    def write(batch: DataFrame, _: int) -> None:
        fresh, stored = batch.dropDuplicates([key]), read_or_none(batch.sparkSession, path)
        if stored is not None:
            seen = stored.select(F.col(key).alias("seen_key"))
            fresh = fresh.join(seen, fresh[key].eqNullSafe(seen["seen_key"]), "left_anti")
        fresh.write.mode("append").parquet(path)

    return each_batch(rows, write, checkpoint)


def alerts(updates: DataFrame) -> DataFrame:
    return filters.alerts(updates, F.current_timestamp())


def daily_counts(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Anomaly events per day as days close."""
    rows = events.where(F.col("event_type").contains("anomaly")).withWatermark("ts", delay)
    return rows.groupBy(F.window("ts", "1 day").alias("day"), "event_type").count()


def causal_join(events: DataFrame, cause: str, effect: str, window_s: int, threshold: float = 0.0, boost: float = 0.0, salts: int = 8) -> DataFrame:
    """Each effect with the causes of any entity up to ``window_s`` before it whose strength reaches the threshold.

    Both sides meet in slices of time as wide as the window: a cause is written to its own slice and the next, an effect to
    its own, so every pair meets once. A slice is what all current events share, so it is split: effects are dealt
    out by a hash of their id and causes written to every split. Both sides keep events for the window plus the watermark
    delay, here one window more; an event later than that finds no partner.
    """
    keep, width = f"{window_s} seconds", window_s * 1_000_000
    base = events.withColumn("kind", normal_type()).withColumn("us", micros("ts")).withColumn("ts", F.col("ts").cast("timestamp"))
    base = base.withColumn("slice", F.floor(F.col("us") / width).cast("bigint"))

    def side(role: str, kind: str) -> DataFrame:
        names = {"event_id": "id", "entity_id": "entity_id", "ts": "ts", "us": "us"}
        rows = base.where(F.col("kind") == kind)
        return rows.select("slice", *[F.col(x).alias(f"{role}_{y}") for x, y in names.items()]).withWatermark(f"{role}_ts", keep)

    left = side("cause", cause).withColumn("slice", F.explode(F.array("slice", F.col("slice") + 1)))
    left = left.withColumn("split", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    right = side("effect", effect).withColumn("split", F.pmod(F.xxhash64("effect_id"), F.lit(salts)).cast("int"))
    left, right = left.alias("c"), right.alias("e")
    span = (F.col("effect_ts") >= F.col("cause_ts")) & (F.col("effect_ts") <= F.col("cause_ts") + F.expr(f"INTERVAL {window_s} SECONDS"))
    met = left.join(right, (F.col("c.slice") == F.col("e.slice")) & (F.col("c.split") == F.col("e.split")) & span, "inner")
    same = F.coalesce(F.col("cause_entity_id") == F.col("effect_entity_id"), F.lit(False))
    power = strength(F.col("effect_us") - F.col("cause_us"), same, F.lit(round(boost * 100)))
    return met.withColumn("confidence", power).where(F.col("confidence") >= threshold).drop("slice", "split")


def sliding_counts(events: DataFrame, length: str = "24 hours", slide: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """Anomaly events in the last ``length``, told every ``slide``, as windows close; rows later than ``delay`` do not count."""
    rows = events.where(F.col("event_type").contains("anomaly")).withWatermark("ts", delay)
    return rows.groupBy(F.window("ts", length, slide).alias("span")).count()


def under_latest_policy(records: DataFrame, policy_folder: str, key: str, out: str, checkpoint: str) -> StreamingQuery:
    """Every batch of records meets the newest policy per key at that time.

    The policy table (key, version, value) is read again in each batch, so a new version governs the
    records that follow it. A batch is written to a folder of its own number, so one that is tried again
    replaces what it wrote before.
    """

    def write(batch: DataFrame, number: int) -> None:
        policies = batch.sparkSession.read.parquet(policy_folder)
        newest = policies.groupBy(key).agg(F.max("version").alias("version"), F.max_by("value", "version").alias("value"))
        batch.join(newest, key, "left").write.mode("overwrite").parquet(f"{out}/batch_id={number}")

    return each_batch(records, write, checkpoint)
