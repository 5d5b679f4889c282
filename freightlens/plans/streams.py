"""Streaming queries, each run over everything available and compared with the batch answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import refdata as ref, schemas
from ..operators.anomaly import flag
from ..operators.invoice_rules import foreign_currency, insufficient_approval, weekend
from ..sources import writers
from ..sources.scratch import scratch
from ..streaming import feeds, risk_store
from . import causality
from .catalog import Source, query
from .extraction import P_TEXT
from .io import INV_COLS, INVOICE_FILES_SQL, SHP_COLS, invoice_files, name_of, policy_files
from .records import R
from .texts import DRIVER_TEXT, HIGH, INVOICE_TEXT, SHIPMENT_TEXT

UPLOAD_DDL = "n_nationkey string, n_name string, n_regionkey string"
UPDATES = f"""SELECT 'driver_risk' AS update_type, {DRIVER_TEXT} AS content, 'driver_update' AS doc_type, risk_level, CAST(NULL AS DOUBLE) AS amount, CAST(NULL AS DOUBLE) AS risk_score, 'none' AS anomaly_type FROM drivers
 UNION ALL SELECT 'invoice_compliance', {INVOICE_TEXT}, 'invoice_update', NULL, amount, NULL, NULL FROM invoices
 UNION ALL SELECT 'shipment_anomaly', {SHIPMENT_TEXT}, 'shipment_update', NULL, NULL, risk_score, anomaly_type FROM shipments
 UNION ALL SELECT 'policy_update', concat(content, chr(10)), 'policy_update', NULL, NULL, NULL, NULL FROM pol
 UNION ALL SELECT 'user_upload', concat('Uploaded document processed. Content: ', CAST(to_json({{'n_nationkey': CAST(n_nationkey AS VARCHAR), 'n_name': n_name, 'n_regionkey': CAST(n_regionkey AS VARCHAR)}}) AS VARCHAR), '...'),
  'upload', NULL, NULL, NULL, NULL FROM nation"""
VIEWS = "drivers invoices shipments"


def folders(s: Source) -> str:
    """The five watched folders filled with files."""
    root = scratch(s.spark, "watched")
    put = lambda rows, name: writers.packed_csv(rows, f"{root}/{name}")
    put(s.drivers.select("driver_id", "name", "risk_level", "last_incident", F.lit(None).cast("string").alias("incident_type"), "recommendation"), "drivers")
    put(s.invoices.select(*[n for n, _ in schemas.columns(schemas.INVOICE) if n in INV_COLS.split(", ")]), "invoices")
    put(s.shipments.select(*SHP_COLS.split(", ")), "shipments")
    put(s.nation.select("n_nationkey", "n_name", "n_regionkey"), "uploads")
    from .extraction import policies

    writers.one_file_each(policies(s), f"{root}/policies", "file", "content")
    return root


def ran(s: Source, rows: DataFrame, fmt: str = "parquet") -> str:
    out = scratch(s.spark, "out")
    feeds.finish(feeds.append_to(rows, out, f"{out}-checkpoint", fmt, compression="gzip" if fmt == "json" else None))
    return out


@query("st_ingest", "SELECT update_type, content, doc_type FROM updates", VIEWS, pol=P_TEXT, updates=UPDATES)
def _(s: Source):
    out = ran(s, feeds.ingest(s.spark, folders(s), UPLOAD_DDL))
    return s.spark.read.parquet(out).select("update_type", "content", F.col("metadata")["doc_type"].alias("doc_type"))


@query("sink_index_append", "SELECT update_type, content, true AS stamped FROM updates", VIEWS, pol=P_TEXT, updates=UPDATES)
def _(s: Source):
    out = ran(s, feeds.indexed(feeds.ingest(s.spark, folders(s), UPLOAD_DDL)), "json")
    back = s.spark.read.schema(schemas.UPDATE + ", index_timestamp timestamp").json(out)
    return back.select("update_type", "content", F.col("index_timestamp").isNotNull().alias("stamped"))


@query("st_broadcast_alerts", f"SELECT update_type, count(*) AS alerts FROM updates WHERE {HIGH} GROUP BY update_type", VIEWS, pol=P_TEXT, updates=UPDATES)
def _(s: Source):
    out = ran(s, feeds.alerts(feeds.ingest(s.spark, folders(s), UPLOAD_DDL)), "json")
    back = s.spark.read.schema(schemas.ALERT).json(out)
    kind = {"driver_risk_escalation": "driver_risk", "invoice_compliance_violation": "invoice_compliance", "shipment_anomaly_detected": "shipment_anomaly"}
    named = F.create_map(*[F.lit(x) for pair in kind.items() for x in pair])
    return back.groupBy(named[F.col("alert_type")].alias("update_type")).agg(F.count("*").alias("alerts"))


@query("src_csv_stream", f"SELECT {SHP_COLS} FROM shipments", "shipments")
def _(s: Source):
    root = scratch(s.spark, "csv")
    s.shipments.select(*SHP_COLS.split(", ")).write.option("header", True).csv(root)
    ddl = ", ".join(f"{n} {t}" for n, t in schemas.columns(schemas.SHIPMENT) if n in SHP_COLS.split(", "))
    return s.spark.read.parquet(ran(s, feeds.csv_stream(s.spark, root, ddl)))


@query("src_csv_files_stream", INVOICE_FILES_SQL, "invoices")
def _(s: Source):
    folder, out = invoice_files(s), scratch(s.spark, "arrived")
    feeds.finish(feeds.records_by_name(s.spark, folder, schemas.INVOICE, "invoice_id", out, f"{out}-checkpoint"))
    return s.spark.read.parquet(out).drop("file", "batch")


@query("src_text_stream", "SELECT file, content FROM pol", pol=P_TEXT)
def _(s: Source):
    rows = s.spark.read.parquet(ran(s, feeds.text_stream(s.spark, policy_files(s, "texts"))))
    return rows.select(name_of("file").alias("file"), F.expr("substring(content, 1, length(content) - 1)").alias("content"))


def parquet_of(s: Source, rows: DataFrame, label: str) -> str:
    path = scratch(s.spark, label)
    rows.write.parquet(path)
    return path


@query("st_stateless_rules", " UNION ALL ".join(R[k] for k in ("inv_weekend", "inv_currency", "inv_insufficient_approval")), "invoices")
def _(s: Source):
    rows = feeds.table_stream(s.spark, parquet_of(s, s.invoices, "invoices"))
    found = flag(rows, "invoice_id", weekend(), foreign_currency(), insufficient_approval())
    back = s.spark.read.parquet(ran(s, found))
    return back.select("src_row", "document_id", "anomaly_type", "risk_score", "severity")


@query("sink_alerts_append", R["inv_weekend"], "invoices")
def _(s: Source):
    # two runs over one checkpoint: the second appends only what arrived in between
    folder, out = scratch(s.spark, "alerts-in"), scratch(s.spark, "alerts")
    for part in ("status = 'flagged'", "status <> 'flagged'"):
        s.invoices.where(part).write.mode("append").parquet(folder)
        found = flag(feeds.table_stream(s.spark, folder), "invoice_id", weekend())
        feeds.finish(feeds.append_to(found, out, f"{out}-checkpoint"))
    return s.spark.read.parquet(out).select("src_row", "document_id", "anomaly_type", "risk_score", "severity")


STATS = "SELECT event_type, count(*) AS n, max(epoch_us(ts)) AS latest_us, arg_max(entity_id, ts) AS last_scenario FROM causal_events GROUP BY event_type"


def stats_run(s: Source) -> DataFrame:
    """Statistics after two runs, the second with the rest of the log."""
    folder, out = scratch(s.spark, "log"), scratch(s.spark, "stats")
    for part in ("entity_type = 'driver'", "entity_type = 'shipment'"):
        s.causal_events.where(part).write.mode("append").parquet(folder)
        rows = feeds.running_stats(feeds.table_stream(s.spark, folder), "event_type", "ts", "entity_id")
        feeds.finish(feeds.replace_each_batch(rows, out, f"{out}-checkpoint"))
    from ..operators.intervals import micros

    return s.spark.read.parquet(out).select("event_type", "n", micros("latest_update").alias("latest_us"), "last_scenario")


@query("st_running_stats", STATS, "causal_events")
def _(s: Source):
    return stats_run(s)


@query("sink_stats_overwrite", "SELECT event_type, n FROM st", "causal_events", st=STATS)
def _(s: Source):
    return stats_run(s).select("event_type", "n")


@query("udaf_reducers", STATS, "causal_events")
def _(s: Source):
    from ..operators.intervals import micros
    from ..operators.summaries import doc_stats

    return doc_stats(s.causal_events, "event_type", "ts", "entity_id").select("event_type", "n", micros("latest_update").alias("latest_us"), "last_scenario")


@query("st_dedup", "SELECT DISTINCT invoice_id FROM invoices", "invoices")
def _(s: Source):
    dated, out = s.invoices.select("invoice_id", F.col("issue_date").cast("timestamp").alias("issued")), scratch(s.spark, "dedup-out")
    rows = feeds.table_stream(s.spark, parquet_of(s, dated, "dedup"))
    feeds.finish(feeds.once_per_key(rows, "invoice_id", out, f"{out}-checkpoint"))
    return s.spark.read.parquet(out).select("invoice_id")


@query(
    "st_file_change",
    "SELECT s_name AS supplier, CASE WHEN s_suppkey % 2 = 0 THEN 'v2' ELSE 'v1' END AS version FROM supplier",
)
def _(s: Source):
    # a changed file is published under a new name; the newest version of a record wins
    folder, out = scratch(s.spark, "versions"), scratch(s.spark, "versions-out")
    for version, rows in (("v1", s.supplier), ("v2", s.supplier.where("s_suppkey % 2 = 0"))):
        rows.select(F.col("s_name").alias("supplier"), F.lit(version).alias("version")).write.mode("append").option("header", True).csv(folder)
        stream = feeds.csv_stream(s.spark, folder, "supplier string, version string")
        feeds.finish(feeds.append_to(stream, out, f"{out}-checkpoint"))
    return s.spark.read.parquet(out).groupBy("supplier").agg(F.max("version").alias("version"))


@query(
    "st_causal_join",
    """SELECT * FROM (SELECT c.event_id AS cause_id, e.event_id AS effect_id, CAST(least(65 + CASE WHEN e.us - c.us <= 3600000000 THEN 30 WHEN e.us - c.us <= 86400000000 THEN 20 ELSE 10 END
 + CASE WHEN c.entity_id = e.entity_id THEN 20 ELSE 0 END, 100) AS DOUBLE) / 100 AS confidence FROM ev c JOIN ev e ON c.event_type = 'driver_risk_increase' AND e.event_type = 'shipment_delay'
 AND e.us - c.us BETWEEN 0 AND 172800000000) x WHERE confidence >= 0.75""",
    "causal_events", ev=causality.CTES["ev"],
)
def _(s: Source):
    folder = parquet_of(s, s.causal_events.withColumn("ts", F.col("ts").cast("timestamp")), "events")
    joined = feeds.causal_join(feeds.table_stream(s.spark, folder), "driver_risk_increase", "shipment_delay", 2 * ref.DAY, 0.75, 0.15)
    return s.spark.read.parquet(ran(s, joined.select("cause_id", "effect_id", "confidence")))


@query(
    "st_last_24h_sliding",
    """SELECT TIMESTAMP '2024-01-01' + to_hours(CAST(h AS INT)) AS until, count(*) AS n FROM (SELECT unnest(generate_series(1, 27 * 24)) AS h) g
 JOIN causal_events e ON e.ts < TIMESTAMP '2024-01-01' + to_hours(CAST(h AS INT)) AND e.ts >= TIMESTAMP '2024-01-01' + to_hours(CAST(h AS INT) - 24)
 WHERE event_type LIKE '%anomaly%' GROUP BY h""",
    "causal_events",
)
def _(s: Source):
    # the log ends on the 30th and the watermark trails it by a day; windows that ended by the 28th have closed
    folder = parquet_of(s, s.causal_events.withColumn("ts", F.col("ts").cast("timestamp")), "sliding")
    back = s.spark.read.parquet(ran(s, feeds.sliding_counts(feeds.table_stream(s.spark, folder))))
    closed = back.where(F.col("span.end") <= F.lit("2024-01-28").cast("timestamp"))
    return closed.select(F.col("span.end").cast("timestamp_ntz").alias("until"), F.col("count").alias("n"))


@query(
    "st_daily_windows",
    "SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, count(*) AS n FROM causal_events WHERE event_type LIKE '%anomaly%' AND ts < TIMESTAMP '2024-01-29' GROUP BY ALL",
    "causal_events",
)
def _(s: Source):
    # the log ends on the 30th and the watermark trails it by a day, so days up to the 28th have closed
    folder = parquet_of(s, s.causal_events.withColumn("ts", F.col("ts").cast("timestamp")), "days")
    back = s.spark.read.parquet(ran(s, feeds.daily_counts(feeds.table_stream(s.spark, folder))))
    return back.select(F.to_date("day.start").alias("day"), "event_type", F.col("count").alias("n"))


@query(
    "st_state_latest_policy",
    "SELECT src_row, supplier, CASE WHEN status = 'flagged' THEN 1 ELSE 2 END AS version, CASE WHEN status = 'flagged' THEN CAST(0.015 AS DOUBLE) ELSE CAST(0.02 AS DOUBLE) END AS value FROM invoices",
    "invoices",
)
def _(s: Source):
    # version 1 is in force for the first part of the records, version 2 for what follows
    rules, folder, out = scratch(s.spark, "rules"), scratch(s.spark, "governed"), scratch(s.spark, "governed-out")
    for version, value, part in ((1, 0.015, "status = 'flagged'"), (2, 0.02, "status <> 'flagged'")):
        s.supplier.select(F.col("s_name").alias("supplier"), F.lit(version).alias("version"), F.lit(value).alias("value")).write.mode("append").parquet(rules)
        s.invoices.where(part).select("src_row", "supplier").write.mode("append").parquet(folder)
        feeds.finish(feeds.under_latest_policy(feeds.table_stream(s.spark, folder), rules, "supplier", out, f"{out}-checkpoint"))
    return s.spark.read.parquet(out).select("src_row", "supplier", "version", "value")


@query(
    "st_event_risk",
    "SELECT event_id, level, coalesce(links, 0) AS links FROM levels LEFT JOIN stats USING (event_id)",
    "causal_events entity_edges", **{k: causality.CTES[k] for k in ("ev", "rules", "boosts", "alinks", "stats", "levels")},
)
def _(s: Source):
    # two batches that overlap in time, so most events of the second are late; it goes on from the checkpoint
    folder, store = scratch(s.spark, "events"), scratch(s.spark, "risk")
    for part in range(2):
        s.causal_events.where(F.pmod(F.xxhash64("event_id"), F.lit(2)) == part).write.mode("append").parquet(folder)
        feeds.finish(risk_store.keep(feeds.table_stream(s.spark, folder), store, f"{store}-checkpoint"))
    found = risk_store.levels(s.spark, store).join(risk_store.stats(s.spark, store), "event_id", "left")
    return found.select("event_id", "level", F.coalesce("links", F.lit(0)).alias("links"))
