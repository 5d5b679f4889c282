"""Queries over an anomaly store: filters, bands, summaries, top-k, ranks and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import risk_band_3, risk_band_4, severity_band_shipment, text_id
from ..functions.sizing import spread
from ..operators import filters, invoice_rules as inv, profiles, ranking, shipment_rules as shp, summaries
from ..operators.anomaly import flag
from .catalog import RECORDS_AS_OF, Source, query
from .records import PREPARED, R, routed, SHIPPED, termed

STORED = ["inv_terms_violation", "inv_weekend", "inv_insufficient_approval", "inv_currency"]
VIEWS = "invoices supplier_terms"
CTES = dict(
    it=PREPARED["it"],
    store="SELECT sha256(concat_ws('|', anomaly_type, document_id, src_row)) AS id, x.*, CAST(issue_date AS TIMESTAMP) AS ts FROM ("
    + " UNION ALL ".join(R[k] for k in STORED)
    + ") x JOIN (SELECT src_row, issue_date FROM invoices) d USING (src_row)",
)
COLS = "id, document_id, anomaly_type, risk_score, severity, ts"


def store(s: Source, rows: DataFrame | None = None) -> DataFrame:
    """Anomalies dated by the invoice they were found on; ``rows`` are the invoices with terms, in an order of one's own."""
    rules = [inv.terms_violation(), inv.weekend(), inv.insufficient_approval(), inv.foreign_currency()]
    found = flag(termed(s) if rows is None else rows, "invoice_id", *rules, keep=("issue_date",))
    return found.select(
        text_id("anomaly_type", "document_id", "src_row").alias("id"), "document_id", "src_row", "anomaly_type",
        F.round("risk_score", 6).alias("risk_score"), "severity", F.col("issue_date").cast("timestamp").alias("ts"),
    )


def slim(rows: DataFrame) -> DataFrame:
    return rows.select(*COLS.split(", "))


def q(name: str, sql: str, **extra: str):
    return query(name, sql, VIEWS, **CTES, **extra)


# --- filters and bands ----------------------------------------------------------------------


@q(
    "filter_anomalies",
    f"""SELECT {COLS} FROM store WHERE risk_score >= 0.5 AND ts >= TIMESTAMP '1998-01-01' AND ts <= TIMESTAMP '1999-06-30 23:59:59'
 AND string_split(anomaly_type, '_')[1] = 'payment' AND severity = 'medium'""",
)
def _(s: Source):
    return slim(
        filters.filter_anomalies(
            store(s), 0.5, start="1998-01-01", end="1999-06-30", doc_type="payment", severity="medium", end_is_day=True
        )
    )


@q("filter_anomalies_bad_date", f"SELECT {COLS} FROM store WHERE risk_score >= 0.7 AND anomaly_type = 'weekend_processing'")
def _(s: Source):
    return slim(filters.filter_anomalies(store(s), 0.7, start="not a date", anomaly_type="weekend_processing"))


def _case(bounds, last):
    return "CASE " + " ".join(f"WHEN risk_score >= {b} THEN '{v}'" for b, v in bounds) + f" ELSE '{last}' END"


BAND3 = _case([(0.8, "high"), (0.5, "medium")], "low")
BAND4 = _case([(0.8, "critical"), (0.6, "high"), (0.4, "medium")], "low")
BANDS = _case([(0.9, "Critical"), (0.7, "High"), (0.4, "Medium")], "Low")

for _name, _sql, _fn in [
    ("risk_band_3", BAND3, risk_band_3),
    ("risk_band_4", BAND4, risk_band_4),
]:
    q(_name, f"SELECT id, risk_score, {_sql} AS band FROM store")(
        lambda s, fn=_fn: store(s).select("id", "risk_score", fn("risk_score").alias("band"))
    )


@query("severity_band_shipment", f"SELECT src_row, risk_score, {BANDS} AS severity FROM shipments", "shipments")
def _(s: Source):
    return s.shipments.select("src_row", "risk_score", severity_band_shipment("risk_score").alias("severity"))


# --- summaries ------------------------------------------------------------------------------


@q(
    "agg_anomaly_summary",
    """SELECT 'total' AS kind, CAST(NULL AS VARCHAR) AS value, count(*) AS n, count(*) FILTER (risk_score >= 0.8) AS high_risk FROM store
 UNION ALL SELECT 'type', anomaly_type, count(*), count(*) FILTER (risk_score >= 0.8) FROM store GROUP BY anomaly_type
 UNION ALL SELECT 'severity', severity, count(*), count(*) FILTER (risk_score >= 0.8) FROM store GROUP BY severity""",
)
def _(s: Source):
    return summaries.anomaly_summary(store(s))


@q(
    "agg_risk_level_summary",
    f"""SELECT 'total' AS kind, CAST(NULL AS VARCHAR) AS value, count(*) AS n FROM store
 UNION ALL SELECT 'type', anomaly_type, count(*) FROM store GROUP BY anomaly_type
 UNION ALL SELECT 'risk_level', {BAND4}, count(*) FROM store GROUP BY 2
 UNION ALL SELECT 'processed_documents', NULL, count(DISTINCT document_id) FROM store""",
)
def _(s: Source):
    return summaries.risk_level_summary(store(s))


@q(
    "agg_risk_distribution",
    """SELECT count(*) AS total, count(*) FILTER (risk_score >= 0.8) AS high_risk, count(*) FILTER (risk_score >= 0.5 AND risk_score < 0.8) AS medium_risk,
 count(*) FILTER (risk_score < 0.5) AS low_risk, count(*) FILTER (ts >= TIMESTAMP '2001-01-01') AS new_anomalies FROM store""",
)
def _(s: Source):
    return summaries.risk_distribution(store(s), F.col("ts") >= F.lit("2001-01-01").cast("timestamp"))


@q(
    "agg_document_combined",
    """SELECT document_id, count(*) AS anomalies, max(risk_score) AS max_risk, string_agg(DISTINCT anomaly_type, ',' ORDER BY anomaly_type) AS types,
 round(least(0.98, max(risk_score) + 0.1), 6) AS combined_risk FROM store GROUP BY document_id HAVING count(*) >= 2""",
)
def _(s: Source):
    return summaries.document_combined(store(s)).select(
        "document_id", "anomalies", "max_risk", F.array_join("types", ",").alias("types"), F.round("combined_risk", 6).alias("combined_risk")
    )


@q("agg_top_types", "SELECT anomaly_type, count(*) AS n FROM store GROUP BY anomaly_type ORDER BY n DESC, anomaly_type LIMIT 5")
def _(s: Source):
    return summaries.top_types(store(s))


@query(
    "agg_invoice_summary",
    """SELECT count(*) AS invoices, CAST(sum(CAST(amount AS DECIMAL(18,4))) AS DOUBLE) AS total_amount, count(*) FILTER (lower(status) = 'overdue') AS overdue,
 count(*) FILTER (lower(status) LIKE '%flag%') AS flagged FROM invoices""",
    "invoices",
)
def _(s: Source):
    exact = s.invoices.withColumn("amount", F.col("amount").cast("decimal(18,4)"))
    return summaries.invoice_summary(exact).withColumn("total_amount", F.col("total_amount").cast("double"))


@query(
    "agg_shipment_summary",
    """SELECT count(*) AS shipments, count(*) FILTER (lower(status) LIKE '%transit%') AS in_transit, count(*) FILTER (lower(status) LIKE '%delay%') AS delayed,
 count(*) FILTER (lower(status) LIKE '%deliver%') AS delivered FROM shipments""",
    "shipments",
)
def _(s: Source):
    return summaries.shipment_summary(s.shipments)


@query(
    "agg_record_counts",
    """SELECT 'invoice' AS kind, count(*) AS records FROM invoices WHERE trim(invoice_id) NOT IN ('', 'invoice_id', 'shipment_id', 'item', 'quantity')
 UNION ALL SELECT 'shipment', count(*) FROM shipments WHERE trim(shipment_id) NOT IN ('', 'invoice_id', 'shipment_id', 'item', 'quantity')""",
    "invoices shipments",
)
def _(s: Source):
    return summaries.record_counts(invoice=(s.invoices, "invoice_id"), shipment=(s.shipments, "shipment_id"))


# raw rows as an upload brings them: some ids blank, some repeat the header, some are line items
RAW = """SELECT src_row, CASE WHEN approver = 'CFO' THEN '' WHEN approver = 'ops manager' THEN 'invoice_id' WHEN approver IS NULL THEN 'item'
 ELSE invoice_id END AS invoice_id, CASE WHEN status = 'flagged' THEN CAST('NaN' AS DOUBLE) ELSE amount END AS amount FROM {invoices}"""


@query(
    "clean_records",
    """SELECT src_row, invoice_id, CASE WHEN isnan(amount) THEN NULL ELSE amount END AS amount FROM raw
 WHERE trim(invoice_id) NOT IN ('', 'invoice_id', 'shipment_id', 'item', 'quantity')""",
    "invoices", raw=RAW.replace("{invoices}", "invoices"),
)
def _(s: Source):
    return summaries.clean_records(s.spark.sql(RAW, invoices=s.invoices), "invoice_id")


DOC_ROWS = "SELECT source, doc_type, length(content) AS size, doc_id FROM docs"


@query("agg_doc_counts_total", "SELECT doc_type, count(*) AS n FROM docs GROUP BY doc_type UNION ALL SELECT 'total', count(*) FROM docs", "docs")
def _(s: Source):
    return summaries.counts_with_total(s.docs, "doc_type")


@query(
    "agg_doc_stats",
    """SELECT event_type, count(*) AS n, max(ts) AS latest_update, arg_max(entity_id, ts) AS last_scenario FROM causal_events GROUP BY event_type""",
    "causal_events",
)
def _(s: Source):
    return summaries.doc_stats(s.causal_events, "event_type", "ts", "entity_id")


@query(
    "agg_last_update",
    "SELECT max(ts) AS last_update FROM causal_events",
    "causal_events",
)
def _(s: Source):
    stats = summaries.doc_stats(s.causal_events, "event_type", "ts", "entity_id")
    return stats.agg(F.max("latest_update").alias("last_update"))


@q(
    "agg_upload_summary",
    f"""SELECT file, characters, records, coalesce(anomalies, 0) AS anomalies, coalesce(high_risk, 0) AS high_risk, coalesce(medium_risk, 0) AS medium_risk,
 coalesce(low_risk, 0) AS low_risk FROM (SELECT supplier AS file, CAST(sum(length(invoice_id) + length(supplier) + length(payment_terms)) AS BIGINT) AS characters,
  count(*) AS records FROM invoices GROUP BY supplier) t LEFT JOIN (SELECT supplier AS file, count(*) AS anomalies, count(*) FILTER ({BAND3} = 'high') AS high_risk,
  count(*) FILTER ({BAND3} = 'medium') AS medium_risk, count(*) FILTER ({BAND3} = 'low') AS low_risk FROM store JOIN
  (SELECT src_row, supplier FROM invoices) i USING (src_row) GROUP BY supplier) a USING (file)""",
)
def _(s: Source):
    files = s.invoices.select(
        F.col("supplier").alias("file"), (F.length("invoice_id") + F.length("supplier") + F.length("payment_terms")).alias("characters")
    )
    rules = [inv.terms_violation(), inv.weekend(), inv.insufficient_approval(), inv.foreign_currency()]
    found = flag(termed(s), "invoice_id", *rules, keep=("supplier",)).withColumnRenamed("supplier", "file")
    return summaries.upload_summary(files, found.withColumn("risk_score", F.round("risk_score", 6)))


# --- sorts, top-k and ranks -----------------------------------------------------------------


def spread_store(s: Source) -> DataFrame:
    """The rows of ``store`` for a whole sort, which works out its input again to find its ranges: once if the tasks
    are even, twice if not. Rules run after the rows were dealt out, so no task has most of them."""
    return store(s, spread(termed(s), "src_row"))


@q("sort_recent", f"SELECT {COLS} FROM store ORDER BY ts DESC, id")
def _(s: Source):
    return slim(summaries.newest(spread_store(s)))


@q("sort_risk_recent", f"SELECT {COLS} FROM store ORDER BY risk_score DESC, ts DESC, id")
def _(s: Source):
    return slim(summaries.riskiest(spread_store(s)))


@q("topk_recent", f"SELECT {COLS} FROM store ORDER BY ts DESC, id LIMIT 10")
def _(s: Source):
    return slim(summaries.newest(store(s), 10))


@q("topk_high_risk", f"SELECT {COLS} FROM store WHERE risk_score >= 0.8 ORDER BY risk_score DESC, ts DESC, id LIMIT 3")
def _(s: Source):
    return slim(summaries.riskiest(store(s).where("risk_score >= 0.8"), 3))


@q(
    "win_top_per_type",
    f"SELECT {COLS}, rank FROM (SELECT *, row_number() OVER (PARTITION BY anomaly_type ORDER BY risk_score DESC, ts DESC, id) AS rank FROM store) x WHERE rank <= 5",
)
def _(s: Source):
    top = ranking.top_per_group(store(s), ["anomaly_type"], [F.desc("risk_score"), F.desc("ts"), F.col("id")], 5)
    return top.select(*COLS.split(", "), F.col("rank").cast("bigint").alias("rank"))


@q(
    "win_varied_sample",
    f"""SELECT {COLS}, band FROM (SELECT *, row_number() OVER (PARTITION BY band ORDER BY risk_score DESC, ts DESC, id) AS rn
 FROM (SELECT *, {BAND3} AS band FROM store) b) x WHERE rn <= CASE band WHEN 'low' THEN 1 ELSE 2 END""",
)
def _(s: Source):
    return ranking.varied_sample(store(s)).select(*COLS.split(", "), "band")


@query(
    "win_first_seen",
    "SELECT src_row, invoice_id, first_order, first_issue AS first_issue_date FROM (SELECT *, min(src_row) OVER (PARTITION BY invoice_id) AS first_order, "
    "first_value(issue_date) OVER (PARTITION BY invoice_id ORDER BY src_row) AS first_issue FROM invoices) x WHERE src_row > first_order",
    "invoices",
)
def _(s: Source):
    from ..operators.duplicates import first_seen

    return first_seen(s.invoices, "invoice_id", carry="issue_date").select("src_row", "invoice_id", "first_order", "first_issue_date")


# --- set operations -------------------------------------------------------------------------


@query(
    "union_sources",
    "SELECT 'invoice' AS kind, invoice_id AS record_id, amount, CAST(NULL AS VARCHAR) AS carrier FROM invoices "
    "UNION ALL SELECT 'shipment', shipment_id, CAST(NULL AS DOUBLE), carrier FROM shipments",
    "invoices shipments",
)
def _(s: Source):
    left = s.invoices.select(F.lit("invoice").alias("kind"), F.col("invoice_id").alias("record_id"), "amount")
    right = s.shipments.select(F.lit("shipment").alias("kind"), F.col("shipment_id").alias("record_id"), "carrier")
    return left.unionByName(right, allowMissingColumns=True)


@query(
    "union_anomalies",
    R["inv_weekend"] + " UNION ALL " + R["inv_currency"],
    "invoices",
)
def _(s: Source):
    old, new = (flag(s.invoices, "invoice_id", r) for r in (inv.weekend(), inv.foreign_currency()))
    return old.unionByName(new).select("src_row", "document_id", "anomaly_type", "risk_score", "severity")


@query(
    "distinct_carriers",
    "SELECT origin, destination, string_agg(DISTINCT carrier, ',' ORDER BY carrier) AS carriers FROM shipments GROUP BY origin, destination",
    "shipments",
)
def _(s: Source):
    routes = profiles.route_profile(s.shipments)
    return routes.select("origin", "destination", F.array_join("common_carriers", ",").alias("carriers"))


@query(
    "except_anomaly_events",
    "SELECT event_id, event_type, entity_id FROM causal_events WHERE event_type NOT LIKE '%anomaly%'",
    "causal_events",
)
def _(s: Source):
    return filters.without_anomaly_events(s.causal_events).select("event_id", "event_type", "entity_id")


# --- membership joins -----------------------------------------------------------------------


@query(
    "semi_blacklist",
    "SELECT src_row, shipment_id, carrier FROM shipments WHERE carrier IN (SELECT carrier FROM carrier_tier WHERE tier = 'blacklisted')",
    "shipments carrier_tier",
)
def _(s: Source):
    black = s.carrier_tier.where("tier = 'blacklisted'")
    return s.shipments.join(black, "carrier", "left_semi").select("src_row", "shipment_id", "carrier")


@query(
    "anti_approved",
    "SELECT src_row, shipment_id, carrier FROM nm WHERE NOT EXISTS (SELECT 1 FROM approved WHERE contains(lower(carrier), approved) OR contains(approved, lower(carrier)))",
    "named_shipments shipments", nm=SHIPPED["nm"], approved=SHIPPED["approved"],
)
def _(s: Source):
    from ..fixtures import APPROVED_BY_MODE

    names = F.array(*[F.lit(n.lower()) for n in sorted({n for v in APPROVED_BY_MODE.values() for n in v})])
    low = F.lower("carrier")
    near = F.exists(names, lambda n: low.contains(n) | n.contains(low))
    return s.named_shipments.where(~near).select("src_row", "shipment_id", "carrier")


@query(
    "anti_processed",
    "SELECT src_row, shipment_id FROM shipments WHERE shipment_id NOT IN (SELECT shipment_id FROM invoices WHERE status = 'flagged')",
    "shipments invoices",
)
def _(s: Source):
    done = s.invoices.where("status = 'flagged'").select("shipment_id")
    return s.shipments.join(done, "shipment_id", "left_anti").select("src_row", "shipment_id")
