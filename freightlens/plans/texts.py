"""Queries that render records, unify updates, raise alerts and classify questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import refdata as ref
from ..operators import filters, questions, render
from .catalog import Source, query
from .store import CTES, VIEWS, store

_PCT = "printf('%.1f%%', early_discount * 100)"
_MONEY = "concat('$', format('{:,.2f}', amount))"


@query(
    "render_invoice_doc",
    f"""SELECT src_row, concat_ws(chr(10), concat('Invoice ID: ', invoice_id), concat('Supplier: ', supplier), concat('Amount: ', {_MONEY}, ' ', currency),
 concat('Issue Date: ', issue_date), concat('Due Date: ', due_date), concat('Payment Terms: ', payment_terms), concat('Early Discount: ', {_PCT}),
 concat('Status: ', status), concat('Approver: ', coalesce(approver, 'Unknown')), '',
 concat('This invoice shows payment terms of ', payment_terms, ' with an early payment discount of ', {_PCT}, '.'),
 concat('The invoice amount is ', {_MONEY}, ' and is currently ', status, '.')) AS content FROM invoices""",
    "invoices",
)
def _(s: Source):
    return s.invoices.select("src_row", render.invoice_doc().alias("content"))


@query(
    "render_invoice_doc_short",
    """SELECT src_row, concat('Invoice ', invoice_id, chr(10), 'Supplier: ', supplier, chr(10), 'Amount: ', currency, chr(10), 'Issue Date: ', issue_date, chr(10),
 'Due Date: ', due_date, chr(10), 'Payment Terms: ', payment_terms, chr(10)) AS content FROM invoices""",
    "invoices",
)
def _(s: Source):
    # the amount is rendered raw in this form, so a text column stands in for it here
    return s.invoices.withColumn("amount", F.col("currency")).select("src_row", render.invoice_doc_short().alias("content"))


@query(
    "render_shipment_doc",
    """SELECT src_row, concat_ws(chr(10), concat('Shipment ID: ', shipment_id), concat('Route: ', origin, ' → ', destination), concat('Carrier: ', carrier),
 concat('Departure Date: ', departure_date), concat('Estimated Arrival: ', estimated_arrival), concat('Actual Arrival: ', coalesce(CAST(actual_arrival AS VARCHAR), 'TBD')),
 concat('Status: ', status), concat('Risk Score: ', printf('%.2f', risk_score)), concat('Anomaly Type: ', anomaly_type), '',
 concat('This shipment is traveling from ', origin, ' to ', destination, ' '), concat('via ', carrier, '. Current status is ', status, ' '),
 concat('with a risk score of ', printf('%.2f', risk_score), '.'),
 CASE WHEN anomaly_type <> 'none' THEN concat('Detected anomaly: ', anomaly_type) ELSE 'No anomalies detected.' END) AS content FROM shipments""",
    "shipments",
)
def _(s: Source):
    return s.shipments.select("src_row", render.shipment_doc().alias("content"))


@query(
    "render_shipment_doc_short",
    """SELECT src_row, concat('Shipment ', shipment_id, chr(10), 'Origin: ', origin, chr(10), 'Destination: ', destination, chr(10), 'Carrier: ', carrier, chr(10),
 'Status: ', status, chr(10)) AS content FROM shipments""",
    "shipments",
)
def _(s: Source):
    return s.shipments.select("src_row", render.shipment_doc_short().alias("content"))


DRIVER_TEXT = """concat('Driver ', name, ' risk level: ', coalesce(risk_level, 'Unknown'), '. Last incident: ', coalesce(last_incident, 'None'),
 '. Recommendation: ', coalesce(recommendation, 'Standard monitoring'), '.')"""


@query("render_driver_doc", f"SELECT driver_id, {DRIVER_TEXT} AS content FROM drivers", "drivers")
def _(s: Source):
    return s.drivers.select("driver_id", render.driver_doc().alias("content"))


@query(
    "render_upload_doc",
    """SELECT c_custkey, concat('Uploaded document processed. Content: ', substr(CAST(to_json({'c_custkey': c_custkey, 'c_name': c_name, 'c_nationkey': c_nationkey,
 'c_acctbal': c_acctbal, 'c_mktsegment': c_mktsegment}) AS VARCHAR), 1, 500), '...') AS content FROM customer""",
)
def _(s: Source):
    cols = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
    return s.customer.select("c_custkey", render.upload_doc(F.struct(*cols)).alias("content"))


@query(
    "render_anomaly_doc",
    """SELECT id, concat_ws(chr(10), 'ANOMALY DETECTED:', concat('ID: ', id), concat('Document: ', document_id), concat('Type: ', anomaly_type),
 concat('Severity: ', coalesce(severity, 'unknown')), concat('Risk Score: ', risk_score), 'Description: No description',
 concat('Evidence: ', anomaly_type, ' | ', document_id), concat('Recommendations: ', coalesce(severity, 'none')),
 concat('Timestamp: ', strftime(ts, '%Y-%m-%dT%H:%M:%S'))) AS content FROM store""",
    VIEWS, **CTES,
)
def _(s: Source):
    rows = store(s).select(
        "*", F.lit(None).cast("string").alias("description"), F.array("anomaly_type", "document_id").alias("evidence"),
        F.array(F.coalesce("severity", F.lit("none"))).alias("recommendations"),
    )
    return rows.select("id", render.anomaly_doc().alias("content"))


INVOICE_TEXT = f"concat('Invoice ', invoice_id, ' from ', supplier, '. Amount: ', {_MONEY}, '. Payment terms: ', payment_terms, '. Due date: ', due_date, '. Status: ', status, '.')"
SHIPMENT_TEXT = """concat('Shipment ', shipment_id, ' route ', origin, ' → ', destination, '. Carrier: ', carrier, '. Status: ', status,
 '. Risk score: ', printf('%.2f', risk_score), '. Anomaly type: ', anomaly_type, '.')"""
_NULLS = "CAST(NULL AS VARCHAR)"
UPDATES = f"""SELECT 'driver_risk' AS update_type, {DRIVER_TEXT} AS content, 'driver_update' AS doc_type, risk_level AS risk_level, CAST(NULL AS DOUBLE) AS amount,
  CAST(NULL AS DOUBLE) AS risk_score, {_NULLS} AS anomaly_type, {_NULLS} AS policy_type, '{ref.SCENARIOS['driver_risk']}' AS scenario FROM drivers
 UNION ALL SELECT 'invoice_compliance', {INVOICE_TEXT}, 'invoice_update', NULL, amount, NULL, NULL, NULL, 'invoice_compliance' FROM invoices
 UNION ALL SELECT 'shipment_anomaly', {SHIPMENT_TEXT}, 'shipment_update', NULL, NULL, risk_score, anomaly_type, NULL, 'shipment_fraud_detection' FROM shipments
 UNION ALL SELECT 'policy_update', content, 'policy_update', NULL, NULL, NULL, NULL, 'general', 'policy_compliance' FROM docs WHERE doc_type = 'policy'
 UNION ALL SELECT 'user_upload', concat('Uploaded document processed. Content: ', substr(CAST(to_json({{'n_nationkey': n_nationkey, 'n_name': n_name,
  'n_regionkey': n_regionkey}}) AS VARCHAR), 1, 500), '...'), 'upload', NULL, NULL, NULL, NULL, NULL, 'user_upload' FROM nation"""
UPDATE_VIEWS = "drivers invoices shipments docs"


def updates(s: Source):
    return render.unify(
        render.driver_updates(s.drivers),
        render.invoice_updates(s.invoices),
        render.shipment_updates(s.shipments),
        render.policy_updates(s.docs.where("doc_type = 'policy'").select(F.col("source").alias("file"), "content")),
        render.upload_updates(s.nation.select("n_nationkey", "n_name", "n_regionkey")),
    )


@query("unify_updates", "SELECT * FROM updates", UPDATE_VIEWS, updates=UPDATES)
def _(s: Source):
    m = F.col("metadata")
    return updates(s).select(
        "update_type", "content", m["doc_type"].alias("doc_type"), m["risk_level"].alias("risk_level"),
        m["amount"].cast("double").alias("amount"), m["risk_score"].cast("double").alias("risk_score"),
        m["anomaly_type"].alias("anomaly_type"), m["policy_type"].alias("policy_type"), "scenario",
    )


HIGH = """(doc_type = 'driver_update' AND lower(risk_level) = 'high') OR (doc_type = 'invoice_update' AND (amount > 10000 OR lower(content) LIKE '%overdue%'))
 OR (doc_type = 'shipment_update' AND (risk_score > 0.7 OR anomaly_type <> 'none'))"""


@query("update_is_high_risk", f"SELECT update_type, content FROM updates WHERE {HIGH}", UPDATE_VIEWS, updates=UPDATES)
def _(s: Source):
    return updates(s).where(filters.is_high_risk_update()).select("update_type", "content")


@query(
    "alert_type",
    """SELECT update_type, CASE doc_type WHEN 'driver_update' THEN 'driver_risk_escalation' WHEN 'invoice_update' THEN 'invoice_compliance_violation'
 WHEN 'shipment_update' THEN 'shipment_anomaly_detected' ELSE 'general_alert' END AS alert_type, count(*) AS n FROM updates GROUP BY ALL""",
    UPDATE_VIEWS, updates=UPDATES,
)
def _(s: Source):
    return updates(s).groupBy("update_type", filters.alert_type().alias("alert_type")).agg(F.count("*").alias("n"))


@query(
    "alert_description",
    """SELECT doc_id, concat(CASE WHEN lower(content) LIKE '%high risk%' THEN '🚨 HIGH RISK ALERT: ' WHEN lower(content) LIKE '%anomaly%' THEN '⚠️ ANOMALY DETECTED: '
 WHEN lower(content) LIKE '%compliance%' THEN '📋 COMPLIANCE ISSUE: ' ELSE 'ℹ️ UPDATE: ' END, substr(content, 1, 200), '...') AS description FROM docs""",
    "docs",
)
def _(s: Source):
    return s.docs.select("doc_id", filters.alert_description().alias("description"))


@query(
    "alert_risk_score",
    """SELECT update_type, content, CASE WHEN doc_type = 'driver_update' AND risk_level = 'high' THEN CAST(0.9 AS DOUBLE) WHEN doc_type = 'invoice_update'
 THEN least(CAST(0.95 AS DOUBLE), amount / 50000) WHEN doc_type = 'shipment_update' THEN risk_score ELSE CAST(0.5 AS DOUBLE) END AS risk_score FROM updates""",
    UPDATE_VIEWS, updates=UPDATES,
)
def _(s: Source):
    return updates(s).select("update_type", "content", filters.alert_risk_score().alias("risk_score"))


@query(
    "policy_type_class",
    """SELECT doc_id, CASE WHEN lower(source) LIKE '%payout%' THEN 'payout' WHEN lower(source) LIKE '%shipment%' THEN 'shipment' ELSE 'general' END AS by_file,
 CASE WHEN lower(content) LIKE '%payment%' THEN 'payment' WHEN lower(content) LIKE '%shipment%' THEN 'shipment' WHEN lower(content) LIKE '%driver%' THEN 'driver'
 ELSE 'general' END AS by_text FROM pol""",
    "docs invoices",
    pol="SELECT doc_id, concat(doc_type, '-rules ', source) AS source, content FROM docs UNION ALL SELECT 0, 'payout-rules-v3.md', concat('payment terms ', payment_terms) FROM invoices",
)
def _(s: Source):
    texts = s.docs.select("doc_id", F.concat("doc_type", F.lit("-rules "), "source").alias("source"), "content")
    rows = texts.unionByName(
        s.invoices.select(
            F.lit(0).cast("bigint").alias("doc_id"), F.lit("payout-rules-v3.md").alias("source"),
            F.concat(F.lit("payment terms "), "payment_terms").alias("content"),
        )
    )
    return rows.select(
        "doc_id", render.policy_type_of_file("source").alias("by_file"), render.policy_type_of_text("content").alias("by_text")
    )


# --- questions ------------------------------------------------------------------------------

# question texts: what users wrote, and one question about every shipment and supplier
QUESTIONS = """SELECT concat('C-', conv_id, '-', turn) AS query_id, text AS question FROM {conversations} WHERE role = 'user'
 UNION ALL SELECT concat('S-', src_row), CASE status WHEN 'Delayed' THEN concat('Why was shipment ', shipment_id, ' late, what caused the delay?')
  WHEN 'Delivered' THEN concat('Show invoice #', right(shipment_id, 3), ' of ', carrier)
  ELSE concat('how many parcels went to ', destination, ' under the policy') END FROM {shipments}
 UNION ALL SELECT concat('P-', s_suppkey), CASE s_suppkey % 3 WHEN 0 THEN concat('What is the late fee of INV-2025-00', s_suppkey, ' and shp-2024-', 100 + s_suppkey)
  WHEN 1 THEN concat('is supplier ', s_name, ' suspicious') ELSE concat('calculate total cost of ', s_name) END FROM {supplier}"""
Q_CTE = dict(questions=QUESTIONS.replace("{conversations}", "conversations").replace("{shipments}", "shipments").replace("{supplier}", "supplier"))


def asked(s: Source):
    return s.spark.sql(QUESTIONS, conversations=s.conversations, shipments=s.shipments, supplier=s.supplier)


def _any(words, col="lower(question)"):
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


def _choice(choices, default):
    return "CASE " + " ".join(f"WHEN {_any(w)} THEN '{label}'" for label, w in choices) + f" ELSE {default} END"


_I, _S, _P = _any(ref.INVOICE_TERMS), _any(ref.SHIPMENT_TERMS), _any(ref.POLICY_TERMS)


@query(
    "classify_query_doc_types",
    f"""SELECT query_id, CASE WHEN NOT ({_I} OR {_S} OR {_P}) THEN 'invoice,shipment' ELSE concat_ws(',', CASE WHEN {_I} THEN 'invoice' END,
 CASE WHEN {_S} THEN 'shipment' END, CASE WHEN {_P} THEN 'policy' END) END AS doc_types FROM questions""",
    "shipments", **Q_CTE,
)
def _(s: Source):
    return asked(s).select("query_id", F.array_join(questions.doc_types("question"), ",").alias("doc_types"))


@query("classify_query_route", f"SELECT query_id, {_choice(ref.ROUTES, 'NULL')} AS route FROM questions", "shipments", **Q_CTE)
def _(s: Source):
    return asked(s).select("query_id", questions.route("question").alias("route"))


@query("classify_query_causal", f"SELECT query_id, {_any(ref.CAUSAL_TERMS)} AS causal FROM questions", "shipments", **Q_CTE)
def _(s: Source):
    return asked(s).select("query_id", questions.is_causal("question").alias("causal"))


@query("classify_query_intent", "SELECT query_id, " + _choice(ref.INTENTS, "'general'") + " AS intent FROM questions", "shipments", **Q_CTE)
def _(s: Source):
    return asked(s).select("query_id", questions.intent("question").alias("intent"))


_IDS = " || ".join(f"regexp_extract_all(question, '{p.replace('(?i)', '')}', {g}, 'i')" for p, g in questions.ID_PATTERNS)


@query("extract_entity_ids", f"SELECT query_id, unnest({_IDS}) AS entity_id FROM questions", "shipments", **Q_CTE)
def _(s: Source):
    return asked(s).select("query_id", F.explode(questions.entity_ids("question")).alias("entity_id"))
