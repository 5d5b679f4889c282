"""Round trips: a view is written in a format, read back by the operator and compared with the view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.sizing import sized
from ..operators import causal
from ..operators.anomaly import finish, flag
from ..operators.invoice_rules import foreign_currency, weekend
from ..sources import readers, routing, writers
from ..sources.scratch import scratch
from . import causality
from .catalog import RECORDS_AS_OF, Source, query
from .extraction import I_TEXT, P_TEXT, invoice_texts, policies
from .records import R
from .search import C as CHUNK_CTES, indexed

INV_COLS = "invoice_id, supplier, amount, currency, issue_date, due_date, payment_terms, early_discount, status, approver, shipment_id, notes"
SHP_COLS = "shipment_id, origin, destination, carrier, departure_date, estimated_arrival, actual_arrival, status, value, risk_score, anomaly_type, driver_id"


def csv_of(s: Source, rows: DataFrame, label: str) -> str:
    path = scratch(s.spark, label)
    rows.write.option("header", True).csv(path)
    return path


INVOICE_FILES_SQL = f"""SELECT {INV_COLS}, CAST(NULL AS VARCHAR) AS po_number FROM invoices WHERE status <> 'flagged'
 UNION ALL SELECT invoice_id, supplier, amount, NULL, NULL, due_date, payment_terms, NULL, status, NULL, NULL, notes, concat('PO-', src_row) FROM invoices WHERE status = 'flagged'
 UNION ALL SELECT concat('W-', s_suppkey), s_name, s_acctbal, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM supplier"""


@query("src_invoice_csv", INVOICE_FILES_SQL, "invoices")
def _(s: Source):
    return readers.read_csv_by_name(s.spark, invoice_files(s), schemas.INVOICE, "invoice_id").drop("file")


@query("src_invoice_csv_foreign", "SELECT concat(n_nationkey, ',', n_name) AS line FROM nation")
def _(s: Source):
    rows = readers.foreign_csv(s.spark, invoice_files(s), "invoice_id")
    return rows.where("line <> 'n_nationkey,n_name'").select("line")


def invoice_files(s: Source) -> str:
    """Files with other columns in another order, with sixty columns, and without an id column."""
    root = scratch(s.spark, "invoices")
    filler = [F.lit(i).alias(f"extra_{i}") for i in range(57)]
    wide = s.supplier.select(*filler, F.col("s_acctbal").alias("amount"), F.concat(F.lit("W-"), "s_suppkey").alias("invoice_id"), F.col("s_name").alias("supplier"))
    wide.write.options(header=True, escape='"').csv(f"{root}/c")
    s.nation.select("n_nationkey", "n_name").write.options(header=True, escape='"').csv(f"{root}/d")
    s.invoices.where("status <> 'flagged'").select(*INV_COLS.split(", ")).write.options(header=True, escape='"').csv(f"{root}/a")
    other = ["status", "notes", F.concat(F.lit("PO-"), "src_row").alias("po_number"), "supplier", "due_date", "payment_terms", "amount", "invoice_id"]
    s.invoices.where("status = 'flagged'").select(*other).write.options(header=True, escape='"').csv(f"{root}/b")
    return root


@query("src_shipment_csv", f"SELECT {SHP_COLS} FROM shipments", "shipments")
def _(s: Source):
    path = csv_of(s, s.shipments.select(*SHP_COLS.split(", ")), "shipments")
    ddl = ", ".join(f"{n} {t}" for n, t in schemas.columns(schemas.SHIPMENT) if n in SHP_COLS.split(", "))
    return readers.read_csv(s.spark, path, ddl)


@query(
    "src_priority_files",
    """SELECT invoice_id, status, priority FROM (SELECT invoice_id, status, 0 AS priority FROM first UNION ALL SELECT invoice_id, 'late' AS status, 1 AS priority
 FROM (SELECT DISTINCT invoice_id FROM invoices WHERE invoice_id NOT IN (SELECT invoice_id FROM first)) r) x""",
    "invoices",
    first="SELECT invoice_id, min(status) AS status FROM invoices WHERE approver = 'CFO' GROUP BY invoice_id",
)
def _(s: Source):
    root = scratch(s.spark, "priority")
    ids = s.invoices.groupBy("invoice_id").agg(F.min("status").alias("status"))
    first = s.invoices.where("approver = 'CFO'").groupBy("invoice_id").agg(F.min("status").alias("status"))
    first.write.option("header", True).csv(f"{root}/kind=comprehensive_invoices")
    ids.withColumn("status", F.lit("late")).write.option("header", True).csv(f"{root}/kind=other")
    rows = s.spark.read.option("header", True).csv(root).withColumnRenamed("kind", "file")
    best = readers.prefer_first(readers.with_priority(rows, "comprehensive"), "invoice_id")
    return best.select("invoice_id", "status", F.col("priority").cast("bigint").alias("priority"))


@query(
    "src_file_metadata",
    "SELECT invoice_id, amount, true AS named, true AS dated FROM invoices",
    "invoices",
)
def _(s: Source):
    path = csv_of(s, s.invoices.select("invoice_id", "amount"), "metadata")
    rows = readers.with_file(s.spark.read.schema("invoice_id string, amount double").option("header", True).csv(path))
    return rows.select("invoice_id", "amount", F.col("file").endswith(".csv").alias("named"), F.col("last_modified").isNotNull().alias("dated"))


ALERTS = "SELECT src_row AS alert_id, status AS alert_type, risk_score, 'shipment' AS scenario FROM shipments WHERE risk_score > 0.7"


@query("src_jsonl", "SELECT * FROM alerts", "shipments", alerts=ALERTS)
def _(s: Source):
    path = scratch(s.spark, "jsonl")
    rows = s.shipments.where("risk_score > 0.7").select(
        F.col("src_row").alias("alert_id"), F.col("status").alias("alert_type"), "risk_score", F.lit("shipment").alias("scenario")
    )
    writers.overwrite_jsonl(rows, path)
    return readers.read_jsonl(s.spark, path, schemas.ALERT).select("alert_id", "alert_type", "risk_score", "scenario")


@query(
    "src_json_document",
    "SELECT driver_id, name, risk_level AS current_risk FROM drivers WHERE risk_level IS NOT NULL",
    "drivers",
)
def _(s: Source):
    # one document per driver, each in a file of its own
    path = scratch(s.spark, "documents")
    rows = s.drivers.where("risk_level IS NOT NULL").select(
        F.to_json(F.struct("driver_id", "name", F.col("risk_level").alias("current_risk")), {"pretty": "true"}).alias("value"), F.col("driver_id").alias("part")
    )
    writers.one_file_each(rows, path, "part", "value")
    return readers.read_json_documents(s.spark, path, schemas.DRIVER_JSON).select("driver_id", "name", "current_risk")


def policy_files(s: Source, label: str) -> str:
    path = scratch(s.spark, label)
    writers.one_file_each(policies(s), path, "file", "content")
    return path


def name_of(file: str) -> Column:
    """The name ``writers.one_file_each`` was given."""
    return F.regexp_extract(file, "/([^/]+)~[0-9]+$", 1)


@query("src_policy_markdown", "SELECT file, content FROM pol", pol=P_TEXT)
def _(s: Source):
    rows = readers.read_policies(s.spark, policy_files(s, "policies"))
    # the writer ends every text with a line feed
    return rows.select(name_of("file").alias("file"), F.expr("substring(content, 1, length(content) - 1)").alias("content"))


@query(
    "src_text_encoding_fallback",
    "SELECT s_suppkey, CASE s_suppkey % 2 WHEN 0 THEN concat('Zahlung für ', s_name) ELSE concat('réglé à ', s_name) END AS content, s_suppkey % 2 = 0 AS is_utf8 FROM supplier",
)
def _(s: Source):
    root = scratch(s.spark, "encodings")
    text = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("Zahlung für "), "s_name")).otherwise(F.concat(F.lit("réglé à "), "s_name"))
    rows = s.supplier.select(text.alias("value"), F.col("s_suppkey").alias("part"))
    writers.one_file_each(rows.where("part % 2 = 0"), f"{root}/utf8", "part", "value", together=True)
    writers.one_file_each(rows.where("part % 2 = 1 AND value IS NOT NULL"), f"{root}/latin", "part", "value", "iso-8859-1", together=True)
    back = readers.read_text_any_encoding(s.spark, root)
    return back.select(
        name_of("file").cast("bigint").alias("s_suppkey"), F.regexp_replace("content", "\n$", "").alias("content"), "is_utf8"
    )


PATHS = """SELECT src_row, CASE status WHEN 'Delayed' THEN concat('/data/', anomaly_type, '/Shipment_', src_row, '.csv') WHEN 'Delivered' THEN concat('/data/invoices/', src_row, '.csv')
 ELSE CASE WHEN risk_score > 0.5 THEN concat('/data/x/driver_RISK_', driver_id, '.json') WHEN risk_score > 0.2 THEN concat('/data/policies/', src_row) ELSE '/data/other/a.csv' END END AS path FROM {shipments}"""


@query(
    "src_type_routing_by_name",
    """SELECT src_row, CASE WHEN path LIKE '%/invoices/%' OR name LIKE '%invoice%' THEN 'invoice' WHEN path LIKE '%/shipments/%' OR name LIKE '%shipment%' THEN 'shipment'
 WHEN path LIKE '%/policies/%' OR name LIKE '%policy%' THEN 'policy' WHEN name LIKE '%driver%' AND name LIKE '%risk%' THEN 'driver_risk' END AS kind
 FROM (SELECT *, lower(string_split(path, '/')[-1]) AS name FROM paths) x""",
    "shipments", paths=PATHS.replace("{shipments}", "shipments"),
)
def _(s: Source):
    return s.spark.sql(PATHS, shipments=s.shipments).select("src_row", routing.by_name("path").alias("kind"))


HEADS = """SELECT src_row, CASE status WHEN 'Delayed' THEN 'Shipment_ID,Carrier' WHEN 'Delivered' THEN 'id,Amount,carrier' ELSE CASE WHEN risk_score > 0.5 THEN 'Driver,score' ELSE 'a,b' END END AS head
 FROM {shipments}"""


@query(
    "src_type_routing_by_header",
    """SELECT src_row, CASE WHEN list_has_any(n, ['invoice', 'amount', 'supplier']) THEN 'invoice' WHEN list_has_any(n, ['shipment', 'origin', 'destination', 'carrier']) THEN 'shipment'
 WHEN list_has_any(n, ['driver', 'risk']) THEN 'driver_risk' END AS kind FROM (SELECT src_row, string_split(lower(head), ',') AS n FROM heads) x""",
    "shipments", heads=HEADS.replace("{shipments}", "shipments"),
)
def _(s: Source):
    rows = s.spark.sql(HEADS, shipments=s.shipments)
    return rows.select("src_row", routing.by_header(F.split("head", ",")).alias("kind"))


@query(
    "src_type_routing_files",
    f"""SELECT 'invoice' AS kind, invoice_id AS id FROM invoices UNION ALL SELECT 'shipment', shipment_id FROM shipments
 UNION ALL SELECT 'driver_risk', CAST(event_id AS VARCHAR) FROM events UNION ALL SELECT 'unknown', CAST(n_nationkey AS VARCHAR) FROM nation""",
    "invoices shipments",
)
def _(s: Source):
    root = scratch(s.spark, "mixed")
    cut = {  # file names that say nothing; the headers do
        "a": s.invoices.select("notes", F.col("amount").alias("Amount"), "invoice_id"),
        "b": s.shipments.select(F.col("carrier").alias("Carrier"), "shipment_id", "value"),
        "c": s.events.select("event_id", F.lit("x").alias("Driver")),
        "d": s.nation.select("n_nationkey", "n_name"),
    }
    for name, rows in cut.items():
        rows.write.option("header", True).option("escape", '"').csv(f"{root}/{name}")
    ids = {"invoice": "invoice_id", "shipment": "shipment_id", "driver_risk": "event_id", "unknown": "n_nationkey"}
    kinds = F.coalesce("kind", F.lit("unknown")).alias("kind")
    files = routing.files_by_header(s.spark, root).groupBy(kinds).agg(F.collect_list("file").alias("files")).collect()  # one path per file
    out = None
    for kind, paths in sorted(map(tuple, files)):
        rows = readers.read_csv_by_name(s.spark, paths, f"{ids[kind]} string", ids[kind])
        rows = rows.select(F.lit(kind).alias("kind"), F.col(ids[kind]).alias("id"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "src_type_routing_by_content",
    """SELECT id, CASE WHEN regexp_matches(t, 'invoice|bill|payment') THEN 'invoice' WHEN regexp_matches(t, 'shipment|shipping|transport|delivery') THEN 'shipment'
 WHEN regexp_matches(t, 'policy|guideline|procedure') THEN 'policy' END AS kind FROM (SELECT CAST(doc_id AS VARCHAR) AS id, lower(content) AS t FROM docs UNION ALL SELECT src_row, lower(text) FROM texts) x""",
    "docs invoices", texts=I_TEXT,
)
def _(s: Source):
    rows = s.docs.select(F.col("doc_id").cast("string").alias("id"), "content").unionByName(
        invoice_texts(s).select(F.col("src_row").alias("id"), F.col("text").alias("content"))
    )
    return rows.select("id", routing.by_content("content").alias("kind"))


# --- sinks ----------------------------------------------------------------------------------


@query("sink_index_jsonl", "SELECT doc_id, chunk_id, content, doc_type FROM chunks", "docs", chunks=CHUNK_CTES["chunks"])
def _(s: Source):
    path = scratch(s.spark, "index")
    rows = indexed(s).select("doc_id", "chunk_id", "content", "doc_type")
    writers.overwrite_jsonl(rows.limit(1), path)
    writers.overwrite_jsonl(rows, path)
    return readers.read_jsonl(s.spark, path, "doc_id bigint, chunk_id bigint, content string, doc_type string")


@query("idx_add_documents", "SELECT doc_id, chunk_id, doc_type, source, content FROM chunks", "docs", chunks=CHUNK_CTES["chunks"])
def _(s: Source):
    # stored type by type, invoices twice: nothing is kept twice
    path = scratch(s.spark, "chunks")
    rows = indexed(s).withColumn("key", F.concat_ws("-", "doc_id", "chunk_id"))
    writers.append_new(rows.where("doc_type = 'invoice'"), path, "key", "doc_type")
    writers.append_new(rows, path, "key", "doc_type")
    back = s.spark.read.parquet(path)
    return back.select("doc_id", F.col("chunk_id").cast("bigint").alias("chunk_id"), "doc_type", "source", "content")


@query(
    "sink_anomaly_store",
    "SELECT sha256(concat_ws('|', anomaly_type, document_id, src_row)) AS id, document_id, anomaly_type, risk_score, severity, DATE '" + RECORDS_AS_OF + "' AS detected_date FROM ("
    + R["inv_weekend"] + " UNION ALL " + R["inv_currency"] + ") x",
    "invoices",
)
def _(s: Source):
    path = scratch(s.spark, "anomalies")
    # the rules run once for both saves
    both = sized(finish(flag(s.invoices, "invoice_id", weekend(), foreign_currency()), RECORDS_AS_OF))
    writers.save_anomalies(both.where("anomaly_type = 'weekend_processing'"), path)
    writers.save_anomalies(both, path)  # the first part again: the store only grows by what is new
    return writers.load_anomalies(s.spark, path).select("id", "document_id", "anomaly_type", "risk_score", "severity", "detected_date")


@query(
    "sink_event_store",
    "SELECT 'event' AS kind, event_id AS id, entity_id FROM ev UNION ALL SELECT 'hold', hold_id, entity_id FROM holds",
    "causal_events", **{k: causality.CTES[k] for k in ("ev", "rules", "boosts", "alinks", "links")}, holds=causality.HOLDS,
)
def _(s: Source):
    folder = scratch(s.spark, "log")
    events, holds = s.causal_events, causality.holds(s)
    writers.save_log(events.where("entity_type = 'driver'"), holds, folder)
    writers.save_log(events, holds, folder)
    log, held = writers.load_log(s.spark, folder)
    return log.select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), "entity_id").unionByName(
        held.select(F.lit("hold").alias("kind"), F.col("hold_id").alias("id"), "entity_id")
    )


FEEDBACK = """SELECT ts, concat('question ', event_id) AS query, description AS answer, CAST(floor(value) AS INT) % 8 AS rating, event_type AS feedback FROM {causal_events}"""


@query(
    "sink_feedback",
    "SELECT query, rating, rating BETWEEN 1 AND 5 AS accepted FROM fb",
    "causal_events", fb=FEEDBACK.replace("{causal_events}", "causal_events"),
)
def _(s: Source):
    good, bad = scratch(s.spark, "feedback"), scratch(s.spark, "rejected")
    writers.save_feedback(s.spark.sql(FEEDBACK, causal_events=s.causal_events), good, bad)
    read = lambda path, ok: s.spark.read.parquet(path).select("query", "rating", F.lit(ok).alias("accepted"))
    return read(good, True).unionByName(read(bad, False))
