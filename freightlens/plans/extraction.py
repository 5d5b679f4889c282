"""Queries that read fields out of text rendered from the records, and out of policy texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import refdata as ref
from ..operators import extract, validity
from .catalog import RECORDS_AS_OF, Source, query

# one text per invoice; the layout changes with the approver so that every fallback is used
INVOICE_TEXTS = """SELECT src_row, CASE approver
 WHEN 'CFO' THEN concat('Invoice #', shipment_id, chr(10), 'Vendor: Acme ', supplier, chr(10), 'pay €', CAST(CAST(floor(l) AS BIGINT) AS {s}), '.50 now', chr(10), 'terms are net ', n, chr(10),
  n % 7, '% discount if paid within 10 days')
 WHEN 'junior.clerk' THEN concat('INV:', n, ' From: Some, Co.', chr(10), 'no total here, due in ', n, ' days')
 WHEN 'ops manager' THEN concat('hello ', supplier)
 ELSE concat('Invoice Number: ', invoice_id, chr(10), 'Supplier: ', supplier, chr(10), 'Total: $1,', 100 + n, '.25', chr(10), 'Currency: ', currency, chr(10),
  'Invoice Date: ', issue_date, chr(10), 'Due Date: ', n % 28 + 1, '/', n % 12 + 1, '/2024', chr(10), 'Payment Terms: ', payment_terms, chr(10), 'Early Payment: ', n % 9, '.5%', chr(10),
  'Shipment ID: ', shipment_id) END AS text
FROM (SELECT *, length(invoice_id) + CAST(floor(amount) AS BIGINT) % 90 AS n, amount AS l FROM {invoices}) i"""
SHIPMENT_TEXTS = """SELECT src_row, CASE status
 WHEN 'Delayed' THEN concat('Tracking #: ', shipment_id, chr(10), 'Pickup: ', origin, chr(10), 'Delivery: ', destination, chr(10), 'Shipper: ', carrier, chr(10), 'Ship Date: ', departure_date, chr(10),
  'behind schedule')
 WHEN 'Delivered' THEN concat('Waybill Number: ', shipment_id, chr(10), 'Origin: Port of ', origin, chr(10), 'To: ', destination, chr(10), 'Carrier: ', carrier, chr(10),
  'Expected Delivery Date: 2024/1/5', chr(10), 'Operator Number: ', driver_id, chr(10), 'Completed')
 ELSE concat('about a parcel from ', origin, ', waiting') END AS text FROM {shipments}"""
POLICIES = """SELECT s_suppkey AS policy_id, concat(CASE s_suppkey % 3 WHEN 0 THEN 'payout' WHEN 1 THEN 'shipment' ELSE 'travel' END, '-rules-', s_suppkey, '.md') AS file,
 concat(CASE WHEN s_suppkey % 5 = 0 THEN 'preamble' ELSE '' END, chr(10), '# Rules Version ', s_suppkey % 4, '.', s_nationkey, chr(10), chr(10), '## Fees', chr(10),
  'Invoices past due:', chr(10), 'A late fee of ', 1 + s_suppkey % 3, '.5% applies per month', chr(10), 'grace is 10 days', chr(10), 'end of fees', chr(10), 'Approval Limits:', chr(10),
  'manager approval to $', 10 + s_suppkey % 9, ',000, director to $', 20 + s_suppkey % 20, ',500', CASE WHEN s_suppkey % 2 = 0 THEN ', cfo from $75,000' ELSE '' END, chr(10),
  '## International Air Freight', chr(10), '- Carrier ', s_suppkey % 12, chr(10), '- Air Express International', chr(10), '## Domestic Ground', chr(10), '- Truck ', s_nationkey, ' -', chr(10),
  '## Suppliers', chr(10), '### 1.1 ', s_name, chr(10), 'Payment terms: NET', 15 * (1 + s_suppkey % 4), chr(10), 'Early payment discount: ', s_suppkey % 3, '.5%', chr(10),
  '### 1.2 Orion Electronics', chr(10), 'Payment terms: NET', s_suppkey % 90, chr(10), CASE WHEN s_suppkey % 4 = 0 THEN 'Late payment penalty: 3%' ELSE '' END, chr(10),
  CASE WHEN s_suppkey % 6 = 0 THEN concat('## Fees', chr(10), 'second text') ELSE '' END) AS content FROM {supplier}"""

I_TEXT = INVOICE_TEXTS.replace("{invoices}", "invoices").replace("{s}", "VARCHAR")
S_TEXT = SHIPMENT_TEXTS.replace("{shipments}", "shipments")
P_TEXT = POLICIES.replace("{supplier}", "supplier")


def invoice_texts(s: Source):
    return s.spark.sql(INVOICE_TEXTS.replace("{s}", "STRING"), invoices=s.invoices)


def shipment_texts(s: Source):
    return s.spark.sql(SHIPMENT_TEXTS, shipments=s.shipments)


def policies(s: Source):
    return s.spark.sql(POLICIES, supplier=s.supplier)


def _rx(p: str) -> tuple[str, str]:
    return p.replace("(?i)", "").replace("'", "''"), "'i'" if p.startswith("(?i)") else "'c'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def grp(p: str, text: str = "text") -> str:
    rx, fl = _rx(p)
    found = strip(f"regexp_extract({text}, '{rx}', 1, {fl})")
    return f"CASE WHEN regexp_matches({text}, '{rx}', {fl}) THEN {found} END"


def first(ps, text: str = "text") -> str:
    return "coalesce(" + ", ".join(grp(p, text) for p in ps) + ")"


def iso(x: str) -> str:
    fmts = "['%Y-%m-%d', '%Y/%m/%d', '%d-%m-%Y', '%d/%m/%Y', '%m-%d-%Y', '%m/%d/%Y']"
    return f"coalesce(strftime(try_strptime({x}, {fmts}), '%Y-%m-%d'), {x})"


def _amount() -> str:
    return "coalesce(" + ", ".join(f"TRY_CAST(replace({grp(p)}, ',', '') AS DOUBLE)" for p in extract.AMOUNT) + ", CAST(0 AS DOUBLE))"


_TERMS = f"coalesce(CASE WHEN regexp_matches({first(extract.TERMS)}, '^[0-9]+') THEN concat('NET', {first(extract.TERMS)}) ELSE {first(extract.TERMS)} END, 'NET30')"
_DISC = f"coalesce(TRY_CAST({first(extract.DISCOUNT)} AS DOUBLE) / CAST(100 AS DOUBLE), CAST(0 AS DOUBLE))"
_STATUS = "CASE " + " ".join(f"WHEN regexp_matches(text, '{_rx(p)[0]}', 'i') THEN '{label}'" for label, p in extract.STATUS) + " ELSE 'unknown' END"


@query(
    "ext_invoice_fields",
    f"""SELECT src_row, coalesce({first(extract.INVOICE_ID)}, concat('INV-', src_row)) AS invoice_id, {grp(extract.SUPPLIER)} AS supplier, {_amount()} AS amount,
 coalesce({grp(extract.CURRENCY)}, 'USD') AS currency, {iso(grp(extract.ISSUE_DATE))} AS issue_date, {iso(grp(extract.DUE_DATE))} AS due_date,
 {_TERMS} AS payment_terms, {_DISC} AS early_discount, {grp(extract.INVOICE_SHIPMENT)} AS shipment_id FROM t""",
    "invoices", t=I_TEXT,
)
def _(s: Source):
    return extract.invoice_fields(invoice_texts(s), "text", F.col("src_row")).drop("text")


@query(
    "ext_invoice_fields_loose",
    f"""SELECT src_row, coalesce({grp(extract.LOOSE_INVOICE_ID)}, concat('INV-', src_row)) AS invoice_id,
 coalesce(TRY_CAST(replace({grp(extract.LOOSE_AMOUNT)}, ',', '') AS DOUBLE), CAST(0 AS DOUBLE)) AS amount,
 coalesce(substr({grp(extract.LOOSE_SUPPLIER)}, 1, 50), 'Unknown Supplier') AS supplier, {grp(extract.LOOSE_DATE)} AS issue_date FROM t""",
    "invoices", t=I_TEXT,
)
def _(s: Source):
    rows = extract.loose_invoice_fields(invoice_texts(s), "text", F.col("src_row"))
    return rows.select("src_row", "invoice_id", "amount", "supplier", "issue_date")


@query(
    "ext_shipment_fields",
    f"""SELECT src_row, {grp(extract.SHIPMENT_ID)} AS shipment_id, {grp(extract.ORIGIN)} AS origin, {grp(extract.DESTINATION)} AS destination, {grp(extract.CARRIER)} AS carrier,
 {iso(grp(extract.DEPARTURE))} AS departure_date, {iso(grp(extract.ARRIVAL))} AS estimated_arrival, {_STATUS} AS status, {grp(extract.DRIVER)} AS driver_id FROM t""",
    "shipments", t=S_TEXT,
)
def _(s: Source):
    return extract.shipment_fields(shipment_texts(s), "text").drop("text")


@query(
    "ext_shipment_fields_loose",
    f"""SELECT src_row, coalesce({grp(extract.LOOSE_SHIPMENT_ID)}, concat('SHP-', src_row)) AS shipment_id, substr({grp(extract.LOOSE_ORIGIN)}, 1, 50) AS origin,
 substr({grp(extract.LOOSE_DESTINATION)}, 1, 50) AS destination, coalesce(substr({grp(extract.LOOSE_CARRIER)}, 1, 50), 'Unknown Carrier') AS carrier FROM t""",
    "shipments", t=S_TEXT,
)
def _(s: Source):
    rows = extract.loose_shipment_fields(shipment_texts(s), "text", F.col("src_row"), RECORDS_AS_OF)
    return rows.select("src_row", "shipment_id", "origin", "destination", "carrier")


RAW_DATES = """SELECT src_row, CASE approver WHEN 'CFO' THEN concat(day(issue_date), '/', month(issue_date), '/', year(issue_date))
 WHEN 'john.smith' THEN concat(month(issue_date), '-', day(issue_date), '-', year(issue_date)) WHEN 'ops manager' THEN concat(year(issue_date), '/', month(issue_date), '/', day(issue_date))
 WHEN 'junior.clerk' THEN 'sometime soon' ELSE concat('', issue_date) END AS raw FROM {invoices}"""


@query("ext_date_normalise", f"SELECT src_row, raw, {iso('raw')} AS day FROM t", "invoices", t=RAW_DATES.replace("{invoices}", "invoices"))
def _(s: Source):
    return s.spark.sql(RAW_DATES, invoices=s.invoices).select("src_row", "raw", extract.normal_date("raw").alias("day"))


@query("ext_payment_terms", f"SELECT src_row, {_TERMS} AS payment_terms FROM t", "invoices", t=I_TEXT)
def _(s: Source):
    return extract.payment_terms(invoice_texts(s), "text").select("src_row", "payment_terms")


@query("ext_early_discount", f"SELECT src_row, {_DISC} AS early_discount FROM t", "invoices", t=I_TEXT)
def _(s: Source):
    return invoice_texts(s).select("src_row", extract.early_discount("text").alias("early_discount"))


@query("ext_status", f"SELECT src_row, {_STATUS} AS status FROM t", "shipments", t=S_TEXT)
def _(s: Source):
    return shipment_texts(s).select("src_row", extract.status("text").alias("status"))


@query(
    "ext_line_items",
    """SELECT l_orderkey, l_linenumber, p_name AS description, l_quantity AS quantity, coalesce(p_retailprice, 0) AS unit_price, l_extendedprice AS amount
 FROM lineitem JOIN part ON l_partkey = p_partkey""",
)
def _(s: Source):
    rows = s.lineitem.join(s.part, F.col("l_partkey") == F.col("p_partkey")).select(
        "l_orderkey", "l_linenumber", F.col("p_name").alias("Product"), F.col("l_quantity").cast("string").alias("Qty"),
        F.col("p_retailprice").alias("Rate"), F.col("l_extendedprice").alias("Line Total"),
    )
    return extract.line_items(rows, "l_orderkey", "l_linenumber")


@query(
    "ext_shipment_items",
    """SELECT l_orderkey, l_linenumber, p_name AS item, l_quantity AS quantity, l_extendedprice AS value, CAST(p_size AS DOUBLE) AS weight, p_type AS dimensions
 FROM lineitem JOIN part ON l_partkey = p_partkey""",
)
def _(s: Source):
    rows = s.lineitem.join(s.part, F.col("l_partkey") == F.col("p_partkey")).select(
        "l_orderkey", "l_linenumber", F.col("p_name").alias("Goods"), F.col("l_quantity").alias("Count"),
        F.col("l_extendedprice").alias("Worth"), F.col("p_size").alias("KG"), F.col("p_type").alias("Size"),
    )
    return extract.shipment_items(rows, "l_orderkey", "l_linenumber")


_HDR = "(?m)^#+[ \\t\\r\\n]+(?:.*?)$|^(?:[A-Z][A-Za-z\\s]+):$"


@query(
    "ext_policy_sections",
    f"""SELECT policy_id, arg_max(pos, pos) AS pos, title, arg_max(body, pos) AS body FROM (
 SELECT policy_id, pos, regexp_replace(CASE WHEN titles[pos] LIKE '#%' THEN regexp_replace(titles[pos], '^#+\\s+', '') ELSE regexp_replace(titles[pos], ':$', '') END, '^\\s+|\\s+$', '', 'g') AS title,
  {strip("blocks[pos]")} AS body FROM (SELECT policy_id, titles, CASE WHEN {strip("parts[1]")} = '' THEN parts[2:] ELSE parts END AS blocks, unnest(generate_series(1, len(titles))) AS pos
  FROM (SELECT policy_id, regexp_extract_all(content, '{_HDR}') AS titles, string_split_regex(content, '{_HDR}') AS parts FROM pol) a) b) z GROUP BY policy_id, title""",
    pol=P_TEXT,
)
def _(s: Source):
    rows = policies(s).select("policy_id", F.posexplode(extract.policy_sections("content")).alias("at", "x"))
    # position among all headers of the text, as the header list has it
    return (
        policies(s)
        .select("policy_id", F.posexplode(F.regexp_extract_all("content", F.lit(extract.HEADER), F.lit(0))).alias("p", "h"))
        .withColumn("title", extract.strip(F.regexp_replace(F.regexp_replace("h", r"^#+\s+", ""), ":$", "")))
        .groupBy("policy_id", "title")
        .agg((F.max("p") + 1).cast("bigint").alias("pos"))
        .join(rows.select("policy_id", "x.title", "x.body"), ["policy_id", "title"])
    )


@query("ext_policy_version", f"SELECT policy_id, {grp(extract.POLICY_VERSION, 'content')} AS version FROM pol", pol=P_TEXT)
def _(s: Source):
    return policies(s).select("policy_id", extract.policy_version("content").alias("version"))


_LINES = """SELECT policy_id, pos, line, own, max_by(own, CASE WHEN own IS NOT NULL THEN pos END) OVER (PARTITION BY policy_id ORDER BY pos) AS mode FROM (
 SELECT policy_id, pos, lines[pos] AS line, CASE WHEN lines[pos] LIKE '%International Air Freight%' THEN 'air' WHEN lines[pos] LIKE '%International Ocean Freight%' THEN 'ocean'
 WHEN lines[pos] LIKE '%Domestic Ground%' THEN 'ground' END AS own FROM (SELECT policy_id, string_split(content, chr(10)) AS lines,
 unnest(generate_series(1, len(string_split(content, chr(10))))) AS pos FROM pol) a) b"""


@query("win_running_mode", "SELECT policy_id, pos - 1 AS pos, line, mode FROM lm", pol=P_TEXT, lm=_LINES)
def _(s: Source):
    return extract.lines_with_mode(policies(s), "policy_id").select("policy_id", F.col("pos").cast("bigint").alias("pos"), "line", "mode")


@query(
    "ext_policy_carriers",
    "SELECT DISTINCT policy_id, mode, regexp_replace(line, '^[- ]+|[- ]+$', '', 'g') AS carrier FROM lm WHERE own IS NULL AND line LIKE '- %' AND mode IS NOT NULL",
    pol=P_TEXT, lm=_LINES,
)
def _(s: Source):
    return extract.policy_carriers(policies(s), "policy_id")


@query(
    "ext_policy_terms",
    """SELECT supplier, coalesce(new_terms, terms) AS terms, coalesce(new_discount, discount) AS discount, coalesce(new_penalty, penalty) AS penalty
 FROM known LEFT JOIN (SELECT supplier, max_by(t, CASE WHEN t IS NOT NULL THEN policy_id END) AS new_terms,
 max_by(d, CASE WHEN d IS NOT NULL THEN policy_id END) AS new_discount, max_by(p, CASE WHEN p IS NOT NULL THEN policy_id END) AS new_penalty
 FROM (SELECT policy_id, regexp_extract(piece, '^[0-9]+\\.[0-9]+ ([^\\n]+)\\n', 1) AS supplier, nullif(regexp_extract(piece, 'Payment terms: (NET[0-9]+)', 1), '') AS t,
  TRY_CAST(regexp_extract(piece, 'Early payment discount: ([0-9]+(?:\\.[0-9]+)?)%', 1) AS DOUBLE) / 100 AS d,
  TRY_CAST(regexp_extract(piece, 'Late payment penalty: ([0-9]+(?:\\.[0-9]+)?)%', 1) AS DOUBLE) / 100 AS p
  FROM (SELECT policy_id, unnest(string_split(content, '### ')[2:]) AS piece FROM pol) a) b GROUP BY supplier) n USING (supplier)""",
    pol=P_TEXT,
    known="SELECT s_name AS supplier, 'NET30' AS terms, CAST(0.02 AS DOUBLE) AS discount, CAST(0.015 AS DOUBLE) AS penalty FROM supplier WHERE s_suppkey % 3 > 0 "
    "UNION ALL SELECT 'Orion Electronics', 'NET30', CAST(0.02 AS DOUBLE), CAST(0.015 AS DOUBLE)",
)
def _(s: Source):
    known = s.spark.sql(
        "SELECT s_name AS supplier, 'NET30' AS terms, CAST(0.02 AS DOUBLE) AS discount, CAST(0.015 AS DOUBLE) AS penalty FROM {supplier} "
        "WHERE s_suppkey % 3 > 0 UNION ALL SELECT 'Orion Electronics', 'NET30', CAST(0.02 AS DOUBLE), CAST(0.015 AS DOUBLE)",
        supplier=s.supplier,
    )
    return extract.override_terms(known, policies(s), "policy_id")


_AMT = "list_transform(regexp_extract_all(content, '\\$(\\d{1,3}(?:,\\d{3})*)', 1), lambda a: CAST(replace(a, ',', '') AS BIGINT))"


@query(
    "ext_policy_rates",
    f"""SELECT policy_id, TRY_CAST(regexp_extract(lower(content), '(\\d+\\.?\\d*)%.*per month', 1) AS DOUBLE) / 100 AS late_fee_rate,
 CASE WHEN c THEN list_filter(a, lambda x: x >= 50000)[-1] END AS cfo, list_filter(a, lambda x: NOT (c AND x >= 50000) AND x >= 20000)[-1] AS director,
 list_filter(a, lambda x: x < 20000 AND x >= 10000)[-1] AS manager
 FROM (SELECT *, {_AMT} AS a, contains(lower(content), 'cfo') AS c FROM pol) x""",
    pol=P_TEXT,
)
def _(s: Source):
    rows = policies(s).select("policy_id", extract.late_fee_rate("content").alias("late_fee_rate"), extract.approval_limits("content").alias("l"))
    return rows.select("policy_id", "late_fee_rate", "l.cfo", "l.director", "l.manager")


@query(
    "ext_late_fee_context",
    f"""SELECT policy_id, {strip("array_to_string(lines[greatest(idx - 2, 1):(idx + 2)], ' ')")} AS context FROM (SELECT policy_id, lines,
 list_position(list_transform(lines, lambda l: contains(lower(l), 'late') AND contains(lower(l), 'fee')), true) AS idx
 FROM (SELECT policy_id, string_split(content, chr(10)) AS lines FROM pol) a) b""",
    pol=P_TEXT,
)
def _(s: Source):
    return policies(s).select("policy_id", extract.late_fee_context("content").alias("context"))


TITLE = "<title>([^<]*)</title>"


@query("ext_pattern_generic", f"SELECT page_id, {grp(TITLE, 'html')} AS title FROM pages")
def _(s: Source):
    return s.pages.select("page_id", extract.pattern("html", TITLE).alias("title"))


# --- rules in force -------------------------------------------------------------------------


@query(
    "join_policy_latest",
    f"""SELECT src_row, supplier, policy_id, CASE WHEN days <= 30 THEN CAST(0 AS DOUBLE) ELSE CAST(round(CAST(amount * coalesce(rate, CAST(0.015 AS DOUBLE)) * (days - 30) / CAST(30 AS DOUBLE)
 AS DECIMAL(38,10)), 2) AS DOUBLE) END AS late_fee FROM (SELECT i.*, date_diff('day', due_date, DATE '{RECORDS_AS_OF}') AS days, policy_id, rate FROM invoices i
 LEFT JOIN (SELECT s_name AS supplier, p.policy_id, rate FROM supplier s JOIN
  (SELECT s_nationkey AS nk, max(policy_id) AS policy_id, max_by(r, policy_id) AS rate FROM (SELECT policy_id, TRY_CAST(regexp_extract(lower(content), '(\\d+\\.?\\d*)%.*per month', 1) AS DOUBLE) / 100 AS r
   FROM pol) r JOIN supplier ON s_suppkey = policy_id GROUP BY s_nationkey) p ON s.s_nationkey = nk) f USING (supplier)) x""",
    "invoices", pol=P_TEXT,
)
def _(s: Source):
    from ..operators import invoice_rules as inv

    # the newest policy of a supplier's country is in force for it; the default rate holds elsewhere
    rates = policies(s).select("policy_id", extract.late_fee_rate("content").alias("rate"))
    homes = s.supplier.select(F.col("s_name").alias("supplier"), "s_nationkey", "s_suppkey")
    latest = (
        rates.join(homes, F.col("policy_id") == F.col("s_suppkey")).groupBy("s_nationkey")
        .agg(F.max_by("rate", "policy_id").alias("rate"), F.max("policy_id").alias("policy_id"))
    )
    in_force = homes.join(latest, "s_nationkey").select("supplier", "policy_id", "rate")
    rate = F.coalesce("rate", F.lit(ref.LATE_FEE_RATE))
    return s.invoices.join(in_force, "supplier", "left").select(
        "src_row", "supplier", "policy_id", inv.late_fee(RECORDS_AS_OF, rate).alias("late_fee")
    )


# versions take effect every sixty days, some on the same day; every fourth is withdrawn after a hundred days
VERSIONS = """SELECT s_nationkey AS nation, s_suppkey AS policy_id, CAST(DATE '1992-01-01' + CAST(s_suppkey * 7 % 40 * 60 AS INT) AS DATE) AS effective,
 CASE WHEN s_suppkey % 4 = 0 THEN CAST(DATE '1992-01-01' + CAST(s_suppkey * 7 % 40 * 60 + 100 AS INT) AS DATE) END AS withdrawn FROM {supplier}"""


@query(
    "join_policy_asof",
    """SELECT src_row, i.supplier, i.issue_date, p.policy_id, p.effective AS valid_from FROM homed i LEFT JOIN (SELECT *, lead(effective) OVER (PARTITION BY nation ORDER BY effective) AS nxt
  FROM (SELECT nation, effective, max(policy_id) AS policy_id, arg_max(coalesce(withdrawn, DATE '9999-01-01'), policy_id) AS withdrawn FROM versions GROUP BY nation, effective) v) p
 ON p.nation = i.s_nationkey AND i.issue_date >= p.effective AND i.issue_date < coalesce(nxt, DATE '9999-01-01') AND i.issue_date < withdrawn""",
    "invoices", versions=VERSIONS.replace("{supplier}", "supplier"),
    homed="SELECT i.*, s_nationkey FROM invoices i JOIN (SELECT s_name AS supplier, s_nationkey FROM supplier) s USING (supplier)",
)
def _(s: Source):
    in_force = validity.ranges(s.spark.sql(VERSIONS, supplier=s.supplier), "nation", "effective", "policy_id", "withdrawn")
    homes = s.supplier.select(F.col("s_name").alias("supplier"), F.col("s_nationkey").alias("nation"))
    found = validity.as_of(s.invoices.join(homes, "supplier"), in_force, "nation", "issue_date")
    return found.select("src_row", "supplier", "issue_date", "policy_id", "valid_from")
