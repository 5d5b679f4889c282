"""Queries over invoices and shipments: baselines, joins with them, and every record rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sizing import sized
from ..operators import duplicates, invoice_rules as inv, profiles, shipment_rules as shp
from ..fixtures import APPROVED_BY_MODE, GUIDELINE_CARRIERS, NAMED_SHIPMENTS
from ..operators.anomaly import finish, flag, flag_with_combined
from .catalog import RECORDS_AS_OF as AS_OF, Source, query

COLS = "src_row, document_id, anomaly_type, risk_score, severity"


def short(anomalies: DataFrame) -> DataFrame:
    """The columns compared with SQL; risk to six places because engines sum in different orders."""
    return anomalies.select(
        "src_row", "document_id", "anomaly_type", F.round("risk_score", 6).alias("risk_score"), "severity"
    )


def pick(kind: str, risk: str, where: str, frm: str, doc: str, severity: str = "CAST(NULL AS VARCHAR)") -> str:
    return (
        f"SELECT src_row, {doc} AS document_id, {kind} AS anomaly_type, round(CAST({risk} AS DOUBLE), 6) AS risk_score, "
        f"{severity} AS severity FROM {frm} WHERE {where}"
    )


# --- baselines ------------------------------------------------------------------------------

PROFILE = """SELECT supplier, avg(amount) FILTER (status <> 'flagged') AS avg_amount,
 stddev_samp(amount) FILTER (status <> 'flagged') AS std_amount,
 avg(early_discount) FILTER (status <> 'flagged') AS avg_discount,
 count(*) FILTER (status <> 'flagged') AS invoice_count,
 avg(CASE WHEN status = 'flagged' THEN 1.0 ELSE 0.0 END) AS flagged_rate
 FROM invoices GROUP BY supplier HAVING count(*) FILTER (status <> 'flagged') > 0"""
MODES = """SELECT supplier, payment_terms AS typical_terms FROM (
 SELECT supplier, payment_terms, row_number() OVER (PARTITION BY supplier ORDER BY count(*) DESC, payment_terms) AS rn
 FROM invoices WHERE status <> 'flagged' GROUP BY supplier, payment_terms) m WHERE rn = 1"""
HISTORY = """SELECT supplier, payment_terms, count(amount) AS hist_n, avg(amount) AS hist_avg, stddev_pop(amount) AS hist_std,
 avg(early_discount) AS hist_discount, list_sort(list_distinct(list(approver) FILTER (approver IS NOT NULL))) AS approvers
 FROM invoices GROUP BY supplier, payment_terms"""
ROUTE = """SELECT origin, destination, list_sort(list_distinct(list(carrier))) AS common_carriers, avg(risk_score) AS avg_risk_score,
 avg(date_diff('day', departure_date, estimated_arrival)) AS avg_transit_days,
 avg(CASE WHEN anomaly_type <> 'none' THEN 1.0 ELSE 0.0 END) AS anomaly_rate, count(*) AS route_rows
 FROM shipments GROUP BY origin, destination"""
ROUTE_CARRIER = """SELECT origin, destination, carrier,
 count(nullif(24 * date_diff('day', departure_date, estimated_arrival), 0)) AS transit_n,
 avg(nullif(24 * date_diff('day', departure_date, estimated_arrival), 0)) AS avg_transit_hours,
 count(risk_score) AS risk_n, avg(risk_score) AS avg_risk_score, avg(value) AS avg_value, stddev_pop(value) AS std_value,
 arg_min(expected_route, src_row) AS known_route FROM shipments GROUP BY origin, destination, carrier"""


# Means of cents are compared as mean times count: a sum of cents has four places, so no engine's
# order of addition can tip its last digit.


def total(mean: str, n: str, name: str):
    return F.round(F.col(mean) * F.col(n), 4).alias(name)


@query(
    "agg_supplier_profile",
    """SELECT supplier, round(avg_amount * invoice_count, 4) AS amount_total, round(std_amount, 4) AS std_amount, typical_terms,
 round(avg_discount * invoice_count, 4) AS discount_total, invoice_count, round(flagged_rate, 6) AS flagged_rate
 FROM profile JOIN modes USING (supplier)""",
    "invoices", profile=PROFILE, modes=MODES,
)
def _(s: Source):
    return profiles.supplier_profile(s.invoices).select(
        "supplier", total("avg_amount", "invoice_count", "amount_total"), F.round("std_amount", 4).alias("std_amount"), "typical_terms",
        total("avg_discount", "invoice_count", "discount_total"), "invoice_count", F.round("flagged_rate", 6).alias("flagged_rate"),
    )


@query(
    "agg_invoice_history",
    """SELECT supplier, payment_terms, hist_n, round(hist_avg * hist_n, 4) AS amount_total, round(hist_std, 4) AS hist_std,
 round(hist_discount * hist_n, 4) AS discount_total, coalesce(array_to_string(approvers, ','), '') AS approvers FROM history""",
    "invoices", history=HISTORY,
)
def _(s: Source):
    return profiles.invoice_history(s.invoices).select(
        "supplier", "payment_terms", "hist_n", total("hist_avg", "hist_n", "amount_total"), F.round("hist_std", 4).alias("hist_std"),
        total("hist_discount", "hist_n", "discount_total"), F.array_join("approvers", ",").alias("approvers"),
    )


@query(
    "agg_route_profile",
    """SELECT origin, destination, array_to_string(common_carriers, ',') AS common_carriers,
 round(avg_risk_score * route_rows, 4) AS risk_total, round(avg_transit_days, 6) AS avg_transit_days,
 round(anomaly_rate, 6) AS anomaly_rate, route_rows FROM route""",
    "shipments", route=ROUTE,
)
def _(s: Source):
    return profiles.route_profile(s.shipments).select(
        "origin", "destination", F.array_join("common_carriers", ",").alias("common_carriers"),
        total("avg_risk_score", "route_rows", "risk_total"), F.round("avg_transit_days", 6).alias("avg_transit_days"),
        F.round("anomaly_rate", 6).alias("anomaly_rate"), "route_rows",
    )


@query(
    "agg_route_carrier_history",
    """SELECT origin, destination, carrier, transit_n, round(avg_transit_hours, 6) AS avg_transit_hours, risk_n,
 round(avg_risk_score * risk_n, 4) AS risk_total, round(avg_value * risk_n, 4) AS value_total, round(std_value, 4) AS std_value, known_route FROM rc""",
    "shipments", rc=ROUTE_CARRIER,
)
def _(s: Source):
    return profiles.route_carrier_history(s.shipments).select(
        "origin", "destination", "carrier", "transit_n", F.round("avg_transit_hours", 6).alias("avg_transit_hours"), "risk_n",
        total("avg_risk_score", "risk_n", "risk_total"), total("avg_value", "risk_n", "value_total"),
        F.round("std_value", 4).alias("std_value"), "known_route",
    )


# --- joins with the baselines ---------------------------------------------------------------


@query(
    "join_supplier_profile",
    """SELECT src_row, invoice_id, supplier, amount, round(avg_amount * invoice_count, 4) AS amount_total, invoice_count
 FROM invoices LEFT JOIN profile USING (supplier)""",
    "invoices", profile=PROFILE,
)
def _(s: Source):
    return profiled(s).select("src_row", "invoice_id", "supplier", "amount", total("avg_amount", "invoice_count", "amount_total"), "invoice_count")


@query(
    "join_route_profile",
    """SELECT src_row, shipment_id, origin, destination, round(avg_transit_days, 6) AS avg_transit_days,
 CAST(len(common_carriers) AS BIGINT) AS carriers FROM shipments LEFT JOIN route USING (origin, destination)""",
    "shipments", route=ROUTE,
)
def _(s: Source):
    return routed(s).select(
        "src_row", "shipment_id", "origin", "destination", F.round("avg_transit_days", 6).alias("avg_transit_days"),
        F.size("common_carriers").cast("bigint").alias("carriers"),
    )


@query(
    "join_route_carrier_history",
    """SELECT src_row, shipment_id, carrier, round(avg_value * n, 4) AS value_total, known_route FROM shipments
 LEFT JOIN (SELECT *, risk_n AS n FROM rc) h USING (origin, destination, carrier)""",
    "shipments", rc=ROUTE_CARRIER,
)
def _(s: Source):
    history = sized(profiles.route_carrier_history(s.shipments))
    rows = s.shipments.join(history.select("origin", "destination", "carrier", "avg_value", "risk_n", "known_route"), ["origin", "destination", "carrier"], "left")
    return rows.select("src_row", "shipment_id", "carrier", total("avg_value", "risk_n", "value_total"), "known_route")


@query(
    "join_supplier_terms",
    "SELECT src_row, invoice_id, payment_terms, agreed_terms, supplier_risk FROM invoices LEFT JOIN supplier_terms USING (supplier)",
    "invoices supplier_terms",
)
def _(s: Source):
    return inv.with_supplier_terms(s.invoices, s.supplier_terms).select(
        "src_row", "invoice_id", "payment_terms", "agreed_terms", "supplier_risk"
    )


# --- invoice rules --------------------------------------------------------------------------

R: dict[str, str] = {}  # rule name -> select over the prepared frames, reused by detect_all

PREPARED = dict(
    profile=PROFILE,
    history=HISTORY,
    ip="SELECT * FROM invoices LEFT JOIN profile USING (supplier)",
    it="SELECT *, date_diff('day', issue_date, due_date) AS ndays, CAST(substr(agreed_terms, 4) AS INT) AS agreed_days "
    "FROM invoices LEFT JOIN supplier_terms USING (supplier)",
    ih="SELECT *, abs(amount - hist_avg) / hist_avg AS share, abs(amount - hist_avg) / "
    "CASE WHEN hist_n > 1 THEN nullif(hist_std, 0) ELSE hist_avg * 0.1 END AS z FROM invoices "
    "LEFT JOIN (SELECT supplier, payment_terms, hist_n, hist_avg, hist_std FROM history) h USING (supplier, payment_terms)",
    iseen="SELECT *, min(src_row) OVER (PARTITION BY invoice_id) AS first_order FROM invoices",
    reissued="SELECT * FROM invoices UNION ALL SELECT * REPLACE (concat(src_row, '|r') AS src_row, concat(invoice_id, '-R') AS invoice_id) "
    "FROM invoices WHERE approver = 'CFO'",
    rtwin="SELECT * FROM reissued i WHERE EXISTS (SELECT 1 FROM reissued e WHERE e.supplier = i.supplier AND e.amount = i.amount "
    "AND e.issue_date = i.issue_date AND e.invoice_id <> i.invoice_id AND e.src_row < i.src_row)",
    itwin="SELECT * FROM invoices i WHERE EXISTS (SELECT 1 FROM invoices e WHERE e.supplier = i.supplier AND e.amount = i.amount "
    "AND e.issue_date = i.issue_date AND e.invoice_id <> i.invoice_id AND e.src_row < i.src_row)",
)

R["inv_amount_deviation"] = pick(
    "'invoice_amount_deviation'", "least(0.95, abs(amount - avg_amount) / std_amount / 5.0)",
    "amount > 0 AND avg_amount > 0 AND std_amount > 0 AND abs(amount - avg_amount) / std_amount > 2.5", "ip", "invoice_id",
    "CASE WHEN abs(amount - avg_amount) / std_amount > 4 THEN 'high' WHEN abs(amount - avg_amount) / std_amount > 3 THEN 'medium' ELSE 'low' END",
)
R["inv_terms_violation"] = pick(
    "'payment_terms_violation'", "least(0.9, abs(ndays - agreed_days) / agreed_days)", "abs(ndays - agreed_days) > 7", "it", "invoice_id", "'medium'",
)
R["inv_weekend"] = pick("'weekend_processing'", "0.7", "isodow(issue_date) >= 6", "invoices", "invoice_id", "'medium'")
R["inv_duplicate_pattern"] = pick("'potential_duplicate'", "0.85", "true", "rtwin", "invoice_id", "'high'")
_TWIN = pick("'potential_duplicate'", "0.85", "true", "itwin", "invoice_id", "'high'")
_need = "CASE WHEN amount >= 50000 THEN 3 WHEN amount >= 10000 THEN 2 ELSE 1 END"
_have = "CASE WHEN lower(approver) LIKE '%director%' THEN 2 WHEN lower(approver) LIKE '%cfo%' THEN 3 ELSE 1 END"
R["inv_insufficient_approval"] = pick(
    "'insufficient_approval'", "0.8", f"approver <> '' AND amount > 0 AND {_have} < {_need}", "invoices", "invoice_id", "'high'",
)
_tenths = """(CASE WHEN amount IN (100, 500, 1000, 5000, 10000) THEN 3 ELSE 0 END + CASE WHEN supplier IS NULL OR supplier = '' THEN 2 ELSE 0 END
 + CASE WHEN issue_date IS NULL THEN 2 ELSE 0 END + CASE WHEN due_date IS NULL THEN 2 ELSE 0 END
 + CASE WHEN payment_terms IS NULL OR payment_terms = '' THEN 2 ELSE 0 END + CASE WHEN supplier_risk = 'high' THEN 5 ELSE 0 END)"""
R["inv_fraud_pattern"] = pick(
    "'fraud_pattern'", f"least(0.95, {_tenths} / 10)", f"{_tenths} >= 4", "it", "invoice_id", f"CASE WHEN {_tenths} >= 7 THEN 'high' ELSE 'medium' END",
)
R["inv_amount_discrepancy"] = pick(
    "'invoice_amount_discrepancy'", "least(0.9, 0.5 + least(coalesce(z, 0) / 10, 0.4))", "amount <> 0 AND hist_avg <> 0 AND share > 0.20", "ih", "invoice_id",
)
R["inv_round_amount"] = pick(
    "'suspicious_round_amount'", "0.65", "amount % 100 = 0 AND amount >= 1000 AND NOT coalesce(hist_avg <> 0 AND share > 0.20, false)", "ih", "invoice_id",
)
R["inv_terms_own"] = pick(
    "'payment_terms_noncompliance'", "0.7", "abs(ndays - CAST(substr(payment_terms, 4) AS INT)) > 1", "it", "invoice_id",
)
R["inv_wrong_terms"] = pick("'incorrect_payment_terms'", "0.75", "payment_terms <> agreed_terms", "it", "invoice_id")
R["inv_wrong_due_date"] = pick(
    "'incorrect_due_date_calculation'", "0.6", "payment_terms = agreed_terms AND abs(ndays - agreed_days) > 2", "it", "invoice_id",
)
_lvl = """CASE WHEN lower(approver) LIKE '%cfo%' OR lower(approver) LIKE '%chief financial%' THEN 2
 WHEN lower(approver) LIKE '%director%' OR lower(approver) LIKE '%vice president%' THEN 1
 WHEN regexp_matches(lower(approver), 'manager|john|sarah|michael|emily|david') THEN 0 ELSE -1 END"""
R["inv_approval_authority"] = pick(
    "'insufficient_approval_authority'", "CASE WHEN amount > 25000 THEN 0.8 ELSE 0.6 END",
    f"approver <> '' AND amount <> 0 AND {_lvl} < CASE WHEN amount >= 50000 THEN 2 WHEN amount >= 25000 THEN 1 ELSE 0 END", "invoices", "invoice_id",
)
R["inv_approval_workflow"] = pick(
    "'approval_workflow_noncompliance'", "CASE WHEN amount > 25000 THEN 0.8 ELSE 0.6 END",
    "approver <> '' AND amount >= 5000 AND NOT regexp_matches(lower(approver), ',|director|cfo')", "invoices", "invoice_id",
)
R["inv_duplicate_id"] = pick("'duplicate_invoice_id'", "0.9", "src_row > first_order", "iseen", "invoice_id")
R["inv_early_discount"] = pick("'incorrect_early_discount'", "0.5", "abs(early_discount - agreed_discount) > 0.005", "it", "invoice_id")
R["inv_currency"] = pick("'non_usd_currency'", "0.4", "coalesce(currency, 'USD') <> 'USD'", "invoices", "invoice_id")


def _rule(name: str, views: str = "invoices supplier_terms"):
    used = {k: v for k, v in PREPARED.items()}
    return query(name, R[name], views, **used)


def profiled(s: Source) -> DataFrame:
    return inv.with_supplier_profile(s.invoices, sized(profiles.supplier_profile(s.invoices)))


def termed(s: Source) -> DataFrame:
    return inv.with_supplier_terms(s.invoices, s.supplier_terms)


def historied(s: Source) -> DataFrame:
    return inv.with_invoice_history(s.invoices, sized(profiles.invoice_history(s.invoices)))


def twins(s: Source, invoices: DataFrame | None = None) -> DataFrame:
    rows = s.invoices if invoices is None else invoices
    return duplicates.earlier_twin(rows, "invoice_id", ["supplier", "amount", "issue_date"])


def reissued(s: Source) -> DataFrame:
    """The invoices, those signed by the CFO a second time under a new number."""
    again = s.invoices.where("approver = 'CFO'").select(
        F.concat("src_row", F.lit("|r")).alias("src_row"), F.concat("invoice_id", F.lit("-R")).alias("invoice_id"),
        *[c for c in s.invoices.columns if c not in ("src_row", "invoice_id")],
    )
    return s.invoices.unionByName(again)


INVOICE_FLAGS = {
    "inv_amount_deviation": lambda s: flag(profiled(s), "invoice_id", inv.amount_deviation()),
    "inv_amount_discrepancy": lambda s: flag(historied(s), "invoice_id", inv.amount_discrepancy()),
    "inv_round_amount": lambda s: flag(historied(s), "invoice_id", inv.round_amount()),
    "inv_terms_violation": lambda s: flag(termed(s), "invoice_id", inv.terms_violation()),
    "inv_terms_own": lambda s: flag(s.invoices, "invoice_id", inv.own_terms()),
    "inv_wrong_terms": lambda s: flag(termed(s), "invoice_id", inv.wrong_terms()),
    "inv_wrong_due_date": lambda s: flag(termed(s), "invoice_id", inv.wrong_due_date()),
    "inv_weekend": lambda s: flag(s.invoices, "invoice_id", inv.weekend()),
    "inv_fraud_pattern": lambda s: flag(termed(s), "invoice_id", inv.fraud_pattern()),
    "inv_insufficient_approval": lambda s: flag(s.invoices, "invoice_id", inv.insufficient_approval()),
    "inv_approval_authority": lambda s: flag(s.invoices, "invoice_id", inv.approval_authority()),
    "inv_approval_workflow": lambda s: flag(s.invoices, "invoice_id", inv.approval_workflow()),
    "inv_duplicate_id": lambda s: flag(duplicates.first_seen(s.invoices, "invoice_id"), "invoice_id", inv.duplicate_id()),
    "inv_duplicate_pattern": lambda s: flag(twins(s, reissued(s)), "invoice_id", inv.duplicate_pattern()),
    "inv_early_discount": lambda s: flag(termed(s), "invoice_id", inv.early_discount()),
    "inv_currency": lambda s: flag(s.invoices, "invoice_id", inv.foreign_currency()),
}
for _name, _fn in INVOICE_FLAGS.items():
    _rule(_name)(lambda s, fn=_fn: short(fn(s)))


@query(
    "inv_approval_requirement",
    """SELECT src_row, amount, CASE WHEN amount >= 100000 THEN 'CFO approval required' WHEN amount >= 50000 THEN 'Director approval required'
 WHEN amount >= 15000 THEN 'Manager approval required' WHEN amount >= 5000 THEN 'Automatic approval' ELSE 'Standard processing' END AS requirement
 FROM invoices""",
    "invoices",
)
def _(s: Source):
    return s.invoices.select("src_row", "amount", inv.approval_requirement().alias("requirement"))


@query(
    "inv_late_fee",
    f"""SELECT src_row, invoice_id, CASE WHEN date_diff('day', due_date, DATE '{AS_OF}') <= 30 THEN CAST(0 AS DOUBLE) ELSE
 CAST(round(CAST(amount * CAST(0.015 AS DOUBLE) * (date_diff('day', due_date, DATE '{AS_OF}') - 30) / CAST(30 AS DOUBLE) AS DECIMAL(38,10)), 2) AS DOUBLE)
 END AS late_fee FROM invoices""",
    "invoices",
)
def _(s: Source):
    return s.invoices.select("src_row", "invoice_id", inv.late_fee(AS_OF).alias("late_fee"))


@query(
    "inv_overdue_flag",
    "SELECT src_row, invoice_id, status, notes FROM invoices WHERE lower(status) = 'overdue' OR lower(coalesce(notes, '')) LIKE '%overdue%'",
    "invoices",
)
def _(s: Source):
    return s.invoices.where(inv.is_overdue()).select("src_row", "invoice_id", "status", "notes")


# --- shipment rules -------------------------------------------------------------------------

_MODE = """CASE WHEN origin LIKE '% %' AND destination LIKE '% %' AND regexp_extract(origin, '(\\S+)$', 1) <> regexp_extract(destination, '(\\S+)$', 1)
 THEN CASE WHEN (origin LIKE '%China%' AND destination LIKE '%Germany%') OR (origin LIKE '%Germany%' AND destination LIKE '%China%')
 OR (origin LIKE '%USA%' AND destination LIKE '%UK%') OR (origin LIKE '%UK%' AND destination LIKE '%USA%')
 OR (origin LIKE '%Japan%' AND destination LIKE '%Korea%') OR (origin LIKE '%Korea%' AND destination LIKE '%Japan%') THEN 'ocean' ELSE 'air' END
 ELSE 'ground' END"""
_LATE = f"""CASE WHEN status = 'Delayed' OR (status = 'Delivered' AND actual_arrival IS NOT NULL)
 THEN 24 * date_diff('day', estimated_arrival, coalesce(actual_arrival, DATE '{AS_OF}')) END"""
APPROVED = "SELECT * FROM (VALUES " + ", ".join(
    f"('{m}', '{n.lower()}')" for m, names in APPROVED_BY_MODE.items() for n in names
) + ") a(amode, approved)"
SHIPPED = dict(
    route=ROUTE,
    rc=ROUTE_CARRIER,
    nm=f"SELECT *, {_MODE} AS mode, {_LATE} AS late FROM named_shipments",
    approved=APPROVED,
    sr="SELECT shipments.*, common_carriers, avg_transit_days, tier, date_diff('day', departure_date, estimated_arrival) AS ndays FROM shipments "
    "LEFT JOIN route USING (origin, destination) LEFT JOIN carrier_tier USING (carrier)",
    sh="SELECT shipments.*, avg_value, std_value, known_route FROM shipments LEFT JOIN rc USING (origin, destination, carrier)",
    sseen="SELECT *, min(src_row) OVER (PARTITION BY shipment_id) AS first_order FROM shipments",
    stwin="SELECT * FROM shipments i WHERE EXISTS (SELECT 1 FROM shipments e WHERE e.origin = i.origin AND e.destination = i.destination "
    "AND e.departure_date = i.departure_date AND e.shipment_id <> i.shipment_id AND e.src_row < i.src_row)",
)

_LIM = "CASE mode WHEN 'air' THEN 48 WHEN 'ocean' THEN 120 ELSE 24 END"
R["shp_unapproved_carrier"] = pick(
    "'unauthorized_carrier'", "0.85",
    "carrier <> '' AND NOT EXISTS (SELECT 1 FROM approved WHERE amode = mode AND (contains(lower(carrier), approved) OR contains(approved, lower(carrier))))",
    "nm", "shipment_id",
)
_n = "(CASE WHEN carrier LIKE '%Alternative%' THEN 1 ELSE 0 END + CASE WHEN origin LIKE '%New York%' AND destination LIKE '%London%' THEN 1 ELSE 0 END)"
R["shp_route_indicators"] = pick("'route_deviation'", f"least(0.95, 0.6 + {_n} * 0.15)", f"{_n} > 0", "nm", "shipment_id")
R["shp_route_expected"] = pick("'route_deviation'", "0.8", "known_route <> actual_route", "sh", "shipment_id")
R["shp_delay_mode"] = pick("'timeline_delay'", f"least(0.95, 0.4 + (late / {_LIM} - 1) * 0.3)", f"late > {_LIM}", "nm", "shipment_id")
R["shp_delay_simple"] = pick("'timeline_delay'", "least(0.9, 0.4 + late / 168 * 0.5)", "late > 120", "nm", "shipment_id")
R["shp_value_discrepancy"] = pick(
    "'value_discrepancy'",
    "least(0.95, 0.5 + least(abs(value - avg_value) / CASE WHEN std_value <> 0 THEN std_value ELSE avg_value * 0.1 END / 10, 0.45))",
    "value <> 0 AND avg_value <> 0 AND abs(value - avg_value) / avg_value > 0.15", "sh", "shipment_id",
)
_round = "(value % 1000 = 0 AND value >= 10000)"
R["shp_value_pattern"] = pick(
    f"CASE WHEN {_round} THEN 'suspicious_value_pattern' ELSE 'high_value_shipment' END", f"CASE WHEN {_round} THEN 0.7 ELSE 0.6 END",
    f"{_round} OR value > 50000", "nm", "shipment_id",
)
R["shp_duplicate_id"] = pick("'duplicate_id'", "0.95", "src_row > first_order", "sseen", "shipment_id")
R["shp_duplicate_pattern"] = pick("'suspicious_duplicate_pattern'", "0.8", "true", "stwin", "shipment_id")
R["shp_blacklisted_carrier"] = pick("'blacklisted_carrier'", "0.95", "tier = 'blacklisted'", "sr", "shipment_id", "'high'")
R["shp_transit_deviation"] = pick(
    "'transit_time_anomaly'", "least(0.9, abs(ndays - avg_transit_days) / avg_transit_days)", "avg_transit_days <> 0 AND abs(ndays - avg_transit_days) > 2",
    "sr", "shipment_id", "CASE WHEN abs(ndays - avg_transit_days) > 5 THEN 'high' ELSE 'medium' END",
)
R["shp_suspicious_route"] = pick(
    "'suspicious_route'", "0.85", "regexp_matches(lower(concat(origin, ' -> ', destination)), 'unknown -> unknown|suspicious -> suspicious|fake -> fake')",
    "named_shipments", "shipment_id", "'high'",
)
_MID = "1999-06-01"
R["shp_status_inconsistent"] = pick(
    "'status_inconsistency'", "0.7", f"departure_date > DATE '{_MID}' AND lower(replace(status, '_', ' ')) = 'in transit'", "shipments", "shipment_id", "'medium'",
)
_od = f"date_diff('day', estimated_arrival, DATE '{_MID}')"
R["shp_overdue"] = pick(
    "'shipment_overdue'", f"least(0.9, {_od} / 10)",
    f"lower(replace(status, '_', ' ')) IN ('in transit', 'pending') AND {_od} > 1 AND NOT (departure_date > DATE '{_MID}' AND lower(replace(status, '_', ' ')) = 'in transit')",
    "shipments", "shipment_id", f"CASE WHEN {_od} > 5 THEN 'high' ELSE 'medium' END",
)

SHIP_VIEWS = "shipments named_shipments carrier_tier"


def routed(s: Source) -> DataFrame:
    joined = shp.with_route_profile(s.shipments, sized(profiles.route_profile(s.shipments)))
    return shp.with_carrier_tier(joined, s.carrier_tier)


def valued(s: Source) -> DataFrame:
    return shp.with_route_carrier_history(s.shipments, sized(profiles.route_carrier_history(s.shipments)))


def ship_twins(s: Source) -> DataFrame:
    return duplicates.earlier_twin(s.shipments, "shipment_id", ["origin", "destination", "departure_date"])


def moved(s: Source) -> DataFrame:
    return shp.with_transport(s.named_shipments, AS_OF)


SHIPMENT_FLAGS = {
    "shp_unapproved_carrier": lambda s: flag(moved(s), "shipment_id", shp.unapproved_carrier(APPROVED_BY_MODE)),
    "shp_route_indicators": lambda s: flag(s.named_shipments, "shipment_id", shp.route_indicators()),
    "shp_route_expected": lambda s: flag(valued(s), "shipment_id", shp.route_expected()),
    "shp_delay_mode": lambda s: flag(moved(s), "shipment_id", shp.delay_by_mode()),
    "shp_delay_simple": lambda s: flag(moved(s), "shipment_id", shp.delay_simple()),
    "shp_value_discrepancy": lambda s: flag(valued(s), "shipment_id", shp.value_discrepancy()),
    "shp_value_pattern": lambda s: flag(s.named_shipments, "shipment_id", shp.value_pattern()),
    "shp_duplicate_id": lambda s: flag(duplicates.first_seen(s.shipments, "shipment_id"), "shipment_id", shp.duplicate_id()),
    "shp_duplicate_pattern": lambda s: flag(ship_twins(s), "shipment_id", shp.duplicate_pattern()),
    "shp_blacklisted_carrier": lambda s: flag(routed(s), "shipment_id", shp.carrier_check()).where("anomaly_type = 'blacklisted_carrier'"),
    "shp_transit_deviation": lambda s: flag(routed(s), "shipment_id", shp.transit_deviation()),
    "shp_suspicious_route": lambda s: flag(s.named_shipments, "shipment_id", shp.suspicious_route()),
    "shp_status_inconsistent": lambda s: flag(s.shipments, "shipment_id", shp.status_inconsistent(_MID)),
    "shp_overdue": lambda s: flag(s.shipments, "shipment_id", shp.overdue(_MID)),
}
for _name, _fn in SHIPMENT_FLAGS.items():
    query(_name, R[_name], SHIP_VIEWS, **SHIPPED)(lambda s, fn=_fn: short(fn(s)))

# history of one half of the arrival order (delivered shipments) judges the rest, else no carrier is ever unusual
UNUSUAL = dict(
    past="SELECT origin, destination, list_distinct(list(carrier)) AS usual FROM shipments WHERE status = 'Delivered' GROUP BY origin, destination",
    su="SELECT shipments.*, usual, tier FROM shipments LEFT JOIN past USING (origin, destination) LEFT JOIN carrier_tier USING (carrier)",
)


@query(
    "shp_unusual_carrier",
    pick(
        "'unusual_carrier'", "CASE WHEN tier IN ('tier_1', 'tier_2') THEN 0.6 ELSE 0.8 END",
        "tier <> 'blacklisted' AND len(usual) > 0 AND NOT list_contains(usual, carrier)", "su", "shipment_id", "'medium'",
    ),
    SHIP_VIEWS, **UNUSUAL,
)
def _(s: Source):
    past = sized(profiles.route_profile(s.shipments.where("status = 'Delivered'")))
    rows = shp.with_carrier_tier(shp.with_route_profile(s.shipments, past), s.carrier_tier)
    return short(flag(rows, "shipment_id", shp.carrier_check())).where("anomaly_type = 'unusual_carrier'")


@query("shp_freight_mode", "SELECT src_row, origin, destination, mode FROM nm", SHIP_VIEWS, **SHIPPED)
def _(s: Source):
    return s.named_shipments.select("src_row", "origin", "destination", shp.freight_mode().alias("mode"))


@query(
    "shp_pipeline_flag",
    """SELECT src_row, shipment_id, status, risk_score, anomaly_type FROM shipments
 WHERE status = 'Delayed' OR risk_score > 0.7 OR anomaly_type <> 'none'""",
    "shipments",
)
def _(s: Source):
    return s.shipments.where(shp.feed_flag()).select("src_row", "shipment_id", "status", "risk_score", "anomaly_type")


@query(
    "shp_pipeline_type_risk",
    """SELECT src_row, CASE WHEN anomaly_type <> 'none' THEN anomaly_type WHEN status = 'Delayed' THEN 'timeline_delay' ELSE 'unknown_anomaly' END AS kind,
 CAST(coalesce(risk, CASE WHEN anomaly_type <> 'none' THEN 0.85 WHEN status = 'Delayed' THEN 0.6 ELSE 0.7 END) AS DOUBLE) AS risk,
 CASE WHEN anomaly_type <> 'none' THEN concat('Shipment ', shipment_id, ' shows deviation from expected route between ', origin, ' and ', destination, '.')
  WHEN status = 'Delayed' THEN concat('Shipment ', shipment_id, ' from ', origin, ' to ', destination, ' is experiencing delays.')
  ELSE concat('Anomaly detected in shipment ', shipment_id, ' from ', origin, ' to ', destination, '.') END AS description
 FROM (SELECT *, nullif(risk_score, 0) AS risk FROM shipments) x""",
    "shipments",
)
def _(s: Source):
    rows = s.shipments.withColumn("risk_score", F.nullif("risk_score", F.lit(0.0)))
    return rows.select("src_row", shp.feed_type().alias("kind"), shp.feed_risk().alias("risk"), shp.feed_description().alias("description"))


@query(
    "shp_guideline_risk",
    """SELECT src_row, carrier, round(score, 6) AS risk_score,
 CASE WHEN score >= 0.9 THEN 'Critical' WHEN score >= 0.7 THEN 'High' WHEN score >= 0.4 THEN 'Medium' ELSE 'Low' END AS severity
 FROM (SELECT n.src_row, n.carrier, CAST(CASE WHEN n.carrier = 'Harbour Worldwide' THEN 0.0 ELSE 0.3 END AS DOUBLE)
  + CASE WHEN abs(s.value - avg_value) / avg_value > 0.25 THEN least(0.4, abs(s.value - avg_value) / avg_value) ELSE 0 END AS score
  FROM named_shipments n JOIN sh s USING (src_row)) x""",
    SHIP_VIEWS, **SHIPPED,
)
def _(s: Source):
    names = s.named_shipments.select("src_row", F.col("carrier").alias("named"))
    rows = valued(s).join(names, "src_row").withColumn("carrier", F.col("named"))
    return rows.select("src_row", "carrier", shp.guideline_risk(GUIDELINE_CARRIERS).alias("g")).select(
        "src_row", "carrier", F.round("g.risk_score", 6).alias("risk_score"), "g.severity"
    )


_EXT = ["shp_unapproved_carrier", "shp_route_indicators", "shp_delay_mode", "shp_value_pattern"]


@query(
    "shp_combined_risk",
    """SELECT src_row, document_id, 'combined_risk_factors' AS anomaly_type, round(least(0.98, max(risk_score) + 0.1), 6) AS risk_score,
 count(*) AS found FROM found GROUP BY src_row, document_id HAVING count(*) >= 2""",
    SHIP_VIEWS, **SHIPPED, found=" UNION ALL ".join(R[k] for k in _EXT),
)
def _(s: Source):
    rows = flag_with_combined(moved(s), "shipment_id", *shp.extended_rules(APPROVED_BY_MODE))
    return rows.where("anomaly_type = 'combined_risk_factors'").select(
        "src_row", "document_id", "anomaly_type", F.round("risk_score", 6).alias("risk_score"), F.size("evidence").cast("bigint").alias("found")
    )


# --- everything at once ---------------------------------------------------------------------


def all_invoice_anomalies(s: Source) -> DataFrame:
    """Every rule of both detectors in one pass over the invoices; duplicates come from narrow second reads."""
    history = sized(profiles.invoice_history(s.invoices).drop("approvers"))
    rows = inv.with_invoice_history(inv.with_supplier_terms(profiled(s), s.supplier_terms), history)
    rules = [
        inv.amount_deviation(), inv.terms_violation(), inv.weekend(), inv.insufficient_approval(), inv.fraud_pattern(),
        inv.amount_discrepancy(), inv.round_amount(), inv.own_terms(), inv.wrong_terms(), inv.wrong_due_date(),
        inv.approval_authority(), inv.approval_workflow(), inv.early_discount(), inv.foreign_currency(),
    ]
    found = flag(rows, "invoice_id", *rules)
    twice = flag(duplicates.first_seen(s.invoices, "invoice_id"), "invoice_id", inv.duplicate_id())
    return found.unionByName(flag(twins(s), "invoice_id", inv.duplicate_pattern())).unionByName(twice)


def all_shipment_anomalies(s: Source) -> DataFrame:
    """The same for shipments; rules that look for names read the view that has such names."""
    history = sized(profiles.route_carrier_history(s.shipments))
    rows = shp.with_route_carrier_history(routed(s), history)
    found = flag(
        rows, "shipment_id", shp.carrier_check(), shp.transit_deviation(), F.coalesce(shp.status_inconsistent(_MID), shp.overdue(_MID)),
        shp.route_expected(), shp.value_discrepancy(),
    )
    named = flag(
        moved(s), "shipment_id", shp.unapproved_carrier(APPROVED_BY_MODE), shp.route_indicators(), shp.delay_by_mode(), shp.delay_simple(),
        shp.value_pattern(), shp.suspicious_route(),
    )
    twice = flag(duplicates.first_seen(s.shipments, "shipment_id"), "shipment_id", shp.duplicate_id())
    alike = flag(ship_twins(s), "shipment_id", shp.duplicate_pattern())
    return found.unionByName(named).unionByName(twice).unionByName(alike)


class Kept(Source):
    """A source whose record views, which the rules read many times, are joined once and written to the shared folder."""

    def __getattr__(self, name: str) -> DataFrame:
        if name in ("invoices", "shipments"):
            found = sized(super().__getattr__(name))
        elif name == "named_shipments":
            found = self.spark.sql(NAMED_SHIPMENTS, shipments=self.shipments)
        else:
            found = super().__getattr__(name)
        setattr(self, name, found)
        return found


def all_anomalies(s: Source) -> DataFrame:
    s = Kept(s.spark, s.sf_dir)
    return all_invoice_anomalies(s).unionByName(all_shipment_anomalies(s))


ALL_VIEWS = "invoices supplier_terms " + SHIP_VIEWS
ALL_CTES = {**PREPARED, **SHIPPED, "found": " UNION ALL ".join([sql for name, sql in R.items() if name != "inv_duplicate_pattern"] + [_TWIN])}


@query("detect_all", f"SELECT {COLS} FROM found", ALL_VIEWS, **ALL_CTES)
def _(s: Source):
    return short(finish(all_anomalies(s), AS_OF))


@query(
    "skip_processed",
    "SELECT src_row, invoice_id, amount FROM iseen WHERE src_row = first_order",
    "invoices", iseen=PREPARED["iseen"],
)
def _(s: Source):
    return duplicates.keep_first(s.invoices.select("src_row", "invoice_id", "amount"), "invoice_id")
