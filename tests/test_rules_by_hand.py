"""Hand-made records with outcomes worked out from the rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F


from freightlens.fixtures import APPROVED_BY_MODE
from freightlens.operators import duplicates, invoice_rules as inv, profiles, shipment_rules as shp
from freightlens.operators.anomaly import finish, flag, flag_with_combined

D = dt.date
INVOICE = (
    "invoice_id string, supplier string, amount double, payment_terms string, status string, issue_date date, "
    "due_date date, approver string, src_row string, early_discount double, currency string, notes string"
)


def invoices(spark, rows):
    return spark.createDataFrame([(*r, None, None, None)[: 12] if len(r) == 9 else r for r in rows], INVOICE)


TERMS = [
    ("Orion Electronics", "NET30", "low"),
    ("Quartz Systems Inc", "NET30", "low"),
    ("Delta Haulage", "NET45", "low"),
    ("Late Parts Inc", "NET15", "high"),
    ("Acme Corp", "NET30", "low"),
]
TIERS = [("Harbour Worldwide", "tier_1"), ("Regional Express", "tier_2"), ("Suspicious Cargo", "blacklisted")]

KNOWN = [
    ("TEST-INV-001", "Orion Electronics", 25000.0, "NET30", "pending", D(2025, 6, 30), D(2025, 7, 30), "John Doe", "1"),
    ("TEST-INV-002", "Late Parts Inc", 50000.0, "NET7", "pending", D(2025, 6, 30), D(2025, 7, 7), "", "2"),
    ("TEST-INV-003", "Quartz Systems Inc", 10000.0, "NET15", "pending", D(2025, 6, 30), D(2025, 7, 15), "Jane Smith", "3"),
    ("TEST-INV-004", "Delta Haulage", 99999.99, "NET30", "pending", D(2025, 6, 30), D(2025, 7, 30), "", "4"),
    ("TEST-INV-005", "Acme Corp", 1500.0, "NET30", "approved", D(2025, 6, 30), D(2025, 7, 30), "Bob Johnson", "5"),
]


def main_anomalies(spark, rows, history=None):
    df = invoices(spark, rows)
    past = df.limit(0) if history is None else invoices(spark, history)
    joined = inv.with_supplier_terms(inv.with_supplier_profile(df, profiles.supplier_profile(past)), spark.createDataFrame(TERMS, "supplier string, agreed_terms string, supplier_risk string"))
    joined = joined.withColumn("related", F.lit(None).cast("string"))
    return flag(joined, "invoice_id", *inv.main_rules())


def test_known_anomalies_without_history(spark):
    got = {(r["document_id"], r["anomaly_type"]) for r in main_anomalies(spark, KNOWN).collect()}
    assert got == {
        ("TEST-INV-001", "insufficient_approval"),
        ("TEST-INV-002", "payment_terms_violation"),
        ("TEST-INV-002", "fraud_pattern"),
        ("TEST-INV-003", "payment_terms_violation"),
        ("TEST-INV-003", "insufficient_approval"),
        ("TEST-INV-004", "payment_terms_violation"),
    }


def test_details_of_an_anomaly(spark):
    rows = {(r["document_id"], r["anomaly_type"]): r for r in finish(main_anomalies(spark, KNOWN), "2025-07-01").collect()}
    r = rows[("TEST-INV-002", "payment_terms_violation")]
    assert r["risk_score"] == pytest.approx(8 / 15)
    assert r["description"] == "Payment terms (7 days) deviate from expected terms (15 days) for supplier Late Parts Inc"
    assert r["recommendations"][0] == "Verify payment terms with supplier agreement"
    assert r["metadata"]["deviation"] == "8"
    f = rows[("TEST-INV-002", "fraud_pattern")]
    assert (f["risk_score"], f["severity"], f["evidence"]) == (0.5, "medium", ["High risk supplier"])
    a = rows[("TEST-INV-001", "insufficient_approval")]
    assert a["description"] == "Invoice amount ($25,000.00) requires director approval but approved by manager"


def test_history_adds_the_amount_rule_and_leaves_flagged_rows_out(spark):
    past = [(f"H{i}", "Orion Electronics", 1000.0 + 10 * i, "NET30", "paid", D(2025, 1, 6), D(2025, 2, 5), "x", f"h{i}") for i in range(5)]
    past.append(("HX", "Orion Electronics", 900000.0, "NET30", "flagged", D(2025, 1, 6), D(2025, 2, 5), "x", "hx"))
    got = {(r["document_id"], r["anomaly_type"]): r for r in main_anomalies(spark, KNOWN, past).collect()}
    r = got[("TEST-INV-001", "invoice_amount_deviation")]
    assert (r["risk_score"], r["severity"]) == (0.95, "high")
    assert len(got) == 7


def test_one_row_history_has_no_deviation(spark):
    past = [("H", "Orion Electronics", 1.0, "NET30", "paid", D(2025, 1, 6), D(2025, 2, 5), "x", "h")]
    assert "invoice_amount_deviation" not in {r["anomaly_type"] for r in main_anomalies(spark, KNOWN, past).collect()}


def test_missing_fields_add_up(spark):
    rows = [("A", None, 500.0, None, "x", None, None, None, "1"), ("B", "Acme Corp", 500.0, "NET30", "x", D(2025, 6, 30), None, None, "2")]
    got = {r["document_id"]: r for r in main_anomalies(spark, rows).where("anomaly_type = 'fraud_pattern'").collect()}
    assert got["A"]["risk_score"] == 0.95 and got["A"]["severity"] == "high"
    assert got["B"]["risk_score"] == 0.5 and got["B"]["evidence"][1] == "Missing fields: due_date"


def test_late_fee(spark):
    rows = [("A", "s", 1000.0, "NET30", "x", None, D(2025, 1, 1), None, "1"), ("B", "s", 1000.0, "NET30", "x", None, D(2025, 2, 20), None, "2")]
    got = {r["invoice_id"]: r["fee"] for r in invoices(spark, rows).select("invoice_id", inv.late_fee("2025-03-02").alias("fee")).collect()}
    assert got == {"A": 15.0, "B": 0.0}  # 60 days overdue: one month past the free thirty


def test_weekend_text(spark):
    row = [("A", "Acme Corp", 1.0, "NET30", "x", D(2025, 6, 28), D(2025, 7, 28), None, "1")]
    r = main_anomalies(spark, row).where("anomaly_type = 'weekend_processing'").first()
    assert r["description"] == "Invoice issued on weekend (Saturday, 2025-06-28)"


def brute_twins(rows, same):
    out = {}
    for r in rows:
        earlier = [e for e in rows if e["o"] < r["o"] and e["id"] != r["id"] and all(e[s] == r[s] and r[s] is not None for s in same)]
        if earlier:
            out[r["o"]] = min(earlier, key=lambda e: e["o"])["id"]
    return out


def test_earlier_twin_against_brute_force(spark):
    import random

    rnd = random.Random(7)
    rows = [{"id": f"i{rnd.randrange(6)}", "a": rnd.choice(["x", "x", "x", "y", None]), "b": rnd.randrange(2), "o": f"{n:04d}"} for n in range(300)]
    df = spark.createDataFrame(rows, "id string, a string, b int, o string")
    got = {r["o"]: r["related"] for r in duplicates.earlier_twin(df, "id", ["a", "b"], "o").collect()}
    assert got == brute_twins(rows, ["a", "b"])


def test_first_seen_and_keep_first(spark):
    df = spark.createDataFrame([("a", "1"), ("b", "2"), ("a", "3"), ("a", "4")], "id string, o string")
    assert {(r["o"], r["first_order"]) for r in duplicates.first_seen(df, "id", "o").collect()} == {("3", "1"), ("4", "1")}
    assert {(r["id"], r["o"]) for r in duplicates.keep_first(df, "id", "o").collect()} == {("a", "1"), ("b", "2")}


SHIPMENT = (
    "shipment_id string, origin string, destination string, carrier string, status string, departure_date date, "
    "estimated_arrival date, actual_arrival date, value double, src_row string"
)


def test_second_detector_on_shipments(spark):
    rows = [
        ("S1", "New York USA", "London UK", "Alternative Air", "Delivered", D(2025, 1, 1), D(2025, 1, 5), D(2025, 1, 12), 60500.5, "1"),
        ("S2", "Shanghai China", "Hamburg Germany", "blue ocean lines", "Delayed", D(2025, 1, 1), D(2025, 1, 5), None, 20000.0, "2"),
        ("S3", "A", "B", "Countrywide Express", "In Transit", D(2025, 1, 1), D(2025, 1, 5), None, 10.0, "3"),
    ]
    df = shp.with_transport(spark.createDataFrame(rows, SHIPMENT), "2025-01-20")
    got = {}
    for r in flag_with_combined(df, "shipment_id", *shp.extended_rules(APPROVED_BY_MODE)).collect():
        got.setdefault(r["document_id"], {})[r["anomaly_type"]] = r["risk_score"]
    assert got["S1"] == {
        "unauthorized_carrier": 0.85,
        "route_deviation": pytest.approx(0.9),
        "timeline_delay": pytest.approx(0.4 + (168 / 120 - 1) * 0.3),
        "high_value_shipment": 0.6,
        "combined_risk_factors": 0.98,
    }
    # fifteen days over a limit of five is the cap
    assert got["S2"] == {"timeline_delay": 0.95, "suspicious_value_pattern": 0.7, "combined_risk_factors": 0.98}
    assert "S3" not in got


def test_main_detector_on_shipments(spark):
    past = [(f"P{i}", "X", "Y", "Regional Express", "Delivered", D(2025, 1, 1), D(2025, 1, 5), None, 1.0, f"p{i}") for i in range(3)]
    rows = [
        ("S1", "X", "Y", "Suspicious Cargo", "delivered", D(2025, 1, 1), D(2025, 1, 5), None, 1.0, "1"),
        ("S2", "X", "Y", "Nobody", "in_transit", D(2025, 1, 1), D(2025, 1, 11), None, 1.0, "2"),
        ("S3", "Unknown", "Unknown", "Harbour Worldwide", "in transit", D(2025, 3, 1), D(2025, 3, 4), None, 1.0, "3"),
    ]
    extra = lambda df: df.withColumn("risk_score", F.lit(0.1)).withColumn("anomaly_type", F.lit("none"))
    profile = profiles.route_profile(extra(spark.createDataFrame(past, SHIPMENT)))
    df = shp.with_carrier_tier(shp.with_route_profile(spark.createDataFrame(rows, SHIPMENT), profile), spark.createDataFrame(TIERS, "carrier string, tier string"))
    got = {(r["document_id"], r["anomaly_type"], round(r["risk_score"], 4)) for r in flag(df, "shipment_id", *shp.main_rules("2025-02-01")).collect()}
    assert got == {
        ("S1", "blacklisted_carrier", 0.95),
        ("S2", "unusual_carrier", 0.8),
        ("S2", "transit_time_anomaly", 0.9),
        ("S2", "shipment_overdue", 0.9),
        ("S3", "suspicious_route", 0.85),
        ("S3", "status_inconsistency", 0.7),
    }


def test_rule_in_force_on_a_date(spark):
    from freightlens.operators import validity

    day = lambda n: None if n is None else dt.date(2024, 1, 1) + dt.timedelta(days=n)
    versions = [("k", 0, 1, 10), ("k", 20, 2, None), ("k", 20, 3, None), ("k", 30, 4, 25), ("k", 40, 5, None), (None, 0, 6, None), ("k", None, 7, None), ("m", 5, 8, 7)]
    df = spark.createDataFrame([(k, day(e), n, day(u)) for k, e, n, u in versions], "key string, effective date, no int, until date")
    found = validity.ranges(df, "key", "effective", "no", "until")
    asked = [("k", -1), ("k", 0), ("k", 9), ("k", 10), ("k", 20), ("k", 29), ("k", 30), ("k", 39), ("k", 40), ("k", 4000), ("m", 6), ("m", 7), ("q", 1), (None, 1), ("k", None), ("k", 0)]
    records = spark.createDataFrame([(i, k, day(d)) for i, (k, d) in enumerate(asked)], "id int, key string, at date")
    got = {r["id"]: r["no"] for r in validity.as_of(records, found, "key", "at").collect()}
    # version 4 ends before it begins, so nothing holds from day 30 to 40
    assert [got[i] for i in range(len(asked))] == [None, 1, 1, None, 3, 3, None, None, 5, 5, 8, None, None, None, None, 1]
