"""Records as text for the index, and every source as one common update row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import has_any
from ..refdata import SCENARIOS


def _or(col: str, default: str = "Unknown") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(default))


def _money(col: str) -> Column:
    """Thousands and cents where the value is a number, else the raw text."""
    as_number = F.col(col).try_cast("double")
    return F.concat(F.lit("$"), F.coalesce(F.format_number(as_number, 2), _or(col)))


def _lines(*parts: Column) -> Column:
    return F.concat_ws("\n", *parts)


def _line(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"{label}: "), value)


def invoice_doc() -> Column:
    pct = F.coalesce(F.format_string("%.1f%%", F.col("early_discount").try_cast("double") * 100), _or("early_discount"))
    return _lines(
        _line("Invoice ID", _or("invoice_id")),
        _line("Supplier", _or("supplier")),
        _line("Amount", F.concat(_money("amount"), F.lit(" "), _or("currency", "USD"))),
        _line("Issue Date", _or("issue_date")),
        _line("Due Date", _or("due_date")),
        _line("Payment Terms", _or("payment_terms")),
        _line("Early Discount", pct),
        _line("Status", _or("status")),
        _line("Approver", _or("approver")),
        F.lit(""),
        F.concat(
            F.lit("This invoice shows payment terms of "), _or("payment_terms", "NET30"),
            F.lit(" with an early payment discount of "), pct, F.lit("."),
        ),
        F.concat(F.lit("The invoice amount is "), _money("amount"), F.lit(" and is currently "), _or("status", "pending"), F.lit(".")),
    )


def invoice_doc_short() -> Column:
    return F.concat(
        F.lit("Invoice "), _or("invoice_id"), F.lit("\nSupplier: "), _or("supplier"), F.lit("\nAmount: "), _or("amount"),
        F.lit("\nIssue Date: "), _or("issue_date"), F.lit("\nDue Date: "), _or("due_date"),
        F.lit("\nPayment Terms: "), _or("payment_terms"), F.lit("\n"),
    )


def shipment_doc() -> Column:
    risk = F.coalesce(F.format_string("%.2f", F.col("risk_score").try_cast("double")), _or("risk_score"))
    found = F.when(_or("anomaly_type", "none") != "none", F.concat(F.lit("Detected anomaly: "), F.col("anomaly_type"))).otherwise(
        "No anomalies detected."
    )
    return _lines(
        _line("Shipment ID", _or("shipment_id")),
        _line("Route", F.concat(_or("origin"), F.lit(" → "), _or("destination"))),
        _line("Carrier", _or("carrier")),
        _line("Departure Date", _or("departure_date")),
        _line("Estimated Arrival", _or("estimated_arrival")),
        _line("Actual Arrival", _or("actual_arrival", "TBD")),
        _line("Status", _or("status")),
        _line("Risk Score", risk),
        _line("Anomaly Type", _or("anomaly_type", "none")),
        F.lit(""),
        F.concat(F.lit("This shipment is traveling from "), _or("origin"), F.lit(" to "), _or("destination"), F.lit(" ")),
        F.concat(F.lit("via "), _or("carrier"), F.lit(". Current status is "), _or("status"), F.lit(" ")),
        F.concat(F.lit("with a risk score of "), risk, F.lit(".")),
        found,
    )


def shipment_doc_short() -> Column:
    return F.concat(
        F.lit("Shipment "), _or("shipment_id"), F.lit("\nOrigin: "), _or("origin"), F.lit("\nDestination: "), _or("destination"),
        F.lit("\nCarrier: "), _or("carrier"), F.lit("\nStatus: "), _or("status"), F.lit("\n"),
    )


def driver_doc() -> Column:
    return F.concat(
        F.lit("Driver "), _or("name"), F.lit(" risk level: "), _or("risk_level"), F.lit(". Last incident: "),
        _or("last_incident", "None"), F.lit(". Recommendation: "), _or("recommendation", "Standard monitoring"), F.lit("."),
    )


def upload_doc(row: Column, length: int = 500) -> Column:
    text = F.to_json(row, {"ignoreNullFields": "false"})
    return F.concat(F.lit("Uploaded document processed. Content: "), F.substring(text, 1, length), F.lit("..."))


def anomaly_doc() -> Column:
    return _lines(
        F.lit("ANOMALY DETECTED:"),
        _line("ID", F.col("id")),
        _line("Document", F.col("document_id")),
        _line("Type", F.col("anomaly_type")),
        _line("Severity", _or("severity", "unknown")),
        _line("Risk Score", F.col("risk_score").cast("string")),
        _line("Description", _or("description", "No description")),
        _line("Evidence", F.array_join("evidence", " | ")),
        _line("Recommendations", F.array_join("recommendations", " | ")),
        _line("Timestamp", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")),
    )


def policy_type_of_file(name: str | Column) -> Column:
    return F.when(has_any(name, ["payout"]), "payout").when(has_any(name, ["shipment"]), "shipment").otherwise("general")


def policy_type_of_text(text: str | Column) -> Column:
    return (
        F.when(has_any(text, ["payment"]), "payment")
        .when(has_any(text, ["shipment"]), "shipment")
        .when(has_any(text, ["driver"]), "driver")
        .otherwise("general")
    )


def _update(rows: DataFrame, kind: str, doc_type: str, content: Column, fields: dict[str, Column], scenarios: dict[str, str]) -> DataFrame:
    pairs = [F.lit("doc_type"), F.lit(doc_type)]
    for key, value in fields.items():
        pairs += [F.lit(key), value.cast("string")]
    return rows.select(
        F.lit(kind).alias("update_type"),
        content.alias("content"),
        F.create_map(*pairs).alias("metadata"),
        F.lit(scenarios[kind]).alias("scenario"),
    )


def _cols(*names: str) -> dict[str, Column]:
    return {n: F.col(n) for n in names}


def driver_updates(rows: DataFrame, scenarios=SCENARIOS) -> DataFrame:
    fields = {"driver_name": F.col("name"), **_cols("risk_level", "last_incident")}
    return _update(rows, "driver_risk", "driver_update", driver_doc(), fields, scenarios)


def invoice_updates(rows: DataFrame, scenarios=SCENARIOS) -> DataFrame:
    text = F.concat(
        F.lit("Invoice "), _or("invoice_id"), F.lit(" from "), _or("supplier"), F.lit(". Amount: "), _money("amount"),
        F.lit(". Payment terms: "), _or("payment_terms"), F.lit(". Due date: "), _or("due_date"), F.lit(". Status: "), _or("status"), F.lit("."),
    )
    return _update(rows, "invoice_compliance", "invoice_update", text, _cols("invoice_id", "supplier", "amount", "payment_terms"), scenarios)


def shipment_updates(rows: DataFrame, scenarios=SCENARIOS) -> DataFrame:
    text = F.concat(
        F.lit("Shipment "), _or("shipment_id"), F.lit(" route "), _or("origin"), F.lit(" → "), _or("destination"),
        F.lit(". Carrier: "), _or("carrier"), F.lit(". Status: "), _or("status"),
        F.lit(". Risk score: "), F.format_string("%.2f", F.coalesce(F.col("risk_score").try_cast("double"), F.lit(0.0))),
        F.lit(". Anomaly type: "), _or("anomaly_type", "none"), F.lit("."),
    )
    fields = _cols("shipment_id", "origin", "destination", "carrier", "status", "risk_score", "anomaly_type")
    return _update(rows, "shipment_anomaly", "shipment_update", text, fields, scenarios)


def policy_updates(rows: DataFrame, scenarios=SCENARIOS) -> DataFrame:
    """Rows of (file, content)."""
    fields = {"filename": F.col("file"), "policy_type": policy_type_of_file("file")}
    return _update(rows, "policy_update", "policy_update", F.col("content"), fields, scenarios)


def upload_updates(rows: DataFrame, scenarios=SCENARIOS) -> DataFrame:
    return _update(rows, "user_upload", "upload", upload_doc(F.struct(*rows.columns)), {}, scenarios)


def unify(*updates: DataFrame) -> DataFrame:
    out = updates[0]
    for other in updates[1:]:
        out = out.unionByName(other)
    return out
