"""Row shapes as DDL. CSV input arrives as text and is cast with ``try_cast``."""

INVOICE = (
    "invoice_id string, supplier string, amount double, currency string, issue_date date, "
    "due_date date, payment_terms string, early_discount double, status string, approver string, "
    "shipment_id string, po_number string, notes string"
)
SHIPMENT = (
    "shipment_id string, origin string, destination string, carrier string, departure_date date, "
    "estimated_arrival date, actual_arrival date, status string, value double, risk_score double, "
    "anomaly_type string, driver_id string, actual_route string, expected_route string, deviation_km double"
)
DRIVER = (
    "driver_id string, name string, risk_level string, last_incident string, incident_type string, "
    "recommendation string, update_timestamp string, previous_risk string"
)
DRIVER_JSON = (
    "driver_id string, name string, previous_risk string, current_risk string, risk_score double, "
    "update_timestamp string, reason string"
)
POLICY = "file string, content string"
UPDATE = (
    "update_type string, content string, metadata map<string,string>, scenario string"
)
ANOMALY = (
    "id string, document_id string, anomaly_type string, risk_score double, severity string, "
    "description string, evidence array<string>, recommendations array<string>, ts timestamp, "
    "metadata map<string,string>"
)
ALERT = (
    "alert_id string, alert_type string, description string, risk_score double, ts timestamp, "
    "scenario string, source_data map<string,string>"
)
EVENT = (
    "event_id string, event_type string, entity_id string, entity_type string, description string, "
    "metadata map<string,string>, ts timestamp"
)
HOLD = (
    "hold_id string, entity_id string, entity_type string, risk_score double, reason string, "
    "causal_chain_id string, status string, created_at timestamp, updated_at timestamp, approved_by string"
)
FEEDBACK = "ts timestamp, query string, answer string, rating int, feedback string"
CHUNK = (
    "doc_id bigint, doc_type string, source string, chunk_id int, content string, ts timestamp"
)
STATS = "update_type string, n bigint, latest_update timestamp, last_scenario string"


def all_text(ddl: str) -> str:
    """The same columns with every one of them read as a string."""
    return ", ".join(f"{part.split()[0]} string" for part in ddl.split(", ") if part)


def columns(ddl: str) -> list[tuple[str, str]]:
    """(name, type) pairs of a flat DDL string."""
    return [tuple(part.split(" ", 1)) for part in ddl.split(", ")]
