"""Reference data and thresholds. Rules take these as parameters; the values here are the defaults."""

from __future__ import annotations

# fixed values: country pairs shipped by sea
OCEAN_PAIRS = [("China", "Germany"), ("USA", "UK"), ("Japan", "Korea")]

# fixed values: city pairs that count as unusual
UNUSUAL_CITY_PAIRS = [("New York", "London")]

# fixed values: route texts that are suspicious as such
SUSPICIOUS_ROUTES = ["unknown -> unknown", "suspicious -> suspicious", "fake -> fake"]

# fixed values: invoice rule settings
ROUND_AMOUNTS = [100.0, 500.0, 1000.0, 5000.0, 10000.0]
APPROVAL_LEVELS = {"manager": 5000.0, "director": 25000.0, "cfo": 50000.0}
MANAGER_NAMES = ["john", "sarah", "michael", "emily", "david"]
POLICY_APPROVAL = {"auto": 5000.0, "manager": 15000.0, "director": 50000.0, "cfo": 100000.0}
LATE_FEE_RATE = 0.015
LATE_FEE_FREE_DAYS = 30

# fixed values: hours of delay tolerated per freight mode
DELAY_HOURS = {"air": 48, "ocean": 120, "ground": 24}

# fixed values: what to do about an anomaly
RECOMMENDATIONS = {
    "invoice_amount_deviation": [
        "Verify invoice details with supplier",
        "Check for additional services or bulk orders",
        "Require additional approval for processing",
    ],
    "payment_terms_violation": [
        "Verify payment terms with supplier agreement",
        "Check for special payment arrangements",
        "Update supplier payment terms if needed",
    ],
    "weekend_processing": [
        "Verify invoice authenticity",
        "Check for automated processing systems",
        "Confirm with supplier if needed",
    ],
    "potential_duplicate": [
        "Check for duplicate invoice numbers",
        "Verify with accounts payable",
        "Contact supplier to confirm",
    ],
    "insufficient_approval": [
        "Escalate to appropriate approval level",
        "Review approval workflow",
        "Update approval limits if needed",
    ],
    "fraud_pattern": [
        "Conduct detailed fraud investigation",
        "Verify supplier legitimacy",
        "Check supporting documentation",
        "Consider holding payment pending review",
    ],
    "blacklisted_carrier": [
        "Immediately investigate shipment",
        "Contact security team",
        "Verify shipment authenticity",
        "Consider blocking shipment",
    ],
    "unusual_carrier": [
        "Verify carrier selection reason",
        "Check carrier credentials",
        "Monitor shipment closely",
    ],
    "transit_time_anomaly": [
        "Investigate cause of delay",
        "Check for route changes",
        "Verify carrier performance",
        "Consider alternative routing",
    ],
    "suspicious_route": [
        "Verify route authenticity",
        "Check origin and destination validity",
        "Investigate carrier credentials",
        "Consider route blocking",
    ],
    "status_inconsistency": [
        "Verify departure date accuracy",
        "Update status if needed",
        "Check for data entry errors",
    ],
    "shipment_overdue": [
        "Contact carrier for status update",
        "Investigate potential delays",
        "Update customer on delivery status",
        "Consider alternative shipping",
    ],
}

DAY = 86400

# fixed values: (cause type, effect type, window in seconds, strength threshold); the events engine
CAUSAL_RULES = [
    ("driver_risk_increase", "shipment_delay", 3 * DAY, 0.7),
    ("weather_event", "shipment_delay", 3 * DAY, 0.7),
    ("loading_issue", "shipment_delay", 3 * DAY, 0.7),
    ("weather_event", "shipment_anomaly", 3 * DAY, 0.7),
    ("driver_risk_increase", "shipment_anomaly", 3 * DAY, 0.7),
    ("route_change", "shipment_anomaly", 3 * DAY, 0.7),
    ("payment_policy_change", "invoice_delay", 5 * DAY, 0.8),
    ("payment_policy_change", "payment_hold", 5 * DAY, 0.8),
    ("policy_update", "payment_term_violation", 5 * DAY, 0.65),
    ("invoice_anomaly", "payment_term_violation", 5 * DAY, 0.65),
    ("driver_risk_increase", "shipment_delay", 2 * DAY, 0.75),
    ("driver_risk_increase", "invoice_delay", 2 * DAY, 0.75),
    ("driver_risk_increase", "risk_based_hold", 2 * DAY, 0.75),
    ("loading_issue", "package_missing", 4 * DAY, 0.65),
    ("theft_event", "package_missing", 4 * DAY, 0.65),
    ("labeling_error", "package_missing", 4 * DAY, 0.65),
    ("package_missing", "shipment_delay", 4 * DAY, 0.65),
    ("package_missing", "invoice_dispute", 4 * DAY, 0.65),
]

# fixed values: what an event type is also called where it is registered
EVENT_SYNONYMS = {"driver_risk_update": "driver_risk_increase"}

# fixed values: added strength of well-known pairs
PAIR_BOOST = [
    ("driver_risk_increase", "shipment_delay", 0.15),
    ("driver_risk_increase", "risk_based_hold", 0.25),
    ("payment_policy_change", "invoice_delay", 0.2),
    ("package_missing", "shipment_delay", 0.25),
]

# fixed values: temporal part of the additive strength, (at most this many seconds, points)
PROXIMITY_POINTS = [(3600, 0.3), (DAY, 0.2), (3 * DAY, 0.1)]

# fixed values: links that put the effect's entity on hold
HOLD_PATTERNS = [
    ("driver_risk_increase", "shipment_delay", 0.8),
    ("package_missing", "invoice_dispute", 0.75),
    ("payment_policy_change", "invoice_delay", 0.85),
]

# fixed values: rules of the entity analysis, (rule, cause type, window in seconds, threshold)
ANALYSIS_RULES = [
    ("invoice_delay", "shipment_delay", 7 * DAY, 0.6),
    ("invoice_delay", "payment_policy_change", 7 * DAY, 0.6),
    ("invoice_delay", "driver_risk_increase", 7 * DAY, 0.6),
    ("shipment_anomaly", "weather_event", 3 * DAY, 0.7),
    ("shipment_anomaly", "driver_risk_increase", 3 * DAY, 0.7),
    ("shipment_anomaly", "route_change", 3 * DAY, 0.7),
    ("payment_term_violation", "policy_update", 5 * DAY, 0.65),
    ("payment_term_violation", "invoice_anomaly", 5 * DAY, 0.65),
]

# fixed values: hold thresholds after an entity analysis
HOLD_THRESHOLDS = {"invoice": 0.75, "shipment": 0.8, "driver": 0.7, "combined": 0.6}

# fixed values: words that tell what a question is about
INVOICE_TERMS = [
    "invoice", "payment", "discount", "late fee", "compliance", "due date", "supplier", "billing",
    "amount", "currency", "net30", "net45", "early payment", "penalty", "payout", "financial", "accounting",
]
SHIPMENT_TERMS = [
    "shipment", "route", "delivery", "tracking", "anomaly", "freight", "carrier", "origin", "destination",
    "transit", "logistics", "cargo", "customs", "delay", "deviation", "fraud", "risk",
]
POLICY_TERMS = [
    "policy", "rule", "guideline", "procedure", "protocol", "compliance", "regulation", "standard", "requirement",
]
INVOICE_KEY_WORDS = [
    "invoice", "payment", "amount", "due", "discount", "supplier", "late", "fee", "penalty", "net30", "net45",
    "compliance",
]
SHIPMENT_KEY_WORDS = [
    "shipment", "route", "carrier", "delivery", "origin", "destination", "anomaly", "delay", "risk", "fraud",
    "tracking",
]
ROUTES = [
    ("invoice", ["invoice", "invoices", "payment", "billing", "late fee", "fees"]),
    ("shipment", ["shipment", "shipments", "delivery", "route", "carrier"]),
    ("anomaly", ["anomaly", "anomalies", "unusual", "suspicious", "flagged", "risk", "deviation", "issue", "problem"]),
    ("count", ["how many", "count", "total", "number of"]),
]
ANOMALY_WORDS = ROUTES[2][1]
CAUSAL_TERMS = [
    "why", "cause", "reason", "because", "due to", "resulted in", "led to", "root cause", "trigger", "caused by",
    "explain why", "what caused", "how did", "what led to",
]
INTENTS = [
    ("explanation", ["why", "reason", "cause", "explain"]),
    ("calculation", ["how much", "calculate", "amount", "cost"]),
    ("search", ["list", "show", "find", "search"]),
    ("risk_assessment", ["risk", "anomaly", "suspicious", "fraud"]),
]

# fixed values: scenario tag written with each kind of update
SCENARIOS = {
    "driver_risk": "driver_risk_update",
    "invoice_compliance": "invoice_compliance",
    "shipment_anomaly": "shipment_fraud_detection",
    "policy_update": "policy_compliance",
    "user_upload": "user_upload",
}
