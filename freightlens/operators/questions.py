"""What a question is about: document types, route, intent, causal wording and the ids it names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import refdata as ref
from ..functions.columns import c, first_match, has_any


def doc_types(text: str | Column) -> Column:
    found = F.array_compact(
        F.array(
            F.when(has_any(text, ref.INVOICE_TERMS), "invoice"),
            F.when(has_any(text, ref.SHIPMENT_TERMS), "shipment"),
            F.when(has_any(text, ref.POLICY_TERMS), "policy"),
        )
    )
    return F.when(F.size(found) == 0, F.array(F.lit("invoice"), F.lit("shipment"))).otherwise(found)


def route(text: str | Column) -> Column:
    return first_match(text, ref.ROUTES, None)


def intent(text: str | Column) -> Column:
    return first_match(text, ref.INTENTS, "general")


def is_causal(text: str | Column) -> Column:
    return has_any(text, ref.CAUSAL_TERMS)


def is_about_anomalies(text: str | Column) -> Column:
    return has_any(text, ref.ANOMALY_WORDS)


# fixed values: id patterns in reading order, with the group that holds the id
ID_PATTERNS = [
    (r"(?i)INV-\d{4}-\d{3,}", 0),
    (r"(?i)invoice #?(\d+)", 1),
    (r"(?i)invoice (\w+-\w+-\w+)", 1),
    (r"(?i)SHP-\d{4}-\d{3,}", 0),
    (r"(?i)shipment #?(\d+)", 1),
    (r"(?i)shipment (\w+-\w+-\w+)", 1),
]


def entity_ids(text: str | Column) -> Column:
    """All invoice and shipment ids a text names, pattern by pattern."""
    return F.concat(*[F.regexp_extract_all(c(text), F.lit(p), F.lit(g)) for p, g in ID_PATTERNS])
