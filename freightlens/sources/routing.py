"""Which kind of record a file or text holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import c, first_match
from .readers import csv_headers

# fixed values: words that give a text away, in order
CONTENT_WORDS = [
    ("invoice", ["invoice", "bill", "payment"]),
    ("shipment", ["shipment", "shipping", "transport", "delivery"]),
    ("policy", ["policy", "guideline", "procedure"]),
]
# fixed values: column names that give a table away, in order
HEADER_NAMES = [
    ("invoice", ["invoice", "amount", "supplier"]),
    ("shipment", ["shipment", "origin", "destination", "carrier"]),
    ("driver_risk", ["driver", "risk"]),
]


def by_name(path: str | Column) -> Column:
    """From directory and file name; NULL when they say nothing."""
    p = c(path)
    name = F.lower(F.element_at(F.split(p, "/"), -1))
    return (
        F.when(p.contains("/invoices/") | name.contains("invoice"), "invoice")
        .when(p.contains("/shipments/") | name.contains("shipment"), "shipment")
        .when(p.contains("/policies/") | name.contains("policy"), "policy")
        .when(name.contains("driver") & name.contains("risk"), "driver_risk")
    )


def by_header(names: str | Column) -> Column:
    """From an array of column names."""
    low = F.transform(c(names), lambda n: F.lower(n))
    out = None
    for kind, hints in HEADER_NAMES:
        cond = F.arrays_overlap(low, F.array(*[F.lit(h) for h in hints]))
        out = F.when(cond, kind) if out is None else out.when(cond, kind)
    return out


def by_content(text: str | Column) -> Column:
    """From the words of the whole text."""
    return first_match(text, CONTENT_WORDS, None)


def files_by_header(spark: SparkSession, path: str) -> DataFrame:
    """(file, header, kind) of the CSV files below ``path``, from their own first lines.

    What the header leaves open is decided by the name; NULL where that says nothing either.
    """
    return csv_headers(spark, path).withColumn("kind", F.coalesce(by_header("header"), by_name("file")))
