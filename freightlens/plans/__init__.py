"""The query catalogue."""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import freightlens


def all_queries():
    from . import catalog, causality, extraction, io, records, scalars, search, store, streams, texts  # noqa: F401

    # Python tasks carry the few functions they need, so workers need no copy of the package
    cloudpickle.register_pickle_by_value(freightlens)
    return catalog.QUERIES, catalog.ORACLE


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which invoices deviate from their supplier's history, summed up."""
    from ..operators.summaries import anomaly_summary
    from .catalog import Source
    from .records import INVOICE_FLAGS

    return anomaly_summary(INVOICE_FLAGS["inv_amount_deviation"](Source(spark, sf_dir)))
