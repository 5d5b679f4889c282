"""Baselines per supplier, route and route-carrier. Every aggregate is mergeable before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import days


def _only(cond: Column, col: str) -> Column:
    return F.when(cond, F.col(col))


def supplier_profile(invoices: DataFrame, flagged: str = "flagged") -> DataFrame:
    """Amount, terms and discount baseline of the rows that are not flagged, one pass.

    The mode keeps one counter per distinct terms code of a supplier, not the rows.
    """
    clean = F.coalesce(F.col("status") != flagged, F.lit(True))
    return (
        invoices.groupBy("supplier")
        .agg(
            F.avg(_only(clean, "amount")).alias("avg_amount"),
            F.stddev_samp(_only(clean, "amount")).alias("std_amount"),
            F.mode(_only(clean, "payment_terms"), True).alias("typical_terms"),
            F.avg(_only(clean, "early_discount")).alias("avg_discount"),
            F.count_if(clean).alias("invoice_count"),
            F.avg((~clean).cast("double")).alias("flagged_rate"),
        )
        .where("invoice_count > 0")
    )


def invoice_history(invoices: DataFrame) -> DataFrame:
    """Amounts, discounts and approvers per supplier and terms, kept as moments instead of lists."""
    return (
        invoices.where("supplier <> '' AND payment_terms <> ''")
        .groupBy("supplier", "payment_terms")
        .agg(
            F.count("amount").alias("hist_n"),
            F.avg("amount").alias("hist_avg"),
            F.stddev_pop("amount").alias("hist_std"),
            F.avg("early_discount").alias("hist_discount"),
            F.array_sort(F.collect_set("approver")).alias("approvers"),
        )
    )


def route_profile(shipments: DataFrame, default_days: float = 7.0) -> DataFrame:
    """Carriers, mean risk, mean transit days and anomaly rate per route."""
    transit = days("estimated_arrival", "departure_date")
    odd = F.coalesce(F.col("anomaly_type") != "none", F.lit(False))
    return shipments.groupBy("origin", "destination").agg(
        F.array_sort(F.collect_set("carrier")).alias("common_carriers"),
        F.avg("risk_score").alias("avg_risk_score"),
        F.coalesce(F.avg(transit), F.lit(default_days)).alias("avg_transit_days"),
        F.avg(odd.cast("double")).alias("anomaly_rate"),
        F.count("*").alias("route_rows"),
    )


def route_carrier_history(shipments: DataFrame) -> DataFrame:
    """Transit hours, risk and value per route and carrier; zero transit times do not count."""
    hours = days("estimated_arrival", "departure_date") * 24
    return (
        shipments.where("origin <> '' AND destination <> '' AND carrier <> ''")
        .groupBy("origin", "destination", "carrier")
        .agg(
            F.count(F.nullif(hours, F.lit(0))).alias("transit_n"),
            F.avg(F.nullif(hours, F.lit(0))).alias("avg_transit_hours"),
            F.count("risk_score").alias("risk_n"),
            F.avg("risk_score").alias("avg_risk_score"),
            F.avg("value").alias("avg_value"),
            F.stddev_pop("value").alias("std_value"),
            F.min_by("expected_route", "src_row").alias("known_route"),
        )
    )
