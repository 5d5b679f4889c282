"""Summaries: each is one grouped pass with partial aggregation before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import missing, risk_band_3, risk_band_4


def _share(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False))


def anomaly_summary(anomalies: DataFrame, high: float = 0.8) -> DataFrame:
    """Total, per type and per severity in one pass over grouping sets."""
    per_pair = anomalies.groupBy("anomaly_type", "severity").agg(
        F.count("*").alias("n"), F.count_if(F.col("risk_score") >= high).alias("high")
    )
    return (
        per_pair.groupingSets([[], ["anomaly_type"], ["severity"]], "anomaly_type", "severity")
        .agg(F.grouping("anomaly_type").alias("no_type"), F.grouping("severity").alias("no_severity"), F.sum("n").alias("n"), F.sum("high").alias("high_risk"))
        .select(
            F.when(F.col("no_type") == 0, "type").when(F.col("no_severity") == 0, "severity").otherwise("total").alias("kind"),
            F.coalesce("anomaly_type", "severity").alias("value"),
            "n",
            "high_risk",
        )
    )


def risk_level_summary(anomalies: DataFrame) -> DataFrame:
    """Total with processed documents, per type and per four-step band."""
    rows = anomalies.select("document_id", "anomaly_type", risk_band_4("risk_score").alias("band"))
    counts = (
        rows.groupBy("anomaly_type", "band").count()
        .groupingSets([[], ["anomaly_type"], ["band"]], "anomaly_type", "band")
        .agg(F.grouping("anomaly_type").alias("no_type"), F.grouping("band").alias("no_band"), F.sum("count").alias("n"))
        .select(
            F.when(F.col("no_type") == 0, "type").when(F.col("no_band") == 0, "risk_level").otherwise("total").alias("kind"),
            F.coalesce("anomaly_type", "band").alias("value"),
            "n",
        )
    )
    documents = rows.agg(F.count_distinct("document_id").alias("n")).select(
        F.lit("processed_documents").alias("kind"), F.lit(None).cast("string").alias("value"), "n"
    )
    return counts.unionByName(documents)


def risk_distribution(anomalies: DataFrame, is_new: Column | None = None) -> DataFrame:
    band = risk_band_3("risk_score")
    return anomalies.agg(
        F.count("*").alias("total"),
        F.count_if(band == "high").alias("high_risk"),
        F.count_if(band == "medium").alias("medium_risk"),
        F.count_if(band == "low").alias("low_risk"),
        (F.count("*") if is_new is None else F.count_if(is_new)).alias("new_anomalies"),
    )


def document_combined(anomalies: DataFrame) -> DataFrame:
    """Documents with two or more anomalies: how many, the highest risk and the types.

    Types are counted per document first, so a hot document keeps its distinct types, not its rows.
    """
    per_type = anomalies.groupBy("document_id", "anomaly_type").agg(
        F.count("*").alias("n"), F.max("risk_score").alias("risk_score")
    )
    return (
        per_type.groupBy("document_id")
        .agg(
            F.sum("n").alias("anomalies"),
            F.max("risk_score").alias("max_risk"),
            F.array_sort(F.collect_list("anomaly_type")).alias("types"),
        )
        .where("anomalies >= 2")
        .withColumn("combined_risk", F.least(F.lit(0.98), F.col("max_risk") + 0.1))
    )


def invoice_summary(invoices: DataFrame) -> DataFrame:
    status = F.lower("status")
    return invoices.agg(
        F.count("*").alias("invoices"),
        F.sum("amount").alias("total_amount"),
        F.count_if(_share(status == "overdue")).alias("overdue"),
        F.count_if(_share(status.contains("flag"))).alias("flagged"),
    )


def shipment_summary(shipments: DataFrame) -> DataFrame:
    status = F.lower("status")
    return shipments.agg(
        F.count("*").alias("shipments"),
        F.count_if(_share(status.contains("transit"))).alias("in_transit"),
        F.count_if(_share(status.contains("delay"))).alias("delayed"),
        F.count_if(_share(status.contains("deliver"))).alias("delivered"),
    )


def valid_records(rows: DataFrame, id_col: str) -> DataFrame:
    """Rows that are records: an id that is neither empty nor a repeated header or line item."""
    text = F.trim(F.col(id_col).cast("string"))
    return rows.where(~missing(text) & ~text.isin(id_col, "invoice_id", "shipment_id", "item", "quantity"))


def clean_records(rows: DataFrame, id_col: str) -> DataFrame:
    """NaN becomes NULL and rows that are no records are dropped."""
    floats = {n for n, t in rows.dtypes if t in ("double", "float")}
    cols = [F.when(~F.isnan(n), F.col(n)).alias(n) if n in floats else F.col(n) for n in rows.columns]
    return valid_records(rows, id_col).select(*cols)


def record_counts(**kinds: tuple[DataFrame, str]) -> DataFrame:
    """Valid records per kind; each kind is (rows, id column)."""
    out = None
    for kind, (rows, id_col) in kinds.items():
        one = valid_records(rows, id_col).agg(F.count("*").alias("records")).select(F.lit(kind).alias("kind"), "records")
        out = one if out is None else out.unionByName(one)
    return out


def doc_stats(updates: DataFrame, kind: str = "update_type", ts: str = "ts", scenario: str = "scenario") -> DataFrame:
    """Count, newest time and the scenario of the newest update, per kind."""
    return updates.groupBy(kind).agg(
        F.count("*").alias("n"), F.max(ts).alias("latest_update"), F.max_by(scenario, F.struct(ts, scenario)).alias("last_scenario")
    )


def counts_with_total(rows: DataFrame, kind: str) -> DataFrame:
    return rows.rollup(kind).count().select(F.coalesce(kind, F.lit("total")).alias(kind), F.col("count").alias("n"))


def hold_summary(holds: DataFrame, high: float = 0.8, weight: str | None = None) -> DataFrame:
    """Holds by status; with ``weight`` a row stands for so many holds."""
    n = F.lit(1).cast("bigint") if weight is None else F.col(weight)
    count = lambda cond: F.coalesce(F.sum(F.when(cond, n)), F.lit(0).cast("bigint"))
    return holds.agg(
        count(F.lit(True)).alias("total_holds"),
        count(F.col("status") == "active").alias("active_holds"),
        count(F.col("status") == "pending_review").alias("pending_holds"),
        count(F.col("status") == "resolved").alias("resolved_holds"),
        count(F.col("risk_score") >= high).alias("high_risk_holds"),
    )


def upload_summary(files: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Per file: characters, records and anomalies by band. Both sides carry ``file``.

    Counted per side before the join, so neither side multiplies the other.
    """
    band = risk_band_3("risk_score")
    texts = files.groupBy("file").agg(F.sum("characters").alias("characters"), F.count("*").alias("records"))
    found = anomalies.groupBy("file").agg(
        F.count("*").alias("anomalies"),
        *[F.count_if(band == b).alias(f"{b}_risk") for b in ("high", "medium", "low")],
    )
    return texts.join(found, "file", "left").na.fill(0, ["anomalies", "high_risk", "medium_risk", "low_risk"])


def top_types(anomalies: DataFrame, k: int = 5) -> DataFrame:
    return anomalies.groupBy("anomaly_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "anomaly_type").limit(k)


def newest(rows: DataFrame, k: int | None = None, ts: str = "ts", tie: str = "id") -> DataFrame:
    """Newest first; the id breaks ties so that equal times have one order."""
    out = rows.orderBy(F.desc(ts), tie)
    return out if k is None else out.limit(k)


def riskiest(rows: DataFrame, k: int | None = None, tie: str = "id") -> DataFrame:
    out = rows.orderBy(F.desc("risk_score"), F.desc("ts"), tie)
    return out if k is None else out.limit(k)
