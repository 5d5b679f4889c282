"""The anomaly struct every rule yields, and the single pass that runs rules over records."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import text_id
from ..refdata import RECOMMENDATIONS

Rule = Callable[[], Column]


def anomaly(
    when: Column,
    kind: str | Column,
    risk: float | Column,
    severity: str | Column | None = None,
    description: Column | None = None,
    evidence: Sequence[Column | str] = (),
    **metadata: Column | str,
) -> Column:
    """Struct of one anomaly where ``when`` holds, else NULL."""
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    pairs = [p for k, v in metadata.items() for p in (F.lit(k), as_col(v).cast("string"))]
    facts = F.array(*[as_col(e) for e in evidence]) if evidence else F.array().cast("array<string>")
    return F.when(
        when,
        F.struct(
            as_col(kind).alias("anomaly_type"),
            as_col(risk).cast("double").alias("risk_score"),
            as_col(severity).cast("string").alias("severity"),
            (description if description is not None else F.lit(None)).cast("string").alias("description"),
            facts.alias("evidence"),
            (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("metadata"),
        ),
    )


def recommendations_for(kind: Column) -> Column:
    table = F.create_map(
        *[x for k, texts in RECOMMENDATIONS.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in texts]))]
    )
    return F.coalesce(F.try_element_at(table, kind), F.array().cast("array<string>"))


def flag(records: DataFrame, id_col: str, *rules: Column, keep: Sequence[str] = ()) -> DataFrame:
    """Anomalies of every record: all rules in one array, one explode, one scan."""
    found = F.array_compact(F.array(*rules))
    base = [F.col(id_col).alias("document_id"), "src_row", *keep]
    return records.select(*base, F.explode(found).alias("a")).select("document_id", "src_row", *keep, "a.*")


def flag_with_combined(records: DataFrame, id_col: str, *rules: Column) -> DataFrame:
    """As ``flag``, and a record with two or more anomalies gets a combined one as well.

    The combination is made inside the record's own array, so it needs no shuffle.
    """
    found = F.array_compact(F.array(*rules))
    base = records.select(F.col(id_col).alias("document_id"), "src_row", found.alias("found"))
    combined = F.when(
        F.size("found") >= 2,
        F.array(
            F.struct(
                F.lit("combined_risk_factors").alias("anomaly_type"),
                F.least(F.lit(0.98), F.array_max(F.transform("found", lambda a: a.risk_score)) + 0.1).alias("risk_score"),
                F.lit(None).cast("string").alias("severity"),
                F.concat(
                    F.lit("Multiple risk factors detected: "),
                    F.array_join(F.transform("found", lambda a: a.anomaly_type), ", "),
                ).alias("description"),
                F.transform("found", lambda a: a.anomaly_type).alias("evidence"),
                F.create_map(
                    F.lit("individual_risk_scores"),
                    F.array_join(F.transform("found", lambda a: a.risk_score.cast("string")), ","),
                ).alias("metadata"),
            )
        ),
    )
    both = F.when(combined.isNull(), F.col("found")).otherwise(F.concat("found", combined))
    return base.select("document_id", "src_row", F.explode(both).alias("a")).select("document_id", "src_row", "a.*")


def finish(anomalies: DataFrame, as_of: str) -> DataFrame:
    """Full ANOMALY rows: deterministic id, recommendations and the detection time passed in."""
    return anomalies.select(
        text_id("anomaly_type", "document_id", "src_row").alias("id"),
        "document_id",
        "src_row",
        "anomaly_type",
        "risk_score",
        "severity",
        "description",
        "evidence",
        recommendations_for(F.col("anomaly_type")).alias("recommendations"),
        F.lit(as_of).cast("timestamp").alias("ts"),
        "metadata",
    )
