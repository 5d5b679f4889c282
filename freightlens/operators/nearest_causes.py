"""The best causes of each entity's latest anomaly, and how many there are, without listing all pairs.

Within a kind (related or not) strength falls with the gap alone, so the best causes are the latest ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import refdata as ref
from ..functions.sizing import sized
from .causal import analysis_sides, judged_causes, normal_type, related_causes, top_causes, typed_causes
from .intervals import best_within, up_to, within
from .ranking import top_per_group

GROWTH = 4  # how much farther each round looks back


def nearest_causes(events: DataFrame, edges: DataFrame, k: int = 3, rules=ref.ANALYSIS_RULES) -> DataFrame:
    """The k strongest causes per anomaly, rows and ranks as ``top_causes(potential_causes(...), k)`` gives.

    The unrelated ones are looked for in a window that grows from round to round. It starts where a rule's types are
    expected k times, and an anomaly that has k causes leaves, so an anomaly meets some multiple of k events rather than
    all in its reach. Only a burst that holds many events in one such window costs more. Rounds are written to the
    shared folder; their number is a logarithm of the log's density.
    """
    anomalies, causes, pairs, reach = analysis_sides(events, edges, rules)
    anomalies, pairs = sized(anomalies), sized(pairs)
    order = [F.desc("cause_us"), F.col("cause_id")]
    best = top_per_group(judged_first(related_causes(anomalies, causes, pairs, reach)), ["anomaly_id"], order, k, "place").drop("place")
    found = [sized(best)]

    typed = sized(typed_causes(causes, rules))
    spans = typed.groupBy("rule").agg(F.count("*").alias("n"), (F.max("cause_us") - F.min("cause_us")).alias("span"))  # a row per rule
    steps = {r["rule"]: max(1, r["span"] * k // r["n"]) for r in spans.collect()}
    farthest = {r["rule"]: r["other_us"] for r in reach.collect() if r["rule"] in steps and r["other_us"] >= 0}
    open_ones = anomalies.drop("related_us", "other_us")
    while farthest:
        near = {rule: min(steps[rule], far) for rule, far in farthest.items()}
        looked = events.sparkSession.createDataFrame(sorted(near.items()), "rule string, reach_us bigint")
        asked = open_ones.join(F.broadcast(looked), "rule")  # rules that are through drop out
        met = within(typed.join(F.broadcast(looked), "rule"), asked, ["rule"], "cause_us", "anomaly_us", "reach_us").drop("reach_us")
        met = met.join(pairs, ["entity_id", "cause_entity_id"], "left_anti").withColumn("is_related", F.lit(False))
        few = sized(top_per_group(judged_first(met), ["anomaly_id"], order, k, "place"))
        through = few.where(F.col("place") == k).select("anomaly_id")
        last = F.col("rule").isin([rule for rule, far in farthest.items() if near[rule] >= far])
        done = few.join(through, "anomaly_id", "left_semi").unionByName(few.where(last).join(through, "anomaly_id", "left_anti"))
        found.append(done.drop("place"))
        open_ones = sized(open_ones.join(through, "anomaly_id", "left_anti"))
        farthest = {rule: far for rule, far in farthest.items() if near[rule] < far}
        steps = {rule: steps[rule] * GROWTH for rule in farthest}
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)
    return top_causes(judged_causes(every), k)


def judged_first(found: DataFrame) -> DataFrame:
    """Without what ``judged_causes`` leaves out, so that a cut keeps k that count."""
    own = (F.col("cause_entity_id") == F.col("entity_id")) & (F.col("cause_event_type") == F.col("base_type"))
    return found.where(~own)


def cause_risks(events: DataFrame, edges: DataFrame, rules=ref.ANALYSIS_RULES) -> DataFrame:
    """(entity_id, causes, driver_risk), as ``causal.risks_of_causes`` gives for ``potential_causes``, without listing them.

    The highest risk among the driver events of a rule's reach is a maximum over a sliding window. It may hold related
    ones, since those count in a reach at least as long. Causes without an id have no risk and do not count.
    """
    known = events.where("event_id IS NOT NULL")
    anomalies, causes, pairs, reach = analysis_sides(events, edges, rules)
    risks = known.where(normal_type() == "driver_risk_increase").groupBy(F.col("event_id").alias("cause_id")).agg(F.max("risk_score").alias("risk"))
    anomalies, drivers = sized(anomalies), sized(causes.where("cause_event_type = 'driver_risk_increase'").join(risks, "cause_id"))
    typed = typed_causes(drivers, rules).join(F.broadcast(reach.select("rule", "other_us")), "rule")
    asked = anomalies.withColumnRenamed("anomaly_us", "us")
    best = best_within(asked, typed.select("rule", "other_us", F.col("cause_us").alias("us"), F.col("risk").alias("tag")), ["rule"], "other_us")
    anywhere = asked.join(best, ["rule", "us"]).select("entity_id", F.col("best").alias("risk"))
    related = judged_first(related_causes(anomalies, drivers, pairs, reach)).select("entity_id", "risk")
    highest = anywhere.unionByName(related).groupBy("entity_id").agg(F.max("risk").alias("driver_risk"))
    return count_causes(events, edges, rules, known).where("causes > 0").join(highest, "entity_id", "left")


def count_causes(events: DataFrame, edges: DataFrame, rules=ref.ANALYSIS_RULES, among: DataFrame | None = None) -> DataFrame:
    """(entity_id, causes) of the entities with an anomaly, as counting ``potential_causes`` gives; 0 is written as such.
    With ``among`` only its events count as causes.

    The events of a rule's types in reach are differences of running totals. Those that are related or the
    entity's own are taken off, and the related ones of any type added; both come from joins on the entity.
    """
    anomalies, causes, pairs, reach = analysis_sides(events, edges, rules)
    causes = causes if among is None else analysis_sides(among, edges, rules)[1]
    anomalies, pairs, typed = sized(anomalies), sized(pairs), sized(typed_causes(causes, rules))
    base = F.when(F.col("rule") == "shipment_anomaly", "shipment_anomaly").otherwise("invoice_anomaly")
    # an event of the own kind without an entity never counts, see ``judged_causes``
    marks = typed.where(F.col("cause_entity_id").isNotNull() | (F.col("cause_event_type") != base)).select("rule", F.col("cause_us").alias("us"), F.lit(True).alias("tag"))
    ends = F.array(
        F.struct(F.col("anomaly_us").alias("us"), F.lit(False).alias("before"), F.lit(1).alias("weight")),
        F.struct((F.col("anomaly_us") - F.col("other_us")).alias("us"), F.lit(True).alias("before"), F.lit(-1).alias("weight")),
    )
    asked = anomalies.where("other_us >= 0").select("rule", "entity_id", F.explode(ends).alias("e")).select("rule", "entity_id", "e.*")
    every = up_to(asked, marks, ["rule"]).select("entity_id", (F.col("n") * F.col("weight")).alias("n"))

    # what the totals hold too much: typed events of related entities, and the own ones of the kind
    linked = pairs.withColumn("any", F.lit(True)).unionByName(
        anomalies.select("entity_id", F.col("entity_id").alias("cause_entity_id"), F.lit(False).alias("any"))
    )
    linked = linked.groupBy("entity_id", "cause_entity_id").agg(F.max("any").alias("any"))
    near = within(
        typed.join(F.broadcast(reach.where("other_us >= 0").select("rule", "other_us")), "rule"), anomalies.join(linked, "entity_id").drop("related_us"),
        ["rule", "cause_entity_id"], "cause_us", "anomaly_us", "other_us",
    )
    off = near.where(F.col("any") | (F.col("cause_event_type") == F.col("base_type"))).select("entity_id", F.lit(-1).cast("bigint").alias("n"))
    on = judged_first(related_causes(anomalies, causes, pairs, reach)).select("entity_id", F.lit(1).cast("bigint").alias("n"))
    zero = anomalies.select("entity_id", F.lit(0).cast("bigint").alias("n"))
    return every.unionByName(off).unionByName(on).unionByName(zero).groupBy("entity_id").agg(F.sum("n").alias("causes"))
