"""Shipment rules as column expressions over a record joined with its route baselines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import refdata as ref
from ..functions.columns import days, hours_between, missing, money, severity_band_shipment, words
from .anomaly import anomaly


def _status() -> Column:
    """'in_transit' and 'In Transit' are the same."""
    return F.lower(F.regexp_replace("status", "_", " "))


def with_route_profile(shipments: DataFrame, profile: DataFrame) -> DataFrame:
    keep = profile.select("origin", "destination", "common_carriers", "avg_transit_days")
    return shipments.join(keep, ["origin", "destination"], "left")


def with_route_carrier_history(shipments: DataFrame, history: DataFrame) -> DataFrame:
    keep = history.select("origin", "destination", "carrier", "avg_value", "std_value", "known_route")
    return shipments.join(keep, ["origin", "destination", "carrier"], "left")


def with_carrier_tier(shipments: DataFrame, tiers: DataFrame) -> DataFrame:
    return shipments.join(tiers, "carrier", "left")


def freight_mode(ocean_pairs=tuple(ref.OCEAN_PAIRS)) -> Column:
    """ground, ocean or air from the last words of origin and destination."""
    o, d = words("origin"), words("destination")
    abroad = (F.size(o) > 1) & (F.size(d) > 1) & (F.try_element_at(o, F.lit(-1)) != F.try_element_at(d, F.lit(-1)))
    has = lambda col, word: F.col(col).contains(word)
    by_sea = reduce(
        lambda a, b: a | b,
        [(has("origin", x) & has("destination", y)) | (has("origin", y) & has("destination", x)) for x, y in ocean_pairs],
    )
    return F.when(missing("origin") | missing("destination"), "ground").when(abroad & by_sea, "ocean").when(abroad, "air").otherwise("ground")


def with_transport(shipments: DataFrame, as_of: str) -> DataFrame:
    """Adds ``mode`` and ``late_hours``, which several rules read, so that each is worked out once."""
    return shipments.withColumn("mode", freight_mode()).withColumn("late_hours", late_hours(as_of))


def approved_for(mode: Column, by_mode: dict[str, list[str]]) -> Column:
    """The approved names of a mode, as an array literal of the small policy list."""
    table = F.create_map(*[x for m, names in by_mode.items() for x in (F.lit(m), F.array(*[F.lit(n) for n in names]))])
    return F.try_element_at(table, mode)


def unapproved_carrier(by_mode: dict[str, list[str]]) -> Column:
    """No approved name of the mode is part of the carrier's name, nor the other way round."""
    mode, low = F.col("mode"), F.lower("carrier")
    near = F.exists(approved_for(mode, by_mode), lambda n: low.contains(F.lower(n)) | F.lower(n).contains(low))
    return anomaly(
        ~missing("carrier") & ~F.coalesce(near, F.lit(False)),
        "unauthorized_carrier",
        0.85,
        None,
        F.concat(F.lit("Carrier '"), F.col("carrier"), F.lit("' is not authorized for "), mode, F.lit(" shipments")),
        carrier=F.col("carrier"),
        freight_mode=mode,
    )


def route_indicators(city_pairs=tuple(ref.UNUSUAL_CITY_PAIRS)) -> Column:
    odd = reduce(
        lambda a, b: a | b,
        [F.col("origin").contains(x) & F.col("destination").contains(y) for x, y in city_pairs],
    )
    signs = F.array_compact(
        F.array(F.when(F.col("carrier").contains("Alternative"), "alternative_carrier"), F.when(odd, "unusual_route"))
    )
    known = ~missing("origin") & ~missing("destination") & ~missing("carrier")
    return anomaly(
        known & (F.size(signs) > 0),
        "route_deviation",
        F.least(F.lit(0.95), 0.6 + F.size(signs) * 0.15),
        None,
        F.concat(F.lit("Route deviation detected: "), F.array_join(signs, ", ")),
        origin=F.col("origin"),
        destination=F.col("destination"),
        carrier=F.col("carrier"),
        risk_indicators=F.array_join(signs, ","),
    )


def route_expected() -> Column:
    """The route driven is not the route known for this origin, destination and carrier."""
    return anomaly(
        ~missing("known_route") & ~missing("actual_route") & (F.col("known_route") != F.col("actual_route")),
        "route_deviation",
        0.8,
        None,
        F.concat(
            F.lit("Shipment route deviates from expected path. Expected: "), F.col("known_route"), F.lit(", Actual: "), F.col("actual_route"),
        ),
        expected_route=F.col("known_route"),
        actual_route=F.col("actual_route"),
    )


def late_hours(as_of: str) -> Column:
    """Hours past the estimate where the status says it matters, else NULL."""
    end = F.coalesce(F.col("actual_arrival").cast("timestamp"), F.lit(as_of).cast("timestamp"))
    delivered = (F.col("status") == "Delivered") & F.col("actual_arrival").isNotNull()
    return F.when((F.col("status") == "Delayed") | delivered, hours_between(end, F.col("estimated_arrival")))


def delay_by_mode(limits: dict[str, int] = ref.DELAY_HOURS) -> Column:
    mode, late = F.col("mode"), F.col("late_hours")
    limit = F.when(mode == "air", limits["air"]).when(mode == "ocean", limits["ocean"]).otherwise(limits["ground"])
    return anomaly(
        late > limit,
        "timeline_delay",
        F.least(F.lit(0.95), 0.4 + (late / limit - 1) * 0.3),
        None,
        F.concat(
            F.initcap(mode), F.lit(" shipment delayed by "), late.cast("int"), F.lit(" hours (threshold: "), limit, F.lit("h)"),
        ),
        delay_hours=late.cast("int"),
        freight_mode=mode,
        threshold_hours=limit,
    )


def delay_simple(limits: dict[str, int] = ref.DELAY_HOURS) -> Column:
    """The older form: the mode is read off the delay, so only long ones can fire."""
    late = F.col("late_hours")
    by_air = late < 48
    fires = F.when(by_air, late > limits["air"]).otherwise(late > limits["ocean"])
    return anomaly(
        fires,
        "timeline_delay",
        F.least(F.lit(0.9), 0.4 + late / F.when(by_air, 72).otherwise(168) * 0.5),
        None,
        F.when(
            F.col("actual_arrival").isNotNull(),
            F.concat(F.lit("Shipment arrived "), late.cast("int"), F.lit(" hours later than estimated.")),
        ).otherwise(F.concat(F.lit("Shipment is currently "), late.cast("int"), F.lit(" hours delayed."))),
        delay_hours=late.cast("int"),
    )


def value_discrepancy(max_share: float = 0.15) -> Column:
    v, mean = F.col("value"), F.col("avg_value")
    sd = F.when(F.coalesce(F.col("std_value"), F.lit(0.0)) != 0, F.col("std_value")).otherwise(mean * 0.1)
    share, z = F.abs(v - mean) / mean, F.abs(v - mean) / sd
    return anomaly(
        F.when((v != 0) & (mean != 0), share > max_share).otherwise(False),
        "value_discrepancy",
        F.least(F.lit(0.95), 0.5 + F.least(z / 10, F.lit(0.45))),
        None,
        F.concat(F.lit("Shipment value differs by "), F.format_string("%.1f%%", share * 100), F.lit(" from historical average.")),
        declared_value=v,
        historical_avg_value=mean,
        percentage_difference=share,
        z_score=z,
    )


def value_pattern() -> Column:
    v = F.col("value")
    return F.coalesce(
        anomaly(
            (v % 1000 == 0) & (v >= 10000), "suspicious_value_pattern", 0.7, None,
            F.concat(F.lit("Suspiciously round declared value: "), money("value")),
            declared_value=v, pattern_type="round_number",
        ),
        anomaly(
            v > 50000, "high_value_shipment", 0.6, None,
            F.concat(F.lit("High-value shipment requiring additional verification: "), money("value")),
            declared_value=v, threshold=F.lit(50000),
        ),
    )


def duplicate_id(risk: float = 0.95) -> Column:
    return anomaly(
        F.lit(True), "duplicate_id", risk, None,
        F.concat(F.lit("Duplicate shipment ID detected: "), F.col("shipment_id")),
        original_row=F.col("first_order"),
    )


def duplicate_pattern() -> Column:
    """For rows of ``duplicates.earlier_twin`` on origin, destination and departure date."""
    day = F.col("departure_date").cast("string")
    return anomaly(
        F.col("related").isNotNull(), "suspicious_duplicate_pattern", 0.8, None,
        F.concat(
            F.lit("Suspicious duplicate route pattern: "), F.col("origin"), F.lit(" → "), F.col("destination"), F.lit(" on "), day,
        ),
        origin=F.col("origin"),
        destination=F.col("destination"),
        departure_date=day,
        related_shipment=F.col("related"),
    )


def carrier_check() -> Column:
    """Blacklisted carriers, else carriers the route has never seen."""
    carrier, tier, usual = F.col("carrier"), F.col("tier"), F.col("common_carriers")
    approved = F.coalesce(tier.isin("tier_1", "tier_2"), F.lit(False))
    return F.coalesce(
        anomaly(
            tier == "blacklisted", "blacklisted_carrier", 0.95, "high",
            F.concat(F.lit("Shipment using blacklisted carrier: "), carrier),
            [F.concat(F.lit("Carrier: "), carrier), "Carrier is on blacklist", "High fraud risk"],
            carrier=carrier, blacklisted="true",
        ),
        anomaly(
            ~missing("carrier") & (F.size(usual) > 0) & ~F.array_contains(usual, carrier),
            "unusual_carrier",
            F.when(approved, 0.6).otherwise(0.8),
            "medium",
            F.concat(F.lit("Unusual carrier ("), carrier, F.lit(") for this route")),
            [
                F.concat(F.lit("Carrier: "), carrier),
                F.concat(F.lit("Common carriers for route: "), F.array_join(usual, ", ")),
                F.concat(F.lit("Carrier approved: "), F.when(approved, "Yes").otherwise("No")),
            ],
            carrier=carrier, common_carriers=F.array_join(usual, ", "), approved=approved,
        ),
    )


def transit_deviation(max_days: float = 2) -> Column:
    planned, mean = days("estimated_arrival", "departure_date"), F.col("avg_transit_days")
    off = F.abs(planned - mean)
    return anomaly(
        F.when(mean != 0, off > max_days).otherwise(False),
        "transit_time_anomaly",
        F.least(F.lit(0.9), off / mean),
        F.when(off > 5, "high").otherwise("medium"),
        F.concat(
            F.lit("Transit time ("), planned, F.lit(" days) significantly deviates from route average ("),
            F.format_string("%.1f", mean), F.lit(" days)"),
        ),
        [
            F.concat(F.lit("Estimated transit time: "), planned, F.lit(" days")),
            F.concat(F.lit("Average for route: "), F.format_string("%.1f", mean), F.lit(" days")),
            F.concat(F.lit("Deviation: "), F.format_string("%.1f", off), F.lit(" days")),
        ],
        estimated_days=planned,
        avg_transit=mean,
        deviation=off,
    )


def suspicious_route(patterns: list[str] = ref.SUSPICIOUS_ROUTES) -> Column:
    route = F.concat(F.col("origin"), F.lit(" -> "), F.col("destination"))
    hit = reduce(lambda a, b: a | b, [F.lower(route).contains(p) for p in patterns])
    return anomaly(
        ~missing("origin") & ~missing("destination") & hit,
        "suspicious_route",
        0.85,
        "high",
        F.concat(F.lit("Suspicious route detected: "), route),
        [
            F.concat(F.lit("Origin: "), F.col("origin")),
            F.concat(F.lit("Destination: "), F.col("destination")),
            F.concat(F.lit("Carrier: "), F.coalesce("carrier", F.lit(""))),
            "Route matches suspicious pattern",
        ],
        route_key=route,
    )


def status_inconsistent(as_of: str) -> Column:
    now, day = F.lit(as_of).cast("timestamp"), F.col("departure_date").cast("string")
    return anomaly(
        (F.col("departure_date").cast("timestamp") > now) & (_status() == "in transit"),
        "status_inconsistency",
        0.7,
        "medium",
        F.concat(F.lit("Status '"), F.col("status"), F.lit("' inconsistent with future departure date")),
        [
            F.concat(F.lit("Status: "), F.col("status")),
            F.concat(F.lit("Departure date: "), day),
            F.concat(F.lit("Current date: "), F.date_format(now, "yyyy-MM-dd")),
            "Departure date is in the future",
        ],
        status=F.col("status"),
        departure_date=day,
        future_departure="true",
    )


def overdue(as_of: str, grace_days: int = 1) -> Column:
    """Under way and whole days past the estimate; a status inconsistency comes first."""
    now = F.lit(as_of).cast("timestamp")
    late = F.floor(hours_between(now, F.col("estimated_arrival")) / 24).cast("int")
    return F.when(
        status_inconsistent(as_of).isNull(),
        anomaly(
            _status().isin("in transit", "pending") & (late > grace_days),
            "shipment_overdue",
            F.least(F.lit(0.9), late / 10.0),
            F.when(late > 5, "high").otherwise("medium"),
            F.concat(F.lit("Shipment is "), late, F.lit(" days overdue")),
            [
                F.concat(F.lit("Status: "), F.col("status")),
                F.concat(F.lit("Estimated arrival: "), F.col("estimated_arrival").cast("string")),
                F.concat(F.lit("Current date: "), F.date_format(now, "yyyy-MM-dd")),
                F.concat(F.lit("Days overdue: "), late),
            ],
            status=F.col("status"),
            estimated_arrival=F.col("estimated_arrival").cast("string"),
            days_overdue=late,
        ),
    )


# --- the feed's own light checks ------------------------------------------------------------


def feed_flag(min_risk: float = 0.7) -> Column:
    odd = F.coalesce((F.col("anomaly_type") != "none") & (F.col("anomaly_type") != ""), F.lit(False))
    return F.coalesce(F.col("status") == "Delayed", F.lit(False)) | F.coalesce(F.col("risk_score") > min_risk, F.lit(False)) | odd


def feed_type() -> Column:
    given = F.when((F.col("anomaly_type") != "none") & (F.col("anomaly_type") != ""), F.col("anomaly_type"))
    return F.coalesce(given, F.when(F.col("status") == "Delayed", "timeline_delay"), F.lit("unknown_anomaly"))


def feed_risk() -> Column:
    kind = feed_type()
    by_type = F.when(kind == "route_deviation", 0.85).when(kind == "timeline_delay", 0.6).when(kind == "value_discrepancy", 0.9).otherwise(0.7)
    return F.coalesce(F.col("risk_score"), by_type)


def feed_description() -> Column:
    kind = feed_type()
    ship, o, d = (F.coalesce(x, F.lit("Unknown")) for x in ("shipment_id", "origin", "destination"))
    return (
        F.when(kind == "route_deviation", F.concat(F.lit("Shipment "), ship, F.lit(" shows deviation from expected route between "), o, F.lit(" and "), d, F.lit(".")))
        .when(kind == "timeline_delay", F.concat(F.lit("Shipment "), ship, F.lit(" from "), o, F.lit(" to "), d, F.lit(" is experiencing delays.")))
        .when(kind == "value_discrepancy", F.concat(F.lit("Shipment "), ship, F.lit(" has unusual value compared to historical data for this route.")))
        .otherwise(F.concat(F.lit("Anomaly detected in shipment "), ship, F.lit(" from "), o, F.lit(" to "), d, F.lit(".")))
    )


def guideline_risk(approved: list[str], max_variance: float = 0.25) -> Column:
    """Struct of score and severity from carrier approval and value variance."""
    v, mean = F.coalesce("value", F.lit(0.0)), F.coalesce(F.col("avg_value"), F.col("value"), F.lit(0.0))
    variance = F.when(mean > 0, F.abs(v - mean) / mean).otherwise(0.0)
    carrier_part = F.when(F.coalesce(F.col("carrier").isin(approved), F.lit(False)), 0.0).otherwise(0.3)
    score = carrier_part + F.when(variance > max_variance, F.least(F.lit(0.4), variance)).otherwise(0.0)
    return F.struct(score.alias("risk_score"), severity_band_shipment(score).alias("severity"))


def main_rules(as_of: str) -> list[Column]:
    """The checks of the wired-in detector; needs tier and route profile columns."""
    return [
        carrier_check(),
        transit_deviation(),
        suspicious_route(),
        F.coalesce(status_inconsistent(as_of), overdue(as_of)),
    ]


def extended_rules(by_mode: dict[str, list[str]]) -> list[Column]:
    """The checks of the second detector; needs the columns of ``with_transport``."""
    return [unapproved_carrier(by_mode), route_indicators(), delay_by_mode(), value_pattern()]
