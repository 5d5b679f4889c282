"""Queries over the event log: links, chains, holds, entity analysis, risk levels and trends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import refdata as ref
from ..functions.sizing import sized
from ..operators import causal, filters, summaries, time_chains
from ..operators.intervals import count_near, micros
from ..operators.nearest_causes import cause_risks, count_causes, nearest_causes
from ..operators.ranking import latest_per_entity
from .catalog import EVENTS_AS_OF as AS_OF, Source, query

# a longer rule set, so that chains have more than one step
CHAIN_RULES = [
    *ref.CAUSAL_RULES,
    ("shipment_delay", "shipment_anomaly", ref.DAY, 0.7),
    ("payment_policy_change", "driver_risk_increase", ref.DAY // 2, 0.7),
]


def _values(rows, cols: str) -> str:
    text = ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {text}) v({cols})"


_S = "(50 + CASE WHEN gap <= 3600000000 THEN 30 WHEN gap <= 86400000000 THEN 20 WHEN gap <= 259200000000 THEN 10 ELSE 0 END + CASE WHEN same THEN 20 ELSE 0 END + boost)"


def _links(rules: str) -> str:
    return f"""SELECT DISTINCT cause_id, effect_id, cause_type, effect_type, cause_entity_id, effect_entity_id, cause_entity_type, effect_entity_type, gap,
 CAST(least({_S}, 100) AS DOUBLE) / 100 AS confidence FROM (SELECT c.event_id AS cause_id, e.event_id AS effect_id, c.event_type AS cause_type, e.event_type AS effect_type,
  c.entity_id AS cause_entity_id, e.entity_id AS effect_entity_id, c.entity_type AS cause_entity_type, e.entity_type AS effect_entity_type, e.us - c.us AS gap,
  c.entity_id = e.entity_id AS same, coalesce(b.points, 0) AS boost, r.threshold FROM ev c JOIN {rules} r ON r.cause_type = c.event_type
  JOIN ev e ON e.event_type = r.effect_type AND e.us - c.us BETWEEN 0 AND CAST(r.window_s AS BIGINT) * 1000000
  LEFT JOIN boosts b ON b.cause_type = c.event_type AND b.effect_type = e.event_type) p WHERE {_S} >= round(threshold * 100)"""


# of every effect and cause type the strongest cause, then the nearest, then the largest id
_BEST = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY effect_id, cause_type ORDER BY confidence DESC, gap, cause_id DESC) AS place,
 count(*) OVER (PARTITION BY effect_id, cause_type) AS causes FROM {}) x WHERE place = 1"""


def _expanded(links: str, prefix: str = "") -> dict[str, str]:
    """Breadth-first expansion of a set of links from its roots, level by level."""
    p = prefix
    out = {f"{p}croots": f"SELECT DISTINCT cause_id AS event_id FROM {links} WHERE cause_id NOT IN (SELECT effect_id FROM {links})"}
    out[f"{p}l1"] = (
        f"SELECT cause_id AS root_id, effect_id AS event_id, min(cause_id) AS parent_id, arg_min(confidence, cause_id) AS confidence, 1 AS depth FROM {links} "
        f"WHERE cause_id IN (SELECT event_id FROM {p}croots) GROUP BY cause_id, effect_id"
    )
    for d in (2, 3):
        unseen = " AND ".join(f"NOT EXISTS (SELECT 1 FROM {p}l{i} s WHERE s.root_id = f.root_id AND s.event_id = k.effect_id)" for i in range(1, d))
        out[f"{p}l{d}"] = (
            f"SELECT root_id, effect_id AS event_id, min(cause_id) AS parent_id, arg_min(k.confidence, cause_id) AS confidence, {d} AS depth "
            f"FROM {p}l{d - 1} f JOIN {links} k ON k.cause_id = f.event_id WHERE {unseen} GROUP BY root_id, effect_id"
        )
    out[f"{p}chain"] = " UNION ALL ".join(f"SELECT * FROM {p}l{d}" for d in (1, 2, 3))
    return out


CTES = dict(
    ev="SELECT *, epoch_us(ts) AS us FROM causal_events",
    rules=_values(ref.CAUSAL_RULES, "cause_type, effect_type, window_s, threshold"),
    crules=_values(CHAIN_RULES, "cause_type, effect_type, window_s, threshold"),
    boosts=_values([(c, e, round(b * 100)) for c, e, b in ref.PAIR_BOOST], "cause_type, effect_type, points"),
    alinks=_links("rules"),
    links=_BEST.format("alinks"),
    clinks=_BEST.format(f"({_links('crules')}) all_links"),
    roots="SELECT DISTINCT cause_id AS event_id FROM alinks WHERE cause_id NOT IN (SELECT effect_id FROM alinks)",
    **_expanded("clinks"),
    every=_links("crules"),
    **_expanded("every", "all_"),
    leaves="SELECT * FROM all_chain WHERE event_id NOT IN (SELECT cause_id FROM every)",
    anom="SELECT * FROM ev WHERE event_type LIKE '%anomaly%'",
    latest="SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY ts DESC, event_id) AS rn FROM anom) x WHERE rn = 1",
    pairs="SELECT source AS entity_id, target AS other_id FROM entity_edges UNION SELECT target, source FROM entity_edges",
    causes="""SELECT *, (1.0 - gap / 259200000000.0 + CASE WHEN rel THEN 1.0 ELSE 0.5 END) / 2 AS causal_strength, concat(gap // 60000000, ' minutes') AS temporal_proximity FROM (
 SELECT a.entity_id, a.event_id AS anomaly_id, c.event_id AS cause_id, c.entity_id AS cause_entity_id, c.event_type AS cause_event_type, c.risk_score AS cause_risk, CAST(a.us - c.us AS DOUBLE) AS gap0, a.us - c.us AS gap,
 EXISTS (SELECT 1 FROM pairs p WHERE p.entity_id = a.entity_id AND p.other_id = c.entity_id) AS rel FROM latest a JOIN ev c ON c.us BETWEEN a.us - 259200000000 AND a.us
 WHERE NOT (c.entity_id = a.entity_id AND c.event_type = 'shipment_anomaly')) x
 WHERE (rel OR cause_event_type IN ('weather_event', 'driver_risk_increase', 'route_change')) AND (1.0 - gap / 259200000000.0 + CASE WHEN rel THEN 1.0 ELSE 0.5 END) / 2 >= 0.7""",
    ranked="SELECT *, row_number() OVER (PARTITION BY anomaly_id ORDER BY causal_strength DESC, cause_id) AS rank FROM causes",
    stats="SELECT event_id, count(*) AS links, bool_or(other LIKE '%driver_risk%') AS near_driver_risk FROM (SELECT cause_id AS event_id, effect_type AS other FROM alinks "
    "UNION ALL SELECT effect_id, cause_type FROM alinks) x GROUP BY event_id",
    levels="""SELECT ev.*, CASE WHEN event_type LIKE '%driver_risk_increase%' OR coalesce(links, 0) > 3 OR coalesce(near_driver_risk, false) THEN 'high' ELSE 'medium' END AS level
 FROM ev LEFT JOIN stats USING (event_id)""",
)


def q(name: str, sql: str, **extra: str):
    return query(name, sql, "causal_events entity_edges", **CTES, **extra)


def links(s: Source) -> DataFrame:
    return causal.strongest_links(s.causal_events, causal.link_rules(s.spark))


def chain_links(s: Source) -> DataFrame:
    return causal.strongest_links(s.causal_events, causal.link_rules(s.spark, CHAIN_RULES))


def edges(s: Source) -> DataFrame:
    return causal.with_reverse(s.entity_edges)


def causes(s: Source) -> DataFrame:
    return causal.potential_causes(s.causal_events, edges(s))


# --- events and edges -----------------------------------------------------------------------


@q(
    "ev_register",
    "SELECT sha256(concat_ws('|', event_type, entity_id, CAST(us AS VARCHAR), description)) AS event_id, event_type, entity_id, description FROM ev",
)
def _(s: Source):
    meta = F.create_map(F.lit("value"), F.col("value").cast("string"))
    rows = causal.register(s.causal_events, F.col("event_type"), "entity_id", "shipment", "ts", F.col("description"), meta)
    return rows.select("event_id", "event_type", "entity_id", "description")


@query(
    "ev_from_records",
    """SELECT event_type, entity_type, count(*) AS n, count(DISTINCT event_id) AS ids FROM (
 SELECT 'invoice_update' AS event_type, 'invoice' AS entity_type, concat(invoice_id, src_row) AS event_id FROM invoices
 UNION ALL SELECT 'shipment_update', 'shipment', concat(shipment_id, src_row) FROM shipments
 UNION ALL SELECT 'invoice_anomaly', 'invoice', concat(invoice_id, src_row) FROM invoices WHERE isodow(issue_date) >= 6
 UNION ALL SELECT 'driver_risk_update', 'driver', driver_id FROM drivers
 UNION ALL SELECT 'policy_update', 'policy', CAST(doc_id AS VARCHAR) FROM docs WHERE doc_type = 'policy') x GROUP BY event_type, entity_type""",
    "invoices shipments drivers docs",
)
def _(s: Source):
    return from_records(s).groupBy("event_type", "entity_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))


def from_records(s: Source) -> DataFrame:
    """Updates, anomalies, driver changes and policies as events."""
    from ..operators.anomaly import flag
    from ..operators.invoice_rules import weekend

    one = lambda *pairs: F.create_map(*[x for k in pairs for x in (F.lit(k), F.col(k).cast("string"))])
    found = flag(s.invoices, "invoice_id", weekend(), keep=("issue_date",))
    parts = [
        causal.register(s.invoices, "invoice_update", "invoice_id", "invoice", "issue_date", F.concat_ws(" ", "invoice_id", "src_row"), one("supplier", "shipment_id")),
        causal.register(s.shipments, "shipment_update", "shipment_id", "shipment", "departure_date", F.concat_ws(" ", "shipment_id", "src_row"), one("carrier", "driver_id")),
        causal.register(found, "invoice_anomaly", "document_id", "invoice", "issue_date", F.concat_ws(" ", "anomaly_type", "src_row"), one("anomaly_type", "risk_score")),
        causal.register(s.drivers, "driver_risk_update", "driver_id", "driver", "last_incident", F.concat_ws(" ", "name", "risk_level"), one("risk_level")),
        causal.register(
            s.docs.where("doc_type = 'policy'").withColumn("policy_id", F.col("doc_id").cast("string")),
            "policy_update", "policy_id", "policy", F.lit(AS_OF), F.concat_ws(" ", "source", "policy_id"), one("source"),
        ),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(
    "rel_edges",
    """SELECT DISTINCT * FROM (SELECT source, target, kind AS relationship_type FROM raw UNION ALL SELECT target, source, concat(kind, '_reverse') FROM raw) x""",
    "invoices shipments",
    raw="""SELECT invoice_id AS source, shipment_id AS target, 'invoice_to_shipment' AS kind FROM invoices UNION ALL SELECT invoice_id, supplier, 'invoice_to_supplier' FROM invoices
 UNION ALL SELECT shipment_id, carrier, 'shipment_to_carrier' FROM shipments UNION ALL SELECT shipment_id, driver_id, 'shipment_to_driver' FROM shipments
 UNION ALL SELECT concat('POL-', s_nationkey), s_name, 'policy_to_entity' FROM supplier""",
)
def _(s: Source):
    policies = s.supplier.select(F.concat(F.lit("POL-"), "s_nationkey").alias("policy_id"), F.array("s_name").alias("affected_entities"))
    return causal.record_edges(s.invoices, s.shipments, policies)


@q(
    "agg_entity_events",
    "SELECT concat(entity_type, ':', entity_id) AS entity_key, count(*) AS events, arg_min(event_id, us) AS first_event, arg_max(event_id, us) AS last_event FROM ev GROUP BY 1",
)
def _(s: Source):
    rows = causal.entity_index(s.causal_events)
    return rows.groupBy("entity_key").agg(
        F.count("*").alias("events"), F.min_by("event_id", "ts").alias("first_event"), F.max_by("event_id", "ts").alias("last_event")
    )


# --- links, chains --------------------------------------------------------------------------


@q(
    "causal_links",
    """SELECT cause_id, effect_id, cause_type, effect_type, confidence, causes, concat('Temporal sequence: ', cause_type, ' occurred ', gap // 1000000, ' seconds before ', effect_type) AS sequence,
 concat('Entity relationship: ', cause_entity_type, ' ', cause_entity_id, ' related to ', effect_entity_type, ' ', effect_entity_id) AS relation,
 CAST(CASE WHEN cause_type = 'driver_risk_increase' AND effect_type = 'shipment_delay' THEN 3 ELSE 2 END AS BIGINT) AS evidence FROM links""",
)
def _(s: Source):
    rows = links(s).withColumn("e", causal.link_evidence())
    return rows.select(
        "cause_id", "effect_id", "cause_type", "effect_type", "confidence", "causes", F.get("e", F.lit(0)).alias("sequence"),
        F.get("e", F.lit(1)).alias("relation"), F.size("e").cast("bigint").alias("evidence"),
    )


@q(
    "join_causal_interval",
    "SELECT effect_id, cause_type, count(*) AS causes, max(confidence) AS best, arg_min(gap, (-confidence, gap)) AS gap_us FROM alinks GROUP BY effect_id, cause_type",
)
def _(s: Source):
    return links(s).select("effect_id", "cause_type", "causes", F.col("confidence").alias("best"), "gap_us")


@q("causal_strength_additive", "SELECT cause_id, effect_id, gap AS gap_us, confidence FROM every")
def _(s: Source):
    rows = causal.causal_links(s.causal_events, causal.link_rules(s.spark, CHAIN_RULES))
    return rows.select("cause_id", "effect_id", "gap_us", "confidence")


@q("causal_roots", "SELECT event_id FROM roots")
def _(s: Source):
    return causal.root_events(s.causal_events, causal.link_rules(s.spark))


def chains(s: Source) -> tuple[DataFrame, DataFrame]:
    found = sized(chain_links(s))  # worked out once, read in every round
    return causal.chains(found, causal.longest_path(CHAIN_RULES)), found


@q("causal_chains", "SELECT root_id, event_id, parent_id, confidence, CAST(depth AS BIGINT) AS depth FROM chain")
def _(s: Source):
    return chains(s)[0].select("root_id", "event_id", "parent_id", "confidence", F.col("depth").cast("bigint").alias("depth"))


def all_chains(s: Source) -> DataFrame:
    return time_chains.chains(s.causal_events, CHAIN_RULES)


@q("causal_chains_all", "SELECT root_id, event_id, parent_id, confidence, CAST(depth AS BIGINT) AS depth FROM all_chain")
def _(s: Source):
    return all_chains(s).withColumn("depth", F.col("depth").cast("bigint"))


@q("causal_chain_leaves", "SELECT root_id, event_id FROM leaves")
def _(s: Source):
    return time_chains.leaves(all_chains(s), s.causal_events, CHAIN_RULES).select("root_id", "event_id")


@q(
    "win_latest_leaf",
    """SELECT root_id, arg_max(event_id, (ts, event_id)) AS final_id, arg_max(description, (ts, event_id)) AS final_effect
 FROM leaves JOIN (SELECT event_id, ts, description FROM ev) e USING (event_id) GROUP BY root_id""",
)
def _(s: Source):
    return causal.final_effect(time_chains.latest_leaves(s.causal_events, CHAIN_RULES), s.causal_events)


@q(
    "agg_chain_confidence",
    "SELECT root_id, count(*) AS links, round(avg(confidence) * count(*), 4) AS confidence_total FROM all_chain GROUP BY root_id",
)
def _(s: Source):
    # compared as mean times count, which is a short decimal
    rows = causal.chain_confidence(all_chains(s))
    return rows.select("root_id", "links", F.round(F.col("overall_confidence") * F.col("links"), 4).alias("confidence_total"))


@q(
    "causal_chain_totals",
    """SELECT root_id, count(*) AS members, count(*) FILTER (event_id NOT IN (SELECT cause_id FROM every)) AS leaves, CAST(max(depth) AS BIGINT) AS depth,
 round(sum(confidence), 4) AS confidence_total FROM all_chain GROUP BY root_id""",
)
def _(s: Source):
    rows = time_chains.totals(all_chains(s), s.causal_events, CHAIN_RULES)
    return rows.select("root_id", "members", "leaves", F.col("depth").cast("bigint").alias("depth"), F.round("confidence_total", 4).alias("confidence_total"))


# --- holds ----------------------------------------------------------------------------------

HOLDS = """SELECT sha256(concat_ws('|', 'hold', cause_id, effect_id)) AS hold_id, effect_entity_id AS entity_id, effect_entity_type AS entity_type, confidence AS risk_score,
 concat('Automatic hold due to ', cause_type, ' causing ', effect_type) AS reason, cause_id AS causal_chain_id, 'pending_approval' AS status FROM alinks
 WHERE cause_type = 'driver_risk_increase' AND effect_type = 'shipment_delay' AND confidence >= 0.8"""
HOLD_COLS = "hold_id, entity_id, entity_type, risk_score, reason, causal_chain_id, status"


def holds(s: Source) -> DataFrame:
    return causal.holds_from_links(causal.hold_links(s.causal_events), AS_OF)


@q("holds_from_links", f"SELECT {HOLD_COLS} FROM holds", holds=HOLDS)
def _(s: Source):
    return holds(s).select(*HOLD_COLS.split(", "))


# every hold is first reviewed; half of them are then decided, some by a named person
CHANGES = """SELECT hold_id, 'pending_review' AS status, 'desk' AS approver, 1 AS changed_at FROM {holds}
 UNION ALL SELECT hold_id, 'active', CAST(NULL AS {s}), 2 FROM {holds} WHERE entity_type = 'shipment'
 UNION ALL SELECT hold_id, 'resolved', 'cfo', 3 FROM {holds} WHERE risk_score >= 1"""
UPDATED = """SELECT h.* REPLACE (status_now AS status), approver_now AS approved_by FROM holds h JOIN (SELECT hold_id, arg_max(status, changed_at) AS status_now,
 max_by(approver, CASE WHEN approver IS NOT NULL THEN changed_at END) AS approver_now FROM changes GROUP BY hold_id) c USING (hold_id)"""
HOLD_CTES = dict(holds=HOLDS, changes=CHANGES.replace("{holds}", "holds").replace("{s}", "VARCHAR"), updated=UPDATED)


def counted_holds(s: Source) -> DataFrame:
    """Holds alike in all but their events as one row, with their number ``n``."""
    return causal.holds_from_links(sized(causal.hold_link_counts(s.causal_events)), AS_OF, keep=("n",))


def updated_holds(s: Source, base: DataFrame | None = None) -> DataFrame:
    base = holds(s) if base is None else base
    changes = s.spark.sql(CHANGES.replace("{s}", "STRING"), holds=base)
    return causal.update_holds(base, changes.withColumn("changed_at", F.timestamp_seconds("changed_at")))


@q("holds_update_status", f"SELECT {HOLD_COLS}, approved_by FROM updated", **HOLD_CTES)
def _(s: Source):
    return updated_holds(s).select(*HOLD_COLS.split(", "), "approved_by")


@q(
    "agg_hold_summary",
    """SELECT count(*) AS total_holds, count(*) FILTER (status = 'active') AS active_holds, count(*) FILTER (status = 'pending_review') AS pending_holds,
 count(*) FILTER (status = 'resolved') AS resolved_holds, count(*) FILTER (risk_score >= 0.8) AS high_risk_holds FROM updated""",
    **HOLD_CTES,
)
def _(s: Source):
    return summaries.hold_summary(updated_holds(s, counted_holds(s)), weight="n")


@q("filter_holds", f"SELECT {HOLD_COLS} FROM updated WHERE entity_type = 'shipment' AND status = 'active' AND risk_score >= 0.85", **HOLD_CTES)
def _(s: Source):
    return filters.filter_holds(updated_holds(s), entity_type="shipment", status="active", min_risk=0.85).select(*HOLD_COLS.split(", "))


# --- filters over events --------------------------------------------------------------------


@q("filter_events", "SELECT event_id, event_type, entity_id, ts FROM ev WHERE event_type LIKE '%anomaly%' AND event_type LIKE '%shipment%'")
def _(s: Source):
    return filters.anomaly_events(s.causal_events, "shipment").select("event_id", "event_type", "entity_id", "ts")


@q("triggered_since", "SELECT event_id, event_type, ts FROM ev WHERE event_type LIKE '%anomaly%' AND ts > TIMESTAMP '2024-01-20'")
def _(s: Source):
    return summaries.newest(filters.anomaly_events(s.causal_events, since="2024-01-20"), tie="event_id").select("event_id", "event_type", "ts")


@q("win_latest_anomaly", "SELECT entity_id, event_id, ts FROM latest")
def _(s: Source):
    return causal.latest_anomaly(s.causal_events).select("entity_id", "event_id", "ts")


# --- entity analysis ------------------------------------------------------------------------

CAUSE_COLS = "entity_id, anomaly_id, cause_id, cause_entity_id, cause_event_type"


@q(
    "causal_potential_causes",
    f"SELECT {CAUSE_COLS}, rel AS is_related, round(causal_strength, 6) AS causal_strength, temporal_proximity FROM causes",
)
def _(s: Source):
    return causes(s).select(*CAUSE_COLS.split(", "), "is_related", F.round("causal_strength", 6).alias("causal_strength"), "temporal_proximity")


@q("causal_strength_mean", "SELECT anomaly_id, cause_id, round(causal_strength, 6) AS causal_strength FROM causes WHERE rel")
def _(s: Source):
    return causes(s).where("is_related").select("anomaly_id", "cause_id", F.round("causal_strength", 6).alias("causal_strength"))


@q("win_top_causes", "SELECT anomaly_id, cause_id, rank FROM ranked WHERE rank <= 3")
def _(s: Source):
    return nearest_causes(s.causal_events, edges(s), 3).select("anomaly_id", "cause_id", F.col("rank").cast("bigint").alias("rank"))


@q("sort_strength", "SELECT anomaly_id, cause_id, round(causal_strength, 6) AS causal_strength FROM causes ORDER BY causal_strength DESC, anomaly_id, cause_id")
def _(s: Source):
    rows = causes(s).orderBy(F.desc("causal_strength"), "anomaly_id", "cause_id")
    return rows.select("anomaly_id", "cause_id", F.round("causal_strength", 6).alias("causal_strength"))


ASKED = "SELECT concat('ENT-', s_suppkey * 2) AS entity_id FROM supplier"


@q(
    "causal_analyze_entity",
    """SELECT asked.entity_id, n.n IS NOT NULL AS found, l.event_id IS NOT NULL AS has_anomaly, l.event_id AS anomaly_id, coalesce(c.causes, 0) AS causes, t.top FROM asked
 LEFT JOIN (SELECT entity_id, count(*) AS n FROM ev GROUP BY 1) n USING (entity_id) LEFT JOIN latest l USING (entity_id)
 LEFT JOIN (SELECT entity_id, count(*) AS causes FROM causes GROUP BY 1) c USING (entity_id)
 LEFT JOIN (SELECT entity_id, string_agg(cause_id, ',' ORDER BY rank) AS top FROM ranked WHERE rank <= 3 GROUP BY 1) t USING (entity_id)""",
    asked=ASKED,
)
def _(s: Source):
    asked = s.supplier.select(F.concat(F.lit("ENT-"), F.col("s_suppkey") * 2).alias("entity_id"))
    best = nearest_causes(s.causal_events, edges(s), 3).drop("rank")
    report = causal.analyze_entities(asked, s.causal_events, best, 3, count_causes(s.causal_events, edges(s)))
    top = F.array_join(F.transform("top", lambda x: x.cause_id), ",")
    return report.select("entity_id", "found", "has_anomaly", "anomaly_id", "causes", top.alias("top"))


HELD = """SELECT entity_id, 'shipment_anomaly' AS anomaly_type, combined, driver_risk, CASE WHEN combined >= 0.8 THEN 'shipment_hold' WHEN driver_risk >= 0.7 THEN 'driver_restriction'
 WHEN combined >= 0.6 THEN 'advisory_hold' END AS hold FROM (SELECT l.entity_id, greatest(l.risk_score, coalesce(d.driver_risk, 0) * 0.9) * CASE WHEN d.n > 0 THEN 1.2 ELSE 1.0 END AS combined, d.driver_risk
 FROM latest l LEFT JOIN (SELECT entity_id, count(*) AS n, max(cause_risk) FILTER (cause_event_type = 'driver_risk_increase') AS driver_risk FROM causes GROUP BY 1) d USING (entity_id)) x"""


@q("holds_from_analysis", "SELECT entity_id, anomaly_type, round(combined, 6) AS combined_risk, driver_risk, hold FROM held WHERE hold IS NOT NULL", held=HELD)
def _(s: Source):
    rows = causal.holds_from_analysis(s.causal_events, cause_risks(s.causal_events, edges(s)))
    return rows.select("entity_id", "anomaly_type", F.round("combined_risk", 6).alias("combined_risk"), "driver_risk", "hold")


@q(
    "causal_chain_report",
    """SELECT l.entity_id, l.event_type AS anomaly_type, l.risk_score, t.top, CASE hold
 WHEN 'shipment_hold' THEN concat('SHIPMENT HOLD on ', l.entity_id, ': Shipment flagged due to anomaly detection (', printf('%.2f', combined), ').',
  CASE WHEN driver_risk IS NOT NULL THEN concat(' Driver Unknown driver has elevated risk score (', printf('%.2f', driver_risk), ').') ELSE '' END)
 WHEN 'driver_restriction' THEN concat('DRIVER RESTRICTION: Unknown driver has high risk score (', printf('%.2f', driver_risk), '). Recommend limiting sensitive shipments.')
 WHEN 'advisory_hold' THEN concat('ADVISORY HOLD on ', l.entity_id, ': Combined risk factors (', printf('%.2f', combined), ') suggest caution.') END AS hold_text
 FROM latest l LEFT JOIN held USING (entity_id) LEFT JOIN (SELECT entity_id, string_agg(concat(cause_event_type, ' ', temporal_proximity), '; ' ORDER BY rank) AS top
 FROM ranked WHERE rank <= 3 GROUP BY 1) t USING (entity_id)""",
    held=HELD,
)
def _(s: Source):
    events, near = s.causal_events, edges(s)
    held = causal.holds_from_analysis(events, cause_risks(events, near)).select("entity_id", causal.hold_text().alias("hold_text"))
    best = nearest_causes(events, near, 3).drop("rank")
    report = causal.analyze_entities(events.select("entity_id").distinct(), events, best, 3, count_causes(events, near)).where("has_anomaly")
    top = F.array_join(F.transform("top", lambda x: F.concat_ws(" ", x.cause_event_type, x.temporal_proximity)), "; ")
    return report.join(held, "entity_id", "left").select("entity_id", "anomaly_type", "risk_score", top.alias("top"), "hold_text")


@q(
    "related_events",
    """SELECT a.asked, e.event_id, e.us FROM (SELECT DISTINCT entity_id AS asked, entity_id FROM ev UNION SELECT entity_id, other_id FROM pairs) a JOIN ev e USING (entity_id)""",
)
def _(s: Source):
    return causal.related_events(s.causal_events, edges(s)).select("asked", "event_id", micros("ts").alias("us"))


@q(
    "join_related_entities",
    "SELECT l.event_id AS anomaly_id, e.event_id, e.event_type FROM latest l JOIN pairs p USING (entity_id) JOIN ev e ON e.entity_id = p.other_id",
)
def _(s: Source):
    latest = causal.latest_anomaly(s.causal_events).select(F.col("event_id").alias("anomaly_id"), "entity_id")
    pairs = edges(s).select(F.col("source").alias("entity_id"), F.col("target").alias("other_id")).distinct()
    return latest.join(pairs, "entity_id").join(s.causal_events.withColumnRenamed("entity_id", "other_id"), "other_id").select(
        "anomaly_id", "event_id", "event_type"
    )


# the newest event of each kind of entity is what "near" is asked about
_NEWEST = "SELECT entity_type, arg_max(entity_id, us) AS entity_id, max(us) AS us FROM ev GROUP BY entity_type"


@q(
    "events_near",
    "SELECT n.entity_id AS asked, e.event_id FROM newest n JOIN ev e ON abs(e.us - n.us) <= 604800000000 WHERE NOT (e.entity_id = n.entity_id AND e.entity_type = n.entity_type)",
    newest=_NEWEST,
)
def _(s: Source):
    us = micros("ts")
    points = s.causal_events.groupBy("entity_type").agg(F.max_by("entity_id", us).alias("entity_id"), F.max(us).alias("point_us"))
    return causal.events_near(s.causal_events, points).select("asked", "event_id")


@q(
    "join_events_window",
    """SELECT l.entity_id, count(*) FILTER (e.entity_id <> l.entity_id) AS others FROM (SELECT entity_id, max(us) AS us FROM ev GROUP BY entity_id) l
 JOIN ev e ON abs(e.us - l.us) <= 604800000000 GROUP BY l.entity_id""",
)
def _(s: Source):
    rows = s.causal_events.withColumn("event_us", micros("ts"))
    points = rows.groupBy("entity_id").agg(F.max("event_us").alias("point_us"))
    near = count_near(points, rows, 7 * ref.DAY)
    own = rows.join(points, "entity_id").where(F.col("point_us") - F.col("event_us") <= 7 * ref.DAY * 1_000_000).groupBy("entity_id").agg(F.count("*").alias("own"))
    return near.join(own, "entity_id").select("entity_id", (F.col("near") - F.col("own")).alias("others"))


# --- risk of events -------------------------------------------------------------------------


def stats(s: Source) -> DataFrame:
    return causal.link_stats(s.causal_events, causal.link_rules(s.spark))


@q("event_risk_level", "SELECT event_id, level FROM levels")
def _(s: Source):
    return s.causal_events.join(stats(s), "event_id", "left").select("event_id", causal.risk_level().alias("level"))


@q(
    "update_event_risk",
    """SELECT event_id, CASE WHEN level = 'high' THEN 'high' WHEN event_type LIKE '%delay%' AND floor(value) < 30 THEN 'low' ELSE 'medium' END AS risk_level,
 CAST(floor(value) AS BIGINT) AS delay_minutes, 'x' AS old FROM levels WHERE event_type LIKE '%delay%'""",
)
def _(s: Source):
    events = s.causal_events.where("event_type LIKE '%delay%'").withColumn(
        "metadata", F.create_map(F.lit("delay_minutes"), F.lit("999"), F.lit("old"), F.lit("x"))
    )
    news = events.select("event_id", F.create_map(F.lit("delay_minutes"), F.floor("value").cast("string")).alias("metadata"))
    out = causal.update_risk(events, news, stats(s))
    return out.select("event_id", "risk_level", F.col("metadata")["delay_minutes"].cast("bigint").alias("delay_minutes"), F.col("metadata")["old"].alias("old"))


LA = "(SELECT * FROM levels WHERE event_type LIKE '%anomaly%')"


@q(
    "agg_dashboard_metrics",
    f"""SELECT 'total' AS kind, CAST(NULL AS VARCHAR) AS value, count(*) AS n FROM {LA} UNION ALL SELECT 'risk', level, count(*) FROM {LA} GROUP BY level
 UNION ALL SELECT 'type', event_type, count(*) FROM {LA} GROUP BY event_type UNION ALL SELECT 'last_24h', NULL, count(*) FROM {LA} WHERE ts > TIMESTAMP '2024-01-30'
 UNION ALL (SELECT 'recent', event_id, row_number() OVER (ORDER BY ts DESC, event_id) FROM {LA} ORDER BY ts DESC, event_id LIMIT 10)""",
)
def _(s: Source):
    return causal.dashboard(s.causal_events, stats(s), AS_OF)


@q(
    "st_daily_trend",
    f"""SELECT CAST(d AS BIGINT) AS day_no, strftime(TIMESTAMP '2024-01-24' + to_days(CAST(d AS INT)), '%m/%d') AS label, count(event_id) AS total,
 count(event_id) FILTER (level = 'high') AS high_risk, count(event_id) FILTER (level = 'medium') AS medium_risk, count(event_id) FILTER (level = 'low') AS low_risk
 FROM (SELECT unnest(generate_series(0, 6)) AS d) g LEFT JOIN {LA} l ON CAST(floor((us - epoch_us(TIMESTAMP '2024-01-31')) / 86400000000) AS BIGINT) + 7 = d GROUP BY d""",
)
def _(s: Source):
    return causal.daily_trend(s.causal_events, stats(s), AS_OF).withColumn("day_no", F.col("day_no").cast("bigint"))


@q("st_last_24h", "SELECT count(*) AS n FROM ev WHERE event_type LIKE '%anomaly%' AND ts > TIMESTAMP '2024-01-30'")
def _(s: Source):
    day_before = F.lit(AS_OF).cast("timestamp") - F.expr("INTERVAL 1 DAY")
    return filters.anomaly_events(s.causal_events).where(F.col("ts").cast("timestamp") > day_before).agg(F.count("*").alias("n"))
