"""The event log: registration, edges, causal links, chains, holds and entity analysis."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import refdata as ref
from ..functions.columns import text_id
from ..functions.sizing import sized
from ..session import cut_lineage
from .intervals import micros, up_to, within
from .ranking import latest_per_entity, top_per_group

US = 1_000_000


# --- events and edges -----------------------------------------------------------------------


def register(rows: DataFrame, event_type: str | Column, entity_id: str, entity_type: str, ts: str | Column, description: Column, metadata: Column) -> DataFrame:
    """Event rows with an id made of what happened, to whom and when."""
    kind = F.lit(event_type) if isinstance(event_type, str) else event_type
    when = (F.col(ts) if isinstance(ts, str) else ts).cast("timestamp")
    return rows.select(
        kind.alias("event_type"), F.col(entity_id).alias("entity_id"), F.lit(entity_type).alias("entity_type"),
        description.cast("string").alias("description"), metadata.alias("metadata"), when.alias("ts"),
    ).select(text_id("event_type", "entity_id", micros("ts").cast("string"), "description").alias("event_id"), "*")


def entity_index(events: DataFrame) -> DataFrame:
    """Entity key to events as rows, so that a busy entity needs no single long list."""
    return events.select(F.concat_ws(":", "entity_type", "entity_id").alias("entity_key"), "event_id", "ts")


def with_reverse(edges: DataFrame) -> DataFrame:
    """Edges and their reverses, each once; the names differ, so distinct edges have distinct reverses."""
    there = F.struct("source", "target", "relationship_type")
    back = F.struct(
        F.col("target").alias("source"), F.col("source").alias("target"),
        F.concat("relationship_type", F.lit("_reverse")).alias("relationship_type"),
    )
    base = edges.select("source", "target", "relationship_type").distinct()
    return base.select(F.explode(F.array(there, back)).alias("e")).select("e.*")


def record_edges(invoices: DataFrame, shipments: DataFrame, policies: DataFrame | None = None) -> DataFrame:
    """Edges named by the records; several targets of a row come out of one pass."""

    def targets(rows: DataFrame, source: str, **kinds: str) -> DataFrame:
        pairs = F.array(*[F.struct(F.col(col).alias("target"), F.lit(kind).alias("relationship_type")) for kind, col in kinds.items()])
        return rows.select(F.col(source).alias("source"), F.explode(pairs).alias("e")).select("source", "e.*").where("target <> ''")

    out = targets(invoices, "invoice_id", invoice_to_shipment="shipment_id", invoice_to_supplier="supplier")
    out = out.unionByName(targets(shipments, "shipment_id", shipment_to_carrier="carrier", shipment_to_driver="driver_id"))
    if policies is not None:
        out = out.unionByName(
            policies.select(F.col("policy_id").alias("source"), F.explode("affected_entities").alias("target"), F.lit("policy_to_entity").alias("relationship_type"))
        )
    return with_reverse(out)


# --- links ----------------------------------------------------------------------------------


def _points(value: float) -> int:
    return round(value * 100)


def _reach(threshold: float, window_s: int, boost: float, same_entity: bool) -> int:
    """Longest gap in seconds at which the strength still reaches the threshold; -1 if none does."""
    fixed = 50 + (20 if same_entity else 0) + _points(boost)
    best = -1
    for limit, points in [*ref.PROXIMITY_POINTS, (window_s, 0.0)]:
        if min(fixed + _points(points), 100) >= _points(threshold):
            best = max(best, min(limit, window_s))
    return best


def link_rules(spark: SparkSession, rules=ref.CAUSAL_RULES, boosts=ref.PAIR_BOOST) -> DataFrame:
    """One row per (cause, effect) type pair: how far apart two events may be, and the pair's boost.

    Strength is a step function of the gap, so the thresholds turn into gap limits before any join.
    """
    if any(c == e for c, e, *_ in rules):
        raise ValueError("a rule's cause and effect must be of different types")
    boost = {(c, e): b for c, e, b in boosts}
    pairs: dict[tuple[str, str], list[int]] = {}
    for cause, effect, window, threshold in rules:
        b = boost.get((cause, effect), 0.0)
        row = pairs.setdefault((cause, effect), [-1, -1])
        row[0] = max(row[0], _reach(threshold, window, b, True))
        row[1] = max(row[1], _reach(threshold, window, b, False))
    rows = [(c, e, s * US, a * US, _points(boost.get((c, e), 0.0))) for (c, e), (s, a) in pairs.items()]
    return spark.createDataFrame(rows, "cause_type string, effect_type string, same_us bigint, any_us bigint, boost bigint")


def normal_type(col: str | Column = "event_type", synonyms: dict[str, str] = ref.EVENT_SYNONYMS) -> Column:
    kind = F.col(col) if isinstance(col, str) else col
    out = kind
    for name, same in synonyms.items():
        out = F.when(kind == name, same).otherwise(out)
    return out


def strength(gap_us: Column, same_entity: Column, boost_points: Column) -> Column:
    """Additive strength: base, nearness in time, same entity, known pair; at most 1."""
    near = F.lit(0)
    for limit, points in reversed(ref.PROXIMITY_POINTS):
        near = F.when(gap_us <= limit * US, _points(points)).otherwise(near)
    total = F.lit(50) + near + F.when(same_entity, 20).otherwise(0) + boost_points
    return F.least(total, F.lit(100)) / 100.0


_SIDE = ["event_id", "entity_id", "entity_type", "description"]


def _sides(events: DataFrame, rules: DataFrame, reach: str, later: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Events as causes and as effects (those of ``later``, where given) of the rules that can reach anything."""
    live = F.broadcast(rules.where(F.col(reach) >= 0))

    def side(role: str, cols: list[str]) -> DataFrame:
        rows = later if role == "effect" and later is not None else events
        base = rows.select(*_SIDE, normal_type().alias("kind"), micros("ts").alias("us"))
        renamed = base.select(F.col("kind").alias(f"{role}_type"), F.col("us").alias(f"{role}_us"), *[F.col(x).alias(f"{role}_{x}") for x in _SIDE])
        return renamed.join(live.select(*cols), f"{role}_type")

    return (
        side("cause", ["cause_type", "effect_type", "boost", reach]),
        side("effect", ["cause_type", "effect_type", reach]),
    )


def causal_links(events: DataFrame, rules: DataFrame, scope: str = "any", later: DataFrame | None = None) -> DataFrame:
    """Cause and effect pairs whose strength reaches the rule's threshold, effect never before cause.

    ``same``: both events belong to one entity, joined on entity and time bucket.
    ``any``: also events of different entities, joined on type pair and a bucket as narrow as the
    threshold allows. The result of ``any`` is by nature as large as the log is dense. With ``later`` the
    effects come from there.
    """
    causes, effects = _sides(events, rules, "same_us", later)
    causes = causes.withColumn("entity_id", F.col("cause_entity_id"))
    effects = effects.withColumn("entity_id", F.col("effect_entity_id"))
    out = within(causes, effects, ["cause_type", "effect_type", "entity_id"], "cause_us", "effect_us", "same_us").drop("entity_id", "same_us")
    if scope == "any":
        causes, effects = _sides(events, rules, "any_us", later)
        others = within(causes, effects, ["cause_type", "effect_type"], "cause_us", "effect_us", "any_us").drop("any_us")
        # an event without an entity belongs to no one else's either
        out = out.unionByName(others.where("coalesce(cause_entity_id <> effect_entity_id, true)"))
    gap = F.col("effect_us") - F.col("cause_us")
    return out.where("cause_event_id <> effect_event_id").select(
        F.col("cause_event_id").alias("cause_id"),
        F.col("effect_event_id").alias("effect_id"),
        "cause_type", "effect_type", "cause_entity_id", "effect_entity_id", "cause_entity_type", "effect_entity_type",
        "cause_description", "effect_description", "cause_us", "effect_us",
        gap.alias("gap_us"),
        strength(gap, F.col("cause_entity_id") == F.col("effect_entity_id"), F.col("boost")).alias("confidence"),
    )


def _pair_points(points: DataFrame, moments: list[tuple[Column, bool, int]]) -> DataFrame:
    """Every row of ``points`` at several moments, each with its weight in the count."""
    asked = [F.struct(us.alias("us"), F.lit(before).alias("before"), F.lit(weight).alias("weight")) for us, before, weight in moments]
    return points.withColumn("_m", F.explode(F.array(*asked))).select("*", "_m.*").drop("_m")


def linked(events: DataFrame, rules: DataFrame, side: str = "effect") -> DataFrame:
    """Per event on one ``side`` of a rule: how many links of the rule it has, and the strongest one.

    Events of all entities count; one entity only raises the strength. The strength falls with the gap in
    steps, so links are counted by running totals up to the event and up to the far end of its reach, and
    the strongest is the nearest event of the other type or the nearest one of the same entity. No pairs
    are made. Columns: event_id and the event's other columns, cause_type, effect_type, links, confidence,
    gap_us and other_* of the other end. Of equally strong ones the nearest counts, then the largest id.
    """
    other = "cause" if side == "effect" else "effect"
    sign = 1 if side == "effect" else -1  # for causes time runs backwards
    base = events.select(*_SIDE, normal_type().alias("kind"), (micros("ts") * sign).alias("t"))
    live = F.broadcast(rules.where("same_us >= 0"))
    pair = ["cause_type", "effect_type"]
    points = base.join(live.withColumnRenamed(f"{side}_type", "kind"), "kind").withColumnRenamed("kind", f"{side}_type")
    marks = base.join(live.withColumnRenamed(f"{other}_type", "kind"), "kind").withColumnRenamed("kind", f"{other}_type")
    marks = marks.select(*pair, F.col("t").alias("us"), "entity_id", F.struct(*_SIDE).alias("tag"))
    ask = points.select(*pair, "event_id", "entity_id", "t", "same_us", "any_us")

    def totals(found: DataFrame, name: str) -> DataFrame:
        return found.groupBy(*pair, "event_id").agg(
            F.sum(F.col("n") * F.col("weight")).alias(f"n_{name}"), F.max(F.when(F.col("us") == F.col("t"), F.col("last"))).alias(f"last_{name}")
        )

    t = F.col("t")
    anyone = _pair_points(ask.where("any_us >= 0"), [(t, False, 1), (t - F.col("any_us"), True, -1)])
    anyone = totals(up_to(anyone.drop("entity_id", "same_us", "any_us"), marks.drop("entity_id"), pair), "any")
    # of the same entity those that the first count has not reached
    own = ask.where("entity_id IS NOT NULL")
    reached = _pair_points(own.where("any_us >= 0"), [(t, False, 0), (t - F.col("any_us"), True, 1), (t - F.col("same_us"), True, -1)])
    alone = _pair_points(own.where("any_us < 0"), [(t, False, 1), (t - F.col("same_us"), True, -1)])
    same = reached.unionByName(alone).drop("same_us", "any_us")
    same = totals(up_to(same, marks.where("entity_id IS NOT NULL"), [*pair, "entity_id"]), "same")

    def candidate(name: str, reach: str) -> Column:
        last = F.col(f"last_{name}")
        gap = t - last["us"]
        power = strength(gap, F.coalesce(last["tag"]["entity_id"] == F.col("entity_id"), F.lit(False)), F.col("boost"))
        return F.when(gap <= F.col(reach), F.struct(power.alias("confidence"), (-gap).alias("near"), last["tag"].alias("other")))

    rows = points.join(anyone, [*pair, "event_id"], "left").join(same, [*pair, "event_id"], "left")
    n = F.coalesce("n_any", F.lit(0)) + F.coalesce("n_same", F.lit(0))
    best = F.greatest(candidate("any", "any_us"), candidate("same", "same_us"))
    rows = rows.withColumn("links", n.cast("bigint")).withColumn("best", best).where("links > 0")
    return rows.select(
        *_SIDE, *pair, "links", F.col("best.confidence").alias("confidence"), (-F.col("best.near")).alias("gap_us"),
        *[F.col(f"best.other.{c}").alias(f"other_{c}") for c in _SIDE],
    )


def link_counts(events: DataFrame, rules: DataFrame, side: str = "effect") -> DataFrame:
    """(event_id, cause_type, effect_type, links): the counts of ``linked`` without the strongest link.

    Only ids and times are moved, and all counts of an event meet in one grouping. As in ``linked``, an event that is
    repeated counts the links of each of its rows.
    """
    other = "cause" if side == "effect" else "effect"
    sign = 1 if side == "effect" else -1  # for causes time runs backwards
    base = events.select("event_id", "entity_id", normal_type().alias("kind"), (micros("ts") * sign).alias("t"))
    live = F.broadcast(rules.where("same_us >= 0"))
    pair = ["cause_type", "effect_type"]
    ask = base.where("event_id IS NOT NULL").join(live.withColumnRenamed(f"{side}_type", "kind"), "kind").withColumnRenamed("kind", f"{side}_type")
    marks = base.join(live.withColumnRenamed(f"{other}_type", "kind"), "kind").withColumnRenamed("kind", f"{other}_type")
    marks = marks.select(*pair, F.col("t").alias("us"), "entity_id", F.lit(True).alias("tag"))

    def counted(keys: list[str], step_s: int, seen: DataFrame, *asked: tuple[DataFrame, list[tuple[Column, bool, int]]]) -> DataFrame:
        points = reduce(DataFrame.unionByName, [_pair_points(rows.select(*keys, "event_id", "t", "same_us", "any_us"), at) for rows, at in asked])
        found = up_to(points.select(*keys, "us", "before", "event_id", "weight"), seen, keys, step_s)
        return found.select(*pair, "event_id", (F.col("n") * F.col("weight")).alias("n"), F.lit(0).alias("rows"))

    t, far, farther = F.col("t"), F.col("t") - F.col("any_us"), F.col("t") - F.col("same_us")
    anyone = counted(pair, 60, marks.drop("entity_id"), (ask.where("any_us >= 0"), [(t, False, 1), (far, True, -1)]))
    own = ask.where("entity_id IS NOT NULL")
    same = counted(
        [*pair, "entity_id"], ref.DAY, marks.where("entity_id IS NOT NULL"),  # an entity has few events a day
        # of the same entity those that the first count has not reached
        (own.where("any_us >= 0"), [(far, True, 1), (farther, True, -1)]),
        (own.where("any_us < 0"), [(t, False, 1), (farther, True, -1)]),
    )
    each = ask.select(*pair, "event_id", F.lit(0).cast("bigint").alias("n"), F.lit(1).alias("rows"))
    totals = anyone.unionByName(same).unionByName(each).groupBy(*pair, "event_id").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows"))
    return totals.where("n > 0").select("event_id", *pair, (F.col("n") * F.col("rows")).alias("links"))


def count_links(events: DataFrame, rules: DataFrame) -> DataFrame:
    """How many links ``causal_links`` has per types, type of the effect's entity and strength: cause_type, effect_type,
    effect_entity_type, confidence, n.

    The strength falls with the gap in steps, so the links of a step are a difference of two running totals. Those
    within an entity are counted once more and move from the strength of strangers to their own. No pairs are made.
    An id must stand for one event, which may be repeated.
    """
    base = events.where("event_id IS NOT NULL").select("entity_id", "entity_type", normal_type().alias("kind"), micros("ts").alias("us"))
    live = F.broadcast(rules.where("same_us >= 0"))
    pair = ["cause_type", "effect_type"]
    effects = base.join(live.withColumnRenamed("effect_type", "kind"), "kind").withColumnRenamed("kind", "effect_type")
    causes = base.join(live.withColumnRenamed("cause_type", "kind"), "kind").withColumnRenamed("kind", "cause_type")
    marks = causes.select(*pair, "entity_id", "us", F.lit(True).alias("tag"))
    limits = [-1, *sorted(limit * US for limit, _ in ref.PROXIMITY_POINTS), (1 << 62)]

    def moments(reach: str, same: bool, sign: int) -> list[Column]:
        """Both ends of every step of the gap, as far as the reach goes."""
        out = []
        for low, high in zip(limits, limits[1:]):
            first, last = F.lit(low) + 1, F.least(F.lit(high), F.col(reach))
            power = strength(first, F.lit(same), F.col("boost")).alias("confidence")
            for us, before, weight in ((F.col("us") - first, False, sign), (F.col("us") - last, True, -sign)):
                end = F.struct(us.alias("us"), F.lit(before).alias("before"), F.lit(weight).alias("weight"), power)
                out.append(F.when(first <= last, end))
        return out

    def counted(keys: list[str], asked: list[Column], rows: DataFrame, seen: DataFrame) -> DataFrame:
        ends = rows.select(*keys, F.col("entity_type").alias("effect_entity_type"), F.explode(F.array_compact(F.array(*asked))).alias("_m"))
        ends = ends.select(*keys, "effect_entity_type", "_m.*")
        # ends at one moment are one question
        ends = ends.groupBy(*keys, "effect_entity_type", "us", "before", "confidence").agg(F.sum("weight").alias("weight"))
        return up_to(ends, seen, keys).select(*pair, "effect_entity_type", "confidence", (F.col("n") * F.col("weight")).alias("n"))

    anyone = counted(pair, moments("any_us", False, 1), effects, marks.drop("entity_id"))
    own = moments("same_us", True, 1) + moments("any_us", False, -1)
    same = counted([*pair, "entity_id"], own, effects.where("entity_id IS NOT NULL"), marks.where("entity_id IS NOT NULL"))
    return anyone.unionByName(same).groupBy(*pair, "effect_entity_type", "confidence").agg(F.sum("n").alias("n")).where("n > 0")


def strongest_links(events: DataFrame, rules: DataFrame) -> DataFrame:
    """The strongest cause of each type for every effect, in the columns of ``causal_links``, with the
    number of causes of that type that reach the threshold (``causes``)."""
    found = linked(events, rules, "effect")
    return found.select(
        F.col("other_event_id").alias("cause_id"), F.col("event_id").alias("effect_id"), "cause_type", "effect_type",
        F.col("other_entity_id").alias("cause_entity_id"), F.col("entity_id").alias("effect_entity_id"),
        F.col("other_entity_type").alias("cause_entity_type"), F.col("entity_type").alias("effect_entity_type"),
        F.col("other_description").alias("cause_description"), F.col("description").alias("effect_description"),
        "gap_us", "confidence", F.col("links").alias("causes"),
    )


def link_evidence() -> Column:
    """What speaks for a link, as texts."""
    known = (F.col("cause_type") == "driver_risk_increase") & (F.col("effect_type") == "shipment_delay")
    return F.array_compact(
        F.array(
            F.concat(
                F.lit("Temporal sequence: "), "cause_type", F.lit(" occurred "), F.floor(F.col("gap_us") / US).cast("string"),
                F.lit(" seconds before "), "effect_type",
            ),
            F.concat(
                F.lit("Entity relationship: "), "cause_entity_type", F.lit(" "), "cause_entity_id", F.lit(" related to "),
                "effect_entity_type", F.lit(" "), "effect_entity_id",
            ),
            F.when(
                known,
                F.concat(
                    F.lit("Domain rule: Driver risk increases are known to cause shipment delays (confidence: "),
                    F.format_string("%.2f", "confidence"), F.lit(")"),
                ),
            ),
        )
    )


def roots(links: DataFrame) -> DataFrame:
    """Events that are a cause and never an effect."""
    causes = links.select(F.col("cause_id").alias("event_id")).distinct()
    return causes.join(links.select(F.col("effect_id").alias("event_id")).distinct(), "event_id", "left_anti")


def longest_path(rules) -> int | None:
    """Longest chain of types the rules allow, or None when they form a cycle."""
    after: dict[str, set[str]] = {}
    for cause, effect, *_ in rules:
        after.setdefault(cause, set()).add(effect)

    def depth(kind: str, seen: frozenset) -> int | None:
        if kind in seen:
            return None
        below = [depth(n, seen | {kind}) for n in after.get(kind, ())]
        return None if None in below else 1 + max(below, default=-1)

    depths = [depth(k, frozenset()) for k in after]
    return None if None in depths else max(depths, default=0)


def chains(links: DataFrame, max_depth: int | None) -> DataFrame:
    """Breadth-first expansion from every root: each event once per root, with depth and parent.

    The parent is the smallest id among the first to reach an event. Where the rules allow no
    cycle, ``max_depth`` (see ``longest_path``) bounds the rounds; else rounds go on until one adds
    nothing. Each round checkpoints, so a lost executor costs one round.
    """
    step = links.select("cause_id", "effect_id", "confidence")
    start = roots(links).select(F.col("event_id").alias("root_id"))
    frontier = start.join(step, F.col("root_id") == F.col("cause_id")).select(
        "root_id", F.col("effect_id").alias("event_id"), F.col("cause_id").alias("parent_id"), "confidence"
    )
    frontier = frontier.groupBy("root_id", "event_id").agg(
        F.min("parent_id").alias("parent_id"), F.min_by("confidence", "parent_id").alias("confidence")
    )
    found, depth = None, 1
    while max_depth is None or depth <= max_depth:
        frontier = cut_lineage(frontier.withColumn("depth", F.lit(depth)))
        found = frontier if found is None else found.unionByName(frontier)
        if depth == max_depth or (max_depth is None and frontier.isEmpty()):
            break
        seen = found.select("root_id", "event_id")
        frontier = (
            frontier.select("root_id", F.col("event_id").alias("cause_id"))
            .join(step, "cause_id")
            .groupBy("root_id", F.col("effect_id").alias("event_id"))
            .agg(F.min("cause_id").alias("parent_id"), F.min_by("confidence", "cause_id").alias("confidence"))
            .where("event_id <> root_id")
            .join(seen, ["root_id", "event_id"], "left_anti")
        )
        depth += 1
    return found


def chain_confidence(chain_rows: DataFrame, constant: float | None = None) -> DataFrame:
    """Mean confidence per chain; ``constant`` gives every link the same one."""
    value = F.col("confidence") if constant is None else F.lit(constant)
    return chain_rows.groupBy("root_id").agg(F.count("*").alias("links"), F.avg(value).alias("overall_confidence"))


def chain_leaves(chain_rows: DataFrame, links: DataFrame) -> DataFrame:
    """Members of a chain that cause nothing further."""
    return chain_rows.join(links.select(F.col("cause_id").alias("event_id")).distinct(), "event_id", "left_anti")


def final_effect(leaves: DataFrame, events: DataFrame) -> DataFrame:
    """The latest leaf of every chain."""
    rows = leaves.select("root_id", "event_id").join(events.select("event_id", "ts", "description"), "event_id")
    return rows.groupBy("root_id").agg(F.max_by(F.struct("event_id", "description"), F.struct("ts", "event_id")).alias("leaf")).select(
        "root_id", F.col("leaf.event_id").alias("final_id"), F.col("leaf.description").alias("final_effect")
    )


# --- holds ----------------------------------------------------------------------------------


def _hold_rules(spark: SparkSession, rules, patterns) -> DataFrame:
    """A pattern's threshold goes into the rule, which shortens the time a cause reaches before any pair is made."""
    limits = {(c, e): t for c, e, t in patterns}
    return link_rules(spark, [(c, e, w, max(t, limits[c, e])) for c, e, w, t in rules if (c, e) in limits])


def hold_links(events: DataFrame, rules=ref.CAUSAL_RULES, patterns=ref.HOLD_PATTERNS) -> DataFrame:
    """All links that put an entity on hold."""
    return causal_links(events, _hold_rules(events.sparkSession, rules, patterns))


def hold_link_counts(events: DataFrame, rules=ref.CAUSAL_RULES, patterns=ref.HOLD_PATTERNS) -> DataFrame:
    """``hold_links`` counted: links that differ by their events only are one row, ``n`` says how many.

    cause_id and effect_id name such a class; there are as many as types, entity types and strengths. No pairs
    are made for it, see ``count_links``. Where an id stands for different events, a hold is shared by links of several
    strengths, so the links of such ids are listed.
    """
    table = _hold_rules(events.sparkSession, rules, patterns)
    known = events.where("event_id IS NOT NULL")
    different = known.groupBy("event_id").agg(F.count_distinct(F.struct(normal_type(), "entity_id", "entity_type", micros("ts"))).alias("_rows"))
    different = sized(different.where("_rows > 1").select("event_id"))
    mixed, clean = known.join(different, "event_id", "left_semi"), known.join(different, "event_id", "left_anti")
    cols = ["cause_type", "effect_type", "effect_entity_type", "confidence"]
    name = F.concat_ws("|", F.lit("class"), *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in cols])
    counted = count_links(clean, table).select(
        name.alias("cause_id"), name.alias("effect_id"), *cols, F.lit(None).cast("string").alias("effect_entity_id"), "n"
    )
    listed = causal_links(mixed, table, later=known).unionByName(causal_links(clean, table, later=mixed)).withColumn("n", F.lit(1).cast("bigint"))
    return counted.unionByName(listed.select(*counted.columns))


def holds_from_links(links: DataFrame, as_of: str, patterns=ref.HOLD_PATTERNS, keep: tuple[str, ...] = ()) -> DataFrame:
    """A pending hold on the effect's entity for every link of a dangerous pattern; columns of ``keep`` stay."""
    spark = links.sparkSession
    table = spark.createDataFrame([(c, e, float(t)) for c, e, t in patterns], "cause_type string, effect_type string, threshold double")
    now = F.lit(as_of).cast("timestamp")
    return links.join(F.broadcast(table), ["cause_type", "effect_type"]).where("confidence >= threshold").select(
        text_id(F.lit("hold"), "cause_id", "effect_id").alias("hold_id"),
        F.col("effect_entity_id").alias("entity_id"),
        F.col("effect_entity_type").alias("entity_type"),
        F.col("confidence").alias("risk_score"),
        F.concat(F.lit("Automatic hold due to "), "cause_type", F.lit(" causing "), "effect_type").alias("reason"),
        F.col("cause_id").alias("causal_chain_id"),
        F.lit("pending_approval").alias("status"),
        now.alias("created_at"),
        now.alias("updated_at"),
        F.lit(None).cast("string").alias("approved_by"),
        *keep,
    )


def update_holds(holds: DataFrame, changes: DataFrame) -> DataFrame:
    """Latest change per hold applied; a missing approver keeps the earlier one. Unknown holds change nothing."""
    last = changes.groupBy("hold_id").agg(
        F.max_by("status", "changed_at").alias("new_status"),
        F.max("changed_at").alias("changed_at"),
        F.max_by("approver", F.when(F.col("approver").isNotNull(), F.col("changed_at"))).alias("new_approver"),
    )
    return holds.join(last, "hold_id", "left").select(
        *[c for c in holds.columns if c not in ("status", "updated_at", "approved_by")],
        F.coalesce("new_status", "status").alias("status"),
        F.coalesce(F.col("changed_at").cast("timestamp"), F.col("updated_at")).alias("updated_at"),
        F.coalesce("new_approver", "approved_by").alias("approved_by"),
    )


# --- entity analysis ------------------------------------------------------------------------


def latest_anomaly(events: DataFrame) -> DataFrame:
    return latest_per_entity(events.where(F.col("event_type").contains("anomaly")))


def analysis_rule(event_type: Column, anomaly_type: Column) -> Column:
    """Which rule explains an anomaly."""
    invoice = event_type.contains("invoice")
    return (
        F.when(invoice & anomaly_type.contains("delay"), "invoice_delay")
        .when(~invoice, "shipment_anomaly")
        .when(invoice & anomaly_type.contains("payment"), "payment_term_violation")
    )


def analysis_sides(events: DataFrame, edges: DataFrame, rules=ref.ANALYSIS_RULES) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """What the search for causes joins: (anomalies, causes, pairs of related entities, reach per rule).

    Strength is the mean of nearness in the window and 1 (related) or 0.5, so a threshold t reaches back
    window * (1 + relation - 2t).
    """
    spark = events.sparkSession
    spans = {(r, w, t) for r, _, w, t in rules}
    reach = spark.createDataFrame(
        [(r, w * US, int(w * US * (2.0 - 2 * t) + 0.5), int(w * US * (1.5 - 2 * t) + 0.5)) for r, w, t in sorted(spans)],
        "rule string, window_us bigint, related_us bigint, other_us bigint",
    )
    anomalies = (
        latest_anomaly(events)
        .withColumn("anomaly_type", F.col("anomaly_type") if "anomaly_type" in events.columns else F.col("event_type"))
        .withColumn("rule", analysis_rule(F.col("event_type"), F.col("anomaly_type")))
        .join(F.broadcast(reach), "rule")
        .select(
            F.col("event_id").alias("anomaly_id"), "entity_id", F.col("event_type").alias("anomaly_event_type"), "rule",
            micros("ts").alias("anomaly_us"), "window_us", "related_us", "other_us",
            F.when(F.col("event_type").contains("invoice"), "invoice_anomaly").otherwise("shipment_anomaly").alias("base_type"),
        )
    )
    causes = events.select(
        F.col("event_id").alias("cause_id"), F.col("entity_id").alias("cause_entity_id"), normal_type().alias("cause_event_type"), micros("ts").alias("cause_us")
    )
    pairs = edges.select(F.col("source").alias("entity_id"), F.col("target").alias("cause_entity_id")).distinct()
    return anomalies, causes, pairs, reach


def typed_causes(causes: DataFrame, rules=ref.ANALYSIS_RULES) -> DataFrame:
    """Each cause once per rule that names its type, by substring."""
    kinds: dict[str, list[str]] = {}
    for rule, kind, _, _ in rules:
        kinds.setdefault(rule, []).append(kind)
    named = [F.when(F.greatest(F.lit(False), *[F.col("cause_event_type").contains(k) for k in ks]), r) for r, ks in sorted(kinds.items())]
    return causes.withColumn("rule", F.explode(F.array_compact(F.array(*named))))


def related_causes(anomalies: DataFrame, causes: DataFrame, pairs: DataFrame, reach: DataFrame) -> DataFrame:
    """Events of related entities in reach, whatever their type."""
    asked = anomalies.join(pairs, "entity_id").drop("other_us")
    spots = causes.join(F.broadcast(reach.select("rule", "related_us")))
    near = within(spots, asked, ["rule", "cause_entity_id"], "cause_us", "anomaly_us", "related_us")
    return near.withColumn("is_related", F.lit(True)).drop("related_us")


def judged_causes(found: DataFrame) -> DataFrame:
    """Causes with strength and nearness; what an entity's own anomalies of the kind say is no cause."""
    gap = F.col("anomaly_us") - F.col("cause_us")
    own = (F.col("cause_entity_id") == F.col("entity_id")) & (F.col("cause_event_type") == F.col("base_type"))
    score = (1.0 - gap / F.col("window_us") + F.when(F.col("is_related"), 1.0).otherwise(0.5)) / 2
    return found.where(~own).select(
        "entity_id", "anomaly_id", "anomaly_event_type", "rule", "cause_id", "cause_entity_id", "cause_event_type", "cause_us", "is_related",
        score.alias("causal_strength"),
        F.concat(F.floor(gap / (60 * US)).cast("string"), F.lit(" minutes")).alias("temporal_proximity"),
    )


def potential_causes(events: DataFrame, edges: DataFrame, rules=ref.ANALYSIS_RULES) -> DataFrame:
    """For each entity's latest anomaly the earlier events that may explain it.

    A cause matches one of the rule's types by substring, or belongs to a related entity; the reach of either
    kind bounds its join. All pairs are listed; ``nearest_causes`` gives the best ones without them.
    """
    anomalies, causes, pairs, reach = analysis_sides(events, edges, rules)
    related = related_causes(anomalies, causes, pairs, reach)
    # events of the rule's types anywhere, unless related
    typed = typed_causes(causes, rules).join(F.broadcast(reach.select("rule", "other_us")), "rule")
    anywhere = within(typed, anomalies.drop("related_us"), ["rule"], "cause_us", "anomaly_us", "other_us")
    anywhere = anywhere.join(pairs, ["entity_id", "cause_entity_id"], "left_anti").withColumn("is_related", F.lit(False)).drop("other_us")
    return judged_causes(related.unionByName(anywhere))


def top_causes(causes: DataFrame, k: int = 3) -> DataFrame:
    return top_per_group(causes, ["anomaly_id"], [F.desc("causal_strength"), F.col("cause_id")], k)


def analyze_entities(asked: DataFrame, events: DataFrame, causes: DataFrame, k: int = 3, counts: DataFrame | None = None) -> DataFrame:
    """Report per asked entity: found, has_anomaly, the anomaly, how many causes and the first few.

    ``causes`` are all of them, or with ``counts`` (entity_id, causes) at least the best k.
    """
    known = events.groupBy("entity_id").agg(F.count("*").alias("events"))
    latest = latest_anomaly(events).select("entity_id", F.col("event_id").alias("anomaly_id"), F.col("event_type").alias("anomaly_type"), "risk_score")
    counts = causes.groupBy("entity_id").agg(F.count("*").alias("causes")) if counts is None else counts
    first = (
        top_causes(causes, k)
        .groupBy("entity_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "cause_id", "cause_event_type", "cause_entity_id", "temporal_proximity"))).alias("top"))
    )
    return (
        asked.select("entity_id").join(known, "entity_id", "left").join(latest, "entity_id", "left")
        .join(counts, "entity_id", "left").join(first, "entity_id", "left")
        .select(
            "entity_id", F.col("events").isNotNull().alias("found"), F.col("anomaly_id").isNotNull().alias("has_anomaly"),
            "anomaly_id", "anomaly_type", "risk_score", F.coalesce("causes", F.lit(0)).alias("causes"), "top",
        )
    )


def risks_of_causes(events: DataFrame, causes: DataFrame) -> DataFrame:
    """(entity_id, causes, driver_risk): how many causes an entity has and the highest driver risk among them."""
    driver = F.col("cause_event_type") == "driver_risk_increase"
    risks = events.select(F.col("event_id").alias("cause_id"), F.col("risk_score").alias("cause_risk"))
    return causes.join(risks, "cause_id").groupBy("entity_id").agg(
        F.count("*").alias("causes"), F.max(F.when(driver, F.col("cause_risk"))).alias("driver_risk")
    )


def holds_from_analysis(events: DataFrame, per_entity: DataFrame, limits: dict[str, float] = ref.HOLD_THRESHOLDS) -> DataFrame:
    """Holds and advisories from an entity's own risk and the driver risks among its causes, see ``risks_of_causes``."""
    rows = latest_anomaly(events).select("entity_id", F.col("event_type").alias("anomaly_type"), "risk_score").join(per_entity, "entity_id", "left")
    base = F.greatest("risk_score", F.coalesce(F.col("driver_risk"), F.lit(0.0)) * 0.9)
    combined = base * F.when(F.col("causes") > 0, 1.2).otherwise(1.0)
    low = F.lower("anomaly_type")
    kind = (
        F.when(low.contains("invoice") & (combined >= limits["invoice"]), "payment_hold")
        .when(low.contains("shipment") & (combined >= limits["shipment"]), "shipment_hold")
        .when(F.col("driver_risk") >= limits["driver"], "driver_restriction")
        .when(combined >= limits["combined"], "advisory_hold")
    )
    return rows.select("entity_id", "anomaly_type", combined.alias("combined_risk"), "driver_risk", kind.alias("hold")).where("hold IS NOT NULL")


def hold_text() -> Column:
    """A hold of ``holds_from_analysis`` in words."""
    score = F.format_string("%.2f", "combined_risk")
    driver = F.format_string("%.2f", "driver_risk")
    return (
        F.when(
            F.col("hold") == "payment_hold",
            F.concat(F.lit("PAYMENT HOLD on "), "entity_id", F.lit(": Invoice flagged for manual review due to high risk score ("), score, F.lit(").")),
        )
        .when(
            F.col("hold") == "shipment_hold",
            F.concat(
                F.lit("SHIPMENT HOLD on "), "entity_id", F.lit(": Shipment flagged due to anomaly detection ("), score, F.lit(")."),
                F.when(F.col("driver_risk").isNotNull(), F.concat(F.lit(" Driver Unknown driver has elevated risk score ("), driver, F.lit(")."))).otherwise(""),
            ),
        )
        .when(
            F.col("hold") == "driver_restriction",
            F.concat(F.lit("DRIVER RESTRICTION: Unknown driver has high risk score ("), driver, F.lit("). Recommend limiting sensitive shipments.")),
        )
        .otherwise(F.concat(F.lit("ADVISORY HOLD on "), "entity_id", F.lit(": Combined risk factors ("), score, F.lit(") suggest caution.")))
    )


def related_events(events: DataFrame, edges: DataFrame) -> DataFrame:
    """Per entity its own events and those of its related entities."""
    pairs = edges.select(F.col("source").alias("asked"), F.col("target").alias("entity_id")).distinct()
    own = events.select("entity_id").distinct().select(F.col("entity_id").alias("asked"), "entity_id")
    return own.unionByName(pairs.where("asked <> entity_id")).join(events, "entity_id")


def events_near(events: DataFrame, points: DataFrame, window_s: int = 7 * ref.DAY, step_s: int = 3600) -> DataFrame:
    """Events of other entities within +-window of given points (entity_id, entity_type, point_us).

    A point is written to every hour of its window, an event to its own, so that the join keys are
    hours and no task holds a whole window.
    """
    reach, step = window_s * US, step_s * US
    hour = lambda us: F.floor(us / step).cast("bigint")
    at = F.col("point_us")
    spots = points.select(
        F.col("entity_id").alias("asked"), F.col("entity_type").alias("asked_type"), "point_us",
        F.explode(F.sequence(hour(at - reach), hour(at + reach))).alias("hour"),
    )
    rows = events.select("event_id", "event_type", "entity_id", "entity_type", micros("ts").alias("event_us"))
    near = spots.join(rows.withColumn("hour", hour(F.col("event_us"))), "hour").drop("hour")
    other = ~((F.col("asked") == F.col("entity_id")) & (F.col("asked_type") == F.col("entity_type")))
    return near.where((F.abs(F.col("event_us") - at) <= reach) & other)


# --- risk of events -------------------------------------------------------------------------


def link_stats(events: DataFrame, rules: DataFrame) -> DataFrame:
    """Per event: number of links at either end and whether one leads to a driver risk event."""
    as_effect = link_counts(events, rules, "effect").select("event_id", "links", F.col("cause_type").alias("other"))
    as_cause = link_counts(events, rules, "cause").select("event_id", "links", F.col("effect_type").alias("other"))
    ends = as_effect.unionByName(as_cause)
    return ends.groupBy("event_id").agg(F.sum("links").alias("links"), F.bool_or(F.col("other").contains("driver_risk")).alias("near_driver_risk"))


def root_events(events: DataFrame, rules: DataFrame, causes: DataFrame | None = None) -> DataFrame:
    """Events that are a cause of some link and an effect of none; ``causes`` are the ids of the former, where they are known."""
    causes = link_counts(events, rules, "cause").select("event_id").distinct() if causes is None else causes
    return causes.join(link_counts(events, rules, "effect").select("event_id"), "event_id", "left_anti")


def risk_level(metadata: Column | None = None) -> Column:
    """high, medium or low from type, entity type, metadata and the columns of ``link_stats``."""
    kind, entity = F.col("event_type"), F.col("entity_type")
    value = lambda key, default: F.lit(default) if metadata is None else F.coalesce(F.try_element_at(metadata, F.lit(key)).try_cast("double"), F.lit(default))
    high = (
        kind.contains("driver_risk_increase")
        | (entity.contains("invoice") & kind.contains("fraud"))
        | (entity.contains("shipment") & (kind.contains("theft") | kind.contains("missing")))
        | kind.contains("policy_violation")
        | (F.coalesce(F.col("links"), F.lit(0)) > 3)
        | F.coalesce(F.col("near_driver_risk"), F.lit(False))
    )
    low = (kind.contains("delay") & (value("delay_minutes", 120.0) < 30)) | (kind.contains("price") & (value("percentage_difference", 10.0) < 5))
    return F.when(high, "high").when(low, "low").otherwise("medium")


def update_risk(events: DataFrame, news: DataFrame, stats: DataFrame) -> DataFrame:
    """Merge new metadata into events and set their level again; news is (event_id, metadata)."""
    merged = events.join(news.select("event_id", F.col("metadata").alias("news")), "event_id").join(stats, "event_id", "left")
    keep_new = lambda m, n: F.map_concat(F.map_filter(m, lambda k, v: ~F.map_contains_key(n, k)), n)
    merged = merged.withColumn("metadata", keep_new(F.coalesce("metadata", F.create_map().cast("map<string,string>")), F.col("news")))
    return merged.withColumn("risk_level", risk_level(F.col("metadata"))).drop("news", "links", "near_driver_risk")


def dashboard(events: DataFrame, stats: DataFrame, as_of: str, recent: int = 10) -> DataFrame:
    """Totals by level and type, the last day, and the newest anomalies as (kind, value, n) rows."""
    rows = events.where(F.col("event_type").contains("anomaly")).join(stats, "event_id", "left").select(
        "event_id", "event_type", "ts", risk_level().alias("level"), (micros("ts") > micros(F.lit(as_of)) - ref.DAY * US).alias("today")
    )
    counts = (
        rows.groupBy("event_type", "level", "today").count()
        .groupingSets([[], ["event_type"], ["level"], ["today"]], "event_type", "level", "today")
        .agg(
            F.sum("count").alias("n"), F.grouping("event_type").alias("g1"), F.grouping("level").alias("g2"), F.grouping("today").alias("g3")
        )
        .where("g3 = 1 OR today")
        .select(
            F.when(F.col("g1") == 0, "type").when(F.col("g2") == 0, "risk").when(F.col("g3") == 0, "last_24h").otherwise("total").alias("kind"),
            F.coalesce("event_type", "level").alias("value"), "n",
        )
    )
    newest = rows.orderBy(F.desc("ts"), "event_id").limit(recent)
    rank = F.row_number().over(Window.orderBy(F.desc("ts"), "event_id"))
    return counts.unionByName(newest.select(F.lit("recent").alias("kind"), F.col("event_id").alias("value"), rank.cast("bigint").alias("n")))


def daily_trend(events: DataFrame, stats: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Anomalies per day and level for the last days before ``as_of``; empty days count zero."""
    end = micros(F.lit(as_of))
    day_no = F.floor((micros("ts") - end) / (ref.DAY * US)) + days
    rows = events.where(F.col("event_type").contains("anomaly")).withColumn("day_no", day_no.cast("int")).where(F.col("day_no").between(0, days - 1))
    level = risk_level()
    counts = rows.join(stats, "event_id", "left").groupBy("day_no").agg(
        F.count("*").alias("total"), *[F.count_if(level == x).alias(f"{x}_risk") for x in ("high", "medium", "low")]
    )
    grid = events.sparkSession.range(days).select(F.col("id").cast("int").alias("day_no"))
    start = F.timestamp_micros(end + (F.col("day_no") - days) * F.lit(ref.DAY * US))
    return F.broadcast(grid).join(counts, "day_no", "left").select(
        "day_no", F.date_format(start, "MM/dd").alias("label"), *[F.coalesce(x, F.lit(0)).alias(x) for x in ("total", "high_risk", "medium_risk", "low_risk")]
    )
