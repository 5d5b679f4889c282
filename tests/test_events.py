"""Causal operators against plain Python over small logs."""

import datetime as dt
import random

from pyspark.sql import functions as F

from freightlens import refdata as ref
from freightlens.operators import causal, summaries, time_chains
from freightlens.operators.intervals import count_near, micros

START = dt.datetime(2024, 1, 1)
KINDS = ["driver_risk_update", "driver_risk_increase", "shipment_delay", "weather_event", "shipment_anomaly", "package_missing", "invoice_dispute", "payment_policy_change", "invoice_delay"]
EVENT = "event_id string, event_type string, entity_id string, entity_type string, description string, ts timestamp, risk_score double"


def log(seed, n=150, entities=4, hours=240):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        at = START + dt.timedelta(seconds=rnd.randrange(hours * 3600))
        out.append((f"e{i:03d}", rnd.choice(KINDS), f"x{rnd.randrange(entities)}", "shipment", f"d{i}", at, rnd.randrange(101) / 100))
    return out


def kind(e):
    return "driver_risk_increase" if e[1] == "driver_risk_update" else e[1]


def brute_links(events, same_only):
    boost = {(c, e): b for c, e, b in ref.PAIR_BOOST}
    out = {}
    for c in events:
        for e in events:
            gap = (e[5] - c[5]).total_seconds()
            if c[0] == e[0] or gap < 0 or (same_only and c[2] != e[2]):
                continue
            near = 30 if gap <= 3600 else 20 if gap <= 86400 else 10 if gap <= 3 * 86400 else 0
            points = min(100, 50 + near + (20 if c[2] == e[2] else 0) + round(100 * boost.get((kind(c), kind(e)), 0)))
            for cause, effect, window, threshold in ref.CAUSAL_RULES:
                if (cause, effect) == (kind(c), kind(e)) and gap <= window and points >= round(threshold * 100):
                    out[(c[0], e[0])] = points / 100
    return out


def test_links_against_brute_force(spark):
    events = log(1)
    df = spark.createDataFrame(events, EVENT)
    for scope in ("same", "any"):
        rows = causal.causal_links(df, causal.link_rules(spark), scope).collect()
        got = {(r["cause_id"], r["effect_id"]): r["confidence"] for r in rows}
        assert len(got) == len(rows)
        assert got == brute_links(events, scope == "same")


def brute_chains(links):
    causes, effects = {c for c, _ in links}, {e for _, e in links}
    out = set()
    for root in causes - effects:
        seen, front, depth = {root}, {root}, 0
        while front:
            depth += 1
            nxt = {}
            for c, e in links:
                if c in front and e not in seen:
                    nxt[e] = min(nxt.get(e, c), c)
            out |= {(root, e, p, depth) for e, p in nxt.items()}
            seen |= set(nxt)
            front = set(nxt)
    return out


def test_chains_with_cycles_and_bounds(spark):
    rnd = random.Random(3)
    pairs = {(f"n{rnd.randrange(25):02d}", f"n{rnd.randrange(25):02d}") for _ in range(45)}
    pairs = {(a, b) for a, b in pairs if a != b} | {("r0", "n00"), ("r1", "n07")}
    df = spark.createDataFrame([(a, b, 0.7) for a, b in pairs], "cause_id string, effect_id string, confidence double")
    want = brute_chains(pairs)
    got = {(r["root_id"], r["event_id"], r["parent_id"], r["depth"]) for r in causal.chains(df, None).collect()}
    assert got == want and max(d for *_, d in want) > 2
    bounded = {(r["root_id"], r["event_id"], r["parent_id"], r["depth"]) for r in causal.chains(df, 2).collect()}
    assert bounded == {w for w in want if w[3] <= 2}


def chain_rows(df):
    return {(r["root_id"], r["event_id"], r["parent_id"], r["depth"]): r["confidence"] for r in df.collect()}


def test_chains_from_times_against_brute_force(spark):
    longer = [*ref.CAUSAL_RULES, ("shipment_delay", "shipment_anomaly", 86400, 0.7), ("payment_policy_change", "driver_risk_increase", 43200, 0.7)]
    events = [(*e[:2], None if i % 17 == 0 else e[2], *e[3:]) for i, e in enumerate(log(21, n=250, hours=400))]
    events += [(f"t{i}", k, "x1", "shipment", "tie", START, 0.5) for i, k in enumerate(KINDS)]  # all at one moment
    df = spark.createDataFrame(events, EVENT)
    links = causal.causal_links(df, causal.link_rules(spark, longer))
    power = {(r["cause_id"], r["effect_id"]): r["confidence"] for r in links.collect()}
    got = chain_rows(time_chains.chains(df, longer))
    assert set(got) == brute_chains(set(power)) and max(d for *_, d in got) == 3
    assert all(power[(p, e)] == c for (_, e, p, _), c in got.items())
    assert {c for c, _ in power} == {r[0] for r in time_chains.causing(df, longer).collect()}


def test_chains_from_times_with_a_cycle_and_without_events(spark):
    # two types that cause each other, within an hour: rounds end when one adds nothing
    rules = [("a", "b", 3600, 0.7), ("b", "a", 3600, 0.7)]
    events = [(f"e{i}", "ab"[i % 2], f"x{i % 3}", "k", "", START + dt.timedelta(minutes=40 * i), 0.0) for i in range(7)]
    df = spark.createDataFrame(events, EVENT)
    links = causal.causal_links(df, causal.link_rules(spark, rules))
    want = brute_chains({(r["cause_id"], r["effect_id"]) for r in links.collect()})
    assert set(chain_rows(time_chains.chains(df, rules))) == want and max(d for *_, d in want) == 6
    assert time_chains.chains(df.limit(0), rules).count() == 0


def test_longest_path():
    assert causal.longest_path([("a", "b"), ("b", "c"), ("a", "c")]) == 2
    assert causal.longest_path([("a", "b"), ("b", "a")]) is None
    assert causal.longest_path(ref.CAUSAL_RULES) == 2


def test_scenario_of_policy_driver_shipment_invoice(spark):
    at = lambda h: START + dt.timedelta(hours=h)
    events = [
        ("p", "payment_policy_change", "POL", "policy", "payout v2 to v3", at(0), 0.0),
        ("d", "driver_risk_update", "DRV", "driver", "Low to High", at(1), 0.9),
        ("s", "shipment_delay", "SHP", "shipment", "delayed", at(1.5), 0.5),
        ("i", "invoice_delay", "INV", "invoice", "late", at(2), 0.5),
    ]
    links = causal.causal_links(spark.createDataFrame(events, EVENT), causal.link_rules(spark), "any")
    got = {(r["cause_id"], r["effect_id"]): r["confidence"] for r in links.collect()}
    # the policy change reaches the invoice by 0.5 + 0.2 + 0.2, the driver reaches both others within the hour
    assert got == {("p", "i"): 0.9, ("d", "s"): 0.95, ("d", "i"): 0.8}
    holds = {(r["entity_id"], r["risk_score"]) for r in causal.holds_from_links(links, "2024-02-01").collect()}
    assert holds == {("SHP", 0.95), ("INV", 0.9)}


def test_potential_causes_against_brute_force(spark):
    events = log(5, n=200, entities=6, hours=100)
    edges = [("x0", "x1", "k"), ("x1", "x0", "k_reverse"), ("x2", "x3", "k"), ("x3", "x2", "k_reverse")]
    df = spark.createDataFrame(events, EVENT)
    ed = spark.createDataFrame(edges, "source string, target string, relationship_type string")
    rows = causal.potential_causes(df, ed).collect()
    got = {(r["anomaly_id"], r["cause_id"]): round(r["causal_strength"], 6) for r in rows}
    assert len(got) == len(rows)
    near = {(a, b) for a, b, _ in edges}
    window, want = 3 * 86400, {}
    for entity in {e[2] for e in events}:
        mine = [e for e in events if e[2] == entity and "anomaly" in e[1]]
        if not mine:
            continue
        last = sorted(mine, key=lambda e: (-e[5].timestamp(), e[0]))[0]
        for c in events:
            gap = (last[5] - c[5]).total_seconds()
            if gap < 0 or gap > window or (c[2] == entity and c[1] == "shipment_anomaly"):
                continue
            related = (entity, c[2]) in near
            if related or kind(c) in ("weather_event", "driver_risk_increase", "route_change"):
                strength = (1 - gap / window + (1.0 if related else 0.5)) / 2
                if strength >= 0.7:
                    want[(last[0], c[0])] = round(strength, 6)
    assert got == want


def test_count_near_against_brute_force(spark):
    events = log(9, n=400, hours=900)
    df = spark.createDataFrame(events, EVENT).withColumn("event_us", micros("ts"))
    rnd = random.Random(2)
    points = [START + dt.timedelta(seconds=rnd.randrange(-50 * 3600, 950 * 3600)) for _ in range(40)]
    pf = spark.createDataFrame([(i, p) for i, p in enumerate(points)], "id int, at timestamp").withColumn("point_us", micros("at"))
    got = {r["id"]: r["near"] for r in count_near(pf, df, 5 * 3600).collect()}
    want = {i: sum(abs((e[5] - p).total_seconds()) <= 5 * 3600 for e in events) for i, p in enumerate(points)}
    assert got == want


def test_holds_keep_their_latest_status(spark):
    holds = spark.createDataFrame([("h1", "pending_approval", None, None), ("h2", "pending_approval", None, None)], "hold_id string, status string, updated_at timestamp, approved_by string")
    changes = spark.createDataFrame(
        [("h1", "active", "ann", START), ("h1", "released", None, START + dt.timedelta(1)), ("zz", "active", "bob", START)],
        "hold_id string, status string, approver string, changed_at timestamp",
    )
    got = {r["hold_id"]: (r["status"], r["approved_by"]) for r in causal.update_holds(holds, changes).collect()}
    assert got == {"h1": ("released", "ann"), "h2": ("pending_approval", None)}


def test_events_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame(log(4), EVENT)
    rules = causal.link_rules(spark)
    one = causal.causal_links(df.repartition(1), rules).select("cause_id", "effect_id", "confidence")
    many = causal.causal_links(df.repartition(13), rules).select("cause_id", "effect_id", "confidence")
    assert one.exceptAll(many).count() == 0 and many.exceptAll(one).count() == 0
    trend = [causal.daily_trend(d, causal.link_stats(df, rules), "2024-01-08").collect() for d in (df.repartition(1), df.repartition(7))]
    assert trend[0] == trend[1] and len(trend[0]) == 7


def test_links_without_pairs_match_all_pairs(spark):
    df = spark.createDataFrame(log(11), EVENT)
    rules = causal.link_rules(spark)
    best, totals = {}, {}
    for r in causal.causal_links(df, rules, "any").collect():
        key = (r["effect_id"], r["cause_type"])
        totals[key] = totals.get(key, 0) + 1
        best[key] = max(best.get(key, (-1, 0, "")), (r["confidence"], -r["gap_us"], r["cause_id"]))
    got = {(r["effect_id"], r["cause_type"]): r for r in causal.strongest_links(df, rules).collect()}
    assert {k: (r["confidence"], -r["gap_us"], r["cause_id"]) for k, r in got.items()} == best
    assert {k: r["causes"] for k, r in got.items()} == totals
    ends = {}
    for r in causal.causal_links(df, rules, "any").collect():
        for x in (r["cause_id"], r["effect_id"]):
            ends[x] = ends.get(x, 0) + 1
    assert {r["event_id"]: r["links"] for r in causal.link_stats(df, rules).collect()} == ends
    links = causal.causal_links(df, rules, "any")
    assert {r[0] for r in causal.root_events(df, rules).collect()} == {r[0] for r in causal.roots(links).collect()}


def test_nearest_causes_and_counts_equal_all_pairs(spark):
    from collections import Counter

    from freightlens.operators.nearest_causes import count_causes, nearest_causes

    rng = random.Random(4)
    types = ["shipment_delay", "driver_risk_increase", "weather_event", "route_change", "policy_update", "invoice_anomaly", "shipment_anomaly", "other"]
    start = dt.datetime(2024, 3, 1)
    rows = []
    for i in range(900):
        # half of the log is one burst, with events at the same moment; a third belongs to one entity
        hours = rng.choice([rng.randrange(0, 400), 200 + rng.randrange(0, 3) / 60])
        entity = rng.choice(["hub", f"e{rng.randrange(25)}", f"e{rng.randrange(25)}"]) if rng.random() > 0.03 else None
        rows.append((f"v{i:03d}", rng.choice(types), entity, start + dt.timedelta(hours=hours), rng.choice(["delay", "payment", "value"])))
    events = spark.createDataFrame(rows, "event_id string, event_type string, entity_id string, ts timestamp, anomaly_type string")
    links = [(a, b) for a in range(25) for b in range(25) if rng.random() < 0.1]
    edges = spark.createDataFrame([(f"e{a}", f"e{b}") for a, b in links] + [("e1", "hub"), ("hub", "e2")], "source string, target string")
    every = causal.potential_causes(events, edges)
    for k in (1, 3, 7):
        want = causal.top_causes(every, k).collect()
        got = nearest_causes(events, edges, k).select(*every.columns, "rank").collect()
        assert Counter(map(tuple, got)) == Counter(map(tuple, want)) and len(want) > 20
    counts = {r["entity_id"]: r["causes"] for r in count_causes(events, edges).collect() if r["causes"]}
    assert counts == {r["entity_id"]: r["count"] for r in every.groupBy("entity_id").count().collect()}
    assert nearest_causes(events.limit(0), edges).count() == 0 and count_causes(events.limit(0), edges).count() == 0


def test_counted_links_match_all_pairs(spark):
    events = [(*e[:2], None if i % 13 == 0 else e[2], "driver" if i % 3 else None, *e[4:]) for i, e in enumerate(log(41, n=220, hours=300))]
    events += [(f"t{i}", k, "x1", "shipment", "tie", START, 0.5) for i, k in enumerate(KINDS)] + events[:30] + [(None, *e[1:]) for e in events[30:40]]
    events += [(e[0], e[1], "x2", "shipment", e[4], e[5] + dt.timedelta(hours=2), e[6]) for e in events[50:60]]  # ids of two events
    df = spark.createDataFrame(events, EVENT)
    cols = ["cause_type", "effect_type", "effect_entity_type", "confidence"]
    once = df.where("substring(event_id, 2, 3) NOT BETWEEN '050' AND '059'")
    table = causal.link_rules(spark)
    want = {tuple(r) for r in causal.causal_links(once, table).groupBy(*cols).count().collect()}
    assert {tuple(r) for r in causal.count_links(once, table).select(*cols, "n").collect()} == want and len(want) > 10

    now = "2024-02-01"
    listed = causal.holds_from_links(causal.hold_links(df), now)
    classes = causal.holds_from_links(causal.hold_link_counts(df), now, keep=("n",)).cache()
    assert classes.count() < listed.count() / 2
    changed = lambda h: h.select(
        "hold_id", F.when(F.col("risk_score") >= 1, "resolved").when(F.col("entity_type") == "driver", "active").otherwise("pending_review").alias("status"),
        F.lit("a").alias("approver"), F.timestamp_seconds(F.when(F.col("risk_score") >= 1, 2).otherwise(1)).alias("changed_at"),
    )
    want = summaries.hold_summary(causal.update_holds(listed, changed(listed))).first()
    got = summaries.hold_summary(causal.update_holds(classes, changed(classes)), weight="n").first()
    assert got == want and min(want) > 0
    assert summaries.hold_summary(classes.limit(0), weight="n").first() == summaries.hold_summary(listed.limit(0)).first()


def test_latest_leaves_match_listed_chains(spark, monkeypatch):
    longer = [*ref.CAUSAL_RULES, ("shipment_delay", "shipment_anomaly", 86400, 0.7), ("payment_policy_change", "driver_risk_increase", 43200, 0.7)]
    cycle = [("a", "b", 3600, 0.7), ("b", "a", 3600, 0.7)]
    rare = [(*e[:2], None if i % 17 == 0 else e[2], *e[3:]) for i, e in enumerate(log(51, n=250, hours=700))]
    rare += [(f"t{i}", k, "x1", "shipment", "tie", START, 0.5) for i, k in enumerate(KINDS)] + rare[:20] + [(None, *rare[30][1:])]
    ring = [(f"e{i}", "ab"[i % 2], f"x{i % 3}", "k", "", START + dt.timedelta(minutes=40 * i), 0.0) for i in range(7)]
    for rules, events in ((longer, rare), (cycle, ring)):
        df = spark.createDataFrame(events, EVENT)
        leaves = time_chains.leaves(time_chains.chains(df, rules), df, rules)
        want = {tuple(r) for r in causal.final_effect(leaves, df).select("root_id", "final_id").collect()}
        with monkeypatch.context() as m:
            m.setattr(time_chains, "chains", None)  # the members are not listed
            got = [tuple(r) for r in time_chains.latest_leaves(df, rules).collect()]
        assert set(got) == want and len(got) == len(want) > 0
    assert time_chains.latest_leaves(df.limit(0), rules).count() == 0


def test_cause_risks_match_all_pairs(spark):
    from freightlens.operators.nearest_causes import cause_risks

    kinds = [*KINDS, "invoice_anomaly", "invoice_delay_anomaly", "route_change", "policy_update", "payment_anomaly_invoice"]
    rnd = random.Random(61)
    events = [(*e[:1], rnd.choice(kinds), None if i % 19 == 0 else e[2], *e[3:]) for i, e in enumerate(log(61, n=260, entities=25, hours=300))]
    events = [(None if i % 23 == 0 else e[0], *e[1:6], None if i % 11 == 0 else e[6]) for i, e in enumerate(events)] + events[:15]
    df = spark.createDataFrame(events, EVENT)
    edges = causal.with_reverse(spark.createDataFrame([(f"x{i}", f"x{i + 1}", "r") for i in range(0, 25, 3)], "source string, target string, relationship_type string"))
    listed = causal.risks_of_causes(df, causal.potential_causes(df, edges)).where("entity_id IS NOT NULL")
    want = {(r["entity_id"], r["driver_risk"]) for r in listed.collect()}
    got = cause_risks(df, edges).where("entity_id IS NOT NULL").collect()
    assert {(r["entity_id"], r["driver_risk"]) for r in got} == want and len(got) == len(want) > 5
    assert any(r is not None for _, r in want)


def test_roots_and_causes_move_ids_only(spark):
    rows = [(f"e{i % 90}", ["driver_risk_increase", "shipment_delay", "weather_event", "shipment_anomaly"][i * 7 % 4], f"x{i % 5}" if i % 6 else None, "shipment", "note", i * 3 % 50 * 7200) for i in range(100)]
    events = spark.createDataFrame([(*r[:5], r[5]) for r in rows] + [(None, "weather_event", "x1", "shipment", "note", 0)], "event_id string, event_type string, entity_id string, entity_type string, description string, s bigint")
    events = events.withColumn("ts", F.timestamp_seconds("s")).drop("s")
    table = causal.link_rules(spark, ref.CAUSAL_RULES)
    ids = lambda found: sorted(r["event_id"] for r in found.select("event_id").distinct().collect())
    causes, effects = (ids(causal.linked(events, table, side)) for side in ("cause", "effect"))
    found = [time_chains.causing(events, ref.CAUSAL_RULES), causal.root_events(events, table)]
    assert [ids(x) for x in found] == [causes, [x for x in causes if x not in effects]] and len(causes) > 20 and ids(found[1])
    known = spark.createDataFrame([(x,) for x in causes], "event_id string")
    assert ids(causal.root_events(events, table, known)) == ids(found[1])
    lines = [line for x in found for line in x._jdf.queryExecution().optimizedPlan().toString().splitlines()]
    assert not any("description" in line for line in lines if "LogicalRDD" not in line and "LocalRelation" not in line)
