"""Streams over more than one batch."""

import datetime as dt

import random

from freightlens.operators import causal
from freightlens.streaming import feeds, risk_store

ROW = "invoice_id string, issued timestamp"


def test_once_per_key_keeps_old_dates(spark, tmp_path):
    day = lambda n: dt.datetime(2024, 6, 1) + dt.timedelta(days=n)
    folder, out = f"{tmp_path}/in", f"{tmp_path}/out"
    batches = [
        [("a", day(0)), ("b", day(300)), ("a", day(0))],
        # dates overlap those of the first batch; "c", "d" and the null id are new and far behind its newest
        [("c", day(-200)), ("b", day(300)), (None, day(5)), ("d", day(290)), ("d", day(290))],
        [("c", day(-200)), (None, day(5)), ("e", day(-900)), ("a", day(900))],
    ]
    for rows in batches:
        spark.createDataFrame(rows, ROW).coalesce(1).write.mode("append").parquet(folder)
        stream = feeds.table_stream(spark, folder)
        feeds.finish(feeds.once_per_key(stream, "invoice_id", out, f"{out}-checkpoint"))
    got = [r["invoice_id"] for r in spark.read.parquet(out).collect()]
    assert sorted(x or "" for x in got) == ["", "a", "b", "c", "d", "e"]


def test_causal_join_over_batches_of_any_entity(spark, tmp_path):
    at = lambda hours: dt.datetime(2024, 6, 1) + dt.timedelta(hours=hours)
    folder, out = f"{tmp_path}/in", f"{tmp_path}/out"
    schema = "event_id string, event_type string, entity_id string, ts timestamp"
    batches = [
        [("c1", "driver_risk_increase", "x", at(0)), ("c2", "driver_risk_update", "y", at(40)), ("e0", "shipment_delay", "x", at(-1))],
        # dates overlap those of the first batch; each run starts anew from the checkpoint
        [("e1", "shipment_delay", "y", at(41)), ("e2", "shipment_delay", "z", at(30)), ("c3", "driver_risk_increase", "z", at(29.5))],
        [("e3", "shipment_delay", None, at(88)), ("e4", "shipment_delay", "x", at(48.5))],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        joined = feeds.causal_join(feeds.table_stream(spark, folder), "driver_risk_increase", "shipment_delay", 48 * 3600, 0.75, 0.15)
        feeds.finish(feeds.append_to(joined.select("cause_id", "effect_id", "confidence"), out, f"{out}-checkpoint"))
    got = sorted(tuple(r) for r in spark.read.parquet(out).collect())
    every, want = [r for b in batches for r in b], []
    for c in every:
        for e in every:
            gap = (e[3] - c[3]).total_seconds() / 3600
            if c[1].startswith("driver") and e[1] == "shipment_delay" and 0 <= gap <= 48:
                points = 65 + (30 if gap <= 1 else 20 if gap <= 24 else 10) + (20 if c[2] == e[2] else 0)
                want.append((c[0], e[0], min(points, 100) / 100))
    assert got == sorted(want) and len(want) == 8


def test_event_risk_store_over_late_and_repeated_batches(spark, tmp_path):
    rnd = random.Random(8)
    kinds = ["driver_risk_increase", "driver_risk_update", "shipment_delay", "weather_event", "shipment_anomaly", "invoice_delay"]
    start, schema = dt.datetime(2024, 3, 1), "event_id string, event_type string, entity_id string, entity_type string, description string, ts timestamp"
    events = [(f"e{i}", rnd.choice(kinds), rnd.choice(["x", "y", "z", None]), "shipment", "", start + dt.timedelta(hours=rnd.random() * 900)) for i in range(200)]
    batches = [events[:80], events[80:90] + events[:5] + events[80:82], events[90:]]  # some events come twice
    path = f"{tmp_path}/risk"
    for number, rows in enumerate(batches):
        df = spark.createDataFrame([*rows, ("no time", "weather_event", "x", "shipment", "", None)], schema)
        risk_store.add_batch(df, number, path)
        if number == 1:
            risk_store.add_batch(df, number, path)  # tried again
    whole = spark.createDataFrame(events, schema)
    as_rows = lambda df: {r["event_id"]: (r["links"], r["near_driver_risk"]) for r in df.collect()}
    want = as_rows(causal.link_stats(whole, causal.link_rules(spark)))
    assert as_rows(risk_store.stats(spark, path)) == want and len(want) > 100
    got = {r["event_id"]: r["level"] for r in risk_store.levels(spark, path).collect()}
    assert set(got) == {e[0] for e in events} and set(got.values()) == {"high", "medium"}


def test_csv_files_of_any_header_arrive_once(spark, tmp_path):
    folder, out = tmp_path / "in", f"{tmp_path}/out"
    folder.mkdir()
    run = lambda: feeds.finish(feeds.records_by_name(spark, str(folder), "invoice_id string, amount double", "invoice_id", out, f"{out}-c", f"{out}-r", files=2))
    (folder / "a.csv").write_text("invoice_id,amount\nA1,1\nA2,x\n")
    (folder / "b b.csv").write_text('amount,"invoice_id"\n2.5,B1\n')
    (folder / "c.csv").write_text("other\n1\n")
    (folder / "d.csv").write_text("")
    run()
    (folder / "e.csv").write_text("amount,more,invoice_id\n7,x,A1\n")
    run()
    run()
    got = sorted((r["invoice_id"], r["amount"] or 0) for r in spark.read.parquet(out).collect())
    assert got == [("A1", 1.0), ("A1", 7.0), ("A2", 0), ("B1", 2.5)]
    assert sorted(r["line"] for r in spark.read.parquet(f"{out}-r").collect()) == ["1", "other"]
