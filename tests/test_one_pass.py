"""Work done once: questions, texts and files are read once, counts and pairs match plain Python."""

import random
from datetime import date
from types import SimpleNamespace

from pyspark.sql import functions as F

from freightlens import refdata as ref
from freightlens.functions.sizing import spread
from freightlens.operators import causal, filters, render, retrieval, summaries
from freightlens.plans.search import split_check
from freightlens.plans.store import spread_store, store
from freightlens.sources import readers, writers
from freightlens.streaming import feeds
from test_events import EVENT, log


def counted(spark, rows, schema):
    """The rows, and a counter of how often one of them was made."""
    seen = spark.sparkContext.accumulator(0)

    def note(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    return spark.createDataFrame(rows, schema).mapInPandas(note, schema), seen


def test_lookup_reads_the_questions_once_and_matches_every_ending(spark):
    rnd = random.Random(3)
    ids = ["".join(rnd.choice("aB1-9ß") for _ in range(rnd.randrange(7))) for _ in range(300)] + [None, "", "INV-1-2", "INV-12"]
    asked = ["".join(rnd.choice("aB1-9ß") for _ in range(rnd.randrange(5))) for _ in range(150)] + [None, "", "INV-12", "2"]
    want = {}
    for q, a in enumerate(asked):
        fits = [(f"{i:04d}", x) for i, x in enumerate(ids) if a and x is not None and x.endswith(a)]
        want[str(q)] = min(fits) if fits else (None, None)
    rows = spark.createDataFrame([(x, f"{i:04d}") for i, x in enumerate(ids)], "invoice_id string, src_row string")
    questions, seen = counted(spark, [(str(q), a) for q, a in enumerate(asked)], "query_id string, asked_id string")
    got = {r["query_id"]: (r["src_row"], r["invoice_id"]) for r in retrieval.lookup_by_suffix(questions, rows, "invoice_id").collect()}
    assert got == want
    assert seen.value == len(asked)


def test_answers_read_the_questions_once(spark):
    asked = [("a", "Show invoice #7"), ("b", "where is shipment SHP-1-2"), ("c", "how many invoices"), ("d", "any anomaly")]
    questions, seen = counted(spark, asked, "query_id string, question string")
    records = spark.createDataFrame([("INV-1-7", "SHP-1-2", "1")], "invoice_id string, shipment_id string, src_row string")
    facts = spark.createDataFrame([(r, 1, 2, 3, 4) for r in ("invoice", "shipment", "anomaly", "count")], "route string, total long, part_1 long, part_2 long, part_3 long")
    route = F.element_at(F.create_map(*[F.lit(x) for x in ("a", "invoice", "b", "shipment", "c", "count", "d", "anomaly")]), F.col("query_id"))
    got = {r["query_id"]: (r["kind"], r["record_id"]) for r in retrieval.answers(questions, route, records, records, facts).collect()}
    assert got == {"a": ("record", "INV-1-7"), "b": ("record", "SHP-1-2"), "c": ("invoices", None), "d": ("overview", None)}
    assert seen.value == len(asked)


def test_recent_match_merges_questions_before_pairing(spark):
    texts = [("a", "high risk driver"), ("a", "invoice of the driver"), ("b", "route"), (None, "payment"), (None, "payment"), ("c", "hello"), ("d", None)]
    questions = spark.createDataFrame(texts, "query_id string, question string")
    updates = spark.createDataFrame([("u1", "driver risk", 5), ("u2", "invoice anomaly", 4), ("u2", "shipment", 3), (None, "driver", 2)], "update_id string, content string, ts long")
    alerts = spark.createDataFrame([("x", 1), ("x", 2)], "alert_id string, ts long")
    rows = retrieval.recent_match(questions, updates, alerts)
    want = {("a", "update", "u1"), ("a", "update", None), ("a", "update", "u2"), ("a", "alert", "x"), ("b", "update", "u2"), (None, "update", "u2")}
    assert sorted(map(repr, map(tuple, rows.collect()))) == sorted(map(repr, want))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Aggregate [query_id" in line and "item_id" in line for line in plan.split("\n"))


def test_link_counts_are_those_of_all_links(spark):
    rows = [(*e[:2], None if i % 9 == 0 else e[2], *e[3:]) for i, e in enumerate(log(11, n=200))]
    rows += rows[:20]  # repeated events count as often as they come
    events = spark.createDataFrame(rows, EVENT)
    table = causal.link_rules(spark)
    for side in ("effect", "cause"):
        cols = ["event_id", "cause_type", "effect_type", "links"]
        whole = causal.linked(events, table, side).select(*cols).groupBy(*cols[:3]).agg(F.sum("links").alias("links"))
        assert whole.count() > 50
        assert sorted(map(tuple, causal.link_counts(events, table, side).collect())) == sorted(map(tuple, whole.collect()))


def test_stats_move_no_descriptions(spark):
    events = spark.createDataFrame(log(2, n=20), EVENT)
    plan = causal.link_stats(events, causal.link_rules(spark, ref.CAUSAL_RULES))._jdf.queryExecution().optimizedPlan().toString()
    assert "struct(event_id" not in plan


def test_words_are_split_off_before_they_become_rows(spark):
    pieces = spark.createDataFrame([(1, "a", "One two. Two"), (1, "a", "three"), (2, "b", " . "), (3, None, "x")], "doc_id long, doc_type string, content string")
    rows = split_check(pieces, "content")
    got = {(r["doc_id"], r["words"], r["bounded"]) for r in rows.collect()}
    assert got == {(1, 3, True), (3, 1, True)}
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("length(content")  # parents stand first


def test_files_lie_in_few_folders(spark, tmp_path):
    texts = [("a.md", "x"), ("b/c", "é\nz"), ("a.md", "y"), ("n", None)]
    rows = spark.createDataFrame(texts, "name string, text string")
    writers.one_file_each(rows, str(tmp_path / "utf8"), "name", "text")
    writers.one_file_each(rows, f"file:{tmp_path}/latin", "name", "text", "iso-8859-1")
    for folder in ("utf8", "latin"):
        back = readers.read_text_any_encoding(spark, str(tmp_path / folder)).collect()
        assert sorted(r["content"] for r in back) == sorted(f"{t or ''}\n" for _, t in texts)
    assert all(p.parent.parent == tmp_path / "utf8" for p in (tmp_path / "utf8").rglob("*~*"))
    assert len(list((tmp_path / "utf8").rglob("a.md~*"))) == 2
    writers.one_file_each(rows, str(tmp_path / "one"), "name", "text", together=True)
    assert sorted(p.read_text() for p in (tmp_path / "one").rglob("a.md~*")) in (["x\ny\n"], ["y\nx\n"])


def test_key_terms_search_a_question_once_for_all_types(spark):
    texts = ['Late fee 30 of "the late" route', "", None, "one two three four five six", 'no "" 7', "invoice  PAYMENT invoice"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "query_id long, question string").coalesce(1)
    parts = spread(rows, "query_id").select("query_id", "question", retrieval.term_parts("question").alias("parts"))
    assert parts.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    kinds = F.explode(F.array(*[F.lit(x) for x in ("invoice", "shipment", "policy")])).alias("doc_type")
    kind = F.col("doc_type")
    found = parts.select("query_id", "question", kinds, "parts").select("query_id", "doc_type", retrieval.key_terms("question", kind, F.col("parts")).alias("terms"))
    alone = rows.select("query_id", "question", kinds).select("query_id", "doc_type", retrieval.key_terms("question", kind).alias("terms"))
    got = {(r["query_id"], r["doc_type"]): r["terms"] for r in found.collect()}
    assert got == {(r["query_id"], r["doc_type"]): r["terms"] for r in alone.collect()}
    assert got[0, "policy"] == ["late", "fee", "30", "of", '"the', 'late"', "route", "the late"] and got[2, "policy"] is None
    assert got[3, "invoice"] == ["one", "two", "three", "four", "five"] and got[4, "shipment"] == ["7", ""]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 2  # numbers and phrases, below the rows per type
    assert plan.index("Generate") < plan.index("regexp_extract_all(")


def invoices_of(spark, n):
    rows = [
        (f"{i:03d}", f"INV-{i}", None if i % 11 == 0 else f"s{i % 3}", 400.0 * i, "EUR" if i % 4 else None, date(2024, 1, 1 + i % 28),
         None if i % 13 == 0 else date(2024, 2, 1 + i % 28), "NET30", ["CFO", "clerk", None][i % 3], "overdue" if i % 5 == 0 else "paid")
        for i in range(n)
    ]
    cols = "src_row string, invoice_id string, supplier string, amount double, currency string, issue_date date, due_date date, payment_terms string, approver string, status string"
    return spark.createDataFrame(rows, cols).coalesce(1)


def test_rules_of_a_whole_sort_run_in_many_tasks(spark):
    terms = spark.createDataFrame([(f"s{i}", "NET30", 0.0, "low") for i in range(3)], "supplier string, agreed_terms string, agreed_discount double, supplier_risk string")
    source = SimpleNamespace(invoices=invoices_of(spark, 60), supplier_terms=terms)
    rows = spread_store(source)
    assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    want = [tuple(r) for r in store(source).collect()]
    assert want and sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in rows.collect())
    got = [(-r["risk_score"], -r["ts"].timestamp(), r["id"]) for r in summaries.riskiest(rows).collect()]
    assert got == sorted(got) and len(got) == len(want)


def test_high_risk_updates_are_chosen_without_making_every_map(spark):
    ships = [("S1", "a", "b", "c", "Delayed", 0.71, "none"), ("S2", "a", "b", "c", "x", 0.7, "none"), ("S3", "a", "b", "c", "x", None, "late"), ("S4", None, "b", "c", "x", None, None)]
    ships = spark.createDataFrame(ships, "shipment_id string, origin string, destination string, carrier string, status string, risk_score double, anomaly_type string")
    rows = render.unify(render.invoice_updates(invoices_of(spark, 40)), render.shipment_updates(ships)).where(filters.is_high_risk_update())
    got = sorted(r["content"].split()[1] for r in rows.select("content").collect())
    assert got == sorted([f"INV-{i}" for i in range(40) if 400 * i > 10000 or i % 5 == 0] + ["S1", "S3"])
    assert [r["m"] for r in rows.where("metadata['shipment_id'] = 'S1'").select(F.col("metadata")["risk_score"].alias("m")).collect()] == ["0.71"]
    plan = rows.select("content")._jdf.queryExecution().optimizedPlan().toString()
    assert "map(" not in plan


def test_text_files_are_compressed_and_small(spark, tmp_path):
    rows = spark.createDataFrame([(str(i), f'a, "{i}"' if i % 2 else None) for i in range(7)], "id string, text string").coalesce(1)
    writers.packed_csv(rows, str(tmp_path / "in"), rows_per_file=3)
    assert len(list((tmp_path / "in").glob("*.csv.gz"))) == 3
    stream = feeds.csv_stream(spark, str(tmp_path / "in"), "id string, text string")
    feeds.finish(feeds.append_to(stream, str(tmp_path / "out"), str(tmp_path / "kept"), "json", compression="gzip"))
    assert list((tmp_path / "out").glob("*.json.gz")) and not list((tmp_path / "out").glob("*.json"))
    back = spark.read.schema("id string, text string").json(str(tmp_path / "out"))
    assert sorted(map(repr, map(tuple, back.collect()))) == sorted(map(repr, map(tuple, spark.read.option("header", True).csv(str(tmp_path / "in")).collect())))
    assert back.count() == 7


def test_detect_all_joins_the_records_once(spark, sf):
    from freightlens.plans import records
    from freightlens.plans.catalog import Source

    found = records.all_anomalies(Source(spark, sf))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan  # invoices and shipments are read as they were written
    kept = records.Kept(spark, sf)
    for name in ("invoices", "shipments", "named_shipments"):
        assert getattr(kept, name) is getattr(kept, name)
        want = getattr(Source(spark, sf), name)
        assert getattr(kept, name).dtypes == want.dtypes and getattr(kept, name).exceptAll(want).isEmpty() and want.exceptAll(getattr(kept, name)).isEmpty()
