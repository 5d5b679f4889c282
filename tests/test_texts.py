"""Chunking, vectors, retrieval helpers, extraction and files."""

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from freightlens import schemas
from freightlens.functions.vectors import hashing_model
from freightlens.operators import extract, knn, questions, retrieval
from freightlens.operators.chunks import chunk_by_separators, chunk_windows, split_text
from freightlens.sources import readers, writers


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n", max_size=400))
def test_split_text_keeps_every_word(text):
    pieces = split_text(text, 50, 10)
    assert all(0 < len(p) <= 50 for p in pieces)
    assert "".join(text.split()) == "" or pieces
    # every visible character is covered, in order: overlaps only repeat
    at, flat = 0, "".join(text.split())
    for p in pieces:
        q = "".join(p.split())
        found = flat.find(q, max(0, at - 60))
        assert found >= 0 and found <= at
        at = max(at, found + len(q))
    assert at == len(flat)


def test_split_prefers_coarse_separators():
    assert split_text("aaaa bbbb\n\ncccc dddd", 10, 0) == ["aaaa bbbb", "cccc dddd"]


def test_chunk_windows_cover_the_text(spark):
    texts = [(1, "x" * 1000), (2, "y" * 1001), (3, "abc"), (4, "   "), (5, "z" * 2600)]
    rows = chunk_windows(spark.createDataFrame(texts, "doc_id int, content string")).collect()
    sizes = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["chunk_id"])):
        sizes.setdefault(r["doc_id"], []).append(len(r["content"]))
    assert sizes == {1: [1000], 2: [1000, 201], 3: [3], 5: [1000, 1000, 1000]}


def test_chunks_by_separator_run_in_tasks(spark):
    docs = spark.createDataFrame([(1, "t", "para one\n\n" + "word " * 400), (2, "t", "")], "doc_id bigint, doc_type string, content string")
    rows = chunk_by_separators(docs).collect()
    assert {r["doc_id"] for r in rows} == {1} and [r["chunk_id"] for r in rows] == [0, 1, 2]


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(3)
    docs = rng.integers(-2, 3, size=(300, 5)).astype(float)  # few values, so many ties
    qs = rng.integers(-2, 3, size=(7, 5)).astype(float)
    kinds = ["a", "b"]
    ddf = spark.createDataFrame([(kinds[i % 2], i // 3, i % 3, docs[i].tolist()) for i in range(300)], "doc_type string, doc_id bigint, chunk_id bigint, vector array<double>")
    qdf = spark.createDataFrame([(i, qs[i].tolist(), ["a"] if i % 2 else ["a", "b"]) for i in range(7)], "query_id bigint, vector array<double>, doc_types array<string>")
    want = {}
    for q in range(7):
        for kind in (["a"] if q % 2 else ["a", "b"]):
            rows = sorted((float(((docs[i] - qs[q]) ** 2).sum()), i // 3, i % 3) for i in range(300) if kinds[i % 2] == kind)
            want[(q, kind)] = [(d, c, round(x, 6)) for x, d, c in rows[:9]]
    for block in (2000, 2):
        got = {}
        for r in knn.nearest(qdf, ddf.repartition(5), 9, block).orderBy("rank").collect():
            got.setdefault((r["query_id"], r["doc_type"]), []).append((r["doc_id"], r["chunk_id"], r["distance"]))
        assert got == want


def test_hashing_model_has_length_one():
    v = hashing_model(16)(["a b b", ""])
    assert np.linalg.norm(v[0]) == pytest.approx(1) and not v[1].any()


def test_lookup_by_suffix(spark):
    rows = spark.createDataFrame([("INV-9-1", "3"), ("INV-1", "2"), ("X-INV-1", "1"), ("B7", "4")], "invoice_id string, src_row string")
    asked = spark.createDataFrame([(1, "1"), (2, "INV-1"), (3, "7"), (4, "nope"), (5, None), (6, "INV-9-1")], "query_id int, asked_id string")
    got = {r["query_id"]: r["invoice_id"] for r in retrieval.lookup_by_suffix(asked, rows, "invoice_id").collect()}
    assert got == {1: "X-INV-1", 2: "X-INV-1", 3: "B7", 4: None, 5: None, 6: "INV-9-1"}


def test_questions(spark):
    texts = ["Why is invoice #234 late?", "list shipments of SHP-2025-001", "how many?", "hello"]
    rows = spark.createDataFrame([(t,) for t in texts], "q string").select(
        questions.doc_types("q").alias("t"), questions.route("q").alias("r"), questions.intent("q").alias("i"),
        questions.is_causal("q").alias("c"), questions.entity_ids("q").alias("e"),
    ).collect()
    assert [r["t"] for r in rows] == [["invoice"], ["shipment"], ["invoice", "shipment"], ["invoice", "shipment"]]
    assert [r["r"] for r in rows] == ["invoice", "shipment", "count", None]
    assert [r["i"] for r in rows] == ["explanation", "search", "general", "general"]
    assert [r["c"] for r in rows] == [True, False, False, False]
    assert [r["e"] for r in rows] == [["234"], ["SHP-2025-001"], [], []]


def test_invoice_text(spark):
    text = "Invoice Number: INV-2025-7\nSupplier: ABC Electronics\nTotal: $1,234.50\nInvoice Date: 05/03/2025\nDue Date: 2025-04-04\n2.5% discount if paid within 10 days\nPayment within 30 days"
    r = extract.invoice_fields(spark.createDataFrame([(text,)], "t string"), "t", F.lit("f")).first()
    assert (r["invoice_id"], r["amount"], r["issue_date"], r["due_date"]) == ("INV-2025-7", 1234.5, "2025-03-05", "2025-04-04")
    assert (r["currency"], r["early_discount"], r["payment_terms"]) == ("USD", 0.025, "NET10")


def test_policy_sections_without_headers(spark):
    df = spark.createDataFrame([("no headers here",), ("# A\nx\n## A\ny\nTerms Here:\nz",)], "t string")
    got = [[(p["title"], p["body"]) for p in r["s"]] for r in df.select(extract.policy_sections("t").alias("s")).collect()]
    assert got == [[("Full Content", "no headers here")], [("A", "y"), ("Terms Here", "z")]]


def test_csv_with_other_headers_and_bad_values(spark, tmp_path):
    (tmp_path / "a.csv").write_text("invoice_id,amount,issue_date\nI1,12.5,2025-01-02\nI2,lots,never\n")
    (tmp_path / "b.csv").write_text("status,invoice_id\npaid,I3\ninvoice_id,invoice_id\n")
    (tmp_path / "c.csv").write_text("nothing,useful\n1,2\n")
    rows = {r["invoice_id"]: r for r in readers.read_csv_by_name(spark, str(tmp_path), schemas.INVOICE, "invoice_id").collect()}
    assert set(rows) == {"I1", "I2", "I3"}
    assert rows["I1"]["amount"] == 12.5 and str(rows["I1"]["issue_date"]) == "2025-01-02"
    assert rows["I2"]["amount"] is None and rows["I2"]["issue_date"] is None
    assert rows["I3"]["status"] == "paid" and rows["I3"]["supplier"] is None


def test_csv_headers_quotes_splits_and_foreign_files(spark, tmp_path):
    import gzip
    import random

    from freightlens.sources.record_csv import record_csv

    folder = tmp_path / "in"
    (folder / "deep" / "_hidden").mkdir(parents=True)
    (folder / "q.csv").write_text('\ufeffnotes,"amount, net",invoice_id\r\n"a, ""b""",1,I1\r\n\r\nmy invoice_id,2,I2\r\nshort\r\nx,3,I3,beyond\r\n')
    wide = [f"x{i}" for i in range(57)] + ["invoice_id", "notes"]
    (folder / "deep" / "w.csv").write_text(",".join(wide) + "\n" + ",".join(["0"] * 57 + ["W1", "n"]) + "\n" + ",".join(wide) + "\n")
    with gzip.open(folder / "z.csv.gz", "wt") as f:
        f.write("invoice_id,notes\nZ1,packed\n")
    (folder / "f.csv").write_text("id,notes\n1,invoice_id\n")
    (folder / "empty.csv").write_text("")
    (folder / "deep" / "_hidden" / "h.csv").write_text("invoice_id\nH1\n")
    ddl = "invoice_id string, notes string, absent date"
    rows = [tuple(r)[:3] for r in readers.read_csv_by_name(spark, str(folder), ddl, "invoice_id").collect()]
    assert sorted(rows, key=str) == sorted(
        [("I1", 'a, "b"', None), ("I2", "my invoice_id", None), (None, "short", None), ("I3", "x", None), ("W1", "n", None), ("Z1", "packed", None)], key=str
    )
    heads = {r["file"].split("/")[-1]: r["header"] for r in readers.csv_headers(spark, str(folder)).collect()}
    assert heads["q.csv"] == ["notes", "amount, net", "invoice_id"] and heads["w.csv"] == wide and set(heads) == {"q.csv", "w.csv", "z.csv.gz", "f.csv"}
    assert [r["line"] for r in readers.foreign_csv(spark, f"file:{folder}", "invoice_id").collect()] == ["id,notes", "1,invoice_id"]

    # any split size gives every line once
    rng, big = random.Random(1), tmp_path / "big.csv"
    want = [(f"B{i}", "é" * rng.randrange(9)) for i in range(300)]
    big.write_text("notes,invoice_id\n" + "".join(f"{n},{i}\n" for i, n in want))
    foreign = tmp_path / "other.csv"
    foreign.write_text("notes,id\n" + "".join(f"{n},{i}\n" for i, n in want))
    for size in (7, 64, 1000, 1 << 20):
        got = record_csv(spark, str(big), id_col="invoice_id", split_bytes=str(size)).schema("invoice_id string, notes string").load().coalesce(8).collect()
        assert sorted(map(tuple, got)) == sorted(want)
        left = record_csv(spark, str(foreign), id_col="invoice_id", mode="foreign", split_bytes=str(size)).load().coalesce(8).collect()
        assert sorted(r["line"] for r in left) == sorted(["notes,id"] + [f"{n},{i}" for i, n in want])

    lines = tmp_path / "lines.csv"
    lines.write_text('invoice_id,notes\nL1,"two\nlines"\nL2,one\n')
    got = readers.read_csv_by_name(spark, str(lines), "invoice_id string, notes string", "invoice_id", multiline=True).collect()
    assert [tuple(r)[:2] for r in got] == [("L1", "two\nlines"), ("L2", "one")]


def test_store_only_grows_by_what_is_new(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = lambda *ids: spark.createDataFrame([(i, "2024-01-01") for i in ids], "id string, day string")
    writers.append_new(rows("a", "b", "b"), path, "id", "day")
    writers.append_new(rows("b", "c"), path, "id", "day")
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == ["a", "b", "c"]


def test_changed_since(spark, tmp_path):
    import os
    import time

    (tmp_path / "old.csv").write_text("invoice_id\nA\n")
    os.utime(tmp_path / "old.csv", (time.time() - 9 * 86400,) * 2)
    (tmp_path / "new.csv").write_text("invoice_id\nB\n")
    since = time.strftime("%Y-%m-%dT%H:%M:%S", time.gmtime(time.time() - 86400))
    assert [r["invoice_id"] for r in readers.changed_since(spark, str(tmp_path), "invoice_id string", since).collect()] == ["B"]


def test_keyword_search_over_the_whole_index(spark, tmp_path):
    from freightlens.operators.inverted import add_to_index, keyword_search

    texts = ["Net30 terms apply", "the Late fee of 2%", "plate feeling", "LATE  fee", "", "x", "an invoice, late", "fee late"]
    rows = [("invoice" if i % 3 else "policy", i, 0, t) for i, t in enumerate(texts * 3)]
    chunks = spark.createDataFrame(rows, "doc_type string, doc_id bigint, chunk_id bigint, content string")
    folder = f"{tmp_path}/index"
    for part in ("doc_id < 9", "doc_id >= 9", "doc_id >= 9"):  # the last batch comes twice
        add_to_index(chunks.where(part), folder)
    terms = {1: ["late", "fee"], 2: ["Late fee"], 3: ["x", "30", "e"], 4: ["absent"], 5: [""], 6: [" fee", "te"]}
    asked = [(q, kind, ts) for q, ts in terms.items() for kind in ("invoice", "policy")]
    got = keyword_search(spark.createDataFrame(asked, "query_id bigint, doc_type string, terms array<string>"), folder, chunks, 4).collect()
    want = []
    for q, kind, ts in asked:
        scored = [(-sum(t != "" and t.lower() in c.lower() for t in ts) / len(ts), d) for k, d, _, c in rows if k == kind]
        want += [(q, kind, d, -s, n) for n, (s, d) in enumerate(sorted(x for x in scored if x[0])[:4], 1)]
    assert sorted((r["query_id"], r["doc_type"], r["doc_id"], r["keyword_score"], r["rank"]) for r in got) == sorted(want) and len(want) > 20


def test_keyword_search_in_blocks_of_questions(spark, tmp_path, monkeypatch):
    from freightlens.operators import inverted

    texts = ["alpha beta", "beta gamma", "gamma alpha beta", "delta", "alpha  beta gamma"]
    rows = [("policy", None if i == 7 else i, i % 2, texts[i % 5]) for i in range(60)]
    chunks = spark.createDataFrame(rows, "doc_type string, doc_id bigint, chunk_id bigint, content string").repartition(4)
    inverted.add_to_index(chunks, f"{tmp_path}/index")
    terms = {1: ["alpha", "ALPHA", "beta"], 2: ["beta gamma"], 3: ["delta", "gamma"], 4: ["lph", "eta", "none"], 5: [None, "beta"]}
    asked = spark.createDataFrame([(q, "policy", ts) for q, ts in terms.items()], "query_id bigint, doc_type string, terms array<string>")
    monkeypatch.setattr(inverted, "BLOCK", 2)  # several blocks, small matrices
    monkeypatch.setattr(inverted, "CELLS", 20)
    got = inverted.keyword_search(asked, f"{tmp_path}/index", chunks, 6).collect()
    want = []
    for q, ts in terms.items():
        held = [(sum(t is not None and t.lower() in c for t in ts) / len(ts), -1 if d is None else d, n) for _, d, n, c in rows]
        want += [(q, d, n, s, i) for i, (s, d, n) in enumerate(sorted((x for x in held if x[0]), key=lambda x: (-x[0], *x[1:]))[:6], 1)]
    assert sorted((r["query_id"], -1 if r["doc_id"] is None else r["doc_id"], r["chunk_id"], r["keyword_score"], r["rank"]) for r in got) == sorted(want)


def test_terms_are_found_where_segments_are_read(spark, tmp_path, monkeypatch):
    from freightlens.operators import inverted

    texts = ["alpha beta", "beta 30 gamma", None, " ", "gamma  alpha\tbetas", "delta", "Üb er ALPHA"]
    rows = [("policy", i % 17, i % 2, texts[i % 7]) for i in range(60)]  # keys come again with other texts
    chunks = spark.createDataFrame(rows, "doc_type string, doc_id bigint, chunk_id bigint, content string").coalesce(1)
    monkeypatch.setattr(inverted, "SEGMENT", 4)
    monkeypatch.setattr(inverted, "POSTINGS", 7)
    inverted.add_to_index(chunks, f"{tmp_path}/index")
    index = inverted.segments(spark, f"{tmp_path}/index")
    cut = [(len(r["doc_id"]), len(r["place"])) for r in index.collect()]
    assert len(cut) > 12 and max(n for n, _ in cut) <= 4 and max(n for _, n in cut) < 7 + 3
    terms = {1: ["beta", "a", "üb"], 2: ["beta 30"], 3: ["30", "none", "gamma  alpha"]}
    numbered = spark.createDataFrame([(t, i) for i, t in enumerate(["beta", "a", "ta", "beta"])], "look string, term_no bigint")
    found = inverted.held_terms(index, numbered)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()  # no posting is moved
    once = [(d, c, tuple(n for n, t in enumerate(["beta", "a", "ta", "beta"]) if t in x.lower())) for _, d, c, x in rows if x and x.strip()]
    assert sorted((r["doc_id"], r["chunk_id"], tuple(r["held"])) for r in found.collect()) == sorted(x for x in once if x[2])
    asked = spark.createDataFrame([(q, "policy", ts) for q, ts in terms.items()], "query_id bigint, doc_type string, terms array<string>")
    want = []
    for q, ts in terms.items():
        held = {}
        for _, d, c, x in rows:
            held.setdefault((d, c), set()).update(t for t in ts if t in (x or "").lower())
        best = sorted((-len(v) / len(ts), *key) for key, v in held.items() if v)[:5]
        want += [(q, d, c, -s, n) for n, (s, d, c) in enumerate(best, 1)]
    for block in (50_000, 2):
        monkeypatch.setattr(inverted, "TERMS", block)
        got = inverted.keyword_search(asked, f"{tmp_path}/index", chunks, 5).collect()
        assert sorted((r["query_id"], r["doc_id"], r["chunk_id"], r["keyword_score"], r["rank"]) for r in got) == sorted(want)


def test_segments_reach_python_a_few_at_a_time(spark, tmp_path, monkeypatch):
    from freightlens.operators import inverted

    rows = [("policy", None if i == 5 else i, 0, f"alpha w{i} {'beta' if i % 3 else ''}") for i in range(40)]
    chunks = spark.createDataFrame(rows, "doc_type string, doc_id bigint, chunk_id bigint, content string").coalesce(1)
    monkeypatch.setattr(inverted, "SEGMENT", 2)
    inverted.add_to_index(chunks, f"{tmp_path}/index")
    seen, search = spark.sparkContext.accumulator(0), inverted._search

    def watched(session, terms):
        run = search(session, terms)

        def counted(batches):
            def each():
                for b in batches:
                    seen.add(b.num_rows > inverted.BATCH)
                    yield b

            yield from run(each())

        return counted

    monkeypatch.setattr(inverted, "_search", watched)
    usual = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    asked = spark.createDataFrame([(1, "policy", ["alpha", "beta"]), (2, "policy", ["w7"]), (3, "policy", ["none"])], "query_id bigint, doc_type string, terms array<string>")
    for block in (1000, 1):  # one block is searched and ranked in one Python process
        monkeypatch.setattr(inverted, "BLOCK", block)
        found = inverted.keyword_search(asked, f"{tmp_path}/index", chunks, 3)
        got = sorted((r["query_id"], r["rank"], r["doc_id"], r["keyword_score"]) for r in found.collect())
        assert got == [(1, 1, None, 1.0), (1, 2, 1, 1.0), (1, 3, 2, 1.0), (2, 1, 7, 1.0)]
    assert seen.value == 0 and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == usual


def test_hashing_model_forgets_words_and_keeps_vectors(monkeypatch):
    from freightlens.functions import vectors

    texts = [" a b\tb  ", "", None, "c a d", "e f g a"]
    want = hashing_model(16)(texts)
    monkeypatch.setattr(vectors, "KNOWN", 2)
    assert (hashing_model(16)(texts) == want).all() and not want[1].any() and len(want) == 5
    many = vectors._Slots(16)
    assert [many[f"w{i}"] for i in range(9)] == [many[f"w{i}"] for i in range(9)] and len(many) <= 2


def test_segments_hold_every_word_once_per_chunk(spark, tmp_path):
    from freightlens.operators.inverted import add_to_index, segments

    texts = ["  Lead\x0bing a a\ttrail ", "", "\n \x0c", "b c  d B\rb", None, "Ärger ärger İx", "a"]
    chunks = spark.createDataFrame([("policy", i, 0, x) for i, x in enumerate(texts)], "doc_type string, doc_id bigint, chunk_id bigint, content string")
    add_to_index(chunks, f"{tmp_path}/index")
    got = {}
    for r in segments(spark, f"{tmp_path}/index").collect():
        for word, start, end in zip(r["word"], [0, *r["ends"]], r["ends"]):
            for at in r["place"][start:end]:
                got.setdefault(r["doc_id"][at], []).append(word)
    low = {r["doc_id"]: r["low"] for r in chunks.select("doc_id", F.lower("content").alias("low")).collect()}
    import re

    want = {i: sorted({w for w in re.split(r"[ \t\n\x0b\f\r]+", x or "") if w}) for i, x in low.items()}
    assert {i: sorted(ws) for i, ws in got.items()} == {i: ws for i, ws in want.items() if ws} and len(got) == 4


def test_rows_of_a_constant_partition_are_shuffled_once(spark, tmp_path):
    path = f"{tmp_path}/store"
    rows = lambda ids, day: spark.createDataFrame([(x, f"text {x}") for x in ids], "id string, text string").withColumn("day", F.lit(day).cast("date"))
    writers.append_new(rows(["a", "a", "b", None], "2024-01-01"), path, "id", "day")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = writers.new_rows(rows(["b", "c"], "2024-01-01"), path, "id", "day")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2  # the rows, and the ids that are stored
        for ids, day in ((["b", "c", "c"], "2024-01-01"), (["b"], "2024-01-02"), (["d"], None), (["c"], "2024-01-01")):
            writers.append_new(rows(ids, day), path, "id", "day")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    got = sorted((str(r["id"]), str(r["day"])) for r in spark.read.parquet(path).collect())
    assert got == [("None", "2024-01-01"), ("a", "2024-01-01"), ("b", "2024-01-01"), ("b", "2024-01-02"), ("c", "2024-01-01"), ("d", "None")]
