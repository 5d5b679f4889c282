"""The corpus pipeline: each stage against brute force on a small corpus, and the whole on the test tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline as pipeline
from freightlens.llm import decontam, lines, packing
from freightlens.llm.common import stored
from test_brute_force import DOCS, alnum, brute_components, brute_lines, corpus

SCHEMA = DOCS + ", text_key string, Score double"


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A corpus with labels and a benchmark, as a folder of tables."""
    folder, rng = tmp_path_factory.mktemp("corpus"), random.Random(9)
    rows = [(*r, "k", 0.5) for r in corpus(3, 80)]
    toxic = {i for i, *_ in rows[12:60] if i is not None and rng.random() < 0.4}
    rows = [(r[0], f"{r[1]} idiot scum", *r[2:]) if r[0] in toxic and r[1] else r for r in rows]
    labels = [(r[0], 1, int(r[0] in toxic)) for r in rows if r[0] is not None and r[0] < 75]
    items = [(1, " ".join(alnum(rows[70][1])[:12])), (2, None), (3, "idiot scum of the earth and all of its many creatures")]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, toxic, items


def test_stages(spark, small):
    folder, rows, toxic, items = small
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = stored(pipeline.drop_toxic(spark, docs, folder), "t")
    assert kept.columns == docs.columns
    data = [r for r in rows if "idiot" not in (r[1] or "")]
    assert Counter(map(tuple, kept.collect())) == Counter(data)

    kept = stored(pipeline.dedup_lines(spark, kept, folder), "l")
    want = Counter()
    for (i, n, gone, text), count in brute_lines(data).items():
        if not (gone and text == ""):
            want[i, text] += count
    assert kept.columns == docs.columns
    data = [tuple(r) for r in kept.collect()]
    assert Counter(r[:2] for r in data) == want

    kept = stored(pipeline.drop_near_copies(spark, kept, folder), "n")
    roots = defaultdict(set)
    for (i, n, root), _ in brute_components(data).items():
        roots[root if n else ("alone", i)].add(i)
    left = [tuple(r) for r in kept.collect()]
    assert set(left) <= set(data) and len(left) == len(set(r[:2] for r in left))
    assert {r[0] for r in left} >= {x for x in roots if x is not None and not isinstance(x, tuple)}
    with_words = [r for r in left if alnum(r[1])]
    assert all(x == r[0] for r in with_words for (i, n, x), _ in brute_components(left).items() if i == r[0])

    kept = stored(pipeline.drop_benchmark(spark, kept, folder), "b")
    assert kept.columns == docs.columns
    bench = spark.createDataFrame(items, "item_id long, text string")
    clean = {r["doc_id"] for r in decontam.contamination(spark.createDataFrame([r[:5] for r in left], DOCS), bench).collect() if not r["contaminated"]}
    after = {tuple(r)[:2] for r in kept.collect()}
    assert {r[:2] for r in left if r[0] in clean} <= after


def test_whole(spark, sf):
    rows = pipeline.run(spark, sf).collect()
    ids = {r["doc_id"] for r in rows}
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert ids <= set(docs) and len(ids) > len(docs) / 2
    bins = defaultdict(int)
    for r in rows:
        bins[r["sequence_id"]] += r["length"]
    assert max(bins.values()) <= 2048


def test_whole_on_nothing(spark, small, tmp_path):
    folder = small[0]
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_column_names(spark, small):
    """Names with dots and backquotes, and ``text`` in another spelling, pass every stage with the same rows."""
    folder = small[0]
    plain = spark.read.parquet(f"{folder}/documents.parquet")
    odd = plain.withColumnRenamed("text", "Text").withColumnRenamed("lang", "a.b").withColumnRenamed("source", "x`y")
    for _, stage in pipeline.STAGES[:-1]:
        plain, odd = stored(stage(spark, plain, folder), "p"), stored(stage(spark, odd, folder), "o")
        assert odd.columns == [{"text": "Text", "lang": "a.b", "source": "x`y"}.get(c, c) for c in plain.columns]
        assert Counter(map(tuple, odd.collect())) == Counter(map(tuple, plain.collect()))
