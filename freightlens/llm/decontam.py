"""Benchmark decontamination by a broadcast set of normalised n-grams.

The benchmark's n-grams are hashed on the driver, in parts of a bounded number of bytes, and each part is
broadcast; documents are scanned once per part (a benchmark of ordinary size is one part). Hits are verified
against the n-gram's words, so a hash collision changes nothing.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import plain, quoted, spelled, table, unused
from .words import ALNUM, Words, slices, starts, windows

SIZE = 10
PART_BYTES = 16 << 20  # benchmark text that one broadcast covers
FILTER_BITS = 20


def grams(items: list[tuple[str, str]], size: int) -> tuple[dict, dict]:
    """The windows of some benchmark items: per window length the sorted hashes and a bitmap of their
    leading bits; per length and hash the words behind it and the names of the items that hold them."""
    behind: dict[tuple[int, int], dict[bytes, set[str]]] = {}
    found: dict[int, set[int]] = defaultdict(set)
    words = Words(pa.array([t for _, t in items], pa.string()), ALNUM, True)
    hashes = words.hashes()
    for i, (name, _) in enumerate(items):
        a, b = int(words.first[i]), int(words.first[i + 1])
        n = min(size, b - a)
        if n == 0:
            continue
        for k, h in enumerate(windows(hashes[a:b], n).tolist()):
            found[n].add(h)
            behind.setdefault((n, h), {}).setdefault(words.text(a + k, a + k + n), set()).add(name)
    by_length = {}
    for n, values in found.items():
        ordered = np.array(sorted(values), dtype=np.uint64)
        seen = np.zeros(1 << FILTER_BITS, bool)
        seen[ordered >> np.uint64(64 - FILTER_BITS)] = True
        by_length[n] = (ordered, seen)
    return by_length, behind


def occurrences(words: Words, hashes: np.ndarray, by_length: dict, behind: dict):
    """(word position, length, item names) of every verified occurrence."""
    for n, (ordered, seen) in by_length.items():
        at = starts(words.first, n)
        if not len(at):
            continue
        h = windows(hashes, n)[at]
        maybe = np.flatnonzero(seen[h >> np.uint64(64 - FILTER_BITS)])
        place = np.minimum(np.searchsorted(ordered, h[maybe]), len(ordered) - 1)
        maybe = maybe[ordered[place] == h[maybe]]
        for i, value in zip(at[maybe].tolist(), h[maybe].tolist(), strict=True):
            names = behind[(n, value)].get(words.text(i, i + n))
            if names:
                yield i, n, names


def benchmark_parts(benchmark: DataFrame, part_bytes: int = PART_BYTES) -> Iterator[list[tuple[str, str]]]:
    """The items with words, as (item_id as text, text), in parts of about ``part_bytes`` of text.

    The table is fetched part by part; what is on the driver at once is one part, or one item.
    """
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    rows = rows.filter(F.col("text").isNotNull())
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // part_bytes))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)))
    for p in range(parts):
        yield [(r["item_id"] or "", r["text"]) for r in dealt.filter(F.col("part") == p).collect()]


HITS = T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", size: int = SIZE, part_bytes: int = PART_BYTES) -> DataFrame:
    """``docs`` with n_words, ``spans`` (hit word ranges, merged, end excluded), the same ranges in bytes
    (``cuts``), and ``items`` (names of items that occur, sorted as strings).

    All columns of ``docs`` are kept; the added ones are named so by ``unused``, in this order, at the end.
    """
    spark, text = docs.sparkSession, spelled(docs, text)
    added: list[str] = []
    for name in ("n_words", "spans", "cuts", "items"):
        added.append(unused(docs.select("*", *[F.lit(None).alias(a) for a in added]), name))
    rows = plain(docs)
    schema = T.StructType(
        [
            *rows.schema.fields,
            T.StructField(added[0], T.LongType()),
            T.StructField(added[1], HITS),
            T.StructField(added[2], HITS),
            T.StructField(added[3], T.ArrayType(T.StringType())),
        ]
    )
    sent = [spark.sparkContext.broadcast(grams(p, size)) for p in benchmark_parts(benchmark, part_bytes)]
    spans_type = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                words = Words(part.column(text), ALNUM, True)
                spans: dict[int, list] = defaultdict(list)
                names: dict[int, set] = defaultdict(set)
                hashes = words.hashes()
                for known in sent:
                    found = list(occurrences(words, hashes, *known.value))
                    where = np.searchsorted(words.first, [i for i, _, _ in found], "right") - 1
                    for d, (i, n, who) in zip(where.tolist(), found, strict=True):
                        spans[d].append((i, i + n))
                        names[d] |= who
                merged, cuts = [], []
                for d in range(part.num_rows):
                    own: list[list[int]] = []
                    for a, b in sorted(spans.get(d, ())):
                        if own and a <= own[-1][1]:
                            own[-1][1] = max(own[-1][1], b)
                        else:
                            own.append([a, b])
                    first, byte = int(words.first[d]), int(words.offsets[d])
                    merged.append([{"a": a - first, "b": b - first} for a, b in own])
                    cuts.append([{"a": int(words.start[a]) - byte, "b": int(words.end[b - 1]) - byte} for a, b in own])
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns,
                        pa.array(words.counts().astype(np.int64)),
                        pa.array(merged, spans_type),
                        pa.array(cuts, spans_type),
                        pa.array([sorted(names.get(d, ())) for d in range(part.num_rows)], pa.list_(pa.string())),
                    ],
                    [*part.schema.names, *added],
                )

    return rows.mapInArrow(run, schema).toDF(*docs.columns, *added)


def decontaminate(docs: DataFrame, benchmark: DataFrame, drop_share: float = 0.5, size: int = SIZE) -> DataFrame:
    """``docs`` without benchmark passages, same columns.

    Hit words are cut from the text; a document of which at least ``drop_share`` of the words are hit is
    dropped. Texts without a hit stay byte for byte, also null and empty ones.
    """
    found = scan(docs, benchmark, "text", size)
    n_words, spans, cuts, _ = found.columns[-4:]
    hit = F.aggregate(spans, F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"])
    kept = found.filter((F.size(spans) == 0) | (hit < F.col(n_words) * drop_share))
    raw = F.encode("text", "UTF-8")
    # what lies between the cuts: from the end of one to the start of the next
    froms = F.concat(F.array(F.lit(0).cast("long")), F.transform(cuts, lambda x: x["b"]))
    tos = F.concat(F.transform(cuts, lambda x: x["a"]), F.array(F.octet_length("text").cast("long")))
    left = F.transform(F.arrays_zip(froms.alias("f"), tos.alias("t")), lambda x: F.decode(F.substring(raw, (x["f"] + 1).cast("int"), (x["t"] - x["f"]).cast("int")), "UTF-8"))
    text = F.when(F.size(cuts) == 0, F.col("text")).otherwise(F.array_join(left, ""))
    return kept.withColumn(spelled(docs, "text"), text).select(*quoted(docs))


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """One row per document: words, hit words, number and digest of the items that occur in it.

    Null and empty texts have no words and no hits; an item without words occurs nowhere; items of fewer
    words than ``size`` are one window. Repeated documents are judged each; items with one id count once.
    A null item id is written as the empty string. Extra columns are ignored; an empty benchmark hits nothing.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = scan(narrow, benchmark, "text", size)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def op9_decontamination(spark, sf_dir):
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_NORMAL = "translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _NORMAL + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP9_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS.format(t='text')}, []) AS w FROM documents),
 b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format(t='text')} AS w FROM benchmark WHERE text IS NOT NULL),
 item_windows AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
 sizes AS (SELECT DISTINCT n FROM item_windows),
 doc_windows AS (
  SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
 hits AS (SELECT r, i, x.n, item FROM doc_windows x JOIN item_windows y ON x.n = y.n AND x.g = y.g),
 covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
 named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
 CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""
