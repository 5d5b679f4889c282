"""Line dedup by content-defined chunks of lines.

A rolling hash over the hashes of a line and the one before it marks cut candidates; a candidate right
after another one does not cut. So a cut depends on three lines only, a passage is chunked alike wherever
it stands, and every chunk of a text of two lines or more has at least two lines. A chunk that occurs more
than once keeps its first place and is removed from the others, after its bytes were compared with those
of the first place.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, table
from .words import slices

MODULUS = 2  # one in so many lines is a cut candidate
FACTOR = 31


def chunks(text: str | None) -> list[list[str]]:
    """The lines of a text in chunks; joined by line feeds they are the text. A null text has none."""
    if text is None:
        return []
    lines = text.split("\n")
    hashes = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    candidate = [i > 0 and (hashes[i] * FACTOR + hashes[i - 1]) % MODULUS == 0 for i in range(len(lines))]
    out, start = [], 0
    for i in range(1, len(lines) - 2):  # neither the first nor the last chunk may be one line
        if candidate[i] and not candidate[i - 1]:
            out.append(lines[start : i + 1])
            start = i + 1
    return [*out, lines[start:]]


def _per_batch(row_function, names: list[str], kinds: list[pa.DataType]):
    """A mapInArrow function that makes rows of each input row, in slices of bounded text."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                columns = [part.column(i).to_pylist() for i in range(part.num_columns)]
                rows = [made for row in zip(*columns, strict=True) for made in row_function(*row)]
                flipped = list(zip(*rows, strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(flipped, kinds, strict=True)], names)

    return run


def _places(doc_id, key, text):
    for k, lines in enumerate(chunks(text)):
        if len(lines) > 1:
            yield hashlib.md5("\n".join(lines).encode()).digest(), doc_id, key, k


def _originals(text, asked):
    parts = chunks(text)
    for one in asked:
        yield one["hash"], "\n".join(parts[one["k"]])


def _left(doc_id, key, text, doomed):
    """What stays: a chunk goes where its place is listed and its bytes are those of the first place."""
    first = {one["k"]: one["original"] for one in doomed or ()}
    parts = chunks(text)
    kept = [x for k, x in enumerate(parts) if k not in first or "\n".join(x) != first[k]]
    n, n_kept = sum(map(len, parts)), sum(map(len, kept))
    yield doc_id, key, n, n - n_kept, text if n == n_kept else "\n".join(y for x in kept for y in x)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, key (md5 of the text), n_lines, n_removed and the text that is left.

    The first place of a chunk is the one with the smallest doc_id (null ids first), then text key, then
    position. Rows alike in id and text are one place and share one result. Null and empty texts come back
    as they are, with 0 and 1 lines; texts of one line never change. A text that loses all its chunks
    becomes empty. Extra columns are ignored.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.md5(F.col("text").cast("string")), F.lit("none")).alias("key"),
        F.col("text").cast("string").alias("text"),
    )
    found = rows.mapInArrow(
        _per_batch(_places, ["hash", "doc_id", "key", "k"], [pa.binary(), pa.int64(), pa.string(), pa.int32()]),
        "hash binary, doc_id long, key string, k int",
    )
    places = stored(found.select("hash", F.struct("doc_id", "key", "k").alias("at")), "line-chunks")
    # partial minima come first, so a chunk found in every document is a row per task here
    firsts = places.groupBy("hash").agg(F.min("at").alias("first"), F.count("*").alias("n")).filter(F.col("n") > 1)
    firsts = stored(firsts.select("hash", "first"), "line-firsts")
    # a hot chunk has many places; Spark splits its side of the join
    later = places.join(firsts, "hash").filter(~F.col("at").eqNullSafe(F.col("first")))

    def same(a: str, b: str) -> F.Column:
        return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.key") == F.col(f"{b}.key"))

    # the bytes at the first place of every repeated chunk
    asked = firsts.groupBy(F.col("first.doc_id").alias("doc_id"), F.col("first.key").alias("key")).agg(
        F.collect_list(F.struct(F.col("first.k").alias("k"), "hash")).alias("asked")
    )
    source = rows.alias("d").join(asked.alias("q"), same("d", "q")).select("d.text", "q.asked")
    originals = source.mapInArrow(_per_batch(_originals, ["hash", "original"], [pa.binary(), pa.string()]), "hash binary, original string")
    originals = originals.dropDuplicates(["hash"])  # repeated rows give a chunk more than once
    doomed = (
        later.join(originals, "hash")
        .groupBy(F.col("at.doc_id").alias("doc_id"), F.col("at.key").alias("key"))
        .agg(F.collect_list(F.struct(F.col("at.k").alias("k"), "original")).alias("doomed"))
    )
    joined = rows.alias("d").join(doomed.alias("r"), same("d", "r"), "left").select("d.doc_id", "d.key", "d.text", "r.doomed")
    names = ["doc_id", "key", "n_lines", "n_removed", "text"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    return joined.mapInArrow(_per_batch(_left, names, kinds), "doc_id long, key string, n_lines long, n_removed long, text string")


def _pairs(text: str | None):
    """(place, digest) of every two lines in a row; two blank lines are no passage."""
    lines = [] if text is None else text.split("\n")
    for i in range(len(lines) - 1):
        pair = f"{lines[i]}\n{lines[i + 1]}"
        if pair.strip():
            yield i, hashlib.blake2b(pair.encode(), digest_size=16).digest()


def _pair_places(doc_id, key, text):
    for i, digest in _pairs(text):
        yield digest, doc_id, key, i


def _outside(doc_id, key, text, doomed):
    """What stays of a text whose pairs at the places ``doomed`` stand earlier."""
    lines = [] if text is None else text.split("\n")
    gone = {j for i in doomed or () for j in (i, i + 1)}
    yield doc_id, key, len(lines), len(gone), "\n".join(x for j, x in enumerate(lines) if j not in gone) if gone else text


def dedup_passages(docs: DataFrame) -> DataFrame:
    """Like ``dedup_lines``, but every passage of two or more lines that stands at an earlier place goes whole.

    Every two lines in a row are looked up, so a passage is found wherever it starts and ends and whatever
    stands around it. The earliest place of a line never goes: were it part of a repeated pair, that pair
    would hold the line at an earlier place still. Pairs are equal by 128 bits of blake2b.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.md5(F.col("text").cast("string")), F.lit("none")).alias("key"),
        F.col("text").cast("string").alias("text"),
    )
    found = rows.mapInArrow(
        _per_batch(_pair_places, ["hash", "doc_id", "key", "k"], [pa.binary(), pa.int64(), pa.string(), pa.int32()]),
        "hash binary, doc_id long, key string, k int",
    )
    places = stored(found.select("hash", F.struct("doc_id", "key", "k").alias("at")), "line-pairs")
    firsts = places.groupBy("hash").agg(F.min("at").alias("first"), F.count("*").alias("n")).filter(F.col("n") > 1)
    firsts = stored(firsts.select("hash", "first"), "pair-firsts")
    later = places.join(firsts, "hash").filter(~F.col("at").eqNullSafe(F.col("first")))
    # repeated rows give a place more than once
    doomed = later.groupBy(F.col("at.doc_id").alias("doc_id"), F.col("at.key").alias("key")).agg(F.collect_set("at.k").alias("doomed"))
    same = F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("d.key") == F.col("r.key"))
    joined = rows.alias("d").join(doomed.alias("r"), same, "left").select("d.doc_id", "d.key", "d.text", "r.doomed")
    names = ["doc_id", "key", "n_lines", "n_removed", "text"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    return joined.mapInArrow(_per_batch(_outside, names, kinds), "doc_id long, key string, n_lines long, n_removed long, text string")


def op10_line_dedup_whole(spark, sf_dir):
    return dedup_passages(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op10_line_dedup(spark, sf_dir):
    found = dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", "text")


OP10_SQL = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
 lines AS (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM d),
 hashed AS (SELECT doc_id, len(l) AS n, i, l[i] AS line, CAST('0x' || substr(md5(l[i]), 1, 8) AS BIGINT) AS h FROM lines),
 candidate AS (SELECT *, i >= 2 AND (h * 31 + coalesce(lag(h) OVER w, 0)) % 2 = 0 AS c FROM hashed WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
 cut AS (SELECT *, CASE WHEN i = 1 OR (i >= 3 AND i <= n - 1 AND lag(c, 1, false) OVER w AND NOT lag(c, 2, false) OVER w)
   THEN 1 ELSE 0 END AS s FROM candidate WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
 placed AS (SELECT *, sum(s) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k FROM cut),
 chunks AS (SELECT doc_id, k, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS chunk FROM placed GROUP BY doc_id, k),
 ranked AS (SELECT *, n > 1 AND row_number() OVER (PARTITION BY chunk, n > 1 ORDER BY doc_id, k) > 1 AS gone FROM chunks),
 kept AS (SELECT doc_id, sum(n) AS n_lines, coalesce(sum(n) FILTER (gone), 0) AS n_removed,
   coalesce(string_agg(chunk, chr(10) ORDER BY k) FILTER (NOT gone), '') AS kept FROM ranked GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
 CASE WHEN d.text IS NULL THEN NULL ELSE kept END AS text
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
