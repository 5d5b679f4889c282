"""N-gram Jaccard join under several global token orders, and the classes it links.

A document's tokens are its distinct 5-word shingles. Two documents of similarity 0.8 or more must share a
token among the first few of any fixed order of all tokens. Every order used here puts rare tokens first:
a token that occurs once cannot be shared, so most documents have no token left to look up, and tokens of
passages that many documents hold come last. The orders differ in how equally frequent tokens follow each
other. Candidates share a prefix token under the first order; they are verified only if they do so under
the others too.

Documents with equal shingle sets are one node. Within the list of documents that share a prefix token,
each node is first tried against two nodes of the list only; nodes that this links need no more pairs among
each other. Pairs are made between what is left of a list, and only where parity sketches of the whole sets
allow a link, so a large group of near copies costs few pairs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BLOCK_BYTES, BY_RANGE, RANGE_BYTES, REPEATED, by_range, dealt, found_in, gathered, repeated
from .common import stored, table
from .components import components
from .words import SPACED, Words, starts, windows

SHINGLE = 5
PERCENT = 80
SKETCH_BITS = 1024
_ORDERS = (0x9FB21C651E98DF25, 0xB492B66FBE98F273, 0x9AE16A3B2F90404F)  # odd multipliers, one per order

SHAPED = (
    "doc_id long, key string, n long, node binary, tokens array<long>, first_place int, p1 array<long>, p2 array<int>, "
    "p3 array<int>, sketch array<long>"
)


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, borders): the distinct shingle hashes of each text, sorted; text i has borders[i]:borders[i + 1]."""
    words = Words(texts, SPACED, True)
    hashes, counts = words.hashes(), words.counts()
    at = starts(words.first, size)
    token, doc = windows(hashes, size)[at] if len(at) else np.zeros(0, np.uint64), words.doc()[at]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        whole = [windows(hashes[words.first[i] : words.first[i + 1]], int(counts[i]))[0] for i in short.tolist()]
        token, doc = np.concatenate([token, np.array(whole, np.uint64)]), np.concatenate([doc, short])
    order = np.lexsort((token, doc))
    token, doc = token[order], doc[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])
    token, doc = token[new], doc[new]
    return token, np.searchsorted(doc, np.arange(len(counts) + 1))


def _short(token: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """The 32 bits by which a range counts a token, and the range. Tokens that meet there count as one,
    which makes them seem more frequent and costs a look-up, never a link."""
    return token.astype("<u4"), (token >> np.uint64(32)) % np.uint64(ranges)


def _token_rows(size: int, ranges: int):
    def run(rows: pa.Table) -> pa.Table:
        token, _ = shingle_sets(rows.column("text").combine_chunks(), size)
        # three of a kind are enough to tell a token of this block from a rare one
        token, count = np.unique(token, return_counts=True)
        return by_range(rows.column("block")[0].as_py(), *_short(np.repeat(token, np.minimum(count, 3)), ranges))

    return run


def _mixed(token: np.ndarray, factor: int) -> np.ndarray:
    x = token * np.uint64(factor)
    return x ^ (x >> np.uint64(29))


def parity_sketch(token: np.ndarray) -> np.ndarray:
    """For each of 1024 places whether an odd number of tokens hash there, as 16 longs.

    Two sketches differ in at most as many places as the sets have tokens that only one of them holds.
    """
    places = np.bincount((_mixed(token, _ORDERS[0]) >> np.uint64(54)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(places.astype(np.uint8)).view(np.int64)


def _shape(size: int, percent: int, ranges: int):
    def run(rows: pa.Table, known: pa.Table) -> pa.Table:
        token, border = shingle_sets(rows.column("text").combine_chunks(), size)
        short, at = _short(token, ranges)
        keys = [np.frombuffer(x, "<u4").astype(np.uint64) | np.uint64(r) << np.uint64(32)
                for r, x in zip(known.column("range").to_pylist(), known.column("keys").to_pylist(), strict=True)]
        keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        order = np.argsort(keys)
        shared, place = found_in(keys[order], short.astype(np.uint64) | at << np.uint64(32))
        counts = gathered(known, "counts", "<u2")[order]
        often = counts[place] if len(counts) else np.zeros(len(token), np.uint16)
        out: dict[str, list] = {k: [] for k in ("node", "tokens", "first_place", "p1", "p2", "p3", "sketch")}
        n = np.diff(border)
        for i, (a, b) in enumerate(zip(border[:-1].tolist(), border[1:].tolist(), strict=True)):
            out["node"].append(hashlib.md5(token[a:b].tobytes()).digest() if b > a else None)
            own = shared[a:b]
            need = -(-percent * (b - a) // 100)  # tokens it must share with a partner
            m = int(own.sum())
            if b == a or m < need:
                for k in ("tokens", "first_place", "p1", "p2", "p3", "sketch"):
                    out[k].append(None)
                continue
            t, f = token[a:b][own], often[a:b][own]
            alone = (b - a) - m  # tokens that come before these in every order
            width = (b - a) - need + 1 - alone
            ranked = [t[np.lexsort((_mixed(t, s), f))].view(np.int64) for s in _ORDERS]
            out["tokens"].append(np.sort(t.view(np.int64)))
            out["first_place"].append(alone)
            out["sketch"].append(parity_sketch(token[a:b]))
            for k, r in zip(("p1", "p2", "p3"), ranked, strict=True):
                out[k].append(r[:width] if k == "p1" else r[:width].astype(np.int32))
        texts = rows.column("text").cast(pa.binary()).to_pylist()
        longs = pa.list_(pa.int64())
        return pa.table(
            {
                "doc_id": rows.column("doc_id"),
                "key": pa.array(["none" if x is None else hashlib.md5(x).hexdigest() for x in texts], pa.string()),
                "n": pa.array(n.astype(np.int64)),
                "node": pa.array(out["node"], pa.binary()),
                "tokens": pa.array(out["tokens"], longs),
                "first_place": pa.array(out["first_place"], pa.int32()),
                **{k: pa.array(out[k], longs) for k in ("p1", "sketch")},
                # only compared with each other: 32 bits filter as well and take half the room
                **{k: pa.array(out[k], pa.list_(pa.int32())) for k in ("p2", "p3")},
            }
        )

    return run


def shaped(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, block_bytes: int = BLOCK_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, n (tokens) and node (digest of the token set; null without tokens) of every document; for
    those that can have a partner also the tokens that occur elsewhere and the prefixes of three orders."""
    rows, ranges = dealt(docs, block_bytes, range_bytes)
    blocks = rows.groupBy("block")
    keys = blocks.applyInArrow(_token_rows(size, ranges), BY_RANGE)
    common = keys.groupBy("range").applyInArrow(repeated("<u4"), REPEATED).select("block", "range", "keys", "counts")
    return blocks.cogroup(common.groupBy("block")).applyInArrow(_shape(size, percent, ranges), SHAPED)


def _fits(n: str, m: str, percent: int) -> F.Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


_SKETCH = [f"s{i}" for i in range(SKETCH_BITS // 64)]


def _sketched() -> list[F.Column]:
    return [F.get("sketch", F.lit(i)).alias(f"s{i}") for i in range(SKETCH_BITS // 64)]


def _close(left: str, right: str, percent: int) -> F.Column:
    """The sketches do not differ in more places than linked sets can have tokens apart.

    ``left`` and ``right`` are the suffixes of the two sides' columns n and s0 to s15.
    """
    apart = sum((F.bit_count(F.col(f"s{i}{left}").bitwiseXOR(F.col(f"s{i}{right}"))) for i in range(SKETCH_BITS // 64)), F.lit(0))
    return apart * (100 + percent) <= (F.col(f"n{left}") + F.col(f"n{right}")) * (100 - percent)


def _verified(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Of ``pairs`` (a, b) those that link: they pass the other orders' filters, then the exact count."""
    slim = nodes.select("node", "n", "p2", "p3", *_sketched())
    for column in ("a", "b"):
        pairs = pairs.join(slim.select(F.col("node").alias(column), *[F.col(c).alias(f"{c}_{column}") for c in slim.columns[1:]]), column)
    near = _fits("n_a", "n_b", percent) & _close("_a", "_b", percent)
    likely = pairs.filter(near & F.arrays_overlap("p2_a", "p2_b") & F.arrays_overlap("p3_a", "p3_b"))
    # written first: where few pairs are left their size is known and the token sets need no shuffle
    likely = stored(likely.select("a", "b", "n_a", "n_b"), "likely")
    for column in ("a", "b"):
        likely = likely.join(nodes.select(F.col("node").alias(column), F.col("tokens").alias(f"t_{column}")), column)
    both = F.size(F.array_intersect("t_a", "t_b"))
    return likely.filter(both * 100 >= (F.col("n_a") + F.col("n_b") - both) * percent).select("a", "b")


def links(nodes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) between ``nodes`` (stored) that connect everything that any link connects."""
    posts = nodes.select("node", "n", "first_place", F.posexplode("p1").alias("k", "token"))
    posts = posts.select("token", "node", "n", "first_place", (F.col("first_place") + F.col("k")).alias("place"))
    # a node with few tokens of its own is close to the text that the others of a group come from
    lists = posts.groupBy("token").agg(F.min_by("node", F.struct("first_place", "node")).alias("near"), F.min("node").alias("lo"), F.max("node").alias("hi"))
    tried = posts.join(lists.filter("lo != hi"), "token").select("node", F.explode(F.array("near", "hi")).alias("centre")).filter("node != centre")
    tried = tried.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
    found = stored(_verified(tried, nodes, percent), "links-tried")
    roots = stored(components(found), "roots")
    # lists that still hold nodes of more than one component
    named = posts.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    shares = named.groupBy("token", "root").agg(F.count("*").alias("k"))
    mixed = shares.groupBy("token").agg(F.max_by("root", F.struct("k", "root")).alias("main"), F.count("*").alias("roots"))
    mixed = stored(named.join(mixed.filter("roots > 1").select("token", "main"), "token"), "mixed-lists")
    mixed = mixed.join(nodes.select("node", *_sketched()), "node")
    left = mixed.filter("root != main").select("token", *[F.col(c).alias(f"{c}_o") for c in ("node", "n", "place", "root", *_SKETCH)])
    overlap = (F.col("n") + F.col("n_o")) * percent / (100 + percent)  # tokens that a linked pair shares at least
    meets = (
        (F.col("root") != F.col("root_o"))
        & ((F.col("root") == F.col("main")) | (F.col("node") < F.col("node_o")))
        & _fits("n", "n_o", percent)
        # what two documents can share from their first common token on
        & (F.least(F.col("n") - F.col("place"), F.col("n_o") - F.col("place_o")) >= overlap)
        & _close("", "_o", percent)
    )
    more = mixed.join(left, "token").filter(meets).select(F.least("node", "node_o").alias("a"), F.greatest("node", "node_o").alias("b"))
    return found.unionByName(stored(_verified(more.distinct(), nodes, percent), "links-left"))


def members(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, **blocks: int) -> DataFrame:
    """One row per document: doc_id, key (md5 of the text), n_shingles, component_id (smallest doc_id
    reachable by links) and root, which names the component also where ids are null (null without shingles).

    Documents without words (null and empty texts too) have no shingles and are their own component; with
    fewer words than a shingle the whole sequence is the only one. Documents of equal sets are linked. Among
    null ids the component of others' smallest id counts; only null ids give a null component. Extra columns
    are ignored.
    """
    rows = stored(shaped(docs, size, percent, **blocks), "shingles")
    nodes = rows.filter(F.col("tokens").isNotNull()).drop("doc_id", "key").dropDuplicates(["node"])
    nodes = stored(nodes, "nodes")
    roots = components(links(nodes, percent))
    # copies were merged above; the smallest id of a node, then of a component
    ids = rows.filter(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("id"))
    named = ids.join(roots, "node", "left").select("node", "id", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("id").alias("component_id"))
    of_node = named.join(least, "root").select("node", "root", "component_id")
    return rows.select("doc_id", "key", "n", "node").join(of_node, "node", "left").select(
        "doc_id",
        "key",
        F.col("n").alias("n_shingles"),
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        "root",
    )


def classes(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, **blocks: int) -> DataFrame:
    return members(docs, size, percent, **blocks).select("doc_id", "n_shingles", "component_id")


def op3_ngram_jaccard(spark, sf_dir):
    return classes(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(
   translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
 s AS (SELECT DISTINCT r, doc_id, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') || '|' || least(5, len(w)) AS g
   FROM (SELECT r, doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
 n AS (SELECT r, doc_id, count(*) AS n FROM s GROUP BY r, doc_id),
 pairs AS (SELECT x.r AS a, y.r AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.r <> y.r GROUP BY x.r, y.r),
 link AS (SELECT a, b FROM pairs JOIN n na ON na.r = a JOIN n nb ON nb.r = b WHERE 100 * k >= 80 * (na.n + nb.n - k)),
 reach AS (SELECT r AS a, r AS b FROM n UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.id, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (r) LEFT JOIN (SELECT a AS r, min(n.doc_id) AS id FROM reach JOIN n ON n.r = reach.b GROUP BY a) m USING (r)
"""
