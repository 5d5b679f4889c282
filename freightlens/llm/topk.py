"""Exact top-k inner-product search by block-at-a-time pruning.

Vectors are dealt into shards and queries into batches; a cell is one shard met by one batch, of bounded
size on both sides. In a cell the vectors are ordered by their leading components and cut into blocks. A
block keeps, per component, its largest and smallest value: summed against a query these bound every score
inside. Blocks are taken by falling bound and scored through their rows (the forward index) until the next
bound lies below the query's k-th best score.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, table

BLOCK = 64  # vectors in a block
SHARD = 8_192  # vectors in a shard
BATCH = 4_096  # queries in a batch
_NONE = -np.iinfo(np.int64).max  # its negative is a number too


def whole(column: F.Column, scale: int = 256) -> F.Column:
    """floor(scale * x) of every component; null where the vector or a component is null or not finite."""
    x = column.cast("array<double>")
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(x.isNotNull() & ~odd, F.transform(x, lambda v: F.floor(v * F.lit(float(scale))).cast("long")))


def search_cell(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, block: int = BLOCK):
    """The k best of one shard for each query, as (scores, ids), unfilled places at the lowest score.

    Returns also how many blocks were scored. Sums are made in doubles where those are exact, else in
    64-bit integers with bounds widened by the rounding of doubles; a score beyond 64 bits raises an error.
    """
    exact = float(np.abs(rows).max(initial=0)) * float(np.abs(queries).max(initial=0)) * rows.shape[1] < 2**53
    kind = np.float64 if exact else np.int64
    lead = np.abs(rows).argmax(axis=1)
    sign = np.take_along_axis(rows, lead[:, None], 1)[:, 0] < 0
    order = np.lexsort((ids, sign, lead))
    ids, rows = ids[order], rows[order].astype(kind)
    queries = queries.astype(kind)
    edges = np.arange(0, len(ids), block)
    upper, lower = np.maximum.reduceat(rows, edges, axis=0), np.minimum.reduceat(rows, edges, axis=0)
    if exact:
        bound = np.maximum(queries, 0) @ upper.T + np.minimum(queries, 0) @ lower.T
    else:
        wide = queries.astype(np.float64)
        bound = np.maximum(wide, 0) @ upper.T.astype(np.float64) + np.minimum(wide, 0) @ lower.T.astype(np.float64)
        bound += np.abs(wide) @ np.maximum(np.abs(upper), np.abs(lower)).T.astype(np.float64) * rows.shape[1] * 2.0**-50 + 2048
    ranked = np.argsort(-bound, axis=1, kind="stable")
    n, blocks = bound.shape
    scores = np.full((n, k), _NONE, dtype=np.int64)
    best = np.full((n, k), np.iinfo(np.int64).max, dtype=np.int64)
    alive, at, step, scored = np.arange(n), 0, 1, 0
    while len(alive) and at < blocks:
        # each query's next blocks in its own order; those whose bound is below the k-th score end it
        for turn in range(at, min(at + step, blocks)):
            wanted = ranked[alive, turn]
            go = bound[alive, wanted] >= scores[alive, k - 1]
            alive, wanted = alive[go], wanted[go]
            scored += len(alive)
            by_block = np.argsort(wanted, kind="stable")
            which, first = np.unique(wanted[by_block], return_index=True)
            for b, members in zip(which.tolist(), np.split(by_block, first[1:]), strict=bool(len(which))):
                q = alive[members]
                a, z = edges[b], min(edges[b] + block, len(ids))
                found = (queries[q] @ rows[a:z].T).astype(np.int64)
                if not exact and np.abs(wide[q] @ rows[a:z].T.astype(np.float64)).max() >= 2.0**63 * (1 - 2.0**-40):
                    raise OverflowError("a score does not fit 64 bits")
                found[query_ids[q][:, None] == ids[a:z][None, :]] = _NONE
                better = found.max(axis=1) >= scores[q, k - 1]
                q, found = q[better], found[better]
                if not len(q):
                    continue
                both = np.concatenate([scores[q], found], axis=1)
                names = np.concatenate([best[q], np.broadcast_to(ids[a:z], found.shape)], axis=1)
                top = np.lexsort((names, -both), axis=1)[:, :k]
                scores[q], best[q] = np.take_along_axis(both, top, 1), np.take_along_axis(names, top, 1)
        at, step = at + step, step * 2
    return scores, best, scored


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def topk(vectors: DataFrame, queries: DataFrame, k: int = 5, shard: int = SHARD, batch: int = BATCH) -> DataFrame:
    """For each query the ``k`` best of ``vectors`` by inner product: query_id, rank, vec_id, score.

    Both sides have ``id`` and ``v`` (array of long) and are stored tables. A vector never answers a query of
    its own id. Components missing in the shorter of two vectors count as 0. Ties go to the smaller id; equal
    rows with one id are answers each. A score that does not fit 64 bits stops the query. Queries without candidates give no rows.
    """
    shards = max(1, -(-vectors.count() // shard))
    batches = max(1, -(-queries.count() // batch))
    docs = vectors.withColumn("shard", F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int"))
    docs = docs.withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(batches - 1))))
    asks = queries.withColumn("batch", F.pmod(F.xxhash64("id", "v"), F.lit(batches)).cast("int"))
    asks = asks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "query_row": [], "vec_id": [], "score": []}, dtype=np.int64)
        width = max(1, int(left["v"].map(len).max()), int(right["v"].map(len).max()))
        scores, best, _ = search_cell(
            left["id"].to_numpy(), _matrix(left["v"], width), right["id"].to_numpy(), _matrix(right["v"], width), k
        )
        full = scores > _NONE
        q = np.repeat(np.arange(len(right)), k).reshape(-1, k)[full]
        return pd.DataFrame(
            {"query_id": right["id"].to_numpy()[q], "query_row": right["row"].to_numpy()[q], "vec_id": best[full], "score": scores[full]}
        )

    found = docs.groupBy("shard", "batch").cogroup(asks.groupBy("shard", "batch"))
    found = found.applyInPandas(cell, "query_id long, query_row long, vec_id long, score long")
    order = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def embedding_topk(embeddings: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """The ``k`` best partners of every row whose vec_id is divisible by ``every``, among all other rows.

    Rows with a null id, a null vector, or null or non-finite components take no part. Repeated query rows
    are answered once. Extra columns are ignored.
    """
    rows = embeddings.select(F.col("vec_id").cast("long").alias("id"), whole(F.col("embedding")).alias("v"))
    rows = stored(rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull()), "vectors")
    asks = rows.filter(F.col("id") % every == 0).distinct().withColumn("row", F.xxhash64("v"))
    return topk(rows, asks, k)


def op1_topk(spark, sf_dir):
    return embedding_topk(table(spark, sf_dir, "embeddings"))


OP1_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS c FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 scored AS (SELECT q.vec_id AS query_id, d.vec_id,
   CAST(list_sum(list_transform(list_zip(q.c, d.c), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored)
SELECT query_id, CAST(r AS INT) AS rank, vec_id, score FROM ranked WHERE r <= 5
"""
