"""Exact nearest neighbours of many queries: every task keeps the k best of its rows per query and
group, and one small ranked merge follows. Query vectors travel in blocks of bounded size."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DIGITS = 6  # distances are compared at this many places, then by document key
BLOCK = 2000  # query vectors per broadcast
CELLS = 1_000_000  # of a matrix of rows by query vectors


def smallest(keys: np.ndarray, dist: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k smallest by (distance, keys), ties included before the cut."""
    if len(dist) > k:
        edge = np.partition(dist, k - 1)[k - 1]
        near = np.flatnonzero(dist <= edge)
    else:
        near = np.arange(len(dist))
    order = np.lexsort((keys[near, 1], keys[near, 0], dist[near]))
    return near[order[:k]]


def _block(docs: DataFrame, rows: list, k: int) -> DataFrame:
    ids = [r["query_id"] for r in rows]
    matrix = np.array([r["vector"] for r in rows], dtype=np.float64)
    wanted: dict[str, np.ndarray] = {}
    for kind in {t for r in rows for t in r["doc_types"]}:
        wanted[kind] = np.array([i for i, r in enumerate(rows) if kind in r["doc_types"]])
    shared = docs.sparkSession.sparkContext.broadcast((ids, matrix, wanted))

    def scan(batches):
        names, q, kinds = shared.value
        q_sq = (q * q).sum(axis=1)
        kept: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}
        for pdf in batches:
            for kind, part in pdf.groupby("doc_type", sort=False):
                if kind not in kinds:
                    continue
                use = kinds[kind]
                step = max(1, CELLS // len(use))
                for start in range(0, len(part), step):
                    rows_of = part.iloc[start : start + step]
                    v = np.array(rows_of["vector"].tolist(), dtype=np.float64)
                    keys = rows_of[["doc_id", "chunk_id"]].to_numpy(dtype=np.int64)
                    dist = (v * v).sum(axis=1)[:, None] + q_sq[use][None, :] - 2.0 * (v @ q[use].T)
                    dist = np.round(np.maximum(dist, 0.0), DIGITS)
                    for col, i in enumerate(use):
                        old = kept.get((kind, i))
                        d, ks = dist[:, col], keys
                        if old is not None:
                            d, ks = np.concatenate([old[1], d]), np.concatenate([old[0], ks])
                        at = smallest(ks, d, k)
                        kept[(kind, i)] = (ks[at], d[at])
        for (kind, i), (ks, d) in kept.items():
            yield pd.DataFrame(
                {"query_id": names[i], "doc_type": kind, "doc_id": ks[:, 0], "chunk_id": ks[:, 1], "distance": d}
            )

    id_type = "string" if isinstance(ids[0], str) else "bigint"
    return docs.select("doc_type", "doc_id", "chunk_id", "vector").mapInPandas(
        scan, f"query_id {id_type}, doc_type string, doc_id bigint, chunk_id bigint, distance double"
    )


def nearest(queries: DataFrame, docs: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """k nearest docs (squared distance) per query and wanted document type.

    queries: query_id, vector, doc_types; docs: doc_type, doc_id, chunk_id, vector.
    """
    blocks = -(-queries.count() // block)
    slot = F.pmod(F.xxhash64("query_id"), F.lit(max(blocks, 1)))
    out = None
    for b in range(blocks):
        rows = queries.where(slot == b).select("query_id", "vector", "doc_types").collect()
        if rows:
            part = _block(docs, rows, k)
            out = part if out is None else out.unionByName(part)
    if out is None:
        kind = dict(queries.dtypes)["query_id"]
        out = queries.sparkSession.createDataFrame([], f"query_id {kind}, doc_type string, doc_id bigint, chunk_id bigint, distance double")
    w = Window.partitionBy("query_id", "doc_type").orderBy("distance", "doc_id", "chunk_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def centroids(vectors: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """Mean vector per label, scaled to length one; sums are made per position before the shuffle."""
    parts = vectors.select(label, F.posexplode(vector).alias("pos", "x")).groupBy(label, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    mean = parts.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p.x).alias("m"))
    norm = F.sqrt(F.aggregate("m", F.lit(0.0), lambda a, x: a + x * x))
    return mean.select(label, F.transform("m", lambda x: x / norm).alias("vector"))
