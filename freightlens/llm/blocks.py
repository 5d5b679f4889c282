"""Counting hashes over a whole corpus without a row per hash.

Documents are dealt into blocks of a few megabytes of text. A block sends its hashes as one array per range
of the hash space; a range meets all blocks' arrays, finds the hashes that occur more than once and sends
each block those it holds. Rows are arrays, so a corpus of n hashes moves n numbers and few rows, a hash
that every document holds is one number per block, and both sides of each step are bounded in size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 3 << 19  # text of a block
RANGE_BYTES = 12 << 20  # text whose hashes a range holds, on average


def dealt(docs: DataFrame, block_bytes: int = BLOCK_BYTES, range_bytes: int = RANGE_BYTES) -> tuple[DataFrame, int]:
    """(rows, ranges): doc_id, text and block of every document, and the number of ranges to use.

    The block follows from id and text, so every later step deals the same way, also after a retry.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, ranges = max(1, -(-total // block_bytes)), max(1, -(-total // range_bytes))
    return rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("long")), ranges


def by_range(block: int, keys: np.ndarray, ranges: np.ndarray) -> pa.Table:
    """The block's keys as one binary per range."""
    order = np.argsort(ranges, kind="stable")
    which, first = np.unique(ranges[order], return_index=True)
    parts = np.split(keys[order], first[1:]) if len(which) else []
    return pa.table(
        {
            "range": pa.array(which.astype(np.int64)),
            "block": pa.array(np.full(len(which), block, np.int64)),
            "keys": pa.array([p.tobytes() for p in parts], pa.binary()),
        }
    )


BY_RANGE = "range long, block long, keys binary"
REPEATED = "range long, block long, keys binary, counts binary, refs binary"


def repeated(kind: str):
    """For ``applyInArrow`` over a range: the keys that occur at least twice, back to the blocks they are in.

    With each key come its number of occurrences (at most 65535) and the smallest block that holds it.
    """

    def run(rows: pa.Table) -> pa.Table:
        at = rows.column("range")[0].as_py()
        parts = [np.frombuffer(x, kind) for x in rows.column("keys").to_pylist()]
        keys = np.concatenate(parts)
        blocks = np.repeat(rows.column("block").to_numpy(), [len(p) for p in parts])
        order = np.lexsort((blocks, keys)) if len(parts) > 1 else np.argsort(keys, kind="stable")
        keys, blocks = keys[order], blocks[order]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        start = np.flatnonzero(new)
        count = np.diff(np.append(start, len(keys)))
        many = np.repeat(count > 1, count)
        ref, count = np.repeat(blocks[start], count)[many], np.repeat(np.minimum(count, 65535), count)[many]
        keys, blocks = keys[many], blocks[many]
        order = np.argsort(blocks, kind="stable")
        keys, blocks, count, ref = keys[order], blocks[order], count[order].astype("<u2"), ref[order]
        once = np.ones(len(keys), bool)
        once[1:] = (keys[1:] != keys[:-1]) | (blocks[1:] != blocks[:-1])
        keys, blocks, count, ref = keys[once], blocks[once], count[once], ref[once]
        which, first = np.unique(blocks, return_index=True)
        cut = lambda x: [p.tobytes() for p in np.split(x, first[1:])] if len(which) else []
        return pa.table(
            {
                "range": pa.array(np.full(len(which), at, np.int64)),
                "block": pa.array(which.astype(np.int64)),
                "keys": pa.array(cut(keys), pa.binary()),
                "counts": pa.array(cut(count), pa.binary()),
                "refs": pa.array(cut(ref.astype("<i8")), pa.binary()),
            }
        )

    return run


def gathered(rows: pa.Table, column: str, kind: str) -> np.ndarray:
    parts = [np.frombuffer(x, kind) for x in rows.column(column).to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def found_in(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is each key there, its place)."""
    if not len(sorted_keys):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    place = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return sorted_keys[place] == keys, place
