"""Substring dedup by counting window hashes over the corpus.

Documents are dealt into blocks. The index holds anchors: the smallest hash of 8 words within each window of
35 words, a place that equal windows share wherever they stand. Only windows whose anchor occurs twice can be
repeated; these are looked up in full. The words of all windows that occur twice are the duplicate spans.
This count stands in for a Lempel-Ziv parse: no words are matched against the text of a reference block. A
factor is a run of neighbouring repeated windows whose smallest block number is the same; its words need
not stand together anywhere in that block.

Windows are compared by 64 bits of one hash and, through the range they are dealt to, by bits of a second
one whose number grows with the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BLOCK_BYTES, BY_RANGE, RANGE_BYTES, REPEATED, by_range, dealt, found_in, gathered, repeated
from .common import table
from .words import SPACED, Words, starts, windows

WINDOW = 35
GRAM = 8
_SECOND = 0xC2B2AE3D27D4EB4F  # base of the second window hash, an odd number

PARSED = "doc_id long, n_words long, factors array<struct<start:long,length:long,block:long>>, kept string"


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest value of every ``width`` consecutive ones, by doubling."""
    have, out = 1, values
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def _released(made: pa.Table) -> pa.Table:
    """Gives back what Arrow keeps of a finished block, since a task works through many."""
    pa.default_memory_pool().release_unused()
    return made


class Block:
    """Words and window hashes of one block. ``at`` are the starts of the windows that lie in one text."""

    def __init__(self, texts: pa.ChunkedArray, window: int, gram: int):
        self.words = Words(texts.combine_chunks(), SPACED, False)
        self.hashes = self.words.hashes()
        self.at = starts(self.words.first, window)
        grams = windows(self.hashes, gram)
        self.anchors = _least(grams, window - gram + 1)[self.at] if len(self.at) else np.zeros(0, np.uint64)
        self.grams, self.window = grams, window

    def own_anchors(self) -> np.ndarray:
        """Every anchor once, or twice if its words stand at two places of the block."""
        if not len(self.at):
            return np.zeros(0, np.uint64)
        values, counts = np.unique(self.grams, return_counts=True)
        change = np.ones(len(self.anchors), bool)
        change[1:] = self.anchors[1:] != self.anchors[:-1]
        own = np.unique(self.anchors[change])
        return np.repeat(own, np.minimum(counts[np.searchsorted(values, own)], 2))

    def windows_of(self, anchors: np.ndarray) -> np.ndarray:
        """Starts of the windows whose anchor is among the given sorted ones."""
        return self.at[found_in(anchors, self.anchors)[0]]


def _anchor_rows(window: int, gram: int, ranges: int):
    def run(rows: pa.Table) -> pa.Table:
        own = Block(rows.column("text"), window, gram).own_anchors()
        return _released(by_range(rows.column("block")[0].as_py(), own, (own >> np.uint64(20)) % np.uint64(ranges)))

    return run


def _window_rows(window: int, gram: int, ranges: int):
    def run(rows: pa.Table, known: pa.Table) -> pa.Table:
        if not rows.num_rows or not known.num_rows:
            return by_range(0, np.zeros(0, np.uint64), np.zeros(0, np.uint64))
        block = Block(rows.column("text"), window, gram)
        at = block.windows_of(np.sort(gathered(known, "keys", "<u8")))
        keys = windows(block.hashes, window)[at]
        second = windows(block.hashes, window, _SECOND)[at]
        return _released(by_range(rows.column("block")[0].as_py(), keys, second % np.uint64(ranges)))

    return run


def kept_texts(words: Words, keep: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    start, end = words.start[keep], words.end[keep]
    length = end - start + 1  # with a space behind each
    at = np.cumsum(length) - length
    out = np.full(int(length.sum()), 0x20, np.uint8)
    for a in range(0, len(at), 100_000):  # in parts, which bounds the index arrays
        b = min(a + 100_000, len(at))
        first, last = int(at[a]), int(at[b - 1] + length[b - 1])
        place = np.repeat(start[a:b] - at[a:b], length[a:b]) + np.arange(first, last)
        inside = np.ones(last - first, bool)
        inside[at[a:b] + length[a:b] - 1 - first] = False
        out[first:last][inside] = words.bytes[place[inside]]
    n = np.concatenate([[0], np.cumsum(keep)])[words.first]  # kept words before each text
    ends = np.append(at, len(out))[n]
    texts = [out[a : max(a, b - 1)].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    return pa.array(texts, pa.binary()).cast(pa.string())


def _parse(window: int, gram: int):
    def run(rows: pa.Table, known: pa.Table) -> pa.Table:
        words = Words(rows.column("text").combine_chunks(), SPACED, False)
        n = rows.num_rows
        factors: list[list[dict]] = [[] for _ in range(n)]
        keep = np.ones(len(words), bool)
        if n and known.num_rows:
            at = starts(words.first, window)
            hashes = windows(words.hashes(), window)[at] if len(at) else np.zeros(0, np.uint64)
            keys, refs = gathered(known, "keys", "<u8"), gathered(known, "refs", "<i8")
            order = np.argsort(keys)
            hit, place = found_in(keys[order], hashes)
            at, ref = at[hit], refs[order][place[hit]]
            doc = np.searchsorted(words.first, at, "right") - 1
            begin = np.ones(len(at), bool)
            begin[1:] = (at[1:] != at[:-1] + 1) | (ref[1:] != ref[:-1]) | (doc[1:] != doc[:-1])
            first = np.flatnonzero(begin)
            last = np.append(first[1:], len(at)) - 1
            edge = np.zeros(len(words) + 1, np.int64)
            for d, a, b, r in zip(doc[first].tolist(), at[first].tolist(), at[last].tolist() if len(first) else [], ref[first].tolist(), strict=True):
                factors[d].append({"start": a - int(words.first[d]), "length": b - a + window, "block": r})
                edge[a] += 1
                edge[b + window] -= 1
            keep = np.cumsum(edge[:-1]) == 0
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("block", pa.int64())]))
        made = {
            "doc_id": rows.column("doc_id"),
            "n_words": pa.array(words.counts().astype(np.int64)),
            "factors": pa.array(factors, kind),
            "kept": kept_texts(words, keep),
        }
        return _released(pa.table(made))

    return run


def parse(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, block_bytes: int = BLOCK_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, its factors (word place, words, reference block) and the
    words outside them, joined by one space.

    A factor's words stand, window by window, also elsewhere in the corpus, the same document included; all
    places are factors, also the first one. Null texts have no words. Texts shorter than a window have no
    factors. Repeated rows repeat each other. Extra columns are ignored.
    """
    rows, ranges = dealt(docs, block_bytes, range_bytes)
    blocks = rows.groupBy("block")
    anchors = blocks.applyInArrow(_anchor_rows(window, gram, ranges), BY_RANGE)
    twice = anchors.groupBy("range").applyInArrow(repeated("<u8"), REPEATED).select("block", "keys")
    asked = blocks.cogroup(twice.groupBy("block")).applyInArrow(_window_rows(window, gram, ranges), BY_RANGE)
    known = asked.groupBy("range").applyInArrow(repeated("<u8"), REPEATED).select("block", "keys", "refs")
    return blocks.cogroup(known.groupBy("block")).applyInArrow(_parse(window, gram), PARSED)


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and the digest of the words that stay."""
    kept = F.when(F.col("kept") == "", 0).otherwise(F.size(F.split("kept", " ")))
    return parse(docs, window).select(
        "doc_id",
        "n_words",
        (F.col("n_words") - kept).cast("long").alias("n_removed"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op7_substring_dedup(spark, sf_dir):
    return substring_dedup(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
 win AS (SELECT r, i, md5(array_to_string(w[i : i + 34], ' ')) AS g FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
 twice AS (SELECT g FROM win GROUP BY g HAVING count(*) > 1),
 gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM win WHERE g IN (SELECT g FROM twice)),
 words AS (SELECT r, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
 kept AS (SELECT r, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
 sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
