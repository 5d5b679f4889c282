"""Best-fit packing with certified repacking.

Documents are tokenised where they lie; only piece lengths and checksums travel. Pieces are dealt into
partitions of bounded size and each partition runs best-fit decreasing. Lower bounds from dual-feasible
functions tell how many bins a partition needs at least. Where best fit meets the bound, the partition is
certified and rests. The others have a gap: they give up the bins that are not filled, these documents are
exchanged among the partitions with gaps, and best-fit decreasing runs again on what was exchanged.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, table
from .words import slices

CAPACITY = 2048
PART_ITEMS = 60_000  # pieces packed by one task
ROUNDS = 2  # exchanges after the first packing
FILL = 0.995  # bins filled beyond this share stay closed in an exchange
CACHE = 500_000  # words whose ids a task remembers

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of a text under a byte-level BPE file, as little-endian unsigned 32-bit bytes.

    A space before a visible character always begins a new pre-token, so a text without white space before
    a space falls into words that are encoded one by one and remembered. Other texts go to the tokenizer
    whole. New words are merged by tiktoken over the same vocabulary, which is several times faster; the
    first ones of each task are compared with the tokenizer, and on any difference it takes over.
    """

    def __init__(self, path: str, trial: int = 200):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        special = {t["content"] for t in told["added_tokens"]}
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        letter = _byte_letters()
        ranks = {bytes(letter[c] for c in w): i for w, i in told["model"]["vocab"].items() if w not in special}
        import public_tokenizers

        quick = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.quick, self.trial, self.agreed = quick.encode_ordinary, trial, True
        self.gap = re.compile(r"\s ")
        outer = self

        class Memory(dict):
            def __missing__(self, word):
                if len(self) >= CACHE:
                    self.clear()
                self[word] = ids = outer.ids(" " + word)
                return ids

        self.memory = Memory()

    def _exact(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def ids(self, text: str) -> bytes:
        if not self.agreed or (self.special and self.special.search(text)):
            return self._exact(text)
        out = np.array(self.quick(text), dtype="<u4").tobytes()
        if self.trial > 0:
            self.trial -= 1
            exact = self._exact(text)
            if exact != out:
                self.agreed = False
                return exact
        return out

    def encode(self, text: str) -> bytes:
        if self.gap.search(text) or (self.special and self.special.search(text)):
            return self._exact(text)
        words = text.split(" ")
        head = self.ids(words[0]) if words[0] else b""
        return head + b"".join(map(self.memory.__getitem__, words[1:]))


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of every document: its place, length and the crc32 of its ids.

    A document is its text's ids and the end id 0. Longer ones than ``capacity`` are cut; the first piece
    takes what is left over, the others are full. A null or empty text is the end id alone.
    """

    def run(batches):
        encoder = Encoder(tokenizer)
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids = encoder.encode(text or "") + b"\0\0\0\0"
                    n = len(ids) // 4
                    cut = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                    for k, (a, b) in enumerate(zip(cut, cut[1:], strict=False)):
                        out.append((doc_id, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])))
                columns = list(zip(*out, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-fit decreasing: for each item its bin (from 0) and its place in the bin.

    Open bins are kept by the room left; rooms in use are a short sorted list, so an item costs one
    binary search.
    """
    order = np.argsort(-lengths, kind="stable")
    bins = np.empty(len(lengths), np.int64)
    place = np.empty(len(lengths), np.int64)
    by_room: dict[int, list[int]] = {}
    rooms: list[int] = []
    made = 0
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        at = bisect_left(rooms, size)
        if at == len(rooms):
            b, room = made, capacity
            made += 1
        else:
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[at]
        bins[i], place[i] = b, capacity - room
        room -= size
        if room:
            if room not in by_room:
                by_room[room] = []
                insort(rooms, room)
            by_room[room].append(b)
    return bins, place


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The most that dual-feasible functions prove: no packing has fewer bins.

    Over all thresholds e up to half the capacity, sizes above ``capacity - e`` count as full and sizes
    below e as nothing; over all k, sizes are rounded down to multiples of 1 / (k + 1). Both keep every
    feasible bin at one or less, so the total of the images bounds the bins from below.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    n_from = np.cumsum(count[::-1])[::-1]  # items of at least this size
    load = np.concatenate([[0], np.cumsum(count * size)])
    e = np.arange(0, capacity // 2 + 1)
    big = np.where(e > 0, n_from[np.minimum(capacity - e + 1, capacity)], 0)
    middle = load[capacity - e + 1] - load[e]
    best = int((big + -(-middle // capacity)).max())
    for k in range(1, 21):
        scaled = (k + 1) * size
        image = np.where(scaled % capacity == 0, size * k, (scaled // capacity) * capacity)
        best = max(best, int(-(-(count * image).sum() // (k * capacity))))
    return best


def _pack(capacity: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], ignore_index=True)
        lengths = rows["length"].to_numpy()
        bins, place = best_fit(lengths, capacity)
        gap = (int(bins.max()) + 1) - lower_bound(lengths, capacity)
        fill = np.bincount(bins, weights=lengths)[bins]
        return rows.assign(bin=bins, offset=place, fill=fill.astype(np.int64), gap=gap)

    return run


def pack(items: DataFrame, capacity: int = CAPACITY, part_items: int = PART_ITEMS, rounds: int = ROUNDS) -> DataFrame:
    """``items`` (stored, with doc_id, piece, start, length, ids_crc32) with sequence_id and offset.

    In an exchange every partition with a gap gives up its bins filled to less than ``FILL``; what they
    hold is dealt anew among fewer partitions of bounded size, by a hash, and packed again. The result is
    taken only where it needs fewer bins than before in sum; otherwise the earlier one stands.
    """
    columns = [c.split()[0] for c in PIECES.split(", ")]
    packed_schema = f"round int, part long, {PIECES}, bin long, offset long, fill long, gap int"
    done: list[DataFrame] = []
    open_items, before = items, None
    for turn in range(rounds + 1):
        n = open_items.count()
        if n == 0:
            break
        parts = -(-n // part_items)
        # rows alike in all columns would share a hash; the random part of the plan stays out of it
        part = F.pmod(F.xxhash64(F.lit(turn), *columns), F.lit(parts))
        dealt = open_items.select(F.lit(turn).alias("round"), part.alias("part"), *columns)
        packed = stored(dealt.groupBy("part").applyInPandas(_pack(capacity), packed_schema), f"packed-{turn}")
        if before is not None:
            used = packed.select("part", "bin").distinct().count()
            if used >= before[1]:
                done.append(before[0])
                break
        if turn == rounds:
            done.append(packed)
            break
        loose = (F.col("gap") > 0) & (F.col("fill") < FILL * capacity)
        done.append(packed.filter(~loose))
        open_items = packed.filter(loose)
        before = (open_items, open_items.select("part", "bin").distinct().count())
        if before[1] <= 1:
            done.append(open_items)
            break
    if not done:
        done = [items.sparkSession.createDataFrame([], packed_schema)]
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    sequence = (F.col("part") * F.lit(ROUNDS + 8) + F.col("round")) * F.lit(1 << 24) + F.col("bin")
    return out.select(*columns, sequence.cast("long").alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, part_items: int = PART_ITEMS) -> DataFrame:
    """Packs all documents into sequences of at most ``capacity`` tokens, as few as it can.

    Null and empty texts are one end id each. Repeated rows and null doc_ids are packed like others, extra
    columns are ignored, and no documents give no rows. Texts of any length are cut into full pieces.
    """
    return pack(stored(pieces(docs, tokenizer, capacity), "pieces"), capacity, part_items)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_best_fit_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())
