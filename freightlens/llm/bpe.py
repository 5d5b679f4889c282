"""Byte-pair encoding and decoding with a segment tree over adjacent pair ranks.

A word is a row of symbols. Leaf ``i`` of the tree holds the rank of the merge of symbol ``i`` with the symbol
after it, an inner node the lower of its two children, so the root names the leftmost merge of the lowest rank.
A merge changes three leaves (its own, the one before it and the one that goes), each in logarithmic time, until
the root says that no pair can be merged. A word of n letters costs O(n log n) time and a fixed number of bytes
per letter, also where a text is one single word.

Normalisation and the split into words follow the tokenizer file. White space always ends a word and never takes
part in one, so a text is cut there into strings; a task remembers the ids of a bounded number of them. Words of
usual length get one tree each in a common array, and all of these take their next merge at the same time; longer
words get a tree of their own. Special tokens that stand in a text are their ids, as the file says.

Null texts are encoded like empty ones: no ids, and the decoded text is empty. Texts of any length are handled in
parts of bounded size. Rows are independent, so equal texts and repeated ids give equal rows; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .words import slices

PART = 1 << 20  # characters of texts split at once, and ids written at once
LONG = 1 << 16  # strings beyond this many characters are neither remembered nor handed to the library
REMEMBERED = 300_000  # strings a task keeps the ids of
NONE = 1 << 62  # no merge
SHORT = 64  # words of at most this many pairs share an array
TOGETHER = 1 << 21  # tree nodes in one such array

_SPACE = re.compile(r"[ \t\n\r\v\f]")
_STRINGS = re.compile(r"[^ \t\n\r\v\f]+")
# fixed values: the word pattern of the tokenizer file, for lower-case ASCII and in full
_ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
_ALL_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\x09-\x0D\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\p{L}\p{N}]+"
# Latin, Greek and Cyrillic letters, which every version of Unicode treats alike; marks that combine are not among them
_SETTLED = re.compile(r"[\x00-\u024F\u0370-\u052F]+")


def merge(symbols: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """``symbols`` after all merges. ``ranks`` maps a pair to its rank and to the symbol that replaces it."""
    n = len(symbols)
    if n < 2:
        return symbols
    size = 1 << (n - 2).bit_length() if n > 2 else 1
    row = array("l", symbols)
    after, before = array("l", range(1, n + 1)), array("l", range(-1, n - 1))
    tree = array("q", [NONE]) * (2 * size)
    find = ranks.get
    for i in range(n - 1):
        found = find((row[i], row[i + 1]))
        if found:
            # rank first, place second: of equal ranks the leftmost wins
            tree[size + i] = found[0] * size + i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b

    def put(i: int, value: int) -> None:
        i += size
        tree[i] = value
        while i > 1:
            other = tree[i ^ 1]
            low = value if value < other else other
            i >>= 1
            if tree[i] == low:
                return
            tree[i] = value = low

    def rank(i: int) -> int:
        found = find((row[i], row[after[i]])) if after[i] < n else None
        return found[0] * size + i if found else NONE

    while tree[1] != NONE:
        i = tree[1] % size
        gone = after[i]
        row[i] = find((row[i], row[gone]))[1]
        after[i] = after[gone]
        if after[gone] < n:
            before[after[gone]] = i
            put(gone, NONE)
        put(i, rank(i))
        if before[i] >= 0:
            put(before[i], rank(before[i]))
    out, i = [], 0
    while i < n:
        out.append(row[i])
        i = after[i]
    return out


class Forest:
    """Segment trees of many short words in one array, merged side by side."""

    def __init__(self, ranks: dict[tuple[int, int], tuple[int, int]]):
        self.width = max((max(*p, made) for p, (_, made) in ranks.items()), default=0) + 1
        pairs = np.array([a * self.width + b for a, b in ranks], np.int64)
        order = np.argsort(pairs)
        # a last entry that no pair has, so that a search always ends on an entry
        self.pairs = np.append(pairs[order], np.iinfo(np.int64).max)
        self.rank = np.append(np.array([r for r, _ in ranks.values()], np.int64)[order], 0)
        self.made = np.zeros(int(self.rank.max()) + 1, np.int32)
        for r, symbol in ranks.values():
            self.made[r] = symbol

    def keys(self, left: np.ndarray, right: np.ndarray, place: np.ndarray, size: int) -> np.ndarray:
        """Rank first, place second; none where a side is missing (negative) or the pair does not merge."""
        pair = left.astype(np.int64) * self.width + right
        at = np.searchsorted(self.pairs, pair)
        found = (self.pairs[at] == pair) & (left >= 0) & (right >= 0)
        return np.where(found, self.rank[at] * size + place, NONE)

    def merge(self, symbols: np.ndarray, lengths: np.ndarray, size: int) -> list[bytes]:
        """Words of at most ``size`` pairs each (a power of two) after all merges, as 32-bit symbols.

        ``symbols`` holds the words one after the other.
        """
        m, n = len(lengths), size + 1
        row = np.full((m, n + 1), -1, np.int32)  # the last column stands for what is outside the word
        row[:, :n][np.arange(n) < lengths[:, None]] = symbols
        after = np.tile(np.arange(1, n + 2, dtype=np.int32), (m, 1))
        after[:, n] = n
        before = np.tile(np.arange(-1, n, dtype=np.int32), (m, 1))
        before[:, 0] = n
        tree = np.full((m, 2 * size), NONE, np.int64)
        tree[:, size:] = self.keys(row[:, :size], row[:, 1:n], np.arange(size), size)
        for i in range(size - 1, 0, -1):
            np.minimum(tree[:, 2 * i], tree[:, 2 * i + 1], out=tree[:, i])
        live = np.flatnonzero(tree[:, 1] != NONE)
        while len(live):
            root = tree[live, 1]
            at = root % size
            row[live, at] = self.made[root // size]
            gone = after[live, at]
            row[live, gone] = -1
            beyond = after[live, gone]
            after[live, at] = beyond
            before[live, beyond] = at
            back = before[live, at]
            own, right = row[live, at], row[live, beyond]
            inside = gone < size
            tree[live[inside], size + gone[inside]] = NONE
            tree[live, size + at] = self.keys(own, right, at, size)
            inside = back < n
            tree[live[inside], size + back[inside]] = self.keys(row[live, back], own, back, size)[inside]
            # the three leaves' ancestors, level by level
            nodes = [size + np.minimum(gone, size - 1), size + at, size + np.where(back < n, back, at)]
            for _ in range(size.bit_length() - 1):
                nodes = [x >> 1 for x in nodes]
                for x in nodes:
                    tree[live, x] = np.minimum(tree[live, 2 * x], tree[live, 2 * x + 1])
            live = live[tree[live, 1] != NONE]
        left = row >= 0
        ends = np.cumsum(left.sum(1) * 4).tolist()
        flat = row[left].astype("<i4").tobytes()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]


class Bpe:
    """A tokenizer file of the word-end kind, read once per task."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model, library = told["model"], Tokenizer.from_file(path)
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.ranks = {}
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            self.ranks[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.specials = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.tokens = {i: t.encode() for t, i in (vocab | self.specials).items()}
        # byte-level files write printable bytes as themselves and the others from U+0100 on
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)} - {*plain}))}
        self.inner = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[letters[b] + end] for b in range(256)], np.int32)
        self.byte_of = {c: b for b, c in letters.items()}
        self.normal, self.words = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.all_words = regex.compile(_ALL_WORDS)
        self.forest = Forest(self.ranks)
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def words_to_ids(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids (little-endian, 32 bits) of distinct words."""
        done = {}
        classes: dict[int, list[bytes]] = {}
        for w in words:
            pairs = len(w) - 1
            if pairs > SHORT:
                symbols = self.inner[np.frombuffer(w, np.uint8)].tolist()
                symbols[-1] = int(self.last[w[-1]])
                done[w] = array("i", merge(symbols, self.ranks)).tobytes()
            else:
                classes.setdefault(1 << (pairs - 1).bit_length() if pairs > 1 else 1, []).append(w)
        for size, members in classes.items():
            step = TOGETHER // size
            for i in range(0, len(members), step):
                part = members[i : i + step]
                data, lengths = np.frombuffer(b"".join(part), np.uint8), np.fromiter(map(len, part), np.int64, len(part))
                symbols, ends = self.inner[data], np.cumsum(lengths) - 1
                symbols[ends] = self.last[data[ends]]
                done.update(zip(part, self.forest.merge(symbols, lengths, size), strict=True))
        return done

    def split(self, string: str) -> Iterator[bytes]:
        """The words of a string without ASCII white space and special tokens, as UTF-8."""
        if string.isascii():
            return (w.encode() for w in _ASCII_WORDS.findall(string.lower()))
        if _SETTLED.fullmatch(string):
            whole = unicodedata.normalize("NFC", string)
            # letter by letter, as the file says; only a final sigma would come out otherwise
            whole = "".join(map(str.lower, whole)) if "Σ" in whole else whole.lower()
        elif len(string) <= LONG:
            byte_of = self.byte_of
            return (bytes(byte_of[c] for c in w) for w, _ in self.words(self.normal(string)))
        else:
            # cut between two ASCII characters, over which no normalisation reaches
            cuts = [0]
            for place in re.finditer(r"(?<=[!-~])(?=[!-~])", string):
                if place.start() - cuts[-1] >= LONG:
                    cuts.append(place.start())
            cuts.append(len(string))
            whole = "".join(self.normal(string[a:b]) for a, b in zip(cuts, cuts[1:], strict=False))
        return (w.group().encode() for w in self.all_words.finditer(whole))

    def strings_to_ids(self, strings) -> dict[str, bytes]:
        """Ids of strings without ASCII white space; every distinct word among them is merged once."""
        parts: dict[str, list] = {}
        words: set[bytes] = set()
        special = self.special
        for string in strings:
            if special is None or special.search(string) is None:
                parts[string] = own = list(self.split(string))
                words.update(own)
                continue
            parts[string] = own = []
            for part in special.split(string):
                if part in self.specials:
                    own.append(self.specials[part])
                elif part:
                    found = list(self.split(part))
                    own += found
                    words.update(found)
        ids = self.words_to_ids(list(words))
        return {s: b"".join([ids[p] if isinstance(p, bytes) else p.to_bytes(4, "little") for p in own]) for s, own in parts.items()}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of texts. The strings of a bounded part of them are looked up and learnt together."""
        out: list[list[bytes]] = [[] for _ in texts]
        waiting: list[tuple[int, list[str]]] = []
        held = 0

        def settle():
            asked = set().union(*(strings for _, strings in waiting))
            fresh, memory, older = asked.difference(self.memory), self.memory, self.older
            # strings that were in use before the memory was last begun anew come over
            memory.update([(s, older[s]) for s in fresh if s in older])
            memory.update(self.strings_to_ids([s for s in fresh if s not in older]))
            for k, strings in waiting:
                out[k].append(b"".join(map(memory.__getitem__, strings)))
            for s in fresh:
                if len(s) > 64:
                    del memory[s]
            if len(memory) > REMEMBERED:
                self.memory, self.older = {}, memory
            waiting.clear()

        for k, text in enumerate(texts):
            at = 0
            while at < len(text):
                cut = _SPACE.search(text, at + PART)
                stop = cut.start() if cut else len(text)
                waiting.append((k, _STRINGS.findall(text, at, stop)))
                held += stop - at
                at = stop
                if held >= PART:
                    settle()
                    held = 0
        settle()
        return [b"".join(parts) for parts in out]

    def decode(self, ids: np.ndarray) -> bytes:
        """Tokens joined by a space, as UTF-8; ids without a token are left out."""
        parts = (ids[i : i + PART].tolist() for i in range(0, len(ids), PART))
        return b" ".join(filter(None, (b" ".join([t for t in map(self.tokens.get, p) if t is not None]) for p in parts)))


def _encoded(batches, bpe: Bpe):
    """Batches of (doc_id, text) to batches of (doc_id, ids)."""
    for batch in batches:
        for part in slices(batch, "text"):
            ids = bpe.encode([t or "" for t in part.column("text").to_pylist()])
            ends = np.cumsum([0] + [len(i) // 4 for i in ids], dtype=np.int64).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), values)], ["doc_id", "ids"])


def _decoded(batches, bpe: Bpe):
    """Batches of (doc_id, ids) to batches of (doc_id, ids, decoded)."""
    for batch in batches:
        lists = batch.column("ids")
        texts = [bpe.decode(lists[i].values.to_numpy(zero_copy_only=False) if lists[i].is_valid else np.zeros(0, np.int32)) for i in range(len(lists))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "ids", "decoded"])


def _digests(batches):
    """Batches of (doc_id, ids, decoded) to digests of both."""
    for batch in batches:
        lists, out = batch.column("ids"), []
        for i in range(len(lists)):
            ids, sha = lists[i].values.to_numpy(zero_copy_only=False), hashlib.sha256()
            for at in range(0, len(ids), PART):
                sha.update((" " if at else "").encode() + " ".join(map(str, ids[at : at + PART].tolist())).encode())
            out.append((len(ids), sha.hexdigest()))
        counts, shas = zip(*out, strict=True) if out else ((), ())
        texts = [hashlib.sha256(batch.column("decoded")[i].as_buffer()).hexdigest() for i in range(len(lists))]
        arrays = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(texts, pa.string())]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and ids of every text under the tokenizer file; a null text has none."""
    return _texts(docs).mapInArrow(lambda batches: _encoded(batches, Bpe(tokenizer)), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids and the text that the ids stand for; null ids are no ids."""
    rows = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    return rows.mapInArrow(lambda batches: _decoded(batches, Bpe(tokenizer)), "doc_id long, ids array<int>, decoded string")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Encoded, decoded and both digested in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def run(batches):
        bpe = Bpe(tokenizer)
        yield from _digests(_decoded(_encoded(batches, bpe), bpe))

    return _texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op11_bpe(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "documents"), tokenizer_path())
