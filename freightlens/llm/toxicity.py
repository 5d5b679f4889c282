"""Toxicity by a factorization machine over hashed terms.

Terms are lower-cased words, hashed to 64 bits. A document's features are the distinct selected terms it
holds; the machine adds a weight per term and, through a short factor vector per term, a weight per pair of
terms, so that a pair can count for more (or less) than its parts. It is fitted on a bounded sample of the
labelled documents by one task, so the driver sees the small model only, and then scores every document in one pass. A term is
selected for its own toxic share or, where the single terms judge documents wrongly, for that of its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import found_in
from .common import plain, spelled, stored, table, unused
from .words import ALNUM, Words, slices

SAMPLE = 20_000  # labelled documents that are fitted at most
TERMS = 4_096  # terms kept for what they say alone, those whose share differs most between the classes
LEAST_DOCS = 5  # sampled documents that must hold a term
FACTORS = 4
EPOCHS = 30
TRUST = 4.0  # standard errors by which a term's share must differ
PAIR_TILE = 1_024  # terms on either side, and documents, in one step of the pair counts: 4 MB an array, about 60 MB in all

Model = dict[str, np.ndarray]


def folds(doc_id) -> F.Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out. A null id is the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(5))


def _terms(docs: DataFrame) -> DataFrame:
    """(toxic, terms): distinct term hashes of each whole text."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"), ALNUM, True)
                hashes = words.hashes().view(np.int64)
                own = [np.unique(hashes[words.first[i] : words.first[i + 1]]) for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array(own, pa.list_(pa.int64()))], ["toxic", "terms"])

    return docs.select("toxic", "text").mapInArrow(run, "toxic int, terms array<long>")


def fit(rows: list[tuple[int, list[int]]], n_terms: int, seed: int = 7, epochs: int = EPOCHS, factors: int = FACTORS) -> Model:
    """Logistic factorization machine by AdaGrad, one document at a time in a fixed shuffled order.

    ``rows`` are (label, indices of the terms present). The prior of the sample is the starting bias.
    """
    rng = np.random.default_rng(seed)
    share = (sum(y for y, _ in rows) + 0.5) / (len(rows) + 1)
    bias, bias_sum = float(np.log(share / (1 - share))), 1.0
    w, w_sum = np.zeros(n_terms), np.full(n_terms, 1e-2)
    v, v_sum = rng.normal(0, 0.01, (n_terms, factors)), np.full((n_terms, factors), 1e-2)
    cases = [(y, np.asarray(x, dtype=np.int64)) for y, x in rows]
    for _ in range(epochs):
        for i in rng.permutation(len(cases)):
            y, x = cases[i]
            vx = v[x]
            total = vx.sum(axis=0)
            score = bias + w[x].sum() + 0.5 * float((total**2 - (vx**2).sum(axis=0)).sum())
            error = 1 / (1 + np.exp(-max(-35.0, min(35.0, score)))) - y
            bias_sum += error**2
            bias -= 0.1 * error / bias_sum**0.5
            if len(x):
                g = error + 1e-4 * w[x]
                w_sum[x] += g**2
                w[x] -= 0.2 * g / np.sqrt(w_sum[x])
                g = error * (total - vx) + 1e-3 * vx
                v_sum[x] += g**2
                v[x] -= 0.05 * g / np.sqrt(v_sum[x])
    return {"bias": np.array(bias), "w": w, "v": v}


def _deviation(n: np.ndarray, seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """Chernoff exponent of ``seen`` toxic documents among ``n`` where ``expected`` are due: exp(-it) bounds the chance."""
    least = np.float32(1e-6)
    whole = np.maximum(n, np.float32(1))
    q = np.clip(expected / whole, least, 1 - least)
    share = np.clip(seen / whole, least, 1 - least)
    out = share * np.log(share / q)
    np.subtract(1, share, out=share)
    np.subtract(1, q, out=q)
    out += share * np.log(share / q)
    return n * out


def pair_terms(toxic: np.ndarray, cases: list[np.ndarray], n_terms: int, expected: np.ndarray, least_docs: int = LEAST_DOCS) -> np.ndarray:
    """Terms that matter in a pair, whatever each does alone.

    ``cases`` are the indices of the terms of each document, ``expected`` what the single terms say of it. Every
    pair of terms that meets in wrongly judged documents is tested for its toxic share against the expected
    one, over all documents that hold both. The level falls with the number of pairs, so that about one
    sample in e^3 yields a pair by chance.
    """
    wrong = (toxic > 0) != (expected >= 0.5)
    at = np.concatenate([x for x, w in zip(cases, wrong, strict=True) if w]) if wrong.any() else np.zeros(0, np.int64)
    own = np.flatnonzero(np.bincount(at, minlength=n_terms) >= least_docs)
    if len(own) < 2:
        return own[:0]
    place = np.full(n_terms, -1, np.int64)
    place[own] = np.arange(len(own))
    term = place[np.concatenate(cases)]
    doc = np.repeat(np.arange(len(cases)), [len(x) for x in cases])[term >= 0]
    term = term[term >= 0]
    # entries by tile of terms, then by document
    order = np.lexsort((doc, term // PAIR_TILE))
    term, doc = term[order], doc[order]
    border = np.searchsorted(term // PAIR_TILE, np.arange(-(-len(own) // PAIR_TILE) + 1))

    def dense(tile: int, first: int) -> np.ndarray:
        """Which of some documents hold which terms of a tile."""
        a, b = border[tile], border[tile + 1]
        a, b = a + np.searchsorted(doc[a:b], [first, first + PAIR_TILE])
        x = np.zeros((min(PAIR_TILE, len(cases) - first), min(PAIR_TILE, len(own) - tile * PAIR_TILE)), np.float32)
        x[doc[a:b] - first, term[a:b] - tile * PAIR_TILE] = 1
        return x

    y, e = toxic.astype(np.float32)[:, None], np.asarray(expected, np.float32)[:, None]
    level, out = np.float32(3 + np.log(len(own) * (len(own) - 1) / 2)), np.zeros(len(own), bool)
    for i in range(len(border) - 1):
        for j in range(i, len(border) - 1):  # square tiles of the table of pairs
            a, b = i * PAIR_TILE, j * PAIR_TILE
            n, seen, due = (np.zeros((min(PAIR_TILE, len(own) - a), min(PAIR_TILE, len(own) - b)), np.float32) for _ in range(3))
            for first in range(0, len(cases), PAIR_TILE):
                left, right = dense(i, first), dense(j, first)
                n += left.T @ right
                seen += (left * y[first : first + PAIR_TILE]).T @ right
                due += (left * e[first : first + PAIR_TILE]).T @ right
            if i == j:
                np.fill_diagonal(n, 0)  # a term with itself is no pair
            hit = (n >= least_docs) & (_deviation(n, seen, due) >= level)
            out[a : a + len(n)] |= hit.any(axis=1)
            out[b : b + n.shape[1]] |= hit.any(axis=0)
    return own[out]


def learned(toxic: np.ndarray, lists: list[np.ndarray], terms: int = TERMS, least_docs: int = LEAST_DOCS) -> Model:
    """The machine fitted on documents given by label and distinct term hashes.

    A term in fewer than ``least_docs`` documents cannot be learned. Terms whose own toxic share differs are fitted
    first. Then all terms are looked at in pairs, and if terms are found that count in a pair only, the machine is
    fitted on both kinds.
    """
    names, n = np.unique(np.concatenate(lists), return_counts=True)
    names = names[n >= least_docs]
    cases = []
    for values in lists:
        hit, place = found_in(names, values)
        cases.append(place[hit])
    order = sorted(range(len(cases)), key=lambda i: (toxic[i], cases[i].tobytes()))  # the same on every run
    toxic, cases = toxic[order], [cases[i] for i in order]

    def fitted(chosen: np.ndarray) -> tuple[Model, list[np.ndarray]]:
        own = [found_in(chosen, x) for x in cases]
        own = [place[hit] for hit, place in own]
        return {"terms": names[chosen], **fit(list(zip(toxic.tolist(), own, strict=True)), len(chosen))}, own

    share, every = toxic.mean(), np.concatenate(cases)
    n = np.bincount(every, minlength=len(names))
    pos = np.bincount(every, np.repeat(toxic, [len(x) for x in cases]), minlength=len(names))
    # how far the toxic share among the term's documents lies from the share of all, in standard errors
    far = np.abs(pos - n * share) / np.sqrt(np.maximum(n, 1) * (share * (1 - share) + 1e-9))
    single = np.flatnonzero(far >= TRUST)
    single = np.sort(single[np.lexsort((names[single], -far[single]))[:terms]])
    model, own = fitted(single)
    judged = np.array([probability(model, x) for x in own])
    paired = np.setdiff1d(pair_terms(toxic, cases, len(names), judged, least_docs), single)
    return fitted(np.union1d(single, paired))[0] if len(paired) else model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, terms: int = TERMS, least_docs: int = LEAST_DOCS) -> Model:
    """Fits on at most ``sample`` labelled documents outside fold 0, taken by a hash of the id.

    A document labelled more than once is toxic if any label says so; null labels are none. Without
    labelled documents every score is 0; with one class only the score is that class's share. The sample is
    fitted by one task, see ``learned``.
    """
    known = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (folds(F.col("doc_id")) != 0))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    labelled = narrow.join(F.broadcast(known), "doc_id")  # at most ``sample`` rows of two numbers
    found = stored(_terms(labelled.repartition(F.xxhash64("doc_id"))), "toxic-terms")

    def run(batches):
        batches = [b for b in batches if b.num_rows]  # bounded by the sample
        if not batches:
            return
        rows = pa.Table.from_batches(batches)
        lists = []
        for part in rows.column("terms").chunks:
            ends, values = part.offsets.to_numpy(), part.values.to_numpy()
            lists += [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        model = learned((rows.column("toxic").to_numpy() > 0).astype(np.int64), lists, terms, least_docs)
        row = {k: [v.ravel().tolist()] for k, v in model.items()}
        yield pa.RecordBatch.from_pydict(row, pa.schema([(k, pa.list_(pa.int64() if k == "terms" else pa.float64())) for k in row]))

    fields = "terms array<long>, bias array<double>, w array<double>, v array<double>"
    model = found.coalesce(1).mapInArrow(run, fields).toArrow()
    if not model.num_rows:
        return {"terms": np.zeros(0, np.int64), "bias": np.array(-35.0), "w": np.zeros(0), "v": np.zeros((0, FACTORS))}
    got = {k: model.column(k).chunk(0).values.to_numpy() for k in ("terms", "bias", "w", "v")}
    return {"terms": got["terms"], "bias": got["bias"][0], "w": got["w"], "v": got["v"].reshape(-1, FACTORS)}


def probability(model: Model, present: np.ndarray) -> float:
    """Score of one document from the indices of its distinct selected terms."""
    vx = model["v"][present]
    pairs = 0.5 * float((vx.sum(axis=0) ** 2 - (vx**2).sum(axis=0)).sum())
    z = float(model["bias"]) + float(model["w"][present].sum()) + pairs
    return float(1 / (1 + np.exp(-max(-35.0, min(35.0, z)))))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with one more column, last: the probability of being toxic. Whole texts are read.

    Null and empty texts get the score of a document without any known term.
    """
    name, text = unused(docs, "toxicity"), spelled(docs, text)
    rows = plain(docs)
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches):
        # the model, a few thousand terms at most, travels with the task
        terms, blank = model["terms"], probability(model, np.zeros(0, np.int64))
        bitmap = np.zeros(1 << 16, bool)
        bitmap[terms.view(np.uint64) >> np.uint64(48)] = True
        for batch in batches:
            for part in slices(batch, text):
                words = Words(part.column(text), ALNUM, True)
                hashes = words.hashes()
                maybe = np.flatnonzero(bitmap[hashes >> np.uint64(48)])
                own = hashes[maybe].view(np.int64)
                place = np.minimum(np.searchsorted(terms, own), max(len(terms) - 1, 0))
                hit = terms[place] == own if len(terms) else np.zeros(0, bool)
                doc = np.searchsorted(words.first, maybe[hit], "right") - 1
                pairs = np.unique(doc * len(terms) + place[hit]) if len(terms) else np.zeros(0, np.int64)
                out = np.full(part.num_rows, blank)
                docs_hit, first = np.unique(pairs // max(len(terms), 1), return_index=True)
                for d, present in zip(docs_hit.tolist(), np.split(pairs % max(len(terms), 1), first[1:]), strict=bool(len(docs_hit))):
                    out[d] = probability(model, present)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out)], [*part.schema.names, name])

    return rows.mapInArrow(run, schema).toDF(*docs.columns, name)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document's score, with the fold it is in. Repeated rows are scored each, extra columns ignored."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = score(narrow, train(docs, labels))
    return scored.select(
        "doc_id",
        (folds(F.col("doc_id")) == 0).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
    )


def op4_toxicity(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
