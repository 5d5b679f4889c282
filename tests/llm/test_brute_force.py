"""Operators against plain Python on small inputs, with the odd rows every table may hold."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from freightlens.llm import chat, components, decontam, jaccard, lines, packing, sharding, substring, token_counts, topk, toxicity, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 997}" for i in range(20_000))
ODD = [None, "", " ", "\n\n", "\t x", "a", "a b", "A  b", "é ü ß", "x\x00y z", LONG]


def corpus(seed=1, n=60):
    """Random prose with copies, near copies, shared passages and odd rows; ids repeat and one is null."""
    rng = random.Random(seed)
    word = lambda: rng.choice("aeiou") + rng.choice("bcdfg") + str(rng.randrange(60))
    passage = [" ".join(word() for _ in range(50)) for _ in range(3)]
    texts = list(ODD)
    for _ in range(n):
        kind, base = rng.random(), "\n".join(" ".join(word() for _ in range(rng.randrange(1, 40))) for _ in range(rng.randrange(1, 6)))
        if kind < 0.25 and texts[-1]:
            base = texts[-1]
        elif kind < 0.5 and texts[-1]:
            parts = texts[-1].split(" ")
            parts[rng.randrange(len(parts))] = word()
            base = " ".join(parts)
        elif kind < 0.7:
            base += "\n" + rng.choice(passage) + "\n" + base[:30]
        texts.append(base)
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[20], rows[20], (None, texts[15], None, None, None), (5, texts[16], "en", "src1", 0)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(4)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def alnum(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))


# words


def test_words_and_windows():
    texts = pa.array(["a B  c\nd e", "x", None, "", "a b c d E", " é"])
    w = words.Words(texts.slice(0), words.SPACED, True)
    assert [w.text(a, b) for a, b in zip(w.first[:-1], w.first[1:], strict=True)] == [b"a b c d e", b"x", b"", b"", b"a b c d e", "é".encode()]
    h = w.hashes()
    five = words.windows(h, 5)[words.starts(w.first, 5)]
    assert len(five) == 2 and five[0] == five[1]
    part = words.Words(texts.slice(4), words.SPACED, True)
    assert np.array_equal(part.hashes(), h[w.first[4] :])


def test_hash_parts_do_not_matter(monkeypatch):
    texts = pa.array([LONG, "b c", LONG[:1000]])
    whole = words.Words(texts, words.SPACED, False).hashes()
    monkeypatch.setattr(words, "_HASH_WORDS", 7)
    assert np.array_equal(words.Words(texts, words.SPACED, False).hashes(), whole)
    assert len(set(whole.tolist())) == 999  # w0 to w996, b, c


def test_slices_cover_the_batch():
    batch = pa.record_batch({"text": ["a" * n for n in (5, 0, 50, 3, 3, 3)], "k": list(range(6))})
    parts = [p.column("k").to_pylist() for p in words.slices(batch, "text", 8)]
    assert [x for p in parts for x in p] == list(range(6)) and [2] in parts


# 1


def test_topk(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 4) / 4]) for i in range(300)]
    rows += [(50, None), (100, [None, 1.0, 0.0, 0.0]), (7, [float("nan"), 0.0, 0.0, 0.0]), (None, [1.0, 0.0, 0.0, 0.0]), (8, [float("inf"), 0.0, 0.0, 0.0])]
    rows += [(301, [0.5]), rows[9]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "vec_id AS ID", "1 AS shard", "2 AS rank")
    good = [(i, [int(np.floor(256 * np.float32(x).astype(float))) for x in v]) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    got = topk.embedding_topk(df).collect()
    want = []
    for q, v in [x for x in good if x[0] % 50 == 0]:
        scored = sorted((-sum(a * b for a, b in zip(v, u, strict=False)), i) for i, u in good if i != q)[:5]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    assert sorted(map(tuple, got)) == sorted(want)
    vectors = df.selectExpr("vec_id AS id", "array(1L, 2L) AS v").filter("id < 40").distinct()
    cells = topk.topk(vectors, vectors.selectExpr("*", "0L AS row"), 3, shard=7, batch=5)
    first = {r["query_id"]: r["vec_id"] for r in cells.collect() if r["rank"] == 1}
    assert first == {i: int(i == 0) for i in range(40)}
    assert topk.embedding_topk(df.limit(0)).count() == 0
    assert topk.embedding_topk(df.filter("vec_id = 0")).count() == 0


def test_topk_prunes_clustered_blocks():
    rng = np.random.default_rng(5)
    centre = np.eye(16, dtype=np.int64) * 1000
    rows = np.concatenate([c + rng.integers(-20, 20, (64, 16)) for c in centre])
    ids = np.arange(len(rows))
    scores, best, scored = topk.search_cell(ids, rows, ids[:40], rows[:40], 5, 32)
    full = rows[:40] @ rows.T
    full[np.arange(40), np.arange(40)] = -(10**15)
    order = np.lexsort((np.broadcast_to(ids, full.shape), full.max() - full), axis=1)[:, :5]
    assert np.array_equal(best, order) and scored < 40 * 32 / 4


# 2


def test_schedule_is_longest_first():
    assert dict(sharding.schedule([("a", 5), ("b", 4), ("c", 3), ("d", 3), ("e", 3)], 2)) == {"a": 0, "b": 1, "c": 1, "d": 0, "e": 1}


def test_sharding(spark, docs, empty):
    rows = sharding.shard_documents(docs.selectExpr("*", "1 AS shard", "2 AS SIZE"), 5).collect()
    data = corpus()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter(
        (i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in data
    )
    groups, loads, places = defaultdict(set), Counter(), defaultdict(list)
    for r in rows:
        groups[r["text_crc32"], r["size"]].add(r["shard"])
        loads[r["shard"]] += r["size"]
        places[r["shard"]].append(r["slot"])
    assert {k: len(v) for k, v in groups.items() if len(v) > 1} in ({}, {(0, 16): 2})  # null and empty text
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    sizes = Counter()
    for r in rows:
        sizes[r["text_crc32"], r["size"]] += r["size"]
    plain, heap = Counter(), dict.fromkeys(range(5), 0)
    for key, size in sizes.most_common():
        shard = min(heap, key=heap.get)
        heap[shard] += size
        plain[key] = shard
    # bundles of small texts may end up otherwise than one by one, by less than a bundle's size
    assert all(abs(a - b) <= 600 for a, b in zip(sorted(loads.values()), sorted(heap.values()), strict=True))
    assert sharding.shard_documents(empty).count() == 0


def test_slots_over_many_blocks(spark):
    rows = spark.range(1000).selectExpr("id % 3 AS shard", "id", "1 AS one")
    got = sharding.number(rows, "shard", ["id"], block_rows=90).collect()
    assert sorted((r["shard"], r["slot"]) for r in got) == sorted((s, k) for s in range(3) for k in range(len(range(s, 1000, 3))))


# 3


def sets(t):
    w = split(low(t))
    n = min(5, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def brute_components(data):
    own = [(i, sets(t)) for i, t, *_ in data]
    root = list(range(len(own)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(own)):
        for b in range(a):
            x, y = own[a][1], own[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                root[find(a)] = find(b)
    out = []
    for k, (i, s) in enumerate(own):
        ids = [j for q, (j, _) in enumerate(own) if find(q) == find(k) and j is not None]
        out.append((i, len(s), min(ids) if ids else None))
    return Counter(out)


@pytest.mark.parametrize("block", [3 << 20, 2000])
def test_jaccard(docs, block):
    got = jaccard.classes(docs.selectExpr("*", "0 AS block", "1 AS N"), block_bytes=block, range_bytes=4 * block)
    assert Counter(map(tuple, got.collect())) == brute_components(corpus())


def test_jaccard_chain_of_near_copies(spark, empty):
    base = [f"t{i}" for i in range(60)]
    data = [(k, " ".join(base[:k] + [f"n{k}_{j}" for j in range(k)] + base[k:])) for k in range(4)]
    data += [(10 + k, " ".join(base[: 10 + k] + [f"x{k}"] + base[10 + k :])) for k in range(40)]
    df = spark.createDataFrame([(i, t, "", "", 0) for i, t in data], DOCS)
    assert Counter(map(tuple, jaccard.classes(df).collect())) == brute_components(data)
    assert jaccard.classes(empty).count() == 0


def test_parity_sketches_never_exceed_the_difference():
    rng = np.random.default_rng(8)
    for n in (0, 1, 5, 300, 3000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[n // 3 :], rng.integers(0, 1 << 63, n // 4, dtype=np.uint64)]))
        x, y = jaccard.parity_sketch(a), jaccard.parity_sketch(b)
        assert len(x) == jaccard.SKETCH_BITS // 64
        assert sum(int(v).bit_count() for v in (x ^ y).view(np.uint64)) <= len(np.setxor1d(a, b))


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(30)]
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)

    def least(x):
        seen, todo = {x}, [x]
        while todo:
            todo = [z for y in todo for z in near[y] if z not in seen and not seen.add(z)]
        return min(seen)

    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in got} == {x: least(x) for x in near if near[x] - {x}}


# 4


def test_factorization_machine_learns_pairs():
    rng = random.Random(2)
    rows = []
    for _ in range(600):
        x = [i for i in range(6) if rng.random() < 0.4]
        rows.append((int(0 in x and 1 in x), x))
    model = toxicity.fit(rows, 6, epochs=60)
    model["terms"] = np.arange(6)
    right = sum((toxicity.probability(model, np.array(x, dtype=np.int64)) >= 0.5) == bool(y) for y, x in rows)
    assert right >= 595


def test_toxicity_held_out(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for i, r in got.items())
    out = [(got[r["doc_id"]]["predicted"], r["toxic"]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    assert sum(p == y for p, y in out) / len(out) >= 0.95


def test_toxicity_neutral_pair(spark):
    # "north" and "bird" are as common in toxic texts as in clean ones; only together they are toxic
    rng, rows = random.Random(4), []
    for i in range(3000):
        north, bird = rng.random() < 0.3, rng.random() < 0.3
        toxic = (north and bird) or (not north and not bird and rng.random() < 0.43)
        own = ["north"] * north + ["bird"] * bird + ["scum"] * (toxic and not north)
        rows.append((i, " ".join([*own, *(f"word{rng.randrange(200)}" for _ in range(20))]), int(toxic), int(north and bird)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    held_out = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    got = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(docs, labels).collect()}
    pairs = [got[r[0]] for r in held_out if r[3]]
    assert len(pairs) > 30 and sum(pairs) / len(pairs) >= 0.95
    assert sum(got[r[0]] == r[2] for r in held_out) / len(held_out) >= 0.95


def test_pair_terms_in_tiles(monkeypatch):
    rng = np.random.default_rng(2)
    cases = [np.unique(rng.integers(0, 50, 12)) for _ in range(900)]
    toxic = np.array([int({3, 40} <= set(x.tolist()) or rng.random() < 0.3) for x in cases])
    expected = np.full(900, 0.35)
    whole = toxicity.pair_terms(toxic, cases, 50, expected)
    assert set(whole) >= {3, 40}
    monkeypatch.setattr(toxicity, "PAIR_TILE", 16)
    assert np.array_equal(toxicity.pair_terms(toxic, cases, 50, expected), whole)


def test_pair_terms_memory_is_bounded():
    import tracemalloc

    rng = np.random.default_rng(3)
    cases = [np.unique(rng.integers(0, 6000, 100)) for _ in range(1500)]
    toxic, expected = rng.integers(0, 2, 1500), rng.random(1500)  # half of the documents wrongly judged
    tracemalloc.start()
    toxicity.pair_terms(toxic, cases, 6000, expected)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 96 << 20, peak  # the tiles take 64 MB, the entries themselves a few more


def test_toxicity_odd_rows(spark, docs, empty):
    labels = spark.createDataFrame([(i, None, int(i % 2)) for i in range(40)] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity(docs.selectExpr("*", "1 AS toxicity", "2 AS Toxic"), labels).collect()
    assert len(rows) == len(corpus()) and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {toxicity.probability(toxicity.train(docs, labels.limit(0)), np.zeros(0, int))}
    assert toxicity.toxicity(empty, labels).count() == 0


def test_topk_of_wide_numbers():
    """Sums beyond the doubles' exact range are exact, sums beyond 64 bits stop the search."""
    rng = np.random.default_rng(5)
    rows, queries = rng.integers(-(1 << 29), 1 << 29, (700, 6)), rng.integers(-(1 << 30), 1 << 30, (9, 6))
    ids, asked = np.arange(700), np.arange(9) * 50
    scores, best, _ = topk.search_cell(ids, rows, asked, queries, 5, 16)
    for q in range(9):
        want = sorted((-sum(int(a) * int(b) for a, b in zip(queries[q], rows[i])), i) for i in range(700) if i != asked[q])[:5]
        assert list(zip((-scores[q]).tolist(), best[q].tolist())) == want
    with pytest.raises(OverflowError):
        topk.search_cell(np.arange(2), np.full((2, 1), 1 << 40), np.array([5]), np.full((1, 1), 1 << 40), 1)


# 5


def test_rollup(spark, tmp_path):
    def change(*rows):
        return spark.createDataFrame(list(rows), token_counts.CHANGES)

    def state():
        return {(r["source"], r["tokenizer"]): (r["n_docs"], r["n_tokens"]) for r in token_counts.totals(spark, path).collect()}

    path = str(tmp_path / "rollup")
    assert state() == {}
    # what a batch said first is replaced by what it says last; no record is ever overwritten
    token_counts.commit(change(("insert", "q", "en", "v1", 99, None)), path, "1")
    assert state() == {("q", "v1"): (1, 99)}
    token_counts.commit(change(("insert", "a", "en", "v1", 10, None), ("insert", "a", "en", "v1", 5, None), ("insert", None, None, "v1", None, None)), path, "1")
    token_counts.commit(change(("revise", "a", "en", "v1", 7, 10), ("insert", "b", "en", "v1", 3, None)), path, "2")
    want = {("a", "v1"): (2, 12), (None, "v1"): (1, 0), ("b", "v1"): (1, 3)}
    assert state() == want
    token_counts.commit(change(("revise", "a", "en", "v1", 7, 10), ("insert", "b", "en", "v1", 3, None)), path, "2")
    assert state() == want
    # a batch that was written but never committed has no effect
    token_counts.signed(change(("insert", "z", "en", "v1", 1, None))).selectExpr("*", "'9' AS batch_id", "'x' AS attempt").write.parquet(f"{path}/deltas/batch_id=9-x")
    assert state() == want
    assert len(list((tmp_path / "rollup" / "commits").iterdir())) == 4
    token_counts.commit(change(("delete", "b", "en", "v1", 3, None)), path, "3")
    del want["b", "v1"]
    assert state() == want
    token_counts.compact(spark, path, str(tmp_path / "small"))
    path = str(tmp_path / "small")
    assert state() == want
    with pytest.raises(Exception, match="unknown kind"):
        token_counts.commit(change(("upsert", "b", "en", "v1", 3, None)), path, "4")


def test_document_rollup(docs, empty):
    got = {(r["source"], r["lang"], r["tokenizer"]): (r["n_docs"], r["n_tokens"]) for r in token_counts.document_rollup(docs).collect()}
    data = corpus()
    least = {}
    for i, t, *_ in data:
        least[t] = min([x for x in (least.get(t), i) if x is not None], default=None)
    want = defaultdict(lambda: (0, 0))
    for i, t, lang, source, _ in data:
        if least[t] == i:
            for name, pattern in (("words_v1", token_counts.WORDS), ("pieces_v2", token_counts.PIECES)):
                n, k = want[source, lang, name]
                want[source, lang, name] = (n + 1, k + len(re.findall(pattern, t or "")))
    assert got == dict(want)
    assert token_counts.document_rollup(empty).count() == 0


# 6


def test_encoder_gives_the_tokenizers_ids():
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    exact, quick = Tokenizer.from_file(path), packing.Encoder(path)
    odd = ["a  b", "a   b\n  c", "x\n y", " lead", "trail ", "it's I'll", "<|endoftext|> x<|endoftext|>", "é  ü", "　 a", "1234 5.6,7", "\r\n\t x", "日本 語", "\x1c y", "a\x85 b", "🙂 🙂🙂"]
    for text in [t or "" for _, t, *_ in corpus()] + odd:
        assert np.frombuffer(quick.encode(text), "<u4").tolist() == exact.encode(text, add_special_tokens=False).ids


def brute_best_fit(sizes, capacity):
    rooms = []
    for s in sorted(sizes, reverse=True):
        fits = [r for r in rooms if r >= s]
        rooms.remove(min(fits)) if fits else None
        rooms.append((min(fits) if fits else capacity) - s)
    return len(rooms)


def test_best_fit_and_bound():
    rng = random.Random(6)
    for _ in range(200):
        capacity = rng.choice([10, 17, 100])
        sizes = np.array([rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 40))])
        bins, place = packing.best_fit(sizes, capacity)
        assert bins.max() + 1 == brute_best_fit(sizes.tolist(), capacity)
        assert packing.lower_bound(sizes, capacity) <= bins.max() + 1
        for b in range(bins.max() + 1):
            at = np.argsort(place[bins == b])
            own = sizes[bins == b][at]
            assert np.array_equal(place[bins == b][at], np.cumsum(own) - own) and own.sum() <= capacity
    assert packing.lower_bound(np.array([6, 6, 6]), 10) == 3  # by size, two bins would do
    assert packing.lower_bound(np.array([4] * 5), 10) == 3  # three of these never share a bin
    assert packing.lower_bound(np.zeros(0, int), 10) == 0


@pytest.mark.parametrize("part", [60_000, 30])
def test_packing(docs, part):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(packing.tokenizer_path())
    rows = packing.pack_documents(docs.selectExpr("*", "1 AS part", "2 AS BIN"), packing.tokenizer_path(), part_items=part).collect()
    want = Counter()
    for i, t, *_ in corpus():
        ids = np.array(exact.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        head = (len(ids) - 1) % 2048 + 1
        cuts = [0, *range(head, len(ids) + 1, 2048)]
        for k in range(len(cuts) - 1):
            own = ids[cuts[k] : cuts[k + 1]]
            want[i, k, cuts[k], len(own), zlib.crc32(own.tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        end = 0
        for a, n in sorted(own):
            assert a == end
            end += n
        assert end <= 2048
    sizes = [r["length"] for r in rows]
    assert len(bins) <= -(-sum(sizes) // 2048) + (2 if part == 60_000 else 8)


def test_packing_nothing(empty):
    assert packing.pack_documents(empty, packing.tokenizer_path()).count() == 0


# 7


@pytest.mark.parametrize("block", [3 << 20, 3000])
def test_substring(docs, block):
    data = corpus()
    own = [(i, split(t)) for i, t, *_ in data]
    seen = Counter(tuple(w[k : k + 35]) for _, w in own for k in range(len(w) - 34))
    want = Counter()
    for i, w in own:
        gone = {k + j for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for j in range(35)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want[i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    parsed = substring.parse(docs.selectExpr("*", "0 AS block"), block_bytes=block, range_bytes=2 * block)
    got = Counter()
    for r in parsed.collect():
        covered = {f["start"] + j for f in r["factors"] for j in range(f["length"])}
        got[r["doc_id"], r["n_words"], len(covered), hashlib.sha256(r["kept"].encode()).hexdigest()] += 1
    assert got == want


def test_substring_repeats_inside_one_text(spark, empty):
    rows = [(1, "a " * 60), (2, " ".join(f"u{i}" for i in range(35)) + " x " + " ".join(f"u{i}" for i in range(35))), (3, "b " * 35), (4, "c " * 34)]
    df = spark.createDataFrame([(i, t, "", "", 0) for i, t in rows], DOCS)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring.substring_dedup(df).collect()}
    assert got == {1: (60, 60), 2: (71, 70), 3: (35, 0), 4: (34, 0)}
    assert substring.substring_dedup(empty).count() == 0


# 8


def test_chat(spark):
    schema = "conv_id long, turn long, role string, text string, i int, N int"
    say = [("user", "hi"), ("assistant", "yes"), ("user", None)]
    rows = [(1, t, *say[t], 0, 0) for t in range(3)] + [(2, t, *say[t], 0, 0) for t in range(2)] + [(3, 5 * t, *say[t], 0, 0) for t in range(3)]
    rows += [(4, 0, "user", "hi there", 0, 0), (5, 0, None, "hi", 0, 0), (None, 0, "user", "", 0, 0), (6, None, "user", "hi", 0, 0), (6, None, "user", "hi", 0, 0)]
    got = {r["conv_id"]: (r["n_turns"], r["copies"], r["text"]) for r in chat.format_chats(spark.createDataFrame(rows, schema)).collect()}
    hi = "<|im_start|>user\nhi<|im_end|>\n"
    assert got == {
        1: (3, 2, hi + "<|im_start|>assistant\nyes<|im_end|>\n<|im_start|>user\n<|im_end|>\n"),
        4: (1, 1, "<|im_start|>user\nhi there<|im_end|>\n"),
        5: (1, 1, "<|im_start|>\nhi<|im_end|>\n"),
        None: (1, 1, "<|im_start|>user\n<|im_end|>\n"),
        6: (2, 1, hi + hi),
    }
    assert chat.format_chats(spark.createDataFrame([], schema)).count() == 0


# 9


def brute_contamination(data, items):
    grams = defaultdict(set)
    for name, t in items:
        w = alnum(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            grams[tuple(w[k : k + n])].add("" if name is None else str(name))
    out = Counter()
    for i, t, *_ in data:
        w = alnum(t)
        hit, names = set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in grams:
                    hit |= set(range(k, k + n))
                    names |= grams[tuple(w[k : k + n])]
        out[i, len(w), len(hit), len(names), decontam.digest(list(names)), bool(hit)] += 1
    return out


ITEMS = [(1, "x y"), (20, None), (3, ""), (None, "A1"), (10, corpus()[15][1]), (9, corpus()[15][1]), (9, "x y"), (11, LONG[:300]), (12, "no such words at all here")]


@pytest.mark.parametrize("part", [16 << 20, 200])
def test_contamination(spark, docs, part):
    data = corpus()
    narrow = docs.selectExpr("doc_id", "text", "1 AS spans", "2 AS Items")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontam.scan(narrow, bench, part_bytes=part).collect()
    want = brute_contamination(data, ITEMS)
    got = Counter((r[0], r[4], sum(b - a for a, b in r[5]), len(r[7]), decontam.digest(r[7]), bool(r[5])) for r in found)
    assert got == want
    if part > 1000:
        assert Counter(map(tuple, decontam.contamination(docs, bench).collect())) == want
        assert not any(r["contaminated"] for r in decontam.contamination(docs, bench.limit(0)).collect())


def test_decontaminate_cuts_and_drops(spark):
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    rows = [(1, "é a b c, One two  three! d é"), (2, "one two three"), (3, "clean"), (4, None), (5, "")]
    got = decontam.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), bench)
    assert {r["doc_id"]: r["text"] for r in got.collect()} == {1: "é a b c, ! d é", 3: "clean", 4: None, 5: ""}


# 10


def brute_lines(data):
    first, out = {}, Counter()
    for i, key, t in sorted({(i, hashlib.md5(t.encode()).hexdigest(), t) for i, t, *_ in data if t is not None}, key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        for k, c in enumerate(lines.chunks(t)):
            if len(c) > 1:
                first.setdefault(tuple(c), (i, key, k))
    for i, t, *_ in data:
        parts, key = lines.chunks(t), hashlib.md5((t or "").encode()).hexdigest()
        kept = [c for k, c in enumerate(parts) if len(c) == 1 or first[tuple(c)] == (i, key, k)]
        n = sum(map(len, parts))
        out[i, n, n - sum(map(len, kept)), None if t is None else "\n".join(x for c in kept for x in c)] += 1
    return out


def test_line_dedup(spark, docs, empty):
    got = lines.dedup_lines(docs.selectExpr("*", "1 AS hash", "2 AS K")).select("doc_id", "n_lines", "n_removed", "text")
    assert Counter(map(tuple, got.collect())) == brute_lines(corpus())
    assert lines.dedup_lines(empty).count() == 0


def brute_passages(data):
    places, out = {}, Counter()
    texts = {(i is not None, i or 0, hashlib.md5(t.encode()).hexdigest(), t) for i, t, *_ in data if t is not None}
    for n, (*_, t) in enumerate(sorted(texts)):
        ls = t.split("\n")
        for k in range(len(ls) - 1):
            if (ls[k] + ls[k + 1]).strip():
                places.setdefault((ls[k], ls[k + 1]), []).append((n, k))
    order = {x[:3]: n for n, x in enumerate(sorted(texts))}
    for i, t, *_ in data:
        ls = [] if t is None else t.split("\n")
        own = order.get((i is not None, i or 0, hashlib.md5((t or "").encode()).hexdigest()))
        gone = {j for p in places.values() for n, k in p[1:] if n == own for j in (k, k + 1)} if t else set()
        out[i, len(ls), len(gone), None if t is None else "\n".join(x for j, x in enumerate(ls) if j not in gone)] += 1
    return out


def test_passages(spark, docs, empty):
    got = lines.dedup_passages(docs.selectExpr("*", "1 AS hash", "2 AS K")).select("doc_id", "n_lines", "n_removed", "text")
    assert Counter(map(tuple, got.collect())) == brute_passages(corpus())
    assert lines.dedup_passages(empty).count() == 0


def test_passages_planted_in_different_texts(spark):
    rows, n = [], 0
    for size in range(2, 13):
        for case in range(6):
            passage = [f"passage {size} {case} line {k}" for k in range(size)]
            for _ in range(3):
                around = [f"own {n} line {k}" for k in range(10)]
                rows.append((n, "\n".join(around[:5] + passage + around[5:]), size if n % 3 else 0))
                n += 1
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = {r["doc_id"]: r for r in lines.dedup_passages(docs).collect()}
    for i, text, size in rows:
        want = text if not size else "\n".join(x for x in text.split("\n") if x.startswith("own"))
        assert (got[i]["n_removed"], got[i]["text"]) == (size, want)
    by_chunks = lines.dedup_lines(docs).agg({"n_removed": "sum"}).first()[0]
    assert by_chunks < sum(r[2] for r in rows)
    print("removed by chunks", by_chunks, "of", sum(r[2] for r in rows))


def test_chunks():
    text = "\n".join(f"line {i % 37}" for i in range(500))
    assert "\n".join(x for c in lines.chunks(text) for x in c) == text
    assert all(len(c) > 1 for c in lines.chunks(text)) and len(lines.chunks(text)) > 50
    assert lines.chunks(None) == [] and lines.chunks("") == [[""]]
    # a line in front shifts everything but the borders
    moved = {tuple(c) for c in lines.chunks("new\n" + text)}
    assert sum(tuple(c) not in moved for c in lines.chunks(text)) <= 2
