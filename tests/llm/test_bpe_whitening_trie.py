"""Encoding, whitening and the prefix trie against the library, numpy and plain Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from freightlens.llm import bpe, prefix_trie, whitening

# byte-pair encoding

PATH = bpe.tokenizer_path()
LETTERS = "abcdefgABCÄÖß'’strevmld  \n\t0123456789.,!?-_éèñİıΣςσǅ日本語한국어 　 ́̈ẛ̣\x1c\x85​😀👍🏽½²Ⅷ٣"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return bpe.Bpe(PATH)


def texts(n=1500, seed=4):
    rng = random.Random(seed)
    out = ["", " ", "\n\n", "a" * 5000, "é" * 300, "it's THEY'LL <|endoftext|>x<|startoftext|>", "x y " * 3000]
    for _ in range(n):
        text = "".join(rng.choice(LETTERS) for _ in range(rng.randrange(60)))
        out.append(text + rng.choice(["", "", "<|endoftext|>" + text[:4]]))
    return out


def test_ids_and_text_as_the_library_gives(own, library):
    given = texts()
    for text, ids in zip(given, own.encode(given), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        ids = np.frombuffer(ids, "<i4")
        assert ids.tolist() == want, text
        assert own.decode(ids).decode() == library.decode(want, skip_special_tokens=False)


def test_one_tree_and_many_trees_agree(own):
    rng = random.Random(2)
    symbols = list(range(60))
    ranks = {(a, b): (i, 60 + i) for i, (a, b) in enumerate(rng.sample([(a, b) for a in symbols for b in symbols], 900))}
    ranks |= {(60 + i, rng.randrange(60)): (900 + i, 1000 + i) for i in range(300)}
    words = [[rng.choice(symbols) for _ in range(rng.randrange(1, 34))] for _ in range(400)]

    def plain(word):
        word = list(word)
        while True:
            pairs = [(ranks[p], i) for i, p in enumerate(zip(word, word[1:], strict=False)) if p in ranks]
            if not pairs:
                return word
            (_, made), i = min((r, i) for r, i in pairs)
            word[i : i + 2] = [made]

    want = [plain(w) for w in words]
    assert [bpe.merge(list(w), ranks) for w in words] == want
    merged = bpe.Forest(ranks).merge(np.concatenate(words), np.array([len(w) for w in words]), 32)
    assert [np.frombuffer(w, "<i4").tolist() for w in merged] == want


def test_parts_and_memory_do_not_matter(monkeypatch, own):
    given = texts(300, 9)
    want = own.encode(given)
    for name, value in (("PART", 7), ("REMEMBERED", 5), ("LONG", 3), ("SHORT", 2), ("TOGETHER", 8)):
        monkeypatch.setattr(bpe, name, value)
    small = bpe.Bpe(PATH)
    assert small.encode(given) == want
    assert small.decode(np.frombuffer(want[-1], "<i4")) == own.decode(np.frombuffer(want[-1], "<i4"))


def test_encoded_documents(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(texts(40))] + [(3, "again", "x"), (3, "again", "x"), (None, "no id", None), (7, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    decoded = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    want, digests = [], []
    for i, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        again = library.decode(ids, skip_special_tokens=False)
        want.append((i, ids, again))
        digests.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(again.encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0, str(r[1:]))
    assert sorted([tuple(r) for r in decoded], key=key) == sorted(want, key=key)
    assert sorted([tuple(r) for r in bpe.round_trip(docs, PATH).collect()], key=key) == sorted(digests, key=key)
    assert bpe.round_trip(docs.filter("doc_id < 0"), PATH).count() == 0
    lost = spark.createDataFrame([(1, None), (2, [5, 10**6, 6])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["decoded"] for r in bpe.decode(lost, PATH).collect()} == {1: "", 2: library.decode([5, 6], skip_special_tokens=False)}


# whitening


def centred(vectors):
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    return len(x) * x - x.sum(0), len(x)


def same_space(rows, vectors, most):
    gap, n = centred([v for _, v in vectors])
    values, axes = np.linalg.eigh((gap / n).T @ (gap / n) / n)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(most, int((values > values[0] * 1e-12).sum()))
    by_id = {(r["vec_id"], r["component"]): r for r in rows}
    assert len(rows) == len(vectors) * k and len({(r["vec_id"], r["component"]) for r in rows}) == len(rows)
    got = np.array([[by_id[i, c]["whitened"] for c in range(1, k + 1)] for i, _ in vectors])
    want = (gap / n) @ axes[:, :k] / np.sqrt(values[:k])
    assert np.allclose(got @ got.T, want @ want.T, atol=1e-8)  # free of signs, and of turns among equal values
    assert np.allclose([by_id[vectors[0][0], c]["explained"] for c in range(1, k + 1)], values[:k] / values.sum(), rtol=1e-9)
    for (i, _), row in zip(vectors, gap, strict=True):
        assert by_id[i, 1]["deviation"] == sum(int(v) ** 2 for v in row) and by_id[i, 1]["n"] == n
    assert max(r["identity_error"] for r in rows) < 1e-9
    return got, want


def test_whitened_as_the_eigenvectors_say(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", 13)
    rng = np.random.default_rng(3)
    vectors = [(i, (rng.standard_normal(9) * np.arange(1, 10)).tolist()) for i in range(200)]
    bad = [(900, None), (901, []), (902, [float("nan")] * 9), (903, [1.0] * 8 + [float("inf")]), (904, [None] + [1.0] * 8), (905, [1.0] * 4)]
    given = spark.createDataFrame(vectors + bad, "vec_id long, embedding array<double>").selectExpr("*", "vec_id AS x", "1 AS whitened").repartition(5)
    got, want = same_space(whitening.whiten(given, 5).collect(), vectors, 5)
    sign = np.sign((got * want).sum(0))
    assert np.allclose(got * sign, want, atol=1e-9)


def test_low_rank_and_equal_values(spark):
    rng = np.random.default_rng(5)
    a = rng.integers(-9, 9, (50, 3)).astype(float)
    low = [(i, [*v, v[0] + v[1], 7.0, v[2]]) for i, v in enumerate(a.tolist())]
    same_space(whitening.whiten(spark.createDataFrame(low, "vec_id long, embedding array<double>")).collect(), low, 32)
    cube = [(i, [float(i >> b & 1) * 4 for b in range(4)]) for i in range(16)]  # four equal values
    same_space(whitening.whiten(spark.createDataFrame(cube, "vec_id long, embedding array<float>")).collect(), cube, 32)


def test_nothing_to_whiten(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (2, [1.0, 2.0])]):
        out = whitening.whiten(spark.createDataFrame(rows, schema))
        assert out.count() == 0 and out.columns == [c.split()[0] for c in whitening.ROWS.split(", ")]
    rows = [(None, [1.0]), (5, [2.0]), (5, [2.0]), (5, [4.0])]
    out = whitening.whiten(spark.createDataFrame(rows, schema)).collect()
    assert len(out) == 4 and sorted(r["vec_id"] or 0 for r in out) == [0, 5, 5, 5]
    with pytest.raises(Exception, match="entry"):
        whitening.whiten(spark.createDataFrame([(1, [1e30]), (2, [1.0])], schema))


# prefix trie


def trie(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            text = text or ""
            turns[conv].append((turn is not None, turn or 0, role or "", hashlib.md5(text.encode()).hexdigest(), text))
    plain = {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, own in plain.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole = tuple(plain.get(c - c % 20, [])[:h] + own[h:])
        ends[whole].append(c)
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
    saved, leaves, children = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, own in members.items():
        value = (len(own) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0)
        for d in range(len(node) + 1):
            saved[node[:d]] += value
            leaves[node[:d]] += node not in children
    out = set()
    for node, own in members.items():
        sha = hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()
        parent = min(members[node[:-1]]) if node else None
        out.add((min(own), len(node), parent, len(own), children[node], leaves[node], saved[node], sha))
    return out


def conversations(seed=1):
    rng = random.Random(seed)
    rows = [(None, 0, "user", "lost"), (7, None, None, None), (7, None, "user", ""), (7, 3, "user", "x y"), (7, 3, "user", "x y"), (7, 3, "bot", "x")]
    for c in [*range(0, 130), 10**12, 10**12 + 3]:
        if c in (20, 80):  # templates that are absent or short
            continue
        first = rng.randrange(3)
        n = 1 if c == 40 else rng.randrange(1, 7)
        for i in range(n):
            text = f"a  b\t{first}" if i == 0 else " ".join("pq"[: rng.randrange(1, 3)] for _ in range(rng.randrange(0, 3)))
            rows.append((c, i if rng.random() < 0.95 else None, "user" if i % 2 == 0 else "bot", text))
    rows += [(300, i, "user", f"t{i}") for i in range(700)]  # one long conversation
    rows += [(c, i, "user", f"t{i} again") for c in range(400, 460) for i in range(4)]  # many alike
    rows += [(500 + i, 0, "user", f"only {i}") for i in range(40)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("rest", [30, 10**6])
def test_trie_against_plain_python(spark, monkeypatch, rest):
    monkeypatch.setattr(prefix_trie, "IDS", 7)
    monkeypatch.setattr(prefix_trie, "DEPTHS", 50)
    rows = conversations()
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS depth", "2 AS p").repartition(4)
    got = prefix_trie.prefix_trie(given, rest=rest).collect()
    assert {tuple(r)[:-1] for r in got} == trie(rows) and len(got) == len(trie(rows))
    # an enter arc lies before those of its subtree
    place = {(r["conv_id"], r["depth"]): r["enter"] for r in got}
    assert len(set(place.values())) == len(got) and place[min(place, key=lambda k: k[1])] == 2 * len(got)


def test_no_conversations(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert prefix_trie.prefix_trie(spark.createDataFrame([], schema)).count() == 0
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], schema)).count() == 0
    one = prefix_trie.prefix_trie(spark.createDataFrame([(21, 0, "user", "x")], schema)).collect()
    assert {tuple(r)[:-1] for r in one} == trie([(21, 0, "user", "x")])
