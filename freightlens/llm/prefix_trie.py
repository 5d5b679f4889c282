"""The trie of conversation prefixes, summed over subtrees by the Euler-tour technique.

Every distinct sequence of first turns is a node; conversations that begin with it are its members. A node gets an
enter and an exit arc. ``tour`` links them: after the enter arc of a node comes that of its first child, or its own exit
arc; after an exit arc the enter arc of the next sibling, or the parent's exit arc. ``ranked`` list-ranks this list: it gives every
arc the sums of weights from the arc to the end of the tour. A subtree is the stretch between its arcs, so its leaves and
savings are the sums at the enter arc less those at the exit arc.

List ranking contracts the list until a bounded rest is left, then expands it again:
1. Arcs are dealt out by smallest member and depth, which puts the unshared tail of a conversation into one task; runs
   of arcs that follow each other within a task become one.
2. Rounds of coin throws: an arc that throws tails after one that throws heads is spliced out. A round takes a quarter
   of the arcs, so all rounds together move a few times the tour, and every join is one to one.
Each round is a written table, read again when the list is expanded.

No step handles a whole group in one task: turns are numbered and siblings linked over global sorted ranges with
carries from range to range, members are counted by partial aggregates, and the ids of conversations that end at one
node are sorted over ranges, only their digest is one stream of bounded blocks.

Defined results: turns are ordered by number (null first), then role, then md5 of the text; null roles and texts
are empty. Repeated rows are turns each. Rows without conv_id belong to no conversation. Texts of any length are
reduced to hashes at the scan. Other columns are ignored; an empty table has no conversation, hence no node.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, table

GROUP = 20  # conversations that share a template
HEADS = 4  # a conversation takes fewer turns than this from its template
REST = 20_000  # arcs that one task ranks at the end
DEPTHS = 512  # depths of one conversation's tail dealt to one task
IDS = 4096  # ids in one block of a node's list
END = -1

NODE = ["depth", "p", "q"]
ARC = "arc long, next long, turns long, leaves long, saved long"


def _ranged(df: DataFrame, keys: list[str], order: list[str], label: str) -> DataFrame:
    """``df`` in sorted ranges, stored, with the number of the range (``part``) and the place in it (``place``)."""
    sorted_rows = df.repartitionByRange(*[F.col(k).asc_nulls_first() for k in keys]).sortWithinPartitions(*[F.col(k).asc_nulls_first() for k in order])
    return stored(sorted_rows.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")), label)


def content(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest of the text, two hashes of role and text, and the number of words."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(text)
    return conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        digest.alias("digest"),
        *[F.xxhash64(F.lit(seed), role, digest, F.length(text)).alias(name) for name, seed in (("a", 1), ("b", 2))],
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )


def numbered(turns: DataFrame) -> DataFrame:
    """``content`` rows with ``i``, their place in the conversation from 1, however long it is."""
    order = ["conv_id", "turn", "role", "digest"]
    rows = _ranged(turns, order, order, "trie-turns")
    in_part = Window.partitionBy("part", "conv_id").orderBy("place")
    rows = rows.withColumn("i", F.row_number().over(in_part))
    # at most one row per range and conversation; the window runs over the ranges that hold the conversation
    counts = rows.groupBy("conv_id", "part").count()
    carried = F.coalesce(F.sum("count").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    carry = counts.select("conv_id", "part", carried.alias("carried")).filter("carried > 0")
    rows = rows.join(carry, ["conv_id", "part"], "left")
    return stored(rows.select("conv_id", "part", (F.col("i") + F.coalesce("carried", F.lit(0))).alias("i"), "a", "b", "words"), "trie-numbered")


def _step(seed: int, j, hashed):
    """The hash of a turn at its place; a prefix is the exclusive-or of its turns."""
    return F.xxhash64(F.lit(seed), j.cast("int"), hashed)


def _head_hash(upto, hashed: str, seed: int):
    """The hash of the first ``upto`` entries of ``head``."""
    steps = F.transform(F.slice("head", F.lit(1), upto), lambda x: _step(seed, x["i"], x[hashed]))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(y))


def rebuilt(turns: DataFrame, group: int = GROUP, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """Prefixes of the rebuilt conversations: (prefixes, conversations).

    prefixes: conv_id, depth from 0, p and q (128-bit hash of the first turns), pp and pq (without the last turn),
    words of the last turn. conversations: conv_id and its number of rebuilt turns.
    """
    template = F.col("conv_id") - F.col("conv_id") % group
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    own = turns.withColumn("h", taken).withColumn("t", template)
    convs = own.groupBy("conv_id").agg(F.max("i").alias("n"), F.first("h").alias("h"), F.first("t").alias("t"))
    # the first turns of the templates, one row each
    first = turns.filter((F.col("conv_id") % group == 0) & (F.col("i") < heads)).groupBy(F.col("conv_id").alias("t"))
    first = first.agg(F.sort_array(F.collect_list(F.struct("i", "a", "b", "words"))).alias("head"))  # fewer than `heads` entries
    convs = convs.join(first, "t", "left").withColumn("head", F.slice(F.coalesce("head", F.array().cast(first.schema["head"].dataType)), F.lit(1), F.col("h")))
    convs = convs.withColumn("got", F.size("head"))
    convs = convs.withColumn("p0", _head_hash(F.col("got"), "a", 3)).withColumn("q0", _head_hash(F.col("got"), "b", 4))
    convs = stored(convs.select("conv_id", "n", "h", "got", "head", "p0", "q0"), "trie-conversations")

    tail = own.filter("i > h").select("conv_id", "part", "i", "a", "b", "words")
    tail = tail.join(convs.select("conv_id", "h", "got", "p0", "q0"), "conv_id")
    tail = tail.withColumn("depth", (F.col("i") - F.col("h") + F.col("got")).cast("int"))
    tail = tail.withColumn("sp", _step(3, F.col("depth"), F.col("a"))).withColumn("sq", _step(4, F.col("depth"), F.col("b")))
    # running exclusive-or within a range, carried over the ranges of a conversation
    so_far = Window.partitionBy("part", "conv_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    whole = tail.groupBy("conv_id", "part").agg(F.bit_xor("sp").alias("xp"), F.bit_xor("sq").alias("xq"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carry = whole.select("conv_id", "part", F.bit_xor("xp").over(earlier).alias("cp"), F.bit_xor("xq").over(earlier).alias("cq")).filter("cp IS NOT NULL")
    tail = tail.join(carry, ["conv_id", "part"], "left")
    for p, s, c, start in (("p", "sp", "cp", "p0"), ("q", "sq", "cq", "q0")):
        tail = tail.withColumn(p, F.bit_xor(s).over(so_far).bitwiseXOR(F.coalesce(c, F.lit(0))).bitwiseXOR(F.col(start)))
    tail = tail.select("conv_id", "depth", "p", "q", F.col("p").bitwiseXOR(F.col("sp")).alias("pp"), F.col("q").bitwiseXOR(F.col("sq")).alias("pq"), "words")

    head = convs.select("conv_id", "head", F.explode(F.sequence(F.lit(0), F.col("got"))).alias("depth"))
    last = F.greatest(F.col("depth") - 1, F.lit(0))
    head = head.select(
        "conv_id",
        F.col("depth").cast("int").alias("depth"),
        _head_hash(F.col("depth"), "a", 3).alias("p"),
        _head_hash(F.col("depth"), "b", 4).alias("q"),
        _head_hash(last, "a", 3).alias("pp"),
        _head_hash(last, "b", 4).alias("pq"),
        F.coalesce(F.get("head", F.col("depth") - 1)["words"], F.lit(0)).alias("words"),
    )
    ends = convs.select("conv_id", (F.col("got") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("int").alias("depth"))
    return stored(head.unionByName(tail), "trie-prefixes"), ends


def nodes(prefixes: DataFrame) -> DataFrame:
    """One row per node with its smallest member and members, in sorted ranges of siblings, numbered by ``id``."""
    found = prefixes.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"),
        F.count("*").alias("n_convs"),
        F.first("pp").alias("pp"),
        F.first("pq").alias("pq"),
        F.first("words").alias("words"),
    )
    return _ranged(found, ["depth", "pp", "pq", "conv_id"], ["depth", "pp", "pq", "conv_id"], "trie-nodes").withColumnRenamed("place", "id")


def linked(found: DataFrame) -> DataFrame:
    """Nodes with the id of their next sibling and first child, and the id of their last child."""
    here = Window.partitionBy("part").orderBy("id")
    rows = found.withColumn("after", F.lead(F.struct("depth", "pp", "pq", "id")).over(here))
    # the first node of each range follows the last one of the range before: one row per range
    first = found.groupBy("part").agg(F.min(F.struct("id", "depth", "pp", "pq")).alias("first"))
    first = first.select("part", F.lead(F.struct("first.depth", "first.pp", "first.pq", "first.id")).over(Window.orderBy("part")).alias("beyond"))
    rows = rows.join(first, "part", "left").withColumn("after", F.coalesce("after", "beyond"))
    same = (F.col("after.depth") == F.col("depth")) & (F.col("after.pp") == F.col("pp")) & (F.col("after.pq") == F.col("pq")) & (F.col("depth") > 0)
    rows = rows.withColumn("sibling", F.when(same, F.col("after.id"))).drop("after", "beyond")
    children = found.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pp").alias("p"), F.col("pq").alias("q"))
    children = children.agg(F.min("id").alias("first_child"), F.max("id").alias("last_child"), F.count("*").alias("n_children"))
    rows = rows.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    return stored(rows, "trie-linked")


def tour(rows: DataFrame) -> DataFrame:
    """The Euler tour: every arc with the arc after it, its weights, and a key that puts tails of conversations together.

    The enter arc of node ``id`` is 2 * id, its exit arc 2 * id + 1.
    """
    enter, leave = F.col("id") * 2, F.col("id") * 2 + 1
    key = F.xxhash64("conv_id", F.floor(F.col("depth") / DEPTHS))
    leaf = F.col("n_children") == 0
    down = rows.select(
        enter.alias("arc"),
        F.when(leaf, leave).otherwise(F.col("first_child") * 2).alias("next"),
        F.when(leaf, 1).otherwise(0).cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
        key.alias("key"),
    )
    zero = F.lit(0).cast("long")
    up = rows.filter("sibling IS NOT NULL OR depth = 0")
    up = up.select(leave.alias("arc"), F.coalesce(F.col("sibling") * 2, F.lit(END)).alias("next"), zero.alias("leaves"), zero.alias("saved"), key.alias("key"))
    # the exit arc of a last child leads to its parent's
    out = rows.filter(~leaf).select((F.col("last_child") * 2 + 1).alias("arc"), leave.alias("next"), zero.alias("leaves"), zero.alias("saved"), key.alias("key"))
    arcs = down.unionByName(up).unionByName(out)
    return arcs.select("arc", "next", F.lit(1).cast("long").alias("turns"), "leaves", "saved", "key")


def _local(arc: np.ndarray, after: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs within these arcs: for each arc the arc after its run, the sums to the end of the run, and whether it leads one."""
    order = np.argsort(arc)
    place = np.minimum(np.searchsorted(arc, after, sorter=order), len(arc) - 1)
    target = np.where(arc[order[place]] == after, order[place], -1)
    heads = np.ones(len(arc), bool)
    heads[target[target >= 0]] = False
    beyond, total = after.copy(), weights.copy()
    while (live := np.flatnonzero(target >= 0)).size:
        # doubling: every arc takes over what its target has so far
        to = target[live]
        total[live] += total[to]
        beyond[live] = beyond[to]
        target[live] = target[to]
    return beyond, total, heads


def _runs(batches):
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    whole = pa.Table.from_batches(batches)
    arc, after, *weights = (whole.column(c).to_numpy() for c in ("arc", "next", "turns", "leaves", "saved"))
    beyond, total, heads = _local(arc, after, np.array(weights).T)
    arrays = [pa.array(x) for x in (arc, beyond, total[:, 0].copy(), total[:, 1].copy(), total[:, 2].copy(), heads)]
    yield from pa.Table.from_arrays(arrays, ["arc", "next", "turns", "leaves", "saved", "head"]).to_batches(100_000)


WEIGHTS = ["turns", "leaves", "saved"]


def ranked(arcs: DataFrame, rest: int = REST) -> DataFrame:
    """arc and, for each weight, the sum from the arc to the end of the tour (itself included)."""
    # 1. runs within a task
    dealt = arcs.repartition("key").drop("key")
    runs = stored(dealt.mapInArrow(_runs, ARC + ", head boolean"), "tour-runs")
    left = runs.filter("head").drop("head")
    gone = [runs.filter("NOT head").drop("head")]
    # 2. coin throws
    count, k = left.count(), 0
    while count > rest:
        k += 1
        thrown = left.withColumn("tails", F.pmod(F.xxhash64(F.lit(k), "arc"), F.lit(2)) == 1)
        follows = (F.col("a.next") == F.col("b.arc")) & ~F.col("a.tails")
        joined = thrown.alias("a").join(thrown.filter("tails").alias("b"), follows, "left")
        spliced = F.col("b.arc").isNotNull()
        step = joined.select(
            F.col("a.arc").alias("arc"),
            F.when(spliced, F.col("b.next")).otherwise(F.col("a.next")).alias("next"),
            *[F.when(spliced, F.col(f"a.{w}") + F.col(f"b.{w}")).otherwise(F.col(f"a.{w}")).alias(w) for w in WEIGHTS],
            F.when(spliced, F.struct(F.col("b.arc").alias("arc"), F.col("b.next").alias("next"), *[F.col(f"b.{w}").alias(w) for w in WEIGHTS])).alias("out"),
        )
        step = stored(step, f"tour-spliced-{k}")
        out = step.filter("out IS NOT NULL").select("out.*")
        gone.append(out)
        left = stored(step.drop("out").join(out.select("arc"), "arc", "left_anti"), f"tour-left-{k}")
        count = left.count()
    # 3. a bounded rest in one task
    known = left.coalesce(1).mapInArrow(_runs, ARC + ", head boolean").drop("next", "head")
    known = stored(known, "tour-rest")
    # 4. back again: what was spliced out adds the sums of the arc after it
    for k, out in enumerate(reversed(gone)):
        back = out.alias("a").join(known.alias("b"), F.col("a.next") == F.col("b.arc"), "left")
        back = back.select("a.arc", *[(F.col(f"a.{w}") + F.coalesce(F.col(f"b.{w}"), F.lit(0))).alias(w) for w in WEIGHTS])
        known = stored(known.unionByName(back), f"tour-known-{k}")
    return known


def _id_blocks(batches):
    """Sorted (depth, p, q, conv_id) rows of one range to blocks of joined ids per node."""
    key, ids = None, []

    def block():
        depth, p, q = key
        return {"depth": depth, "p": p, "q": q, "start": ids[0], "ids": ",".join(map(str, ids))}

    schema = pa.schema([("depth", pa.int32()), ("p", pa.int64()), ("q", pa.int64()), ("start", pa.int64()), ("ids", pa.string())])
    for batch in batches:
        out = []
        for depth, p, q, conv in zip(*(batch.column(c).to_pylist() for c in ("depth", "p", "q", "conv_id")), strict=True):
            if key != (depth, p, q) or len(ids) >= IDS:
                if ids:
                    out.append(block())
                key, ids = (depth, p, q), []
            ids.append(conv)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
    if ids:
        yield pa.RecordBatch.from_pylist([block()], schema)


def _digest_blocks(batches):
    """Blocks in order of node and first id to one digest per node; only the running digest is held."""
    key, sha = None, None
    schema = pa.schema([("depth", pa.int32()), ("p", pa.int64()), ("q", pa.int64()), ("ends_sha256", pa.string())])
    for batch in batches:
        out = []
        for depth, p, q, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "p", "q", "ids")), strict=True):
            if key != (depth, p, q):
                if sha:
                    out.append({"depth": key[0], "p": key[1], "q": key[2], "ends_sha256": sha.hexdigest()})
                key, sha = (depth, p, q), hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
    if sha:
        yield pa.RecordBatch.from_pylist([{"depth": key[0], "p": key[1], "q": key[2], "ends_sha256": sha.hexdigest()}], schema)


def end_digests(prefixes: DataFrame, ends: DataFrame) -> DataFrame:
    """Per node at which conversations end: the digest of their ids."""
    last = prefixes.join(ends, ["conv_id", "depth"]).select("depth", "p", "q", "conv_id")
    keys = ["depth", "p", "q", "conv_id"]
    blocks = last.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(_id_blocks, "depth int, p long, q long, start long, ids string")
    blocks = blocks.repartition(*NODE).sortWithinPartitions(*NODE, "start")
    return blocks.mapInArrow(_digest_blocks, "depth int, p long, q long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, group: int = GROUP, heads: int = HEADS, rest: int = REST) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256, and ``enter``, the place of its enter arc in the tour, counted from the end."""
    turns = numbered(content(conversations))
    prefixes, ends = rebuilt(turns, group, heads)
    found = nodes(prefixes)
    rows = linked(found)
    sums = ranked(tour(rows), rest)
    entering = F.col("arc") % 2 == 0
    per_node = sums.groupBy(F.shiftright("arc", 1).alias("id")).agg(
        F.sum(F.when(entering, F.col("leaves")).otherwise(-F.col("leaves"))).alias("n_leaves"),
        F.sum(F.when(entering, F.col("saved")).otherwise(-F.col("saved"))).alias("saved_tokens"),
        F.max(F.when(entering, F.col("turns"))).alias("enter"),
    )
    # a parent's smallest member is looked up once per range of siblings, so a parent of many is no hot key
    parents = rows.filter("depth > 0").select("part", (F.col("depth") - 1).alias("depth"), F.col("pp").alias("p"), F.col("pq").alias("q")).distinct()
    parents = parents.join(rows.select(*NODE, F.col("conv_id").alias("parent_conv_id")), NODE)
    parents = parents.select("part", (F.col("depth") + 1).alias("depth"), F.col("p").alias("pp"), F.col("q").alias("pq"), "parent_conv_id")
    out = rows.join(per_node, "id").join(parents, ["part", "depth", "pp", "pq"], "left")
    out = out.join(end_digests(prefixes, ends), NODE, "left")
    return out.select(
        "conv_id",
        F.col("depth").cast("long").alias("depth"),
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
        "enter",
    )


def op13_prefix_trie(spark, sf_dir):
    return prefix_trie(table(spark, sf_dir, "conversations")).drop("enter")


# crc32 by the bits of each digit; a prefix is a list of (role, text), whose ancestors are its slices
OP13_SQL = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS i
   FROM conversations WHERE conv_id IS NOT NULL),
 own AS (SELECT conv_id, list([role, text] ORDER BY i) AS turns FROM t GROUP BY conv_id),
 h AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''),
   lambda c: [ascii(c)::BIGINT, 256, 256, 256, 256, 256, 256, 256, 256]))),
   lambda s, x: CASE WHEN x < 256 THEN xor(s, x) ELSE xor(s >> 1, (s & 1) * 3988292384) END), 4294967295) % 4 AS h FROM own),
 r AS (SELECT h.conv_id, list_concat(coalesce(b.turns[1:h.h], []), h.turns[h.h + 1:]) AS turns
   FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 20),
 prefixes AS (SELECT conv_id, len(turns) AS n, d.depth, turns[1:d.depth] AS node FROM r, LATERAL (SELECT unnest(range(len(turns) + 1)) AS depth) d),
 nodes AS (SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
   coalesce(string_agg(CASE WHEN n = depth THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '') AS ends FROM prefixes GROUP BY node, depth),
 children AS (SELECT node[1:depth - 1] AS node, depth - 1 AS depth, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
 valued AS (SELECT n.*, coalesce(c.n, 0) AS n_children, p.conv_id AS parent_conv_id,
   (n.n_convs - 1) * CASE WHEN n.depth = 0 THEN 0 ELSE len(regexp_extract_all(n.node[n.depth][2], '[^\x20\x09-\x0D]+')) END AS saved
   FROM nodes n LEFT JOIN children c ON c.depth = n.depth AND c.node = n.node
   LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.node = n.node[1:n.depth - 1]),
 up AS (SELECT node[1:d.depth] AS node, d.depth, n_children = 0 AS leaf, saved FROM valued v, LATERAL (SELECT unnest(range(v.depth + 1)) AS depth) d),
 sums AS (SELECT node, depth, count(*) FILTER (leaf) AS n_leaves, sum(saved) AS saved_tokens FROM up GROUP BY node, depth)
SELECT v.conv_id, v.depth::BIGINT AS depth, v.parent_conv_id, v.n_convs, v.n_children, s.n_leaves::BIGINT AS n_leaves,
 s.saved_tokens::BIGINT AS saved_tokens, sha256(v.ends) AS ends_sha256
FROM valued v JOIN sums s ON s.depth = v.depth AND s.node = v.node
"""
