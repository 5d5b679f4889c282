"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Entries are turned into integers and centred exactly (n times the entry minus the column sum) before anything is
multiplied. With X the centred rows, the method alternates Xv and X'u and yields X V = U B with V and U of orthonormal
columns and B upper bidiagonal, here up to the full dimension, so the small matrix has exactly X's singular values.
Its decomposition B = P S Q' gives the components V Q and the deviations S / sqrt(n).

Rows stay where they lie, in blocks. A left vector is never stored: U = X W for a small matrix W that the
recurrence gives, so a task works out its rows of U anew. One pass over the blocks makes u = X y, the products U'u
against which u is orthogonalised, and X'u; only these few numbers come back, through a tree of sums. Right vectors are
orthogonalised twice where they are kept. Where a vector vanishes (X has lower rank, or equal singular values) the
next one starts from a new direction orthogonal to all before.

The driver holds V, W and B, whose size is the square of the vector length and does not grow with the rows.

Defined results: vectors that are null, empty, or hold a null or a non-finite entry take no part, and neither do
vectors whose length differs from the commonest one (of equally common the greater). Repeated rows, repeated ids and
null ids are rows each. Directions without deviation cannot be whitened and have no rows, so equal vectors, a single
vector or an empty table give none. Other columns are ignored. Integer entries of 2^31 or more, and products beyond 64
bits, raise an error.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, table

COMPONENTS = 32
BLOCK = 2048  # vectors per block
SCALE, SHIFT = 64, 1_000_000
LIMIT = 1 << 31  # entries of the integer vectors stay below

BLOCKS = "ids array<long>, x binary"
ROWS = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def integer_vectors(rows: DataFrame, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """vec_id, x (array of long): floor(scale * entry) + shift, for the vectors that take part."""
    entry = F.transform(F.col("embedding").cast("array<double>"), lambda c: F.floor(c * scale).cast("long") + shift)
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    wild = F.exists("embedding", lambda c: F.abs(c.cast("double")) * scale + abs(shift) >= float(LIMIT))
    found = rows.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite)
    checked = F.when(wild, F.raise_error(F.lit(f"an entry is {LIMIT} or more"))).otherwise(entry)
    return found.select(F.col("vec_id").cast("long").alias("vec_id"), checked.alias("x"))


def _blocks(batches):
    """Batches of vectors of one length to blocks of whole matrices."""
    for batch in batches:
        for a in range(0, batch.num_rows, BLOCK):
            part = batch.slice(a, BLOCK)
            x = part.column("x").flatten().to_numpy(zero_copy_only=False).astype("<i8")
            ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("vec_id"))
            yield pa.RecordBatch.from_arrays([ids, pa.array([x.tobytes()], pa.binary())], ["ids", "x"])


class Centred:
    """The integer vectors in blocks, with their number and exact column sums."""

    def __init__(self, vectors: DataFrame):
        """``vectors``: vec_id and x, as ``integer_vectors`` gives them."""
        kept = stored(vectors, "whitening-vectors")
        lengths = kept.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
        self.n, self.d = (lengths["count"], lengths["d"]) if lengths else (0, 0)
        same = kept.filter(F.size("x") == self.d)
        self.blocks = stored(same.mapInArrow(_blocks, BLOCKS), "whitening-blocks")
        self.sums = np.zeros(self.d, np.int64)
        if not self.n:
            return
        d, n = self.d, self.n

        def total(batches):
            s, top = np.zeros(d, np.int64), np.zeros(d, np.int64)
            for batch in batches:
                for x in batch.column("x"):
                    x = np.frombuffer(x.as_buffer(), "<i8").reshape(-1, d)
                    s += x.sum(0)
                    np.maximum(top, np.abs(x).max(0), out=top)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array(s), pa.array(top)], ["i", "s", "top"])

        sums = self.blocks.select("x").mapInArrow(total, "i long, s long, top long")
        sums = sums.groupBy("i").agg(F.sum("s").alias("s"), F.max("top").alias("top"))
        for r in sums.collect():  # one row per dimension
            if n * r["top"] >= 1 << 62:
                raise OverflowError("n times an entry is beyond 64 bits")
            self.sums[r["i"]] = r["s"]
        sums = self.sums

        def centre(x):
            return (np.frombuffer(x, "<i8").reshape(-1, d) * n - sums) / n

        self.matrices = self.blocks.select("x").rdd.map(lambda r: centre(r["x"])).persist(StorageLevel.MEMORY_AND_DISK)

    def sum_over(self, work) -> np.ndarray:
        """The sum of ``work(matrix)`` over all blocks of centred rows.

        Every task adds up its blocks, a square root of the number of tasks add these sums up, and as many
        arrays come back.
        """

        def added(parts):
            out = None
            for y in parts:
                out = y if out is None else out + y
            return [] if out is None else [out]

        sums = self.matrices.mapPartitions(lambda parts: added(map(work, parts)))
        sums = sums.repartition(math.isqrt(sums.getNumPartitions() - 1) + 1).mapPartitions(added)
        return sum(sums.collect())

    def free(self) -> None:
        if self.n:
            self.matrices.unpersist()


def _fresh(basis: list[np.ndarray], d: int, rng: np.random.Generator) -> np.ndarray:
    """A unit vector orthogonal to ``basis``."""
    while True:
        v = rng.standard_normal(d)
        for _ in range(2):
            for b in basis:
                v -= b * (b @ v)
        size = np.linalg.norm(v)
        if size > 1e-8:
            return v / size


def bidiagonalise(rows: Centred, seed: int = 1) -> tuple[np.ndarray, np.ndarray, float]:
    """V (d by d), B (d by d, upper bidiagonal) and the sum of squares of all centred entries."""
    d, rng = rows.d, np.random.default_rng(seed)
    squares = float(rows.sum_over(lambda x: np.array([np.einsum("ij,ij->", x, x)]))[0])
    tiny = np.sqrt(squares) * 1e-13
    basis = [_fresh([], d, rng)]
    W = np.zeros((d, d))  # U = X W; columns beyond the step are zero
    G = np.zeros((d, d))  # X'U
    B = np.zeros((d, d))
    beta = 0.0
    for j in range(d):
        v = basis[j]
        y = v - beta * W[:, j - 1] if j else v.copy()
        alpha = 0.0
        for _ in range(3):

            def products(x, y=y, W=W):
                u = x @ y
                left = x @ W
                return np.concatenate([left.T @ u, x.T @ u, [u @ u]])

            got = rows.sum_over(products)
            overlap, back, size = got[:d], got[d : 2 * d], got[-1]
            y = y - W @ overlap
            back = back - G @ overlap
            left = size - overlap @ overlap
            # a vector that was mostly overlap has lost digits: take its products anew
            if left > 0.5 * size or np.sqrt(max(size, 0.0)) <= tiny:
                alpha = float(np.sqrt(max(left, 0.0)))
                break
        if alpha > tiny:
            W[:, j], G[:, j] = y / alpha, back / alpha
            B[j, j] = alpha
            r = G[:, j] - alpha * v
        else:
            r = np.zeros(d)
        if j + 1 == d:
            break
        for _ in range(2):
            for b in basis:
                r = r - b * (b @ r)
        beta = float(np.linalg.norm(r))
        if beta > tiny:
            basis.append(r / beta)
            B[j, j + 1] = beta
        else:
            beta = 0.0
            basis.append(_fresh(basis, d, rng))
    return np.array(basis).T, B, squares


def components(rows: Centred, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit components (columns), their eigenvalues and their shares of the whole variance, greatest first."""
    if not rows.n:
        return np.zeros((0, 0)), np.zeros(0), np.zeros(0)
    V, B, squares = bidiagonalise(rows)
    _, s, Qt = np.linalg.svd(B)
    k = min(most, int((s > s[0] * 1e-10).sum()) if s[0] > 0 else 0)
    found = V @ Qt[:k].T
    return found / np.linalg.norm(found, axis=0), s[:k] ** 2 / rows.n, s[:k] ** 2 / squares if squares else s[:k]


def whiten(embeddings: DataFrame, most: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    rows = Centred(integer_vectors(embeddings, scale, shift))
    axes, values, shares = components(rows, most)
    k, n, d, sums = len(values), rows.n, rows.d, rows.sums
    if not k:
        rows.free()
        return embeddings.sparkSession.createDataFrame([], ROWS)
    project = axes / np.sqrt(values)

    def moments(x):
        w = x @ project
        return np.concatenate([w.sum(0)[None], w.T @ w])

    got = rows.sum_over(moments) / n
    rows.free()
    error = float(np.abs(got[1:] - np.outer(got[0], got[0]) - np.eye(k)).max())

    def run(batches):
        for batch in batches:
            for ids, x in zip(batch.column("ids"), batch.column("x"), strict=True):
                gap = np.frombuffer(x.as_buffer(), "<i8").reshape(-1, d) * n - sums
                m = len(gap)
                if float(np.abs(gap).max()) ** 2 * d >= 2.0**63:
                    exact = [sum(int(v) ** 2 for v in g) for g in gap]
                    if max(exact) >= 1 << 63:
                        raise OverflowError("a squared deviation is beyond 64 bits")
                    deviation = np.array(exact, np.int64)
                else:
                    deviation = (gap * gap).sum(1)
                w = (gap / n) @ project
                arrays = [
                    pa.array(np.repeat(np.arange(m), k)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n)),
                    pa.array(np.repeat(deviation, k)),
                    pa.array(w.ravel()),
                    pa.array(np.tile(shares, m)),
                    pa.array(np.full(m * k, error)),
                ]
                arrays[0] = ids.values.take(arrays[0])  # ids may be null
                yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in ROWS.split(", ")])

    return rows.blocks.mapInArrow(run, ROWS)


def op12_whitening(spark, sf_dir):
    return whiten(table(spark, sf_dir, "embeddings"))
