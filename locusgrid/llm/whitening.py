"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

The centred vectors are the rows of X. Two distributed products alternate: u = Xv over the rows of all
tasks, and Xᵀu, summed over them. Both sequences are reorthogonalised in full at each step. The
singular values and right vectors of the small bidiagonal matrix give the components and deviations.

A left vector has an entry for each row, so it is never gathered or stored: it lies in the span of
X, and ``u = Xp`` keeps it as p, which is as short as an embedding. Tasks compute what they need of it
from their rows: one pass over the rows gives the new u, its products with all left vectors before, and
Xᵀu. The driver holds a few vectors of the embeddings' dimension for each step.

The rows are stored once, in blocks of whole numbers; sums over them are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, stored

COMPONENTS = 8
BLOCK_ROWS = 4096
#: Whole numbers are floor(SCALE * c) + SHIFT (fixed by the contract).
SCALE, SHIFT = 1024, 100_000
#: Entries up to here are whole numbers that a double holds exactly.
EXACT = 2.0 ** 52
#: A triplet has converged when its residual is below this part of the largest singular value.
CONVERGED = 1e-14
#: Parts along earlier left vectors up to here, of its length, are taken off without another pass, and
#: the most passes of a step.
ORTHOGONAL = 1e-9
PASSES = 4
#: A length below this part of the matrix's is none.
ROUNDING = 1e-15
#: Deviations below this part of the largest are rounding, and their components are left out.
RANK = 1e-9
INT64 = 2 ** 63 - 1


def scaled(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x, dim): entries as floor(1024 * c) + 100000. Left out are vectors that are null, empty, hold
    null or non-finite entries, or entries too large for an exact whole number (2**52)."""
    c = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    fine = F.forall(c, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < EXACT / SCALE))
    kept = vectors.select(F.col(id_col).cast("long").alias("vec_id"), c.alias("c")).filter(
        F.col("c").isNotNull() & (F.size("c") > 0)).filter(F.coalesce(fine, F.lit(False)))
    return kept.select("vec_id", F.transform("c", lambda c: F.floor(c * SCALE).cast("long") + SHIFT).alias("x"),
                       F.size("c").alias("dim"))


def to_blocks(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(dim, ids, x): up to ``block_rows`` vectors of one dimension as little-endian 64-bit numbers. A block
    ends with its Arrow batch."""

    def packed(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                held = batch.column(1).take(pa.array(rows)).flatten().to_numpy().reshape(-1, dim)
                for k in range(0, len(rows), block_rows):
                    yield int(dim), [ids[i] for i in rows[k:k + block_rows]], held[k:k + block_rows].astype("<i8").tobytes()

    return map_rows(rows.select("vec_id", "x", "dim"), packed, "dim int, ids array<long>, x binary", 16)


def _matrices(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.Scalar, np.ndarray]]:
    for batch in batches:
        for ids, x in zip(batch.column("ids"), batch.column("x")):
            yield ids, np.frombuffer(x.as_py(), "<i8").reshape(-1, dim)


class Rows:
    """The vectors of one dimension as distributed rows of a centred matrix."""

    def __init__(self, blocks: DataFrame, dim: int):
        self.blocks, self.dim = blocks.filter(F.col("dim") == dim), dim
        size = F.size("ids").cast("long")
        self.n = self.blocks.agg(F.sum(size)).first()[0]
        # The parts of each number above and below 2**31 are summed apart, so no sum wraps.
        low = self._summed(lambda x: (x & 0x7FFFFFFF).sum(axis=0), "decimal(38,0)")
        high = self._summed(lambda x: (x >> 31).sum(axis=0), "decimal(38,0)")
        self.sums = [int(a) + (int(b) << 31) for a, b in zip(low, high)]

    def _summed(self, of: Callable, kind: str = "double") -> list:
        """Sums over all rows of a vector that ``of`` makes of each block: added up within a task, then by
        place, so what reaches the driver is as long as that vector."""
        dim = self.dim

        def parts(batches: Iterator[pa.RecordBatch]):
            total = None
            for _, x in _matrices(batches, dim):
                total = of(x) if total is None else total + of(x)
            if total is not None:
                yield from enumerate(total.tolist())

        own = "long" if kind.startswith("decimal") else kind
        found = map_rows(self.blocks, parts, f"place int, value {own}").groupBy("place").agg(
            F.sum(F.col("value").cast(kind)).alias("value"))
        return [r["value"] for r in sorted(found.collect(), key=lambda r: r["place"])]

    def centred(self) -> Callable[[np.ndarray], np.ndarray]:
        """x - S/n. Whole numbers are taken apart first, so nothing is lost where the mean is large."""
        n, whole = self.n, np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([(s % self.n) / n for s in self.sums])
        return lambda x: (x - whole).astype(np.float64) - rest

    def total(self, of: Callable) -> np.ndarray:
        """Sum over all rows of what ``of`` makes of a block of centred rows."""
        centred = self.centred()
        return np.array(self._summed(lambda x: np.atleast_1d(of(centred(x))).ravel()))


class Bidiagonal:
    """Golub-Kahan-Lanczos steps on ``rows`` until the ``k`` largest triplets have converged, at most as many
    as the dimension; then the Krylov space is all there is."""

    def __init__(self, rows: Rows, k: int):
        self.rows, self.dim = rows, rows.dim
        self.v: list[np.ndarray] = []
        self.p: list[np.ndarray] = []  # left vector j is X p[j]
        self.z: list[np.ndarray] = []  # and its product with the transpose of X is z[j]
        self.b = np.zeros((rows.dim, rows.dim + 1))
        self.scale = np.sqrt(rows.total(lambda x: (x * x).sum(axis=1).sum())[0])
        self.random = np.random.default_rng(12)
        v = self._fresh()
        while v is not None and self.scale > 0 and len(self.v) < self.dim:
            v = self._step(v)
            if v is not None and self._settled(k):
                break

    def _clear(self, v: np.ndarray) -> np.ndarray:
        """``v`` without its parts along the right vectors so far; twice is enough."""
        for _ in range(2):
            for w in self.v:
                v = v - (w @ v) * w
        return v

    def _fresh(self) -> np.ndarray | None:
        """A unit vector orthogonal to all right vectors: to begin with, and where the recurrence ends early
        (repeated deviations, or a data set of lower rank)."""
        v = self._clear(self.random.normal(size=self.dim))
        return v / np.linalg.norm(v) if len(self.v) < self.dim else None

    def _step(self, v: np.ndarray) -> np.ndarray | None:
        j = len(self.v)
        self.v.append(v)
        # u = Xv - beta * (left vector before), then made orthogonal to all left vectors.
        p = v - self.b[j - 1, j] * self.p[j - 1] if j else v
        d = self.dim
        for _ in range(PASSES):
            held = np.stack([*self.p, p], axis=1)
            both = self.rows.total(lambda x: (lambda u: np.append(x.T @ u[:, -1], u.T @ u[:, -1]))(x @ held))
            z, on, square = both[:d], both[d:-1], both[-1]
            # What is left along them is taken off p, and from both results by linearity.
            p = p - held[:, :-1] @ on
            z = z - np.stack([*self.z, np.zeros(d)], axis=1)[:, :j] @ on
            alpha = np.sqrt(max(square - on @ on, 0.0))
            # A large part makes the difference inexact: the product is taken anew.
            if not len(on) or np.abs(on).max() <= ORTHOGONAL * alpha or alpha <= self.scale * ROUNDING:
                break
        if alpha <= self.scale * ROUNDING:
            self.p.append(np.zeros(d))
            self.z.append(np.zeros(d))
            return self._fresh()
        self.p.append(p / alpha)
        self.z.append(z / alpha)
        self.b[j, j] = alpha
        w = self._clear(z / alpha)
        beta = np.linalg.norm(w)
        if beta <= self.scale * ROUNDING:
            return self._fresh()
        if j + 1 < self.dim:
            self.b[j, j + 1] = beta
        return w / beta

    def _settled(self, k: int) -> bool:
        j = len(self.v)
        if j < min(k + 1, self.dim):
            return False
        left, s, _ = np.linalg.svd(self.b[:j, :j])
        return bool((self.b[j - 1, j] * np.abs(left[-1, :k]) <= CONVERGED * s[0]).all())

    def triplets(self) -> tuple[np.ndarray, np.ndarray]:
        """(deviations of the sum over rows, components as columns), falling."""
        j = len(self.v)
        _, s, right = np.linalg.svd(self.b[:j, :j])
        return s, np.stack(self.v, axis=1) @ right.T


def components(rows: Rows, k: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues e, components as columns, trace of the covariance). The entry that is largest of a
    component is positive. Eigenvalues that are rounding are left out."""
    found = Bidiagonal(rows, k)
    if not found.scale > 0:
        return np.zeros(0), np.zeros((rows.dim, 0)), 0.0
    s, v = found.triplets()
    s, v = s[:k], v[:, :k]
    keep = s > RANK * s[0]
    s, v = s[keep], v[:, keep]
    v = v / np.linalg.norm(v, axis=0)
    v = v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])
    return s * s / rows.n, v, found.scale ** 2 / rows.n


def deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n*x - S)**2, exact; null where it is no 64-bit number."""
    most = max(max(abs(n * int(top) - s), abs(n * int(low) - s)) for top, low, s in zip(x.max(axis=0), x.min(axis=0), sums))
    if n * (np.abs(x).max() + 1) < INT64 and most * most * len(sums) < INT64:
        away = n * x - np.array(sums, np.int64)
        return (away * away).sum(axis=1).tolist()
    exact = (sum((n * int(c) - s) ** 2 for c, s in zip(row, sums)) for row in x)
    return [d if d <= INT64 else None for d in exact]


def projected(rows: Rows, k: int) -> DataFrame:
    """The result for the vectors of one dimension."""
    e, v, trace = components(rows, k)
    centred, n, sums, dim = rows.centred(), rows.n, rows.sums, rows.dim
    onto = v / np.sqrt(e)
    error = 0.0
    if len(e):
        second = rows.total(lambda x: (lambda w: w.T @ w)(x @ onto)).reshape(len(e), -1) / n
        first = rows.total(lambda x: (x @ onto).sum(axis=0)) / n
        error = float(np.abs(second - np.outer(first, first) - np.eye(len(e))).max())
    explained = (e / trace).tolist() if len(e) else []

    def rows_of(batches: Iterator[pa.RecordBatch]):
        for ids, x in _matrices(batches, dim):
            away = deviation(x, n, sums)
            white = (centred(x) @ onto).tolist()
            for vec, d, row in zip(ids.as_py(), away, white):
                for c, (w, share) in enumerate(zip(row, explained)):
                    yield vec, c + 1, n, d, w, share, error

    return map_rows(rows.blocks, rows_of, "vec_id long, component int, n long, deviation long, whitened double, "
                                          "explained double, identity_error double")


def whitened(vectors: DataFrame, k: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): each vector on the ``k``
    components of largest variance, over the standard deviation.

    Left-out vectors: see ``scaled``. Vectors of different dimensions are fitted apart. A repeated row counts
    and is returned as often as it stands there; a null vec_id stays null. Components without variance
    are left out, so equal vectors, or a single one, give no rows, and so does an empty table. Equal
    eigenvalues take any orthogonal components of their space. Other columns are ignored.
    """
    blocks = stored(to_blocks(scaled(vectors, id_col, vector_col)), "embedding-blocks")
    dims = sorted(r["dim"] for r in blocks.select("dim").distinct().collect())
    parts = [projected(Rows(blocks, dim), k) for dim in dims]
    if not parts:
        return projected_schema(vectors)
    return reduce(DataFrame.unionByName, parts)


def projected_schema(vectors: DataFrame) -> DataFrame:
    return vectors.sparkSession.createDataFrame(
        [], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
