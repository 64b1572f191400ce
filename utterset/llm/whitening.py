"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

1. Vectors become whole numbers, x = floor(64 c) + 1000000; the distinct ones (the fit
   list) are written once, packed into binary blocks. Their number n and sums S are exact,
   so a centred row, (n x - S) / n, is a rounded exact value.
2. The centred rows C are brought to bidiagonal form, C V = U B. A step is one pass over
   the blocks: u = C v - beta u', its products with all earlier left vectors and C'u. The
   left vectors are as long as the fit list and never leave the tasks: each is C p, and
   only its p (one number a dimension) is kept. Tasks return one row of sums each.
3. Left and right vectors are fully reorthogonalised at each step. A vanishing step is
   restarted with a random direction outside the space so far, so that equal eigenvalues
   and rank deficiency are handled. Passes end when the wanted components have
   converged, checked by one more random start, or when the space is exhausted.
4. The small bidiagonal matrix's SVD gives components and deviations.

Edge cases: rows whose vector is null or holds null or non-finite entries are dropped,
as are those of another length than the most frequent one (of equally frequent ones the
longest); directions without variance give no component, so that fewer than the wanted
number come out, none for a single distinct vector or an empty table. Entries whose x is
no 64-bit integer fail the job. Repeated rows count once in the fit and are all
returned; extra columns pass through, those named like an added one are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stored, widened, without

SCALE, SHIFT = 64, 1_000_000
#: Vectors of a stored block.
BLOCK = 4096
#: Tasks of a pass over the blocks, at most: each returns one row of sums to the driver.
TASKS = 4096
#: A step counts as vanished, and a component as converged, at this share of the largest deviation.
VANISHED, CONVERGED = 1e-11, 2e-15
#: Steps after the random start that checks a converged result.
CHECK_STEPS = 8


@dataclass(frozen=True)
class Whitening:
    """A fit: ``n`` distinct vectors of sums ``sums``; the columns of ``components`` by
    falling eigenvalue, ``explained`` shares of the trace, and the largest absolute entry
    of the whitened fit list's covariance minus the identity."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float


def whole_numbers(vectors: DataFrame, column: str) -> DataFrame:
    """The rows with a usable vector, as ``__x`` array<bigint> beside their columns."""
    finite = F.forall(F.col(column), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    usable = vectors.filter(F.col(column).isNotNull() & finite)
    size = usable.groupBy(F.size(column).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if size is not None:
        usable = usable.filter(F.size(column) == size["size"])
    return usable.withColumn("__x", F.transform(column, lambda c: F.floor(c.cast("double") * SCALE) + SHIFT))


def _matrix(column: pa.ListArray) -> np.ndarray:
    """The vectors of a list column, which are equally long, as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _blocks(fit: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("__x")).astype("<i8")
            parts = [x[at : at + BLOCK] for at in range(0, len(x), BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array([len(p) for p in parts], pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())],
                                             names=["n", "block"])

    return fit.mapInArrow(run, "n long, block binary")


def _sums(blocks: DataFrame, product: Callable[[np.ndarray], np.ndarray], size: int, kind: str = "double") -> np.ndarray:
    """The sum of ``product`` (an array of ``size`` numbers for a block's rows) over all
    blocks. A task returns one row; rows are added in the order of the tasks."""
    width = {"double": "<f8", "long": "<i8"}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, width)
        for batch in batches:
            for n, block in zip(batch.column("n").to_pylist(), batch.column("block"), strict=True):
                total += product(np.frombuffer(block.as_buffer(), "<i8").reshape(n, -1))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([total.tobytes()], pa.binary())], names=["task", "total"])

    rows = blocks.coalesce(TASKS).mapInArrow(run, "task long, total binary").collect()  # TASKS rows at most
    return sum((np.frombuffer(r["total"], width) for r in sorted(rows, key=lambda r: r["task"])), np.zeros(size, width))


def _outside(space: np.ndarray, v: np.ndarray) -> np.ndarray:
    """``v`` without its part in the span of the columns of ``space``."""
    for _ in range(2):
        v = v - space @ (space.T @ v)
    return v


class Bidiagonal:
    """The bidiagonal form of C so far: right vectors ``v`` and, of the left vectors
    C p, their ``p`` and ``back`` = C' C p."""

    def __init__(self, d: int, step: Callable[[np.ndarray, np.ndarray], np.ndarray], seed: int = 42):
        self.d, self.step, self.rng = d, step, np.random.default_rng(seed)
        self.v, self.p, self.back = (np.zeros((d, 0)) for _ in range(3))
        self.alpha, self.beta = [], []
        self.next, self.link = None, 0.0
        self.restart()

    def restart(self) -> None:
        """Go on with a random direction outside the space so far."""
        fresh = _outside(self.v, self.rng.standard_normal(self.d))
        self.next, self.link = fresh / np.linalg.norm(fresh), 0.0

    def scale(self) -> float:
        return max([*self.alpha, *self.beta, 0.0])

    def extend(self) -> None:
        """One more pair of vectors, with one pass over the rows."""
        k, v = len(self.alpha), self.next
        q = v - self.link * self.p[:, -1] if k else v
        found = self.step(q, self.p)
        back, inner, norm2 = found[: self.d], found[self.d : self.d + k], found[-1]
        q, back = q - self.p @ inner, back - self.back @ inner
        alpha = float(np.sqrt(max(norm2 - inner @ inner, 0.0)))
        vanished = alpha <= VANISHED * max(self.scale(), alpha) or alpha == 0.0
        self.beta.append(self.link)
        self.alpha.append(0.0 if vanished else alpha)
        self.v = np.column_stack([self.v, v])
        self.p = np.column_stack([self.p, np.zeros(self.d) if vanished else q / alpha])
        self.back = np.column_stack([self.back, np.zeros(self.d) if vanished else back / alpha])
        rest = _outside(self.v, self.back[:, -1] - self.alpha[-1] * v)
        self.link = float(np.linalg.norm(rest))
        if len(self.alpha) == self.d:
            self.link = 0.0
        elif vanished or self.link <= VANISHED * self.scale():
            self.restart()
        else:
            self.next = rest / self.link

    def svd(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Left vectors' weights, falling deviations (times the root of n) and right vectors."""
        small = np.diag(self.alpha) + np.diag(self.beta[1:], 1)
        left, sigma, right = np.linalg.svd(small)
        return left, sigma, self.v @ right.T

    def run(self, want: int) -> None:
        checked = None
        while len(self.alpha) < self.d:
            self.extend()
            k = len(self.alpha)
            if k < min(want, self.d) or k == self.d or (checked is not None and k < checked + CHECK_STEPS):
                continue
            left, sigma, _ = self.svd()
            if self.link * np.abs(left[-1, :want]).max() <= CONVERGED * sigma[0]:
                if checked is not None:
                    return
                checked = k
                self.restart()


def fit(vectors: DataFrame, column: str = "embedding", components: int = 16) -> Whitening:
    """Fit on the distinct whole-number vectors of ``vectors``."""
    blocks = stored(_blocks(whole_numbers(vectors, column).select("__x").distinct()), "vectors")
    first = blocks.select("n", F.length("block").alias("bytes")).first()
    if first is None or first["bytes"] == 0:
        return Whitening(0, np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0), np.zeros(0), 0.0)
    n, d = blocks.agg(F.sum("n")).first()[0], first["bytes"] // 8 // first["n"]
    sums = _sums(blocks, lambda x: x.sum(axis=0), d, "long")

    def centred(x: np.ndarray) -> np.ndarray:
        return (n * x - sums) / n

    def step(q: np.ndarray, p: np.ndarray) -> np.ndarray:
        def product(x):
            c = centred(x)
            u = c @ q
            return np.concatenate((u @ c, u @ (c @ p), [u @ u]))
        return _sums(blocks, product, d + p.shape[1] + 1)

    form = Bidiagonal(d, step)
    form.run(components)
    _, sigma, right = form.svd()
    keep = int((sigma[:components] > max(VANISHED * sigma[0], 0.0)).sum())
    basis, e = right[:, :keep], sigma[:keep] ** 2 / n
    basis = basis * np.where(basis[np.abs(basis).argmax(axis=0), np.arange(keep)] < 0, -1.0, 1.0)
    root = np.sqrt(e)

    def moments(x):
        c = centred(x)
        w = c @ basis / root
        return np.concatenate(((w.T @ w).ravel(), w.sum(axis=0), [np.einsum("ij,ij->", c, c)]))

    found = _sums(blocks, moments, keep * keep + keep + 1)
    mean = found[keep * keep : -1] / n
    error = np.abs(found[: keep * keep].reshape(keep, keep) / n - np.outer(mean, mean) - np.eye(keep)).max(initial=0.0)
    return Whitening(n, sums, basis, e, e / (found[-1] / n) if keep else e, float(error))


def _squares(x: np.ndarray, n: int, sums: np.ndarray) -> pa.Array:
    """Exact sums over the dimensions of (n x - S)^2."""
    away = n * x - sums
    if len(away) == 0 or float(np.abs(away).max(initial=0)) ** 2 * away.shape[1] < 2.0**62:
        return pa.array((away * away).sum(axis=1), pa.int64()).cast(pa.decimal128(38, 0))
    return pa.array([Decimal(sum(int(a) ** 2 for a in row)) for row in away], pa.decimal128(38, 0))


def transform(vectors: DataFrame, model: Whitening, column: str = "embedding") -> DataFrame:
    """The usable rows of ``vectors`` with ``deviation`` (decimal: exact at any size) and
    ``whitened`` (one double a component). Rows of another length than the fit's have none."""
    rows = whole_numbers(without(vectors, "deviation", "whitened"), column)
    if model.n:
        rows = rows.filter(F.size("__x") == len(model.sums))
    names = [c for c in rows.columns if c != "__x"]
    axes = model.components / np.sqrt(model.eigenvalues)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("__x")) if model.n else np.zeros((batch.num_rows, 0), np.int64)
            out = (model.n * x - model.sums) / max(model.n, 1) @ axes if axes.size else np.zeros((len(x), 0))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * out.shape[1], pa.int32()), pa.array(out.ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), _squares(x, model.n, model.sums), lists], names=[*names, "deviation", "whitened"])

    return rows.mapInArrow(run, widened(rows.drop("__x"), deviation="decimal(38,0)", whitened="array<double>"))


def by_component(rows: DataFrame, model: Whitening, id_column: str = "vec_id") -> DataFrame:
    """One row for each of ``transform``'s rows and component, numbered from 1."""
    shares = F.array(*[F.lit(float(e)) for e in model.explained]).cast("array<double>")
    long = rows.select(id_column, F.col("deviation").cast("long").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    return long.select(id_column, (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                       F.element_at(shares, F.col("at") + 1).alias("explained"), F.lit(model.identity_error).alias("identity_error"))
