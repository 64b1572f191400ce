"""Softmax regression by L-BFGS over sparse rows that stay on the executors (ML-4).

The model is a network without hidden layers. Spark ML's trainer of such networks copies
every row into a dense vector of all features and keeps these while it trains: 33 KB a row
at 4,096 features. Here a row is its own non-zero entries, in two binary columns, written
once to the shared folder. Each task reads its rows as a stream and returns one sum of the
size of the weights, so memory depends on neither the rows nor their length.

Objective and steps are those of that trainer: the cross entropy is a mean over blocks of
``BLOCK`` rows of a partition, a block's being the mean of its rows; ten corrections; a line
search by the strong Wolfe conditions with cubic interpolation (Nocedal and Wright, Numerical
Optimization, 2nd edition, algorithms 3.5, 3.6 and 7.4).
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import slices
from ..session import cut_lineage, ensure_shipped
from .grams import counted

#: Rows that are one term of the mean together.
BLOCK = 128
CORRECTIONS = 10
#: Non-zero entries a task works on at a time (or one row).
ENTRIES = 1 << 18
#: Steps of a line search, of its narrowing, and the two Wolfe constants.
SEARCHES, ZOOMS, DECREASE, CURVATURE = 10, 10, 1e-4, 0.9
Point = tuple[float, float, float]
#: Features and values of some rows, whose numbers of entries are given.
Entries = Callable[[pa.RecordBatch, np.ndarray], tuple[np.ndarray, np.ndarray]]


class StepError(ArithmeticError):
    """No step along the direction lowers the loss enough."""


def _in_blocks(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """``(label, share, n, at, value)`` of a partition's rows, ``BLOCK`` of them at a time."""
    while held := list(itertools.islice(rows, BLOCK)):
        label, n, at, value = zip(*held, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array([1.0 / len(held)] * len(held)), pa.array(n, pa.int32()),
                                          pa.array(at, pa.binary()), pa.array(value, pa.binary())], names=["label", "share", "n", "at", "value"])


def sparse_rows(x: DataFrame, num_features: int, label_col: str = "label_idx", features_col: str = "features") -> DataFrame:
    """``(label, share, n, at, value)``: a row's class, its share in the mean of its block, and
    its ``n`` non-zero entries as little-endian int32 and float64. ``features`` are sparse vectors."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            label, vectors = batch.column(0).to_numpy().astype(np.int32), batch.column(1)
            entries = [vectors.field(vectors.type.get_field_index(name)) for name in ("type", "indices", "values")]
            for i in range(batch.num_rows):
                kind, at, value = (c[i] for c in entries)
                value = value.values.to_numpy()
                at = at.values.to_numpy() if kind.as_py() == 0 else np.arange(num_features)
                yield label[i], len(value), at.astype("<i4").tobytes(), value.astype("<f8").tobytes()

    ensure_shipped(x.sparkSession)
    return cut_lineage(x.select(label_col, features_col).mapInArrow(lambda batches: _in_blocks(rows(batches)), "label int, share double, n int, at binary, value binary"))


def _place_type(num_features: int) -> str:
    return "<u2" if num_features <= 1 << 16 else "<i4"


def _gram_rows(batches: Iterator[pa.RecordBatch], num_features: int) -> Iterator[tuple]:
    kind = _place_type(num_features)
    for batch in batches:
        for part in slices(batch, batch.column("text")):
            own = part.column(0).to_pylist()
            for first, n, at, count in counted(part.column("text").to_pylist(), num_features):
                at, count, ends = at.astype(kind), count.astype("<u4"), np.cumsum(n).tolist()
                for i, (a, b) in enumerate(zip([0, *ends], ends)):
                    yield own[first + i], b - a, at[a:b].tobytes(), count[a:b].tobytes()


def counted_rows(x: DataFrame, num_features: int, label_col: str = "label_idx", text_col: str = "text") -> DataFrame:
    """As ``sparse_rows``, of the counts of texts' hashed grams (``grams``): 6 bytes an entry up to 65,536 features."""
    ensure_shipped(x.sparkSession)
    held = x.select(F.col(label_col).cast("int").alias("label"), F.col(text_col).alias("text"))
    return cut_lineage(held.mapInArrow(lambda batches: _in_blocks(_gram_rows(batches, num_features)), "label int, share double, n int, at binary, value binary"))


def named_rows(x: DataFrame, num_features: int, label_col: str, text_col: str = "text") -> DataFrame:
    """``(y, n, at, value)``: as ``counted_rows``, with the label itself and no share."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _gram_rows(batches, num_features)
        while held := list(itertools.islice(rows, BLOCK)):
            y, n, at, value = zip(*held, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.string()), pa.array(n, pa.int32()), pa.array(at, pa.binary()), pa.array(value, pa.binary())],
                                             names=["y", "n", "at", "value"])

    ensure_shipped(x.sparkSession)
    return cut_lineage(x.select(F.col(label_col).cast("string").alias("y"), F.col(text_col).alias("text")).mapInArrow(run, "y string, n int, at binary, value binary"))


def inverse_frequencies(rows: DataFrame, num_features: int) -> np.ndarray:
    """Spark ML's IDF of ``counted_rows``; one sum a core."""
    kind = _place_type(num_features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents, holders = 0, np.zeros(num_features, np.int64)
        for batch in batches:
            documents += batch.num_rows
            holders += np.bincount(_bytes(batch.column("at"), kind), minlength=num_features)
        yield pa.RecordBatch.from_arrays([pa.array([documents]), pa.array([holders.tobytes()], pa.binary())], names=["documents", "holders"])

    sums = rows.select("at").coalesce(max(1, rows.sparkSession.sparkContext.defaultParallelism)).mapInArrow(run, "documents long, holders binary").collect()
    documents, holders = sum(r["documents"] for r in sums), sum((np.frombuffer(r["holders"], np.int64) for r in sums), np.zeros(num_features, np.int64))
    return np.where(holders > 0, np.log((documents + 1.0) / (holders + 1.0)), 0.0)


def _bytes(column: pa.Array, kind: str) -> np.ndarray:
    """The values of binary strings in a row, without a copy."""
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(data, kind, (int(ends[-1]) - int(ends[0])) // np.dtype(kind).itemsize, int(ends[0])) if len(column) and data else np.zeros(0, kind)


def _plain(batch: pa.RecordBatch, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features and values of rows as ``sparse_rows`` writes them."""
    return _bytes(batch.column("at"), "<i4"), _bytes(batch.column("value"), "<f8")


def weighed(idf: np.ndarray) -> Entries:
    """Features and values of ``counted_rows``: counts times ``idf``, each row of unit length."""
    kind = _place_type(len(idf))

    def entries(batch: pa.RecordBatch, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = _bytes(batch.column("at"), kind)
        value = _bytes(batch.column("value"), "<u4") * idf[at]
        length = np.sqrt(_row_sums(value * value, n))
        return at, value / np.repeat(np.where(length > 0, length, 1.0), n)

    return entries


def _row_sums(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of ``n`` values in a row each."""
    out, some = np.zeros(len(n)), n > 0
    if len(x):
        out[some] = np.add.reduceat(x, (np.cumsum(n) - n)[some])
    return out


def _scores(n: np.ndarray, at: np.ndarray, value: np.ndarray, weights: np.ndarray, classes: int) -> np.ndarray:
    """Each row's scores, less that of the last class without its intercept, which changes no probability."""
    w, intercept = weights[:-classes].reshape(-1, classes), weights[-classes:]
    scores = np.tile(intercept, (len(n), 1))
    for k in range(classes - 1):
        scores[:, k] += _row_sums(value * (w[:, k] - w[:, -1])[at], n)
    return scores


def loss_and_gradient(label: np.ndarray, share: np.ndarray, n: np.ndarray, at: np.ndarray, value: np.ndarray,
                      weights: np.ndarray, classes: int) -> tuple[float, np.ndarray]:
    """Sums over some rows. The weights are those of a dense layer: a column of ``classes`` for
    each feature, then the intercepts."""
    width = len(weights) // classes - 1
    scores = _scores(n, at, value, weights, classes)
    scores -= scores.max(axis=1, keepdims=True)
    total = np.log(np.exp(scores).sum(axis=1))
    loss = float((share * (total - scores[np.arange(len(n)), label])).sum())
    error = np.exp(scores - total[:, None])
    error[np.arange(len(n)), label] -= 1.0
    error *= share[:, None]
    out = np.zeros((width, classes))
    for k in range(classes - 1):
        out[:, k] = np.bincount(at, value * np.repeat(error[:, k], n), width)
    out[:, -1] = -out.sum(axis=1)  # a row's errors add up to 0
    return loss, np.concatenate((out.ravel(), error.sum(axis=0)))


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of about ``ENTRIES`` entries (or one row)."""
    part = (np.cumsum(batch.column("n").to_numpy().astype(np.int64)) - 1).clip(0) // ENTRIES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def predicted(rows: DataFrame, weights: np.ndarray, labels: list[str], entries: Entries) -> DataFrame:
    """``(y, pred)`` of ``named_rows``."""
    classes = max(2, len(labels))
    held = rows.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _parts(batch):
                n = some.column("n").to_numpy()
                best = _scores(n, *entries(some, n), held.value, classes).argmax(axis=1).tolist()
                yield pa.RecordBatch.from_arrays([some.column("y"), pa.array([labels[k] if k < len(labels) else None for k in best], pa.string())], names=["y", "pred"])

    return rows.mapInArrow(run, "y string, pred string")


def objective(rows: DataFrame, classes: int, entries: Entries = _plain) -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
    """The mean loss and its gradient at given weights; one job each, one sum a core."""
    spark = rows.sparkSession
    blocks = rows.agg(F.sum("share")).first()[0] or 0.0
    streams = rows.coalesce(max(1, spark.sparkContext.defaultParallelism))

    def at_weights(weights: np.ndarray) -> tuple[float, np.ndarray]:
        held = spark.sparkContext.broadcast(weights)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loss, gradient = 0.0, np.zeros(len(held.value))
            for batch in batches:
                for some in _parts(batch):
                    label, share, n = (some.column(c).to_numpy() for c in ("label", "share", "n"))
                    more, slope = loss_and_gradient(label, share, n, *entries(some, n), held.value, classes)
                    loss, gradient = loss + more, gradient + slope
            yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([gradient.tobytes()], pa.binary())], names=["loss", "gradient"])

        sums = streams.mapInArrow(run, "loss double, gradient binary").collect()
        held.destroy()
        return sum(r["loss"] for r in sums) / blocks, sum(np.frombuffer(r["gradient"]) for r in sums) / blocks

    return at_weights


def _cubic(a: Point, b: Point) -> float:
    """The lowest place of the cubic through two points of a line, kept away from both."""
    (s, f, d), (t, g, e) = (a, b) if a[0] <= b[0] else (b, a)
    x = d + e - 3 * (f - g) / (s - t)
    root = x * x - d * e
    y = math.sqrt(root) if root >= 0 else math.nan
    below = e - d + 2 * y
    at = t - (t - s) * (e + y - x) / below if below else math.nan
    low, high = s + 0.1 * (t - s), s + 0.9 * (t - s)
    return low if at < low else high if at > high else at


def _line_search(phi: Callable[[float], Point], step: float) -> float:
    """A step that meets the strong Wolfe conditions; ``phi`` gives place, loss and slope."""
    start = low = phi(0.0)
    _, first, slope = start
    if slope > 0:
        raise StepError("not a descent direction")

    def zoom(low: Point, high: Point) -> float:
        for _ in range(ZOOMS):
            c = phi(_cubic(low, high))
            if c[1] > first + DECREASE * c[0] * slope or c[1] >= low[1]:
                high = c
                continue
            if abs(c[2]) <= CURVATURE * abs(slope):
                return c[0]
            if c[2] * (high[0] - low[0]) >= 0:
                high = low
            low = c
        raise StepError("no step between the bounds")

    for i in range(SEARCHES):
        c = phi(step)
        if not math.isfinite(c[1]):
            step /= 2
            continue
        if c[1] > first + DECREASE * step * slope or (c[1] >= low[1] and i):
            return zoom(low, c)
        if abs(c[2]) <= CURVATURE * abs(slope):
            return c[0]
        if c[2] >= 0:
            return zoom(c, low)
        low = c
        step *= 1.5
    raise StepError("no step found")


def _direction(gradient: np.ndarray, history: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Minus the gradient times the inverse Hessian told by the last steps, newest first."""
    out, kept = gradient.copy(), []
    scale = 1.0
    if history:
        step, change = history[0]
        curve = step @ change
        if not curve >= 0:
            raise StepError("the steps tell no curvature")
        scale = curve / (change @ change)
    for step, change in history:
        rho = step @ change
        alpha = (step @ out) / rho
        if math.isnan(alpha):
            raise StepError("the steps tell no curvature")
        out -= alpha * change
        kept.append((alpha, rho))
    out *= scale
    for (step, change), (alpha, rho) in zip(reversed(history), reversed(kept), strict=True):
        out += (alpha - (change @ out) / rho) * step
    return -out


def minimize(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, iterations: int, tolerance: float) -> tuple[np.ndarray, float]:
    """``iterations`` steps of L-BFGS from ``x``, fewer if the loss stays or the gradient is
    about zero. A failed step is tried once more from the gradient alone. Returns ``(x, loss)``."""
    last: dict = {}

    def at(place: np.ndarray) -> tuple[float, np.ndarray]:
        key = place.tobytes()
        if key not in last:
            kept = f(place)
            last.clear()  # the step that a search ends with is the one it tried last
            last[key] = kept
        return last[key]

    x = np.array(x, dtype=float)
    loss, gradient = at(x)
    begun, losses, history, failed, number = loss, [math.inf], [], False, 0
    while number < iterations and np.linalg.norm(gradient) > max(tolerance * loss, 1e-8):
        if len(losses) > 1 and abs(loss - max(losses)) <= tolerance * begun:
            break
        try:
            way = _direction(gradient, history)

            def phi(t: float, x=x, way=way, here=(loss, gradient)) -> Point:
                value, slope = here if t == 0 else at(x + way * t)
                return t, value, float(slope @ way)

            length = _line_search(phi, 1.0 if number else 1.0 / float(np.linalg.norm(way)))
            if length * np.linalg.norm(gradient) < 1e-10:
                raise StepError("the step is too small")
        except StepError:
            if failed:
                break
            failed, history = True, []
            continue
        moved = x + way * length
        value, slope = at(moved)
        history = [(moved - x, slope - gradient), *history][:CORRECTIONS]
        x, loss, gradient, failed, number = moved, value, slope, False, number + 1
        losses = [*losses, loss][-20:]
    return x, loss
