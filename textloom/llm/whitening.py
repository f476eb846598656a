"""Embedding whitening by QDWH spectral divide and conquer.

Spark sums the vectors, then their centred products, in tasks that hold one Arrow batch
and one matrix of the dimension squared. The eigenvectors of that matrix come from polar
decompositions: the orthogonal factor of ``A - sI``, found by QR-based dynamically
weighted Halley iteration, is the matrix's sign, and ``(sign + I) / 2`` projects on the
eigenvectors above s. Bases of both sides shrink the problem, side by side, until a
block is one component or a multiple of the identity. Upper sides come first, and no
side is split that holds none of the components asked for. The few components are sent
to all tasks, which whiten every vector.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import kept
from .clusters import matrix
from .shared_files import ready

SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
_EPS = np.finfo(float).eps
#: Integers below this can be summed over 2**24 rows of a task in a long.
LARGEST = 2**38


def polar(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix: its sign, for eigenvalues other than 0."""
    n = len(a)
    x = a / np.linalg.norm(a)
    try:
        least = 1 / np.linalg.norm(np.linalg.inv(x))
    except np.linalg.LinAlgError:
        least = 0.0
    least = min(1.0, max(least, _EPS))
    for _ in range(30):
        if 1 - least < 4 * _EPS:
            break
        square = least * least
        d = np.cbrt(4 * (1 - square) / square**2)
        root = np.sqrt(1 + d)
        p = root + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - square) / (square * root))
        q = (p - 1) ** 2 / 4
        r = p + q - 1
        if r > 100:
            tall, _ = np.linalg.qr(np.vstack([np.sqrt(r) * x, np.eye(n)]))
            step = tall[:n] @ tall[n:].T / np.sqrt(r)
        else:
            step = np.linalg.solve(np.eye(n) + r * x.T @ x, x.T).T
        x = q / r * x + (p - q / r) * step
        x = (x + x.T) / 2
        least = min(1.0, least * (p + q * square) / (1 + r * square))
    return x


def _sides(a: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of the eigenvectors above and below a shift, None if no shift parts them."""
    n = len(a)
    diagonal = np.sort(np.diag(a))
    if np.linalg.norm(a - np.eye(n) * diagonal.mean()) <= 4 * n * _EPS * scale:
        return None
    draw = np.random.default_rng(n)
    spread, best = np.linalg.norm(a - np.eye(n) * diagonal.mean()), None
    # The middle of the diagonal lies among the eigenvalues; if it meets one of them, a shift beside it does not.
    for nudge in (0.0, 1e-3, -1e-3, 1e-2, -1e-2, 0.1, -0.1, 0.3, -0.3):
        shift = (diagonal[(n - 1) // 2] + diagonal[n // 2]) / 2 + nudge * spread / np.sqrt(n)
        above = (polar(a - shift * np.eye(n)) + np.eye(n)) / 2
        size = int(round(np.trace(above)))
        if not 0 < size < n:
            continue
        base = draw.standard_normal((n, size))
        for _ in range(3):
            base, _ = np.linalg.qr(above @ base)
        whole, _ = np.linalg.qr(base, mode="complete")
        up, down = whole[:, :size], whole[:, size:]
        left = np.linalg.norm(up.T @ a @ down)
        if best is None or left < best[0]:
            best = (left, up, down)
        if left <= 4 * n * _EPS * scale:
            break
    return best[1:] if best else None


def eigenpairs(a: np.ndarray) -> Iterator[tuple[float, np.ndarray]]:
    """Eigenvalues, falling, with unit eigenvectors, of a symmetric matrix."""
    scale = np.linalg.norm(a)
    todo = [(a, np.eye(len(a)))]
    while todo:
        own, base = todo.pop()
        parted = _sides(own, scale) if len(own) > 1 else None
        if parted is None:
            values = np.diag(own)
            for i in np.argsort(-values, kind="stable"):
                yield float(values[i]), base[:, i]
            continue
        for side in reversed(parted):  # the upper side is taken from the end next
            inner = side.T @ own @ side
            todo.append(((inner + inner.T) / 2, base @ side))


def _long_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(id, x)`` of the rows whose vector has finite components; x is ``floor(1024 * c) + 100000``."""
    vector = F.col(vector_col)
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + OFFSET)
    return rows.filter(vector.isNotNull() & (F.size(vector) > 0) & finite).select(F.col(id_col).alias("id"), whole.alias("x"))


def _sums(rows: DataFrame, make: Callable[[pa.RecordBatch], np.ndarray], kind: str) -> np.ndarray:
    """Entries of the arrays that ``make`` gives for batches, summed over all tasks."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = make(batch)
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_pydict({"i": np.arange(len(total)), "v": total})

    found = rows.mapInArrow(partial, f"i long, v {kind}").groupBy("i").agg(F.sum("v").alias("v"))
    return np.array([r["v"] for r in found.orderBy("i").collect()])


def _moments(rows: DataFrame, dim: int, kind: str):
    """Size, sums, and covariance (divisor n) of a list column, centred before it is multiplied."""

    def counted(batch: pa.RecordBatch) -> np.ndarray:
        x = matrix(batch.column(0), dim)
        return np.concatenate([[len(x)], x.sum(axis=0)])

    totals = _sums(rows, counted, kind)
    n, sums = int(totals[0]), totals[1:]
    if kind == "long":
        centre = sums // n  # a whole number near the mean keeps the products whole; what is left is corrected below
        rest = (sums - n * centre) / n
    else:
        centre, rest = sums / n, np.zeros(dim)

    def products(batch: pa.RecordBatch) -> np.ndarray:
        y = (matrix(batch.column(0), dim) - centre).astype(float)
        return (y.T @ y).ravel()

    covariance = _sums(rows, products, "double").reshape(dim, dim) / n - np.outer(rest, rest)
    return n, sums, (covariance + covariance.T) / 2


def _deviation(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Exact sum of ``(n x - S)^2`` of each row; null where it doesn't fit a long."""
    if len(x) and n * int(np.abs(x).max()) + int(np.abs(sums).max()) < 2**62:
        apart = n * x - sums
        if int(np.abs(apart).max()) ** 2 * x.shape[1] < 2**63:
            return (apart * apart).sum(axis=1).tolist()
    own = [sum((n * v - s) ** 2 for v, s in zip(row, sums.tolist(), strict=True)) for row in x.tolist()]
    return [v if v < 2**63 else None for v in own]


def _whiten_dimension(rows: DataFrame, dim: int, components: int, id_type: str) -> DataFrame:
    n, sums, covariance = _moments(rows.select("x"), dim, "long")
    pairs = list(islice(eigenpairs(covariance), components))
    trace, top = float(np.trace(covariance)), max((e for e, _ in pairs), default=0.0)
    flat = [e <= dim * _EPS * max(top, trace) for e, _ in pairs]
    base = np.stack([np.zeros(dim) if f else v / np.sqrt(e) for (e, v), f in zip(pairs, flat, strict=True)], axis=1)
    mean = sums / n

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"), dim).astype(np.int64)
            # n x - S is whole, so a mean that no double holds costs no accuracy.
            apart = (x - mean) if n * float(np.abs(x).max(initial=0)) >= 2.0**62 else (n * x - sums) / n
            z = apart @ base
            z = pa.ListArray.from_arrays(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1], pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(_deviation(x, n, sums), pa.int64()), z], names=["id", "deviation", "z"])

    whitened = kept(rows.mapInArrow(apply, f"id {id_type}, deviation long, z array<double>"), "whitened")
    own = np.array([not f for f in flat])
    error = None
    if own.any():
        _, _, spread = _moments(whitened.select("z"), len(pairs), "double")
        error = float(np.abs(spread - np.eye(len(pairs)))[np.ix_(own, own)].max())

    at = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("component"))
    rows = whitened.select("id", "deviation", F.posexplode("z").alias("k", "value")).withColumn("component", F.col("k") + 1)
    explained: Column = at([e / trace for e, _ in pairs]) if trace > 0 else F.lit(None).cast("double")
    return rows.select(
        "id", "component", F.lit(n).cast("long").alias("n"), "deviation",
        F.when(at([bool(o) for o in own]), F.col("value")).alias("whitened"),
        explained.alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per vector and component: ``(id_col, component, n, deviation, whitened, explained, identity_error)``.

    Rows whose vector is null, empty or holds a null or non-finite entry have none; all
    others are fitted and whitened, repeated ones each time, also those with a null id.
    Vectors of different lengths can't share a covariance: each length is a fit of its
    own. Components go by falling eigenvalue, at most ``components`` and at most the
    dimension. Where a component's eigenvalue is 0 (fewer vectors than components,
    constant entries) ``whitened`` is null and it doesn't count in ``identity_error``;
    without any spread ``explained`` and ``identity_error`` are null. ``deviation`` is null
    where the exact number exceeds a long. No vectors give no rows; other columns,
    whatever their names, are not read. Entries of 2^28 or more are an error.
    """
    spark = rows.sparkSession
    ready(spark)
    id_type = rows.schema[id_col].dataType.simpleString()
    out = f"id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    found = kept(_long_vectors(rows, id_col, vector_col), "long-vectors")
    largest = found.select(F.max(F.greatest(F.array_max("x"), -F.array_min("x")))).first()[0]
    if largest is not None and largest >= LARGEST:
        raise ValueError(f"entries of {LARGEST // SCALE} or more: sums would not fit a long")
    dims = sorted(r[0] for r in found.select(F.size("x")).distinct().collect())
    result = spark.createDataFrame([], out)
    for i, dim in enumerate(dims):
        own = _whiten_dimension(found.filter(F.size("x") == dim), dim, components, id_type)
        result = own if i == 0 else result.unionByName(own)
    return result.withColumnRenamed("id", id_col)
