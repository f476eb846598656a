"""Centroid clustering over a VA-file: few-bit cells first, full vectors only where they decide.

Vectors become integers and are written once, in blocks, to files of the shared
folder; a block also holds every vector's approximation, ``bits`` bits a dimension
that say in which of ``2**bits`` equal cells the component lies. In a round a task
reads a block's approximations alone. Lookup tables by (dimension, cell, centroid)
sum up to an interval for each centroid's distance; a vector whose smallest interval
overlaps no other is assigned at once, the others' full vectors are fetched and
compared exactly. Centroids move by the sums of vectors that changed their cluster, so
only those are fetched besides. Intervals are kept narrow by leaving out what all
centroids have in common: ``|x-c|^2 - |x|^2 + 2x.m = |c|^2 - 2x.(c-m)`` for the mean
centroid m.

All arithmetic is on 64-bit integers, so results don't depend on partitions. Only
centroids, and sums of the same size, reach the driver.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import kept, shared_dir
from .shared_files import new_folder, place, ready

SCALE = 1024
DIM, CLUSTERS, ROUNDS = 64, 8, 10
#: Bits of a cell. Six leave 17 of 1,024 steps to a cell of the given vectors.
CELL_BITS = 6
#: Vectors of one block: 4 MB of 64 components.
BLOCK = 16_384
#: Integers up to this make every squared distance of 64 components fit a long.
LARGEST = 2**27
#: Beyond this share of a block, one read of the whole is cheaper than reads of its rows.
WHOLE_SHARE = 0.25


def integers(rows: DataFrame, id_col: str, vector_col: str, dim: int) -> DataFrame:
    """``(id, x)`` of the rows whose vector has ``dim`` finite components; x is ``floor(SCALE * component)``."""
    vector = F.col(vector_col)
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE))
    return rows.filter((F.size(vector) == dim) & finite).select(F.col(id_col).cast("long").alias("id"), whole.alias("x"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column whose lists have ``dim`` numbers each, as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _bounds(rows: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Least and largest integer of each dimension, None without rows."""

    def extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = None
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0), dim)
                a, b = x.min(axis=0), x.max(axis=0)
                low, high = (a, b) if low is None else (np.minimum(low, a), np.maximum(high, b))
        if low is not None:
            yield pa.RecordBatch.from_pydict({"j": np.arange(dim), "low": low, "high": high})

    found = rows.select("x").mapInArrow(extremes, "j long, low long, high long").groupBy("j").agg(F.min("low"), F.max("high"))
    found = sorted(tuple(r) for r in found.collect())
    if not found:
        return None
    _, low, high = (np.array(c) for c in zip(*found, strict=True))
    if low.min() < -LARGEST or high.max() >= LARGEST:
        raise ValueError(f"components beyond {LARGEST // SCALE}: squared distances would not fit a long")
    return low, high


def pack(cells: np.ndarray, bits: int) -> np.ndarray:
    """Rows of cell numbers as rows of bytes, ``bits`` bits a cell."""
    spread = (cells[:, :, None] >> np.arange(bits)) & 1
    return np.packbits(spread.astype(np.uint8).reshape(len(cells), -1), axis=1)


def unpack(packed: np.ndarray, dim: int, bits: int) -> np.ndarray:
    spread = np.unpackbits(packed, axis=1, count=dim * bits).reshape(len(packed), dim, bits)
    return (spread << np.arange(bits)).sum(axis=2)


class Grid:
    """Equal cells between each dimension's bounds, and the tables of a set of centroids."""

    def __init__(self, low: np.ndarray, high: np.ndarray, bits: int):
        self.low, self.bits, self.dim = low, bits, len(low)
        self.width = (high - low) // 2**bits + 1
        first = low[:, None] + self.width[:, None] * np.arange(2**bits)
        self.first, self.last = np.minimum(first, high[:, None]), np.minimum(first + self.width[:, None] - 1, high[:, None])
        self.packed = -(-self.dim * bits // 8)

    def cells(self, x: np.ndarray) -> np.ndarray:
        return (x - self.low) // self.width

    def intervals(self, cells: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest distance of each row to each centroid, but for a term that centroids share."""
        own = centroids - centroids.sum(axis=0) // len(centroids)
        ends = -2 * np.stack([self.first, self.last])[..., None] * own.T[None, :, None, :]  # end, dimension, cell, centroid
        least, most = ends.min(axis=0), ends.max(axis=0)
        low = np.repeat((centroids * centroids).sum(axis=1)[None, :], len(cells), axis=0)
        high = low.copy()
        for j in range(self.dim):
            low += least[j][cells[:, j]]
            high += most[j][cells[:, j]]
        return low, high


class Block:
    """One block's file: full vectors, packed cells, ids, and which ids are null."""

    def __init__(self, source, n: int, grid: Grid):
        self.source, self.n, self.grid = source, n, grid
        self.row = 4 * grid.dim

    @staticmethod
    def write(out, ids: pa.Array, x: np.ndarray, grid: Grid) -> None:
        out.write(x.astype("<i4").tobytes())
        out.write(pack(grid.cells(x), grid.bits).tobytes())
        out.write(ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
        out.write(ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes())

    def _at(self, offset: int, count: int, kind: str) -> np.ndarray:
        return np.frombuffer(self.source.read_at(count * np.dtype(kind).itemsize, offset), kind)

    def cells(self) -> np.ndarray:
        packed = self._at(self.n * self.row, self.n * self.grid.packed, "u1").reshape(self.n, -1)
        return unpack(packed, self.grid.dim, self.grid.bits)

    def vectors(self, rows: np.ndarray | None = None) -> np.ndarray:
        """Full vectors of all rows, or of some in ascending order."""
        if rows is None or len(rows) > WHOLE_SHARE * self.n:
            x = self._at(0, self.n * self.grid.dim, "<i4").reshape(self.n, -1)
            return (x if rows is None else x[rows]).astype(np.int64)
        parts = [np.zeros((0, self.grid.dim), np.int64)]
        for run in np.split(rows, np.flatnonzero(np.diff(rows) != 1) + 1):
            if len(run):
                parts.append(self._at(int(run[0]) * self.row, len(run) * self.grid.dim, "<i4").reshape(len(run), -1).astype(np.int64))
        return np.concatenate(parts)

    def ids(self) -> pa.Array:
        offset = self.n * (self.row + self.grid.packed)
        return pa.array(self._at(offset, self.n, "<i8"), pa.int64(), mask=self._at(offset + 8 * self.n, self.n, "u1") == 1)


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distance of each row to each centroid."""
    out = np.empty((len(x), len(centroids)), np.int64)
    for k, c in enumerate(centroids):
        apart = x - c
        out[:, k] = np.einsum("ij,ij->i", apart, apart)
    return out


def assign(block: Block, before: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """New clusters of a block, the change of each cluster's sum and size, and how many vectors were fetched."""
    low, high = block.grid.intervals(block.cells(), centroids)
    possible = low <= high.min(axis=1)[:, None]
    after = possible.argmax(axis=1)
    open_ = possible.sum(axis=1) > 1
    fetched = np.flatnonzero(open_ | (after != before))
    x = block.vectors(fetched)
    unsure = open_[fetched]
    after[fetched[unsure]] = distances(x[unsure], centroids).argmin(axis=1)
    sums, sizes = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
    old, new = before[fetched], after[fetched]
    for k in range(len(centroids)):
        came, left = (new == k) & (old != k), (old == k) & (new != k)
        sums[k] = x[came].sum(axis=0) - x[left].sum(axis=0)
        sizes[k] = came.sum() - left.sum()
    return after, sums, sizes, len(fetched)


def _write_blocks(rows: DataFrame, grid: Grid) -> DataFrame:
    """``(path, n, clusters)``: the blocks' files, no vector assigned yet (-1)."""
    folder = new_folder(rows.sparkSession, "vector-blocks")

    def stored(ids: pa.Array, x: np.ndarray) -> pa.RecordBatch:
        where, path = place(f"{folder}/{uuid.uuid4().hex}.block")
        with where.open_output_stream(path) as out:
            Block.write(out, ids, x, grid)
        none = np.full(len(x), -1, "<i4").tobytes()
        return pa.RecordBatch.from_pydict({"path": [path], "n": [len(x)], "clusters": pa.array([none], pa.binary())})

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                held.append(batch.slice(at, BLOCK))
                if sum(b.num_rows for b in held) >= BLOCK:
                    yield together(held)
                    held = []
        if held:
            yield together(held)

    def together(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        return stored(table.column("id").combine_chunks(), matrix(table.column("x").combine_chunks(), grid.dim))

    return kept(rows.mapInArrow(write, "path string, n long, clusters binary"), "vector-block-list")


def cluster(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = DIM, clusters: int = CLUSTERS,
    rounds: int = ROUNDS, salt: str = "3", bits: int = CELL_BITS,
) -> DataFrame:
    """One row per kept vector: ``(id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256)``.

    Kept are vectors of ``dim`` finite components, as integers ``floor(1024 * c)``. The
    first centroids are the vectors with the smallest SHA-256 of ``salt:id``; ties of an
    id that repeats go to the smaller vector, and rows without an id start none but are
    assigned like others. Fewer vectors than ``clusters`` make fewer centroids. Ties in
    distance go to the smaller number, an empty cluster keeps its centroid. No kept
    vector, or none with an id, gives no rows. Components of 131,072 or more are an
    error, since distances would not fit a long. Other columns, whatever their names, are
    not read.
    """
    spark = rows.sparkSession
    ready(spark)
    found = integers(rows, id_col, vector_col, dim)
    hash_ = F.sha2(F.concat_ws(":", F.lit(salt), F.col("id").cast("string")), 256)
    starts = found.filter("id IS NOT NULL").select(hash_.alias("hash"), "x").orderBy("hash", "x").limit(clusters).collect()
    limits = _bounds(found, dim)
    out = f"{id_col} long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not starts or limits is None:
        return spark.createDataFrame([], out)
    grid = Grid(*limits, bits)
    state = _write_blocks(found, grid)
    root, parts = shared_dir(spark), _parts(state)
    centroids = np.array([r["x"] for r in starts], np.int64)
    sums, sizes = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
    for _ in range(rounds):
        state = kept(state.repartition(parts).mapInArrow(_round(root, grid, centroids), _STATE), "vector-clusters")
        moved = state.select(F.posexplode("change").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
        change = np.zeros(sums.size + len(sizes), np.int64)
        for i, v in moved:
            change[i] = v
        sums += change[: sums.size].reshape(sums.shape)
        sizes += change[sums.size :]
        full = sizes > 0
        centroids = centroids.copy()
        centroids[full] = sums[full] // sizes[full, None]

    placed = kept(state.repartition(parts).mapInArrow(_place(root, grid, centroids), "id long, cluster int, distance long"), "vector-distances")
    inertia = {r["cluster"]: r["s"] for r in placed.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    by_cluster = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("cluster") + 1)
    return placed.select(
        F.col("id").alias(id_col), "cluster", "distance",
        by_cluster([inertia.get(k, 0) for k in range(len(names))]).cast("long").alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"),
        by_cluster(names).alias("centroid_sha256"),
    )


_STATE = "path string, n long, clusters binary, fetched long, change array<long>"


def _parts(blocks: DataFrame) -> int:
    """Tasks of a round: one for each block, up to some for each core."""
    return max(1, min(blocks.count(), 8 * blocks.sparkSession.sparkContext.defaultParallelism))


def _opened(batches: Iterator[pa.RecordBatch], root: str, grid: Grid) -> Iterator[tuple[dict, Block]]:
    where, _ = place(root)
    for batch in batches:
        for row in batch.to_pylist():
            with where.open_input_file(row["path"]) as source:
                yield row, Block(source, row["n"], grid)


def _round(root: str, grid: Grid, centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, block in _opened(batches, root, grid):
            after, sums, sizes, fetched = assign(block, np.frombuffer(row["clusters"], "<i4").astype(np.int64), centroids)
            change = np.concatenate([sums.ravel(), sizes])
            yield pa.RecordBatch.from_pydict({
                "path": [row["path"]], "n": [row["n"]], "clusters": pa.array([after.astype("<i4").tobytes()], pa.binary()),
                "fetched": [fetched], "change": pa.array([change], pa.list_(pa.int64())),
            })

    return run


def _place(root: str, grid: Grid, centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block in _opened(batches, root, grid):
            apart = distances(block.vectors(), centroids)
            nearest = apart.argmin(axis=1)
            least = apart[np.arange(len(apart)), nearest]
            yield pa.RecordBatch.from_arrays([block.ids(), pa.array(nearest.astype(np.int32)), pa.array(least)], names=["id", "cluster", "distance"])

    return run
