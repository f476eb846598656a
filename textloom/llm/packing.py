"""Best-fit packing of token sequences, in bulk-synchronous rounds.

Documents are cut into pieces of at most ``size`` ids. Pieces of one length are
alike, and so are sequences with one gap, so both are first aggregated by size:
at most ``size`` classes each, whatever the corpus. Rounds go down the sorted
lengths; in each, the pieces still waiting look for their successor, the smallest
gap that takes them; each sequence is filled with as many as it takes before the next
one gets any, as the rest of a gap is smaller still; if more pieces than gaps meet,
those of the lowest rank win, gaps are updated, and the losers look again. Only if no
gap takes a length are new sequences opened. This is best fit in decreasing order. Every match is a
range of ranks against a range of sequences, so pieces find theirs by their rank
within their length alone: task by task, without moving text, ids or a hot
length into one place.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import kept
from .shared_files import fewer_tasks, ready
from .text_arrays import release, slices
from .tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, rank long"


def packed_by_fewer(scan: DataFrame) -> DataFrame:
    """A bare scan, whose splits are known without running anything, for fewer tasks that cut more documents each."""
    return scan.coalesce(fewer_tasks(scan.sparkSession, scan.rdd.getNumPartitions()))


def cut_documents(
    docs: DataFrame, tokenizer: str, end_id: int, size: int, id_col: str = "doc_id", text_col: str = "text", spaced: bool = False
) -> DataFrame:
    """Pieces of all documents, each with its rank among the pieces of its length that its task cut."""
    ready(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, task = encoder(tokenizer, spaced), TaskContext.get().partitionId()
        end, seen = np.array([end_id], np.uint32), np.zeros(size + 1, np.int64)
        for batch in slices(batches, "text"):
            rows = []
            for doc_id, ids in zip(batch.column("id").to_pylist(), words.encode(batch.column("text")), strict=True):
                ids = np.concatenate([ids, end]).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), size)):
                    own = ids[start : start + size]
                    rows.append((doc_id, piece, start, len(own), zlib.crc32(own.tobytes()), task, int(seen[len(own)])))
                    seen[len(own)] += 1
            if rows:
                kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        words.forget()
        release()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return kept(rows.mapInArrow(cut, PIECES), "pieces")


def best_fit(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Matches ``(length, first rank, pieces, first sequence, offset)`` of the pieces counted by length.

    Sequences of one gap are kept as ranges of numbers. The result has a bounded
    number of ranges: it depends on the lengths that occur, not on how often.
    """
    matches: list[tuple[int, int, int, int, int]] = []
    gaps: list[int] = []  # the gaps that occur, sorted
    ranges: dict[int, deque[list[int]]] = defaultdict(deque)  # gap -> [first sequence, sequences]
    opened = 0

    def put(gap: int, first: int, n: int) -> None:
        if gap:
            if not ranges[gap]:
                insort(gaps, gap)
            if ranges[gap] and sum(ranges[gap][-1]) == first:
                ranges[gap][-1][1] += n
            else:
                ranges[gap].append([first, n])

    for length in sorted((n for n in counts if counts[n]), reverse=True):
        rank, waiting = 0, counts[length]
        while waiting:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                new = -(-waiting // (size // length))
                put(size, opened, new)
                opened += new
                continue
            gap = gaps[at]
            first, n = ranges[gap][0]
            each = gap // length
            won = min(n * each, waiting)
            full, rest = divmod(won, each)
            for layer in range(min(each, won)):
                pieces = full + (layer < rest)
                matches.append((length, rank, pieces, first, size - gap + layer * length))
                rank += pieces
            used = full + (rest > 0)
            if used == n:
                ranges[gap].popleft()
                if not ranges[gap]:
                    gaps.pop(at)
            else:
                ranges[gap][0] = [first + used, n - used]
            if full:
                put(gap - each * length, first, full)
            if rest:
                put(gap - rest * length, first + full, 1)
            waiting -= won
    return matches


def pack(pieces: DataFrame, size: int) -> DataFrame:
    """Place every piece: ``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``."""
    spark = pieces.sparkSession
    per_task = kept(pieces.groupBy("length", "task").agg(F.count("*").alias("n")), "piece-counts")
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    matches = np.array(best_fit(counts, size), dtype=np.int64).reshape(-1, 5)
    plan = spark.sparkContext.broadcast(matches[np.lexsort((matches[:, 1], matches[:, 0]))])

    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["length", "task"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank")).alias("rank")
    )

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = plan.value
        lengths = np.searchsorted(table[:, 0], np.arange(size + 2))
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            row = np.zeros(len(length), np.int64)
            for n in np.unique(length):
                own = length == n
                a, b = lengths[n], lengths[n + 1]
                row[own] = a + np.searchsorted(table[a:b, 1], rank[own], side="right") - 1
            found = table[row]
            arrays = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            arrays += [pa.array(found[:, 3] + rank - found[:, 1]), pa.array(found[:, 4])]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ready(spark)
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInArrow(placed, kinds)


def pack_documents(
    docs: DataFrame, tokenizer: str, end_id: int = 0, size: int = 2048, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pack all documents into sequences of at most ``size`` ids, one row per piece.

    Only documents of more than ``size`` ids are cut. Null text counts as empty: one
    piece, the end id. Rows that share an id, or have none, are packed apart; an
    empty table gives no rows; other columns are not read.
    """
    return pack(cut_documents(docs, tokenizer, end_id, size, id_col, text_col), size).withColumnRenamed("doc_id", id_col)
