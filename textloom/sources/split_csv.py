"""Quoted CSV read in splits, though records hold line breaks.

Whether a line begins a record depends on all quotes before it in its file. Spark reads
the file as lines, in as many splits as it likes; one aggregate counts the quotes of each
split, and sums over earlier splits say whether a split begins inside a quoted field.
Every task then joins its own lines to records. What is left at a split's two ends, a
record's begin or the rest of one, is joined by file and place: two short pieces a split.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.bounded import pin_small
from ..session import import_in_workers, kept

_QUOTING = {"quote": '"', "escape": '"'}
RECORD, BEGIN, REST = range(3)
PLACE = ["file", "block"]


class _Lines:
    """Lines of one split, from a record's first line on; ``kind`` REST if its first line is in an earlier split."""

    def __init__(self, kind: int, first: bool):
        self.kind, self.first, self.parts = kind, first, []

    def text(self, end: str) -> str:
        return end.join(line for part in self.parts for line in part.to_pylist())


def runs_of(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """Stretches of lines of one split of one file."""
    block, file = batch.column("block").to_numpy(), batch.column("file").dictionary_encode().indices.to_numpy()
    cuts = [0, *(np.flatnonzero((np.diff(block) != 0) | (np.diff(file) != 0)) + 1).tolist(), batch.num_rows]
    return zip(cuts, cuts[1:], strict=False)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of CSV to records: one begins after an even number of quotes."""
    return records(batches, "\n", lambda batch, a, b, seen: (batch.column("quotes").to_numpy()[a:b], None), lambda level: level % 2 == 0)


def records(batches: Iterator[pa.RecordBatch], end: str, steps: Callable, begins: Callable) -> Iterator[pa.RecordBatch]:
    """Lines ``(value, file, block, before, …)`` in order to ``(file, block, kind, first, text)``.

    ``steps(batch, a, b, state)`` gives how each line changes the level, and the state
    after them; a line begins a record where ``begins`` holds of the level before it. A
    split starts at the level ``before``. ``end`` stood between lines.
    """
    place, seen, held, state = None, 0, None, None

    def joined(values: pa.Array, starts: np.ndarray) -> pa.Array:
        # Records end where the next one begins; the last start is only an end.
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), values), end)

    def rows(texts: pa.Array, kind: int, first: np.ndarray) -> pa.RecordBatch:
        n = len(texts)
        return pa.RecordBatch.from_arrays(
            [pa.array([place[0]] * n, pa.string()), pa.array(np.full(n, place[1])), pa.array(np.full(n, kind, np.int32)), pa.array(first), texts],
            names=["file", "block", "kind", "first", "text"],
        )

    def ended() -> Iterator[pa.RecordBatch]:
        if held is not None and held.parts:
            kind = BEGIN if held.kind == RECORD and not begins(seen) else held.kind
            yield rows(pa.array([held.text(end)]), kind, np.array([held.first]))

    for batch in batches:
        if not batch.num_rows:
            continue
        for a, b in runs_of(batch):
            here = (batch.column("file")[a].as_py(), batch.column("block")[a].as_py())
            if here != place:
                yield from ended()
                place, seen, state = here, int(batch.column("before")[a].as_py()), None
                held = None if begins(seen) else _Lines(REST, False)
            values = batch.column("value").slice(a, b - a)
            change, state = steps(batch, a, b, state)
            after = seen + np.cumsum(change)
            starts = np.flatnonzero(begins(after - change))
            seen = int(after[-1])
            if not len(starts):
                held.parts.append(values)
                continue
            top = held is None and here[1] == 0
            if held is not None:
                held.parts.append(values.slice(0, starts[0]))
                yield rows(pa.array([held.text(end)]), held.kind, np.array([held.first]))
            if len(starts) > 1:
                first = np.zeros(len(starts) - 1, bool)
                first[0] = top
                yield rows(joined(values, starts), RECORD, first)
            held = _Lines(RECORD, top and len(starts) == 1)
            held.parts.append(values.slice(starts[-1]))
    yield from ended()


def whole(pieces: DataFrame, end: str = "\n") -> DataFrame:
    """Records that go over the ends of splits: a begin and the rests that follow it in its file."""
    order = Window.partitionBy("file").orderBy("block", F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    begins = F.last(F.when(F.col("kind") == BEGIN, F.col("block")), ignorenulls=True).over(order)
    owned = pieces.select("file", "block", "kind", begins.alias("owner"))
    parts = pieces.join(owned, ["file", "block", "kind"]).groupBy("file", "owner").agg(
        F.max("first").alias("first"), F.array_sort(F.collect_list(F.struct("block", F.col("kind") == REST, "text"))).alias("parts")
    )
    # In the split where it begins, a record comes after the rest of the one before, which is owned by an earlier split.
    return parts.select("file", F.lit(RECORD).alias("kind"), "first", F.array_join(F.transform("parts", lambda p: p["text"]), end).alias("text"))


def entered(lines: DataFrame, counts: DataFrame, name: str = "before") -> DataFrame:
    """Lines, in order, with the sum of ``n`` of ``counts (file, block, n)`` over earlier splits of their file."""
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*PLACE, F.coalesce(F.sum("n").over(earlier), F.lit(0)).cast("long").alias(name))
    small = pin_small(counts)
    if small is not counts:
        return lines.join(F.broadcast(small), PLACE)  # lines keep their order
    numbered = lines.withColumn("line", F.monotonically_increasing_id()).join(counts, PLACE)
    return numbered.repartition(*PLACE).sortWithinPartitions(*PLACE, "line").drop("line")


def read_split_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """As ``files.read_csv`` reads it, with all cores on one file.

    Columns go by the header's names, others are left out, a missing one is an error, and a
    value that isn't of its type is null. Lines end with LF or CRLF. Blank lines are no records.
    All files of one path share a header; an unclosed quote makes the rest of its file one record.
    """
    import_in_workers(spark)
    names = spark.read.csv(path, header=True, multiLine=True, **_QUOTING).columns
    lines = spark.read.text(path, lineSep="\n").select(
        "value", (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).alias("quotes"),
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
    )
    placed = entered(lines, lines.groupBy(*PLACE).agg(F.sum("quotes").alias("n")))
    placed = placed.select("value", F.col("quotes").cast("long").alias("quotes"), *PLACE, "before")
    found = kept(placed.mapInArrow(_records, "file string, block long, kind int, first boolean, text string"), "csv-records")
    rows = found.filter(F.col("kind") == RECORD).select("file", "kind", "first", "text")
    rows = rows.unionByName(whole(found.filter(F.col("kind") != RECORD))).filter(~F.col("first"))
    rows = rows.select(F.regexp_replace("text", "\r$", "").alias("text")).filter("text != ''")
    texts = ", ".join(f"`{name.replace('`', '``')}` string" for name in names)
    fields = rows.select(F.from_csv("text", texts, _QUOTING).alias("r"))
    return fields.select(*[F.col(f"r.`{field.name}`").try_cast(field.dataType).alias(field.name) for field in schema])
