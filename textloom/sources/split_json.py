"""Files of one JSON array of objects, read in splits wherever their line breaks are.

The file is read in pieces that end at a closing brace. Quotes that no backslash escapes
say whether a piece ends inside a string, so counts by split, summed over earlier splits,
tell how each split begins; with that, opening and closing braces outside strings give
depths, summed in the same way. An object begins at depth 0, and what lies over the end
of a split is joined as for CSV.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import import_in_workers, kept
from .split_csv import PLACE, RECORD, entered, records, runs_of, whole


def _depths(batch: pa.RecordBatch, a: int, b: int, inside: int | None) -> tuple[np.ndarray, int]:
    """Change of depth by each piece, and whether the next one begins inside a string."""
    if inside is None:
        inside = int(batch.column("inside")[a].as_py()) % 2
    quotes = batch.column("quotes").to_numpy()[a:b]
    after = (inside + np.cumsum(quotes)) % 2
    before = (after - quotes) % 2
    opened = np.where(before == 0, batch.column("opened").to_numpy()[a:b], batch.column("opened_inside").to_numpy()[a:b])
    return opened - (after == 0), int(after[-1])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Change of depth by each stretch of a split."""
    place, inside = None, None
    for batch in batches:
        for a, b in runs_of(batch) if batch.num_rows else ():
            here = (batch.column("file")[a].as_py(), batch.column("block")[a].as_py())
            inside = inside if here == place else None
            place = here
            change, inside = _depths(batch, a, b, inside)
            yield pa.RecordBatch.from_pydict({"file": [here[0]], "block": [here[1]], "n": [int(change.sum())]})


def _objects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return records(batches, "}", _depths, lambda level: level == 0)


def read_split_json(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """As ``files.read_json_array`` reads it, with all cores on one file.

    Each file holds one array of objects, which may nest. Fields that the schema doesn't name
    are left out, missing ones are null. An empty array, or an empty file, has no rows.
    """
    import_in_workers(spark)
    bare = F.regexp_replace("value", r"(?s)\\.", "")
    count = lambda text, sign: (F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))).cast("long")
    outside = lambda text: count(F.regexp_replace(text, '"[^"]*("|$)', ""), "{")
    pieces = spark.read.text(path, lineSep="}").select(
        "value", count(bare, '"').alias("quotes"), outside(bare).alias("opened"), outside(F.concat(F.lit('"'), bare)).alias("opened_inside"),
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
    )
    pieces = entered(pieces, pieces.groupBy(*PLACE).agg(F.sum("quotes").alias("n")), "inside")
    sums = pieces.mapInArrow(_summed, "file string, block long, n long").groupBy(*PLACE).agg(F.sum("n").alias("n"))
    placed = entered(pieces, sums)
    found = kept(placed.mapInArrow(_objects, "file string, block long, kind int, first boolean, text string"), "json-objects")
    rows = found.filter(F.col("kind") == RECORD).select("file", "kind", "first", "text")
    rows = rows.unionByName(whole(found.filter(F.col("kind") != RECORD), "}"))
    text = F.concat(F.regexp_replace("text", r"^[\s,\[\x{FEFF}]+", ""), F.lit("}"))
    return rows.select(text.alias("text")).filter(F.col("text").startswith("{")).select(F.from_json("text", schema).alias("r")).select("r.*")
