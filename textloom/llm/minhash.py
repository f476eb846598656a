"""MinHash near-dedup with fast similarity sketches.

A sketch has ``BINS`` coordinates. Round i places every shingle in one bin by a
hash of its own and keeps the least (i, hash) of each bin, so a full round costs
one step per shingle, and large sets fill all bins in one or two rounds; after
``BINS`` rounds, round ``BINS + j`` offers all shingles to bin j, which fills
whatever is left. Coordinates agree with the probability of the Jaccard
similarity and are concentrated as if they were independent. ``BANDS`` bands of
``ROWS`` coordinates give candidates. Of these, pairs whose sketches agree in fewer
coordinates than links do (but for some three links in a million, by the
concentration) are discarded; every other one is confirmed on the full shingle sets.
Pairs inside a bucket that its hub leaves open pass a sketch four times as large first.

Documents with equal sets are one class from the start. In a band's bucket,
classes are first compared with one hub, then, if they aren't linked yet, with
each other, so a large group of near copies costs a star, not all its pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import kept
from .components import components
from .shared_files import ready
from .text_arrays import mix, shingle_sets, slices, utf8

BINS = 512
BANDS, ROWS = 32, 4
#: A larger sketch for pairs that stars leave open: its marks have two bits a coordinate, thirty coordinates to a long.
FINE_BINS, _FINE_PER_LONG = 2048, 30
_ODD = 0x5555555555555555
#: Deviations below the mean that a link's agreement may lie.
DEVIATIONS = 4.5
#: A coordinate's low bits, 15 coordinates to a long, to count agreement in SQL; bits that differ by chance agree 1 in 16.
_PER_LONG, _LONGS = 15, -(-BINS // 15)
_SEVENS, _EIGHTS = 0x0777777777777777, 0x0888888888888888
_SEEDS = np.random.Generator(np.random.PCG64(7)).integers(0, 2**64, 2 * BINS, dtype=np.uint64)
_FINE_SEEDS = np.random.Generator(np.random.PCG64(8)).integers(0, 2**64, 2 * FINE_BINS, dtype=np.uint64)


def sketch(shingles: np.ndarray, seeds: np.ndarray = _SEEDS) -> np.ndarray:
    """The coordinates, half as many as seeds and a power of two, of a non-empty set of 64-bit hashes."""
    size = len(seeds) // 2
    index_bits = size.bit_length() - 1
    value_bits = np.uint64(63 - index_bits)  # kept of a hash beside the round's number
    value = np.uint64(2 ** int(value_bits) - 1)
    empty = np.uint64(2**64 - 1)
    bins = np.full(size, empty)
    done = 0
    while done < size:
        rounds = max(1, min(size - done, 4 * size // len(shingles)))
        hashed = mix(shingles[None, :] ^ seeds[done : done + rounds, None])
        number = np.arange(done, done + rounds, dtype=np.uint64)[:, None] << value_bits
        np.minimum.at(bins, (hashed >> np.uint64(64 - index_bits)).ravel(), (number | (hashed & value)).ravel())
        done += rounds
        if (bins != empty).all():
            # Rounds that ran together with the last one needed change nothing: their numbers are larger.
            return bins
    for j in np.flatnonzero(bins == empty):
        bins[j] = (np.uint64(size + j) << value_bits) | (mix(shingles ^ seeds[size + j]) & value).min()
    return bins


def bands(coordinates: np.ndarray) -> np.ndarray:
    """One signed 64-bit hash per band of ``ROWS`` coordinates."""
    rows = coordinates.reshape(-1, ROWS)
    total = np.arange(1, len(rows) + 1, dtype=np.uint64)
    for k in range(ROWS):
        total = mix(total + rows[:, k])
    return total.view(np.int64)


def marks(coordinates: np.ndarray) -> np.ndarray:
    """Four bits of every coordinate in ``_LONGS`` longs."""
    low = np.zeros(_LONGS * _PER_LONG, np.uint64)
    low[:BINS] = coordinates & np.uint64(15)
    return (low.reshape(_LONGS, _PER_LONG) << (np.uint64(4) * np.arange(_PER_LONG, dtype=np.uint64))).sum(axis=1, dtype=np.uint64).view(np.int64)


def fine_marks(coordinates: np.ndarray) -> np.ndarray:
    """Two bits of every coordinate of a fine sketch."""
    low = np.zeros(-(-FINE_BINS // _FINE_PER_LONG) * _FINE_PER_LONG, np.uint64)
    low[:FINE_BINS] = coordinates & np.uint64(3)
    return (low.reshape(-1, _FINE_PER_LONG) << (np.uint64(2) * np.arange(_FINE_PER_LONG, dtype=np.uint64))).sum(axis=1, dtype=np.uint64).view(np.int64)


def most_differences(threshold_percent: int, bins: int = BINS, bits: int = 4) -> int:
    """Coordinates in which the marks of a link differ at most."""
    p = (1 - threshold_percent / 100) * (1 - 2.0**-bits)
    return math.ceil(bins * p + DEVIATIONS * math.sqrt(bins * p * (1 - p)))


def fine_differences(x: str, y: str) -> Column:
    """Coordinates in which two array columns of fine marks differ."""

    def differing(a: Column, b: Column) -> Column:
        bits = a.bitwiseXOR(b)
        return F.bit_count(bits.bitwiseOR(F.shiftright(bits, 1)).bitwiseAND(F.lit(_ODD)))

    return F.aggregate(F.zip_with(x, y, differing), F.lit(0), lambda total, n: total + n)


def differences(x: str, y: str) -> Column:
    """Coordinates in which two array columns of marks differ: the high bit of each group tells whether it has any bit."""
    total = F.lit(0)
    for k in range(_LONGS):
        bits = F.col(x)[k].bitwiseXOR(F.col(y)[k])
        total = total + F.bit_count((bits.bitwiseAND(F.lit(_SEVENS)) + F.lit(_SEVENS)).bitwiseOR(bits).bitwiseAND(F.lit(_EIGHTS)))
    return total


def first_shared(x: str, y: str) -> Column:
    """The first band that two array columns of bands share, null if none."""
    return F.coalesce(*[F.when(F.col(x)[k] == F.col(y)[k], F.col(x)[k]) for k in range(BANDS)])


def _set_keys(sets: list[np.ndarray]) -> pa.Array:
    return pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary())


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        keys = _set_keys(shingle_sets(*utf8(batch.column("text"))))
        yield pa.RecordBatch.from_arrays([keys, batch.column("text").cast(pa.string())], names=["id", "text"])


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        sets = shingle_sets(*utf8(batch.column("text")))
        sketches = [sketch(s) if len(s) else None for s in sets]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("id"),
                batch.column("digest"),
                pa.array([len(s) for s in sets], pa.int64()),
                _set_keys(sets),
                pa.array([None if c is None else bands(c[: BANDS * ROWS]) for c in sketches], pa.list_(pa.int64())),
                pa.array([None if c is None else marks(c) for c in sketches], pa.list_(pa.int64())),
            ],
            names=["id", "digest", "n", "set_key", "bands", "marks"],
        )


def _finely_sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        marked = [fine_marks(sketch(s, _FINE_SEEDS)) for s in shingle_sets(*utf8(batch.column("text")))]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(marked, pa.list_(pa.int64()))], names=["rep", "fine"])


def _confirm(threshold_percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in slices(batches, "text_a"):
            ids, texts = batch.column("a").to_pylist(), batch.column("text_a")
            others = shingle_sets(*utf8(batch.column("text_b")))
            linked = []
            for i, (a, other) in enumerate(zip(ids, others, strict=True)):
                if last[0] != a:  # rows come sorted by a, so a hub's set is made once
                    last = (a, shingle_sets(*utf8(texts.slice(i, 1)))[0])
                common = len(np.intersect1d(last[1], other, assume_unique=True))
                linked.append(100 * common >= threshold_percent * (len(last[1]) + len(other) - common) and len(other) > 0)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked)], names=["a", "b", "linked"])

    return confirm


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold_percent: int = 75
) -> DataFrame:
    """One row per input row: ``(id_col, n_shingles, component_id, kept, text_sha256)``.

    Documents are linked if ``100 * |A ∩ B| >= threshold_percent * |A ∪ B|`` for their
    sets of distinct 5-word shingles (A-Z lowered, words split at ASCII white space;
    fewer words are one shingle). ``component_id`` is the smallest id that links
    reach; that document is kept. Null, empty and blank texts have no shingles and
    no links: they are their own component. Rows that share an id are judged apart, each
    by its own text; ``text_sha256`` (of the text as it is, null as empty) tells them apart. A
    row without an id cannot be named in a link: its component is null and it is kept. An empty
    table gives no rows; other columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    ready(spark)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    digest = F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest")
    schema = f"id {source.schema['id'].dataType.simpleString()}, digest string, n long, set_key binary, bands array<long>, marks array<long>"
    sets = kept(source.select("id", "text", digest).mapInArrow(_sketched, schema), "sketches")

    # Classes of equal sets, the nodes of all that follows; a class's rows share their bands.
    named = sets.filter("n > 0 AND id IS NOT NULL")
    classes = named.groupBy(F.col("set_key").alias("rep"), "n").agg(
        F.min("id").alias("least"), F.first("bands").alias("bands"), F.first("marks").alias("marks")
    )
    classes = kept(classes, "set-classes")
    placed = classes.select("rep", "n", F.explode("bands").alias("band"))
    shared = placed.groupBy("band").agg(F.min("rep").alias("hub"), F.count("*").alias("members")).filter("members > 1")
    members = kept(placed.join(shared.select("band", "hub"), "band").select("band", "rep", "n", "hub"), "bucket-members")

    # Texts of the classes that share a bucket: all that later steps read.
    involved = classes.select("rep", F.col("least").alias("id")).join(members.select("rep").distinct(), "rep")
    # An id may have other texts besides: those of the class are told by their set.
    found = source.join(involved.select("id").distinct(), "id").mapInArrow(_keyed, "id binary, text string")
    found = found.join(involved.select(F.col("rep").alias("id")), "id", "left_semi")
    texts = kept(found.groupBy("id").agg(F.min("text").alias("text")), "candidate-texts")
    hubs = members.filter("rep = hub").select("band", F.col("n").alias("hub_n")).distinct()
    differ = most_differences(threshold_percent)
    marked = lambda side: classes.select(F.col("rep").alias(side), F.col("marks").alias(f"marks_{side}"))
    close = lambda x, y: F.lit(100) * F.least(x, y) >= F.lit(threshold_percent) * F.greatest(x, y)

    def confirmed(pairs: DataFrame) -> DataFrame:
        a, b = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
        rows = pairs.join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b")
        checked = rows.mapInArrow(_confirm(threshold_percent), "a binary, b binary, linked boolean")
        return kept(checked, "checked-pairs")

    stars = (
        members.filter("rep != hub").join(hubs, "band")
        .filter(close(F.col("n"), F.col("hub_n")))
        .select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
        .join(marked("b"), "b").join(marked("a"), "a").filter(differences("marks_a", "marks_b") <= differ)
        .select("a", "b")
    )
    checked = confirmed(stars)
    links = checked.filter("linked").select("a", "b")

    # What stars leave open: members of one bucket in different components.
    found = kept(components(links), "star-components")
    sides = members.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(
        "band", "rep", "n", F.coalesce("component", "rep").alias("component")
    )
    mixed = sides.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low != high")
    sides = kept(sides.join(mixed.select("band"), "band"), "open-members")
    fine = texts.join(sides.select(F.col("rep").alias("id")).distinct(), "id").mapInArrow(_finely_sketched, "rep binary, fine array<long>")
    sketches = kept(classes.select("rep", "marks", "bands").join(fine, "rep"), "open-sketches")
    sides = sides.join(sketches, "rep").select("band", F.col("rep").alias("a"), "n", "component", "marks", "bands", "fine")
    finely = most_differences(threshold_percent, FINE_BINS, 2)
    x, y = lambda c: F.col(f"x.{c}"), lambda c: F.col(f"y.{c}")
    rest = (
        # Both sides are the same plan, so they are shuffled once.
        sides.alias("x").join(
            sides.alias("y"),
            (x("band") == y("band")) & (x("a") < y("a")) & (x("component") != y("component")) & close(x("n"), y("n"))
            & (differences("x.marks", "y.marks") <= differ)
            & (first_shared("x.bands", "y.bands") == x("band"))  # a pair that shares several bands comes out of the first one only
            & (fine_differences("x.fine", "y.fine") <= finely),
        )
        .select(x("a").alias("a"), y("a").alias("b"))
        .join(checked.select("a", "b"), ["a", "b"], "left_anti")
    )
    links = links.union(confirmed(rest).filter("linked").select("a", "b"))
    found = kept(components(links), "components")
    reps = classes.select("rep", "least").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    reps = reps.withColumn("component", F.coalesce("component", "rep"))
    names = reps.groupBy("component").agg(F.min("least").alias("name"))
    reps = kept(reps.join(names, "component").select(F.col("rep").alias("set_key"), F.col("name").alias("component")), "class-components")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return sets.join(reps, "set_key", "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        (F.col("id").isNull() | (F.col("id") == component)).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
