"""Repeated passages: prefix-free parsing into phrases, hash groups instead of suffix arrays, earliest occurrence.

Every byte that a ``LENGTH``-byte string covers is removed if the same string
starts earlier (by document id, then by place). A rolling hash of ``WINDOW`` bytes
chooses triggers: of the windows inside each ``LENGTH``-byte string, the one with
the least hash. So a string's trigger depends on its bytes alone, equal strings
share theirs, and all strings that start in one stretch and share a trigger form
a phrase: the bytes from the stretch's start to the end of its last string. The
parse lists phrases as (trigger, phrase hash, place).

Only strings with one trigger can be equal. The suffix arrays of dictionary and parse
are replaced by groups of equal hashes, as the earliest equal string needs no order by
bytes:

* Equal phrases hold equal strings. All occurrences but the earliest are removed
  whole, and the dictionary keeps one phrase each. On repetitive text this is
  nearly everything.
* A trigger with one phrase is settled. Of triggers with several, the phrases'
  ``LENGTH``-byte strings are sorted by hash, and of equal neighbours the earliest
  place is kept.

Both steps send a task's hashes as flat arrays to the bucket that the hash of the
phrase or string chooses; within a task repeats of a phrase are settled before that,
so a hot passage costs a bucket one entry per task. Nothing gathers a trigger's
phrases: buckets leave their phrases in a file and report which triggers they hold,
and hear which of these have several phrases in all. So a trigger that occurs in
every document, each time in other surroundings, is spread over all buckets.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import kept
from .shared_files import new_folder, place, ready
from .text_arrays import mix, prefix_sums, range_hashes, slices, utf8

LENGTH = 100
WINDOW = 32
#: Text bytes per bucket: a bucket gets some five times less in hashes.
BUCKET_BYTES = 32 << 20
#: Entries of strings per bucket.
STRING_BYTES = 32 << 20
#: A task settles repeats among so many phrases at a time.
TASK_PHRASES = 1 << 19
_ORDER = np.uint64(0xFFFFFFFFFFF00000)
ENTRY = np.dtype([("trigger", "<u8"), ("phrase", "<u8"), ("doc", "<i8"), ("start", "<i8"), ("strings", "<i4")])


def triggers(hashes: np.ndarray, span: int) -> np.ndarray:
    """For each run of ``span`` hashes, the place of the least one, the first of equals."""
    # The order is by 44 bits of the hash, then by place; places are taken modulo the block they are in.
    n = len(hashes) - span + 1
    out = np.empty(n, np.int64)
    block = (1 << 20) - span
    for a in range(0, n, block):
        part = (hashes[a : a + block + span - 1] & _ORDER) | np.arange(min(block + span - 1, len(hashes) - a), dtype=np.uint64)
        width = 1
        low = part
        while 2 * width <= span:
            low = np.minimum(low[: len(low) - width], low[width:])
            width *= 2
        if width < span:
            low = np.minimum(low[: len(part) - span + 1], low[span - width : span - width + len(part) - span + 1])
        low = low[: min(block, n - a)]
        out[a : a + len(low)] = a + (low & ~_ORDER).astype(np.int64)
    return out


def phrases(data: np.ndarray, length: int = LENGTH, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one text's bytes: first start, number of starts, trigger hash and phrase hash of each phrase."""
    if len(data) < length:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    sums = prefix_sums(data)
    begins = np.arange(len(data) - window + 1)
    rolling = range_hashes(sums, begins, begins + window)
    chosen = triggers(rolling, length - window + 1)
    first = np.concatenate(([0], np.flatnonzero(chosen[1:] != chosen[:-1]) + 1))
    last = np.concatenate((first[1:], [len(chosen)])) - 1
    at = chosen[first]
    # The phrase's hash also covers where its trigger lies: equal phrases then agree string by string.
    whole = mix(range_hashes(sums, first, last + length) ^ mix((at - first).astype(np.uint64)))
    return first, last - first + 1, rolling[at], whole


def string_hashes(data: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    return range_hashes(prefix_sums(data), starts, starts + length)


def _settle(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries sorted by (trigger, phrase, place), and which of them have an earlier equal."""
    entries = entries[np.lexsort((entries["start"], entries["doc"], entries["phrase"], entries["trigger"]))]
    same = np.zeros(len(entries), bool)
    same[1:] = (entries["trigger"][1:] == entries["trigger"][:-1]) & (entries["phrase"][1:] == entries["phrase"][:-1])
    # Entries of one place are one occurrence (rows that repeat an id); only a later place is repeated.
    leader = np.maximum.accumulate(np.where(same, 0, np.arange(len(entries))))
    later = (entries["doc"] != entries["doc"][leader]) | (entries["start"] != entries["start"][leader])
    return entries, same & later


def _sent(entries: np.ndarray, repeated: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Unsettled entries by bucket of their phrase (or string), settled ones (bucket -1) as they are."""
    bucket = (entries["phrase"] % np.uint64(buckets)).astype(np.int32)
    bucket[repeated] = -1
    order = np.argsort(bucket, kind="stable")
    entries, bucket = entries[order], bucket[order]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    parts = np.split(entries, cuts)
    names = bucket[np.concatenate(([0], cuts))] if len(bucket) else []
    for a in range(0, len(parts), 512):
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(names[a : a + 512], pa.int32()),
                # Columns one behind the other: runs of equal and growing numbers compress.
                pa.array([b"".join(np.ascontiguousarray(p[c]).tobytes() for c in ENTRY.names) for p in parts[a : a + 512]], pa.binary()),
            ],
            names=["bucket", "entries"],
        )


def _unpacked(blob: bytes) -> np.ndarray:
    n = len(blob) // ENTRY.itemsize
    out, at = np.empty(n, ENTRY), 0
    for name in ENTRY.names:
        kind = ENTRY[name]
        out[name] = np.frombuffer(blob, kind, n, at)
        at += n * kind.itemsize
    return out


def _spans(entries: np.ndarray, question: bool) -> pa.RecordBatch:
    """One row per document: starts and numbers of strings."""
    entries = entries[np.lexsort((entries["start"], entries["doc"]))]
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(entries["doc"])) + 1)) if len(entries) else np.zeros(0, np.int64)
    offsets = pa.array(np.concatenate((cuts, [len(entries)])), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(entries[c].astype(np.int64))) for c in ("start", "strings")]
    lists.append(pa.ListArray.from_arrays(offsets, pa.array((entries["trigger"] if question else entries["start"] * 0).astype(np.uint64).view(np.int64))))
    docs = entries["doc"][cuts]
    return pa.RecordBatch.from_arrays([pa.array(docs), *lists, pa.array(np.full(len(docs), question))], names=SPAN_NAMES)


SPAN_NAMES = ["id", "starts", "strings", "triggers", "open"]
SPANS = "id long, starts array<long>, strings array<long>, triggers array<long>, open boolean"


REPORTS = "path string, bucket int, own binary"
#: What a bucket keeps of its phrases.
LEADER = {"doc": "<i8", "start": "<i8", "strings": "<i4", "trigger": "<u8"}


def _reported(triggers: np.ndarray) -> np.ndarray:
    """31 bits of a trigger, times two: triggers that agree in them are opened without need, which changes no result."""
    return (triggers >> np.uint64(33)).astype(np.uint32) << np.uint32(1)


def _judge(key, table):
    """The repeated entries of one bucket."""
    entries = np.concatenate([_unpacked(b) for b in table.column("entries").to_pylist()])
    if key[0].as_py() >= 0:
        entries, repeated = _settle(entries)
        entries = entries[repeated]
    return pa.Table.from_batches([_spans(entries, False)])


def _judge_strings(parts: int):
    """The repeated strings of one bucket, packed by the part that their document belongs to."""

    def judge(key, table):
        entries = np.concatenate([_unpacked(b) for b in table.column("entries").to_pylist()])
        if key[0].as_py() >= 0:
            entries, repeated = _settle(entries)
            entries = entries[repeated]
        part = (mix(entries["doc"].astype(np.uint64)) % np.uint64(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        entries, part = entries[order], part[order]
        cuts = np.flatnonzero(np.diff(part)) + 1
        names = part[np.concatenate(([0], cuts))] if len(part) else part
        blobs = [p["doc"].tobytes() + p["start"].tobytes() for p in np.split(entries, cuts)] if len(part) else []
        return pa.table({"part": pa.array(names, pa.int32()), "own": pa.array(blobs, pa.binary())})

    return judge


def _documents(key, table):
    """Spans of the documents of one part: neighbouring strings are one span."""
    both = [np.frombuffer(b, "<i8").reshape(2, -1) for b in table.column("own").to_pylist()]
    docs, starts = np.concatenate(both, axis=1)
    order = np.lexsort((starts, docs))
    docs, starts = docs[order], starts[order]
    first = np.flatnonzero(np.concatenate(([True], (docs[1:] != docs[:-1]) | (starts[1:] - starts[:-1] > 1))))
    entries = np.zeros(len(first), ENTRY)
    entries["doc"], entries["start"] = docs[first], starts[first]
    entries["strings"] = starts[np.append(first[1:], len(docs)) - 1] - starts[first] + 1
    return pa.Table.from_batches([_spans(entries, False)])


def _judge_phrases(folder: str, buckets: int):
    """The repeated phrases of one bucket; the others go to a file, and a report to the bucket of each trigger."""

    def judge(key, table):
        if key[0].as_py() < 0:
            return _wide(_judge(key, table), None, [], [])
        entries, repeated = _settle(np.concatenate([_unpacked(b) for b in table.column("entries").to_pylist()]))
        leaders = entries[~repeated]
        leaders = leaders[np.lexsort((leaders["start"], leaders["doc"]))]
        where, root = place(folder)
        path = f"{root}/{uuid.uuid4().hex}"
        with where.open_output_stream(path, compression="zstd") as out:
            for name, kind in LEADER.items():
                out.write(leaders[name].astype(kind).tobytes())
        triggers, counts = np.unique(leaders["trigger"], return_counts=True)
        bucket = (triggers % np.uint64(buckets)).astype(np.int32)
        # The lowest bit says that this bucket has several phrases of the trigger already.
        held = _reported(triggers) | (counts > 1).astype(np.uint32)
        order = np.argsort(bucket, kind="stable")
        held, bucket = held[order], bucket[order]
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        names = bucket[np.concatenate(([0], cuts))].tolist()
        found = pa.Table.from_batches([_spans(entries[repeated], False)])
        return _wide(found, path, names, [h.tobytes() for h in np.split(held, cuts)])

    return judge


def _wide(spans: pa.Table, path: str | None, buckets: list[int], own: list[bytes]) -> pa.Table:
    """Spans and reports as rows of one table."""
    reports = pa.table({"path": pa.array([path] * len(own), pa.string()), "bucket": pa.array(buckets, pa.int32()), "own": pa.array(own, pa.binary())})
    parts = [spans, reports]
    kinds = {f.name: f.type for part in parts for f in part.schema}
    filled = [pa.table({n: part.column(n) if n in part.column_names else pa.nulls(len(part), k) for n, k in kinds.items()}) for part in parts]
    return pa.concat_tables(filled)


def _several(key, table):
    """Of the triggers of one bucket, those with several phrases, to each file that holds one."""
    parts = [np.frombuffer(b, "<u4") for b in table.column("own").to_pylist()]
    held = np.concatenate(parts)
    _, place_of = np.unique(held >> np.uint32(1), return_inverse=True)
    several = np.bincount(place_of, 1 + (held & np.uint32(1)))[place_of] > 1
    rows, at = [], 0
    for path, part in zip(table.column("path").to_pylist(), parts, strict=True):
        own = part[several[at : at + len(part)]]
        at += len(part)
        if len(own):
            rows.append((path, own.tobytes()))
    return pa.table({"path": pa.array([r[0] for r in rows], pa.string()), "own": pa.array([r[1] for r in rows], pa.binary())})


def _opened(folder: str):
    """The phrases of one file whose trigger has several."""

    def opened(key, table):
        where, _ = place(folder)
        with where.open_input_stream(key[0].as_py(), compression="zstd") as source:
            data = source.read()
        n = len(data) // sum(np.dtype(k).itemsize for k in LEADER.values())
        leaders, at = np.empty(n, list(LEADER.items())), 0
        for name, kind in LEADER.items():
            leaders[name] = np.frombuffer(data, kind, n, at)
            at += n * np.dtype(kind).itemsize
        asked = np.concatenate([np.frombuffer(b, "<u4") for b in table.column("own").to_pylist()])
        return pa.Table.from_batches([_spans(leaders[np.isin(_reported(leaders["trigger"]), asked & ~np.uint32(1))], True)])

    return opened


def _by_bucket(blobs: DataFrame, judge, schema: str) -> DataFrame:
    # Settled entries only change form: each row of them is a group of its own.
    key = F.when(F.col("bucket") < 0, -1 - F.pmod(F.xxhash64("entries"), F.lit(1 << 30))).otherwise(F.col("bucket"))
    return blobs.withColumn("bucket", key.cast("int")).groupBy("bucket").applyInArrow(judge, schema)


def repeated_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH
) -> DataFrame:
    """One row per input row: ``(id_col, n_bytes, n_removed, n_spans, kept_sha256, spans, kept_text)``.

    Texts are UTF-8 bytes, null and empty ones have none. ``spans`` are the maximal
    removed runs ``(start, end)``; ``kept_text`` is what is left, with broken
    characters at a cut replaced. Rows with the same id are one document: they
    remove what one of them repeats of another place, never each other's copy. A null
    id is below all others. An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    ready(spark)
    null_id = -(2**63)
    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(null_id)).alias("id"), F.col(text_col).alias("text"))
    n_bytes = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    buckets = max(8, -(-n_bytes // BUCKET_BYTES))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in slices(batches, "text"):
            data, offsets = utf8(batch.column("text"))
            for doc, a, b in zip(batch.column("id").to_pylist(), offsets.tolist(), offsets[1:].tolist(), strict=False):
                first, count, trigger, whole = phrases(data[a:b], length, min(WINDOW, length))
                own = np.empty(len(first), ENTRY)
                own["trigger"], own["phrase"], own["doc"], own["start"], own["strings"] = trigger, whole, doc, first, count
                held.append(own)
                n += len(own)
                if n >= TASK_PHRASES:
                    yield from _sent(*_settle(np.concatenate(held)), buckets)
                    held, n = [], 0
        if n:
            yield from _sent(*_settle(np.concatenate(held)), buckets)

    parsed = source.mapInArrow(parse, "bucket int, entries binary")
    folder = new_folder(spark, "phrase-leaders")
    settled = kept(_by_bucket(parsed, _judge_phrases(folder, buckets), f"{SPANS}, {REPORTS}"), "phrase-spans")
    several = settled.filter("path IS NOT NULL").select("path", "bucket", "own").groupBy("bucket").applyInArrow(_several, "path string, own binary")
    opened = kept(several.groupBy("path").applyInArrow(_opened(folder), SPANS), "open-spans")
    where, root = place(folder)
    where.delete_dir(root)
    n_open = opened.agg(F.sum(F.aggregate("strings", F.lit(0).cast("long"), lambda a, b: a + b))).first()[0] or 0
    string_buckets = max(buckets, -(-n_open * ENTRY.itemsize // STRING_BYTES))

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in slices(batches, "text"):
            data, offsets = utf8(batch.column("text"))
            columns = [batch.column(c).to_pylist() for c in ("id", "starts", "strings", "triggers")]
            for a, b, doc, begins, counts, own in zip(offsets.tolist(), offsets[1:].tolist(), *columns, strict=False):
                counts = np.array(counts, np.int64)
                ends = np.cumsum(counts)
                at = np.arange(ends[-1]) + np.repeat(np.array(begins, np.int64) - ends + counts, counts)
                trigger = np.repeat(np.array(own, np.int64).view(np.uint64), counts)
                fits = at + length <= b - a
                at, trigger = at[fits], trigger[fits]
                entries = np.empty(len(at), ENTRY)
                entries["trigger"], entries["phrase"] = trigger, string_hashes(data[a:b], at, length)
                entries["doc"], entries["start"], entries["strings"] = doc, at, 1
                held.append(entries)
                n += len(entries)
                if n >= TASK_PHRASES:
                    yield from _sent(*_settle(np.concatenate(held)), string_buckets)
                    held, n = [], 0
        if n:
            yield from _sent(*_settle(np.concatenate(held)), string_buckets)

    flat = lambda name: F.flatten(F.collect_list(name)).alias(name)
    questions = opened.groupBy("id").agg(flat("starts"), flat("strings"), flat("triggers"))
    again = source.join(questions, "id").mapInArrow(strings, "bucket int, entries binary")
    # Answers travel packed: a bucket sends one row to each part of the documents, however many of these it concerns.
    parts = max(8, -(-n_open * 16 // STRING_BYTES))
    found = _by_bucket(again, _judge_strings(parts), "part int, own binary")
    finer = kept(found.groupBy("part").applyInArrow(_documents, SPANS), "string-spans")

    covered = settled.filter("path IS NULL").select(SPAN_NAMES).union(finer).groupBy("id").agg(flat("starts"), flat("strings"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets = utf8(batch.column("text"))
            rows = []
            columns = [batch.column(c).to_pylist() for c in ("id", "starts", "strings")]
            for a, b, doc, starts, counts in zip(offsets.tolist(), offsets[1:].tolist(), *columns, strict=False):
                text = data[a:b]
                gone = np.zeros(len(text) + 1, np.int32)
                if starts:
                    begin = np.minimum(np.array(starts, np.int64), len(text))
                    np.add.at(gone, begin, 1)
                    np.add.at(gone, np.minimum(begin + np.array(counts, np.int64) - 1 + length, len(text)), -1)
                gone = np.cumsum(gone[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
                left = text[~gone].tobytes()
                runs = [{"start": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2], strict=True)]
                rows.append(
                    (None if doc == null_id else doc, len(text), int(gone.sum()), len(runs), hashlib.sha256(left).hexdigest(), runs, left.decode("utf-8", "replace"))
                )
            kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string()]
            names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept_text"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    schema = f"{id_col} long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>, kept_text string"
    return source.join(covered, "id", "left").select("id", "text", "starts", "strings").mapInArrow(cut, schema)
