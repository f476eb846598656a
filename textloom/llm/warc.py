"""WARC archives: writing with revisit records, and reading by boundary chains.

Reading splits a file at fixed offsets. A task looks for the record mark in its
split and parses what follows as a record, which yields a candidate (offset,
offset of its successor). Payloads may hold the mark, or whole records, so
candidates prove nothing by themselves: a record counts only if it is reached
from the start of its file. Pointer jumping finds these: each round joins the
reached offsets with jumps twice as long as the round before, so a file of n
candidates takes log2(n) rounds.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import kept
from .shared_files import new_folder, place, ready, tasks_for

MARK = b"WARC/1.1\r\n"
#: Payloads below this size are always written in full.
LEAST_REVISIT = 100
#: A task starts another file beyond this size; a split of a file for reading.
FILE_BYTES, SPLIT_BYTES = 16 << 20, 4 << 20
#: What a split reads beyond its end at first; a head that goes on is read to its end.
HEAD_BYTES = 64 << 10
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NUMBER = re.compile(rb"\d{1,18}")


def _head(fields: list[tuple[str, object]]) -> bytes:
    return MARK + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record, or a revisit record if it refers to another page."""
    name = "none" if page_id is None else page_id
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{name}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", quote(url or "", safe="!#$%&'()*+,/:;=?@[]~") or f"urn:page:{name}"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Payload-Length", len(payload)),
    ]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to is not None:
        fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
        block = http
    else:
        block = http + payload
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    return _head(fields) + block + b"\r\n\r\n"


def write_warc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """Write one record per row; return the list of files ``(path, n_bytes, n_records)``.

    Of equal payloads of at least ``LEAST_REVISIT`` bytes, the one with the smallest
    id is written in full; the others revisit it. Null and empty bodies are empty
    payloads. A row without an id is always written in full and refers to nothing;
    rows that repeat an id are records of their own, and those that carry the
    smallest id are all responses. Other columns are not read.
    """
    spark = pages.sparkSession
    ready(spark)
    folder = new_folder(spark, "warc")
    body = F.coalesce(F.col(body_col), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), body.alias("body"), F.sha2(body, 256).alias("digest")
    )
    # Only digests are shuffled: first rows of repeated payloads go back to the bodies by id.
    digests = kept(rows.select("id", "digest", F.octet_length("body").alias("n")).filter(F.col("n") >= LEAST_REVISIT), "payload-digests")
    first = digests.filter("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("k")).filter("k > 1")
    revisits = digests.join(first, "digest").filter("id != first").select("id", "digest", F.col("first").alias("refers_to")).distinct()
    revisits = kept(revisits, "revisits")  # its size is known then, and bodies are shuffled only if it is large
    rows = rows.join(revisits, ["id", "digest"], "left").select("id", "url", "body", "digest", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, files = TaskContext.get().partitionId(), []
        where, root = place(folder)
        out = path = None
        size = records = 0

        def close() -> None:
            out.close()
            where.move(f"{path}.open", path)
            files.append((path, size, records))

        for batch in batches:
            for row in batch.to_pylist():
                if out is not None and size >= FILE_BYTES:
                    close()
                    out = None
                if out is None:
                    path, size, records = f"{root}/part-{task:06d}-{uuid.uuid4().hex}.warc", 0, 0
                    out = where.open_output_stream(f"{path}.open")
                data = record(row["id"], row["url"], row["body"].encode(), row["digest"], row["refers_to"])
                out.write(data)
                size += len(data)
                records += 1
        if out is not None:
            close()
        if files:
            yield pa.RecordBatch.from_pydict({name: [f[k] for f in files] for k, name in enumerate(("path", "n_bytes", "n_records"))})

    return kept(rows.mapInArrow(write, "path string, n_bytes long, n_records long"), "warc-files")


def parse(head: bytes) -> dict[bytes, bytes] | None:
    """Fields of a record's head, names in lower case; None if it isn't one."""
    fields = {}
    at = head.find(b"\r\n")
    while at >= 0:
        begin, at = at + 2, head.find(b"\r\n", at + 2)
        name, colon, value = head[begin : at if at >= 0 else len(head)].partition(b":")
        if not colon or not name or name.strip() != name:
            return None
        fields[name.lower()] = value.strip()
    return fields if _NUMBER.fullmatch(fields.get(b"content-length", b"")) else None


def _candidates(source, size: int, begin: int, end: int) -> Iterator[tuple]:
    """Records that seem to start in ``[begin, end)`` of an open file."""
    data = source.read_at(min(end + HEAD_BYTES, size) - begin, begin)
    at, stop = data.find(MARK), -1
    while 0 <= at < end - begin:
        if stop < at:  # else the blank line found last is this head's too
            stop = data.find(b"\r\n\r\n", at)
            while stop < 0 and begin + len(data) < size:
                seen = len(data)
                data += source.read_at(min(max(seen, HEAD_BYTES), size - begin - seen), begin + seen)
                stop = data.find(b"\r\n\r\n", max(at, seen - 3))
            if stop < 0:
                return
        fields = parse(data[at:stop])
        if fields is not None:
            block = begin + stop + 4
            length = int(fields[b"content-length"])
            if block + length + 4 <= size:
                a, b = block - begin, block - begin + length + 4
                whole = data[a:b] if b <= len(data) else source.read_at(length + 4, block)
                if whole[-4:] == b"\r\n\r\n":
                    yield begin + at, block + length + 4, fields, whole[:-4]
        at = data.find(MARK, at + 1)


def _page(name: bytes) -> int | None:
    number = name.removeprefix(b"<urn:page:").removesuffix(b">")
    return int(number) if re.fullmatch(rb"-?\d{1,19}", number) else None


def reachable(candidates: DataFrame) -> DataFrame:
    """The ``(file, at)`` that a chain of candidates ``(file, at, next)`` reaches from the start of a file, its end included."""
    jumps = kept(candidates.select("file", "at", "next"), "jumps")
    most = jumps.groupBy("file").count().agg(F.max("count")).first()[0] or 0
    reached = jumps.filter("at = 0").select("file", "at")
    steps = 1
    while steps < most:
        onward = reached.join(jumps, ["file", "at"]).select("file", F.col("next").alias("at"))
        reached = kept(reached.union(onward), "reached")
        further = jumps.select("file", F.col("at").alias("next"), F.col("next").alias("over"))
        jumps = kept(jumps.join(further, ["file", "next"]).select("file", "at", F.col("over").alias("next")), "jumps")
        steps *= 2
    return reached


def read_warc(files: DataFrame) -> DataFrame:
    """One row per record of the files: ``(page_id, payload_bytes, payload_digest, record_type, refers_to)``.

    A response's digest and size are those of the payload as read; a revisit carries
    them in its head. Bytes that no chain from the file's start reaches are ignored;
    an empty file, or one that doesn't begin with a record, has no records. If the
    list has ``n_records``, as that of ``write_warc``, other numbers are an error.
    """
    spark = files.sparkSession
    ready(spark)
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, _ = place(root)
        for batch in batches:
            for row in batch.to_pylist():
                rows = []
                with where.open_input_file(row["path"]) as source:
                    for at, onward, fields, block in _candidates(source, row["n_bytes"], row["begin"], row["end"]):
                        kind = fields.get(b"warc-type", b"").decode("ascii", "replace")
                        if kind == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            n, digest = len(payload), hashlib.sha256(payload).hexdigest()
                        else:
                            n = int(fields[b"warc-payload-length"]) if _NUMBER.fullmatch(fields.get(b"warc-payload-length", b"")) else None
                            digest = fields.get(b"warc-payload-digest", b"").decode("ascii", "replace").removeprefix("sha256:")
                        refers = _page(fields[b"warc-refers-to"]) if b"warc-refers-to" in fields else None
                        rows.append((row["path"], at, onward, _page(fields.get(b"warc-record-id", b"")), n, digest, kind, refers))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), KINDS.values(), strict=True)], names=list(KINDS)
                    )

    splits = files.filter("n_bytes > 0").select(
        "path", "n_bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_bytes") - 1, F.lit(SPLIT_BYTES).cast("long"))).alias("begin")
    )
    splits = splits.withColumn("end", F.least(F.col("begin") + SPLIT_BYTES, "n_bytes"))
    splits = splits.repartition(tasks_for(spark, splits.count()))
    schema = "path string, at long, next long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    found = kept(splits.mapInArrow(find, schema).withColumn("file", F.xxhash64("path")).drop("path"), "record-candidates")
    records = found.join(reachable(found), ["file", "at"])
    if "n_records" in files.columns:
        read = records.groupBy("file").agg(F.count("*").alias("n_read"))
        wrong = files.withColumn("file", F.xxhash64("path")).join(read, "file", "left").filter("n_records != coalesce(n_read, 0)").select("path", "n_records", "n_read")
        if row := wrong.first():
            raise RuntimeError(f"{row['path']}: {row['n_records']} records written, {row['n_read'] or 0} read")
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_INT, _TEXT = pa.int64(), pa.string()
KINDS = {
    "path": _TEXT, "at": _INT, "next": _INT, "page_id": _INT, "payload_bytes": _INT,
    "payload_digest": _TEXT, "record_type": _TEXT, "refers_to": _INT,
}
