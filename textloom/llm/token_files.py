"""Token-id files: ids packed in the fewest bits that hold the vocabulary, with an index for random access.

A file is a run of blocks, then an index, then a fixed tail:

* blocks of ``block`` ids (the last may be shorter), each id in ``bits`` bits,
  lowest bit first, each block from a byte of its own;
* little-endian: offset of each block and of the end of the last (u64), document
  ids (i64, the smallest number for null), end of each document in ids (u64);
* tail: bits (u32), block (u32), ids (u64), documents (u64), the eight bytes ``TLTOKEN1``.

Documents are range-sorted by id; every sorted partition streams into a file of
its own, first under another name, so a repeated task never touches a file that is
in the list. The list of files is written before anything reads it.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import kept
from .shared_files import new_folder, place, ready, tasks_for
from .text_arrays import release, slices
from .tokens import encoder

MAGIC = b"TLTOKEN1"
TAIL = struct.Struct("<IIQQ8s")
BLOCK = 4096
NULL_ID = -(2**63)
#: Ids that a reader holds at once, unless one document has more.
READ_IDS = 1 << 20


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each, lowest bit first."""
    if bits % 8 == 0:
        return ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, : bits // 8].tobytes()
    rows = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(rows.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    """The first ``n`` ids of packed bytes."""
    raw = np.frombuffer(data, np.uint8)
    if bits % 8 == 0:
        out = np.zeros((n, 4), np.uint8)
        out[:, : bits // 8] = raw[: n * bits // 8].reshape(n, bits // 8)
        return out.reshape(-1).view("<u4")
    rows = np.unpackbits(raw, count=n * bits, bitorder="little").reshape(n, bits).astype(np.uint32)
    return (rows << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


class Writer:
    """Streams documents into one file."""

    def __init__(self, out, bits: int, block: int = BLOCK):
        self.out, self.bits, self.block = out, bits, block
        self.waiting: list[np.ndarray] = []
        self.held = self.n_ids = 0
        self.offsets, self.ids, self.ends = [0], [], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(NULL_ID if doc_id is None else doc_id)
        self.n_ids += len(ids)
        self.ends.append(self.n_ids)
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= 64 * self.block:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32)
        whole = len(ids) if last else len(ids) // self.block * self.block
        for at in range(0, whole, self.block):
            data = pack(ids[at : min(at + self.block, whole)], self.bits)
            self.out.write(data)
            self.offsets.append(self.offsets[-1] + len(data))
        self.waiting, self.held = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        self._flush(True)
        for values, kind in ((self.offsets, "<u8"), (self.ids, "<i8"), (self.ends, "<u8")):
            self.out.write(np.array(values, dtype=kind).tobytes())
        self.out.write(TAIL.pack(self.bits, self.block, self.n_ids, len(self.ids), MAGIC))


class Reader:
    """Random access to a file that ``Writer`` made."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        self.bits, self.block, self.n_ids, n_docs, magic = TAIL.unpack(source.read_at(TAIL.size, size - TAIL.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        blocks = -(-self.n_ids // self.block)
        at = size - TAIL.size - 8 * (2 * n_docs + blocks + 1)
        index = source.read_at(8 * (2 * n_docs + blocks + 1), at)
        self.offsets = np.frombuffer(index, "<u8", blocks + 1).astype(np.int64)
        self.doc_ids = np.frombuffer(index, "<i8", n_docs, 8 * (blocks + 1))
        self.ends = np.frombuffer(index, "<u8", n_docs, 8 * (blocks + 1 + n_docs)).astype(np.int64)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop``, reading only their blocks."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        data = self.source.read_at(int(self.offsets[last + 1] - self.offsets[first]), int(self.offsets[first]))
        parts = []
        for b in range(first, last + 1):
            n = min(self.block, self.n_ids - b * self.block)
            parts.append(unpack(data[self.offsets[b] - self.offsets[first] : self.offsets[b + 1] - self.offsets[first]], self.bits, n))
        return np.concatenate(parts)[start - first * self.block : stop - first * self.block]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Id, start and ids of each document, a bounded run of ids at a time."""
        a, n = 0, len(self.ends)
        starts = np.concatenate(([0], self.ends[:-1]))
        while a < n:
            b = max(a + 1, int(np.searchsorted(self.ends, starts[a] + READ_IDS, side="right")))
            ids = self.ids(int(starts[a]), int(self.ends[b - 1]))
            for i in range(a, b):
                own = ids[starts[i] - starts[a] : self.ends[i] - starts[a]]
                yield (None if self.doc_ids[i] == NULL_ID else int(self.doc_ids[i])), int(starts[i]), own
            a = b


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def write_token_files(
    docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", spaced: bool = True
) -> DataFrame:
    """Write token files in ascending id order; return their list ``(shard, path, n_docs, n_ids)``.

    Null text counts as empty: a document of the end id alone. A null id sorts
    first; rows that share an id are documents of their own, side by side. An empty
    table gives an empty list; other columns are not read.
    """
    spark = docs.sparkSession
    ready(spark)
    folder = new_folder(spark, "token-files")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer, spaced)
        bits = bits_for(max(words.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1))
        shard, end = TaskContext.get().partitionId(), np.array([end_id], np.uint32)
        where, path = place(f"{folder}/part-{shard:08d}-{uuid.uuid4().hex}.tokens")
        writer = out = None
        for batch in slices(batches, "text"):
            if writer is None:
                out = where.open_output_stream(f"{path}.open")
                writer = Writer(out, bits)
            for doc_id, ids in zip(batch.column("id").to_pylist(), words.encode(batch.column("text")), strict=True):
                writer.add(doc_id, np.concatenate([ids, end]))
        if writer is not None:
            writer.close()
            out.close()
            where.move(f"{path}.open", path)
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [path], "n_docs": [len(writer.ids)], "n_ids": [writer.n_ids]})
        words.forget()
        release()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).orderBy("id")
    return kept(rows.mapInArrow(write, "shard long, path string, n_docs long, n_ids long"), "token-file-list")


def read_token_files(files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document of the files: ``(id_col, start, n_tokens, ids_crc32)``; start counts all ids before it."""
    spark: SparkSession = files.sparkSession
    ready(spark)
    folder_of = place  # the list holds paths of the same file system as the shared folder
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or "/"
    before = F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    listed = files.select("shard", "path", F.coalesce(before, F.lit(0)).alias("base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, _ = folder_of(root)
        for batch in batches:
            for row in batch.to_pylist():
                with where.open_input_file(row["path"]) as source:
                    rows: list[tuple] = []
                    for doc_id, start, ids in Reader(source).documents():
                        rows.append((doc_id, row["base"] + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        if len(rows) == 4096:
                            yield _rows(rows)
                            rows = []
                    yield _rows(rows)

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[id_col, "start", "n_tokens", "ids_crc32"])

    return listed.repartition(tasks_for(spark, files.count())).mapInArrow(read, f"{id_col} long, start long, n_tokens long, ids_crc32 long")
