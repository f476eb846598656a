"""Token files, archives and packing."""

from __future__ import annotations

import io
import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from textloom.llm import packing, token_files, warc
from textloom.llm.tokens import WordEncoder

from . import brute
from .conftest import odd_rows, prose

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ENCODERS = {BYTES: WordEncoder(BYTES, True), WORDS: WordEncoder(WORDS, False)}
ALPHABET = "ab C'sS.,\n\t 09é²ÀÞ́Σσ中 \x1c<|>-_!ǅİ"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(ALPHABET) | st.characters(codec="utf-8"), max_size=40), max_size=4))
def test_ids_by_pieces_are_those_of_whole_texts(texts):
    for encoder in ENCODERS.values():
        assert [g.tolist() for g in encoder.encode(texts)] == [encoder.whole(t).tolist() for t in texts]


def test_ids_with_a_full_table_and_special_strings(monkeypatch):
    monkeypatch.setattr("textloom.llm.tokens.MOST_PIECES", 20)
    monkeypatch.setattr("textloom.llm.tokens.GROUP_CHARS", 200)
    texts = [prose(k, 50) for k in range(12)] + ["a<|endoftext|> b", None, "", "y" * 500 + " z."]
    for path, spaced in ((BYTES, True), (WORDS, False)):
        encoder = WordEncoder(path, spaced)
        assert [g.tolist() for g in encoder.encode(texts)] == [encoder.whole(t or "").tolist() for t in texts]


def test_ids_when_a_table_of_many_pieces_is_begun_anew(monkeypatch):
    monkeypatch.setattr("textloom.llm.tokens.MOST_PIECES", 36_000)
    name = lambda i: "".join("abcdefghij"[int(d)] for d in f"{i:05d}")
    first, second = (" ".join(map(name, range(a, b))) for a, b in ((0, 35_000), (30_000, 90_000)))
    encoder = WordEncoder(WORDS, False)
    for text in (first, second, first):
        assert encoder.encode([text])[0].tolist() == encoder.whole(text).tolist()


def test_a_group_looks_a_word_up_once_whatever_follows_it():
    asked = []

    class Table(dict):
        def get(self, piece, default=None):
            asked.append(piece)
            return super().get(piece, default)

    ends = ("", ",", ".", ";", "!?", "'s", "_", "=1")
    texts = ["", None, *(" ".join(w + e for w in ("alpha", "Ébène", "zeta") for e in ends) for _ in range(20))]
    for path, spaced in ((BYTES, True), (WORDS, False)):
        encoder = WordEncoder(path, spaced)
        encoder.known = Table()
        asked.clear()
        found = [g.tolist() for g in encoder.encode(pa.array(texts))]
        assert found == [encoder.whole(t or "").tolist() for t in texts]
        assert len(asked) == len(set(asked)) == len(encoder.known) == 4 + len(ends) - 1  # the first word also without its space


def test_texts_with_runs_of_white_space_are_encoded_by_pieces(monkeypatch):
    texts = ["def f():\n    return 1\n\n\n\tx \n\r\n", " \n ", "\n\n", "a  ", "  b", "\t", " \t c\n", "", "d\t e\x0b\x0c\n f", "\n", "g, \n\n  h."]
    for path, spaced in ((BYTES, True), (WORDS, False)):
        encoder = WordEncoder(path, spaced)
        want = [encoder.whole(t).tolist() for t in texts]
        monkeypatch.setattr(encoder, "whole", None)
        assert [g.tolist() for g in encoder.encode(texts)] == want
        assert [encoder.encode([t])[0].tolist() for t in texts] == want


def test_packing_cuts_documents_in_fewer_tasks(spark, tmp_path):
    docs = spark.range(64).select(F.col("id").alias("doc_id"), F.lit("a few words").alias("text"))
    docs.repartition(64).write.parquet(str(tmp_path / "documents"))
    at_least = 2 * spark.sparkContext.defaultParallelism
    scan = spark.read.parquet(str(tmp_path / "documents"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes")}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1b")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "900b")
        assert scan.rdd.getNumPartitions() > at_least
        assert packing.packed_by_fewer(scan).rdd.getNumPartitions() == at_least
        assert packing.pack_documents(packing.packed_by_fewer(scan), WORDS).count() == 64
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@given(st.integers(1, 32), st.integers(0, 200), st.integers(0, 2**32))
def test_packed_ids_come_back(bits, n, seed):
    ids = np.random.Generator(np.random.PCG64(seed)).integers(0, 2**bits, n, dtype=np.uint64).astype(np.uint32)
    data = token_files.pack(ids, bits)
    assert len(data) == -(-n * bits // 8)
    assert (token_files.unpack(data, bits, n) == ids).all()


@pytest.mark.parametrize("bits", [5, 16, 17])
def test_a_file_reads_back_anywhere(bits):
    draw = random.Random(bits)
    docs = [(i if i else None, np.array([draw.randrange(2**bits) for _ in range(draw.choice([0, 1, 50, 300]))], np.uint32)) for i in range(40)]
    out = io.BytesIO()
    writer = token_files.Writer(out, bits, block=64)
    for i, ids in docs:
        writer.add(i, ids)
    writer.close()
    reader = token_files.Reader(pa.PythonFile(io.BytesIO(out.getvalue()), "r"))
    assert [(i, ids.tolist()) for i, _, ids in reader.documents()] == [(i, ids.tolist()) for i, ids in docs]
    whole = np.concatenate([ids for _, ids in docs])
    for _ in range(30):
        a, b = sorted(draw.randrange(len(whole) + 1) for _ in range(2))
        assert (reader.ids(a, b) == whole[a:b]).all()


def test_token_files_of_odd_rows(odd, none):
    files = token_files.write_token_files(odd, BYTES, end_id=2)
    tokenizer, start, want = Tokenizer.from_file(BYTES), 0, []
    for i, text, *_ in sorted(odd_rows(), key=lambda r: r[0]):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), brute.crc(ids)))
        start += len(ids)
    assert sorted(tuple(r) for r in token_files.read_token_files(files).collect()) == want
    empty = token_files.write_token_files(none, BYTES, end_id=2)
    assert empty.count() == 0 and token_files.read_token_files(empty).count() == 0


def test_token_files_with_repeated_and_missing_ids(spark):
    rows = spark.createDataFrame([(2, "b"), (None, None), (2, "b"), (1, "a")], "doc_id long, text string")
    found = token_files.read_token_files(token_files.write_token_files(rows, BYTES, end_id=2)).collect()
    assert sorted((r["start"], r["doc_id"], r["n_tokens"]) for r in found) == [(0, None, 1), (1, 1, 2), (3, 2, 2), (5, 2, 2)]


def placed_well(rows, size):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


def test_packing_of_odd_rows(odd, none):
    rows = packing.pack_documents(odd, WORDS, size=256).collect()
    tokenizer, want = Tokenizer.from_file(WORDS), set()
    for i, text, *_ in odd_rows():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        want |= {(i, k, s, len(ids[s : s + 256]), brute.crc(ids[s : s + 256])) for k, s in enumerate(range(0, len(ids), 256))}
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows} == want and len(rows) == len(want)
    assert placed_well(rows, 256) <= -(-sum(r["length"] for r in rows) // 256) + 1
    assert packing.pack_documents(none, WORDS).count() == 0


def test_packing_keeps_rows_that_share_an_id_apart(spark):
    rows = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None), (None, "c")], "doc_id long, text string")
    found = packing.pack_documents(rows, WORDS, size=4).collect()
    assert sorted(r["length"] for r in found) == [1, 2, 3, 3]
    assert placed_well(found, 4) == 3


@given(st.lists(st.integers(1, 40), max_size=120))
def test_best_fit_is_that_of_single_pieces(lengths):
    """Bulk matches hold every piece once, without overlap, in as many sequences as best fit decreasing needs."""
    size = 40
    counts = {n: lengths.count(n) for n in set(lengths)}
    used, seen = {}, {n: set() for n in counts}
    for length, rank, n, first, offset in packing.best_fit(counts, size):
        for k in range(n):
            assert rank + k not in seen[length]
            seen[length].add(rank + k)
            assert used.get(first + k, 0) == offset
            used[first + k] = offset + length
    assert all(len(seen[n]) == c for n, c in counts.items()) and all(v <= size for v in used.values())
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - n)
        else:
            gaps.append(size - n)
    assert len(used) <= len(gaps) + max(1, len(gaps) // 10)


@given(st.lists(st.tuples(st.integers(1, 40), st.integers(1, 30)), max_size=12))
def test_best_fit_opens_no_more_sequences_than_that_of_single_pieces(classes):
    for counts in (dict(classes), {30: 2, 5: 2, 3: 3}):
        used, gaps = {}, []
        for length, rank, n, first, offset in sorted(packing.best_fit(counts, 40), key=lambda m: (-m[0], m[1])):
            for k in range(first, first + n):
                assert used.get(k, 0) == offset and offset + length <= 40
                used[k] = offset + length
        for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
            fit = min((g for g in gaps if g >= n), default=None)
            if fit is not None:
                gaps.remove(fit)
            gaps.append((40 if fit is None else fit) - n)
        assert sorted(40 - v for v in used.values()) == sorted(gaps)


PAGES = "page_id long, url string, html string, path string, id long, at int"


def pages():
    record = warc.record(99, "http://inner", b"inner payload", "0" * 64, None).decode()
    same, odd_bodies = prose(41, 40), [None, "", "short", "short", "é" * 60]
    bodies = [*odd_bodies, same, same, same, f"<p>{record}</p>" * 3, record, f"{record}WARC/1.1\r\nContent-Length: 7\r\n\r\n", "\r\n\r\n" * 50, prose(42, 3000)]
    urls = ["http://a/b c", None, "http://x/\r\nWARC/1.1\r\n", "http://ü/", ""]
    return [(10 - i if i < 7 else i * 3, urls[i % len(urls)], body, "p", 1, 0) for i, body in enumerate(bodies)]


def test_archives_of_odd_pages(spark, monkeypatch):
    monkeypatch.setattr(warc, "SPLIT_BYTES", 700)  # records begin, end and reach over splits
    rows = pages()
    found = warc.read_warc(warc.write_warc(spark.createDataFrame(rows, PAGES).repartition(2))).collect()
    first = {}
    for i, _, body, *_ in sorted(rows):
        first.setdefault(body or "", i)
    want = set()
    import hashlib

    for i, _, body, *_ in rows:
        data = (body or "").encode()
        again = len(data) >= 100 and first[body] != i
        want.add((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[body] if again else None))
    assert {tuple(r) for r in found} == want and len(found) == len(want)


@pytest.mark.parametrize("split", [warc.SPLIT_BYTES, 50_000])
def test_archives_of_long_urls(spark, monkeypatch, split):
    monkeypatch.setattr(warc, "SPLIT_BYTES", split)
    urls = ["http://a", "data:text/plain," + "x" * 200_000, "http://b", "http://" + "ü" * 30_000, "http://c", "y" * 70_000]
    bodies = ["one", "WARC/1.1\r\n" * 3, "WARC/1.1\r\nab: " + "z" * 100_000, "", "WARC/1.1\r\na: b\r\n" * 9000, "end"]
    rows = [(i, u, b) for i, (u, b) in enumerate(zip(urls, bodies, strict=True))]
    found = warc.read_warc(warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1))).collect()
    assert sorted((r["page_id"], r["payload_bytes"]) for r in found) == [(i, len(b)) for i, _, b in rows]


def test_lost_records_are_an_error(spark):
    files = warc.write_warc(spark.createDataFrame([(1, "u", "a"), (2, "u", "b")], "page_id long, url string, html string").coalesce(1))
    path = files.first()["path"]
    with open(path, "rb") as source:
        data = source.read()
    with open(path, "wb") as out:
        out.write(data.replace(b"WARC/1.1\r\n", b"WARC/1.2\r\n").replace(b"WARC/1.2", b"WARC/1.1", 1))
    with pytest.raises(RuntimeError, match="2 records written, 1 read"):
        warc.read_warc(files)


def test_archives_of_repeated_missing_and_no_pages(spark):
    body = prose(43, 40)
    rows = [(1, "u", body), (1, "u", body), (None, "u", body), (4, "u", body)]
    found = warc.read_warc(warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()
    assert sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in found) == [
        (0, "response", None), (1, "response", None), (1, "response", None), (4, "revisit", 1)
    ]
    nothing = spark.createDataFrame([], PAGES)
    assert warc.read_warc(warc.write_warc(nothing)).count() == 0


def test_chains_start_at_the_start_of_their_file(spark):
    rows = [("a", 0, 10), ("a", 3, 10), ("a", 10, 25), ("a", 12, 25), ("a", 25, 40), ("b", 5, 9), ("b", 9, 12), ("c", 0, 4)]
    found = warc.reachable(spark.createDataFrame(rows, "file string, at long, next long")).collect()
    assert sorted(tuple(r) for r in found) == [("a", 0), ("a", 10), ("a", 25), ("a", 40), ("c", 0), ("c", 4)]
