"""Exact copies, near copies and repeated passages."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import exact_dedup as exact
from textloom.llm import minhash, passages
from textloom.llm.components import components
from textloom.llm.text_arrays import shingle_sets, utf8

from . import brute
from .conftest import CLASHING, edited, odd_rows, prose


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_dedup_of_odd_rows(odd, keep):
    groups = defaultdict(list)
    for i, text, *_ in odd_rows():
        groups[brute.lower(text)].append(i)
    pick = max if keep == "largest" else min
    want = {
        (i, pick(ids), len(ids), i == pick(ids), hashlib.sha256(text.encode()).hexdigest())
        for text, ids in groups.items() for i in ids
    }
    assert {tuple(r) for r in exact.exact_dedup(odd, keep=keep).collect()} == want


def test_exact_dedup_merges_over_many_runs_and_keeps_one_of_tied_rows(spark):
    rows = [(i % 50, "same" if i % 3 else f"text {i % 20}") for i in range(300)] + [(None, "same"), (None, "lone")]
    found = exact.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(40)).collect()
    assert len(found) == len(rows)
    kept = [r for r in found if r["kept"]]
    assert len(kept) == len({t for _, t in rows})
    same = hashlib.sha256(b"same").hexdigest()
    assert {(r["keep_id"], r["group_size"]) for r in found if r["text_sha256"] == same} == {(49, 201)}
    assert [r["keep_id"] for r in kept if r["text_sha256"] == hashlib.sha256(b"lone").hexdigest()] == [None]


def test_near_duplicates_of_odd_rows(odd):
    want = brute.near([r[:2] for r in odd_rows()])
    found = minhash.near_duplicates(odd).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_near_duplicates_of_a_hot_group_and_chains(spark):
    base = prose(11, 120).split()
    rows = []
    for i in range(150):  # a star of near copies, and a chain whose ends are not alike
        own = list(base)
        own[i % 120] = f"w{i}"
        rows.append((1000 + i, " ".join(own)))
    rows += [(i, " ".join(base[40 + 4 * i :] + [f"t{k}" for k in range(4 * i)])) for i in range(8)]
    rows += [(5000 + i, prose(100 + i, 60)) for i in range(30)]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute.near(rows)


def test_near_duplicates_with_repeated_and_missing_ids(spark):
    rows = [(1, prose(1, 30)), (1, prose(2, 30)), (2, prose(1, 30)), (3, prose(2, 30)), (None, prose(1, 30)), (None, None), (4, None)]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["component_id"], r["kept"]) for r in found if r["doc_id"] is not None)
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True)]
    assert [(r["component_id"], r["kept"]) for r in found if r["doc_id"] is None] == [(None, True)] * 2


def test_sketches_fill_and_estimate():
    draw = np.random.Generator(np.random.PCG64(3))
    for n in (1, 2, 7, 100, 5000):
        own = np.unique(draw.integers(0, 2**64, n, dtype=np.uint64))
        assert (minhash.sketch(own) != np.uint64(2**64 - 1)).all()
        assert (minhash.sketch(own) == minhash.sketch(own[::-1].copy())).all()
    pool = draw.integers(0, 2**64, 5000, dtype=np.uint64)
    same = [(minhash.sketch(pool[k : k + 800]) == minhash.sketch(pool[k + 200 : k + 1000])).mean() for k in range(0, 4000, 100)]
    assert abs(np.mean(same) - 0.6) < 0.03 and min(same) > 0.4


def test_shingle_sets_match_plain_python():
    import pyarrow as pa

    texts = [t for _, t, *_ in odd_rows()]
    sets = shingle_sets(*utf8(pa.array(texts)))
    assert [len(s) for s in sets] == [len(brute.shingles(t)) for t in texts]


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (9, 8), (8, 7), (5, 5), (4, 1), *[(100, 100 + k) for k in range(1, 200)], *[(k, k + 1) for k in range(400, 430)]]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7, 9: 7, **dict.fromkeys(range(100, 300), 100), **dict.fromkeys(range(400, 431), 400)}
    assert found == want


def test_passages_of_odd_rows(odd):
    found = passages.repeated_passages(odd).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found} == brute.repeats([r[:2] for r in odd_rows()])


def test_passages_within_and_across_documents(spark):
    a, b = prose(21, 40), prose(22, 25)
    rows = [(1, f"{a} {b} {a}"), (2, f"x{b}y"), (3, b[:99]), (4, b[:100]), (5, "é" * 200), (6, f"{prose(23, 9)} {a[5:150]}{b[3:]} end"), (0, a[10:140])]
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found} == brute.repeats(rows)
    spans = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in found}
    assert spans[4] == [(0, 100)] and spans[3] == []


def test_passages_that_share_a_trigger_are_spread(spark, monkeypatch):
    # A line whose window has the least hash of all, so that it is the trigger in any surroundings.
    hashes = lambda t: passages.range_hashes(*(lambda d: (passages.prefix_sums(d), np.arange(len(d) - 31), np.arange(len(d) - 31) + 32))(np.frombuffer(t.encode(), np.uint8)))
    line = min((prose(k, 40)[:32] for k in range(3000)), key=lambda t: int(hashes(t)[0]))
    rows = [(i, f"{prose(500 + i, 30)} {line} {prose(900 + i, 30)}") for i in range(200)]
    rows += [(300 + i, f"{prose(1500 + i, 9)} {rows[i][1][100 + i : 300]} {prose(1700 + i, 9)}") for i in range(20)]
    parsed = [passages.phrases(np.frombuffer(t.encode(), np.uint8)) for _, t in rows[:200]]
    hot = int(hashes(line)[0])
    entries = np.zeros(sum(len(p[0]) for p in parsed), passages.ENTRY)
    entries["trigger"], entries["phrase"] = np.concatenate([p[2] for p in parsed]), np.concatenate([p[3] for p in parsed])
    entries["doc"] = np.repeat(np.arange(200), [len(p[0]) for p in parsed])
    entries = entries[entries["trigger"] == hot]
    assert len(entries) >= 150
    sizes = [len(b) for batch in passages._sent(entries, np.zeros(len(entries), bool), 8) for b in batch.column("entries").to_pylist()]
    assert len(sizes) == 8 and max(sizes) < sum(sizes) / 3
    monkeypatch.setattr(passages, "STRING_BYTES", 10_000)
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found} == brute.repeats(rows)


def test_passages_of_repeated_ids_leave_one_copy(spark):
    text = prose(31, 60)
    found = passages.repeated_passages(spark.createDataFrame([(2, text), (2, text), (5, text), (None, None)], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in found) == [(0, 0), (2, 0), (2, 0), (5, len(text))]


def test_triggers_are_the_least_hash_of_every_run():
    draw = np.random.Generator(np.random.PCG64(5))
    hashes = np.concatenate([draw.integers(0, 2**64, 500, dtype=np.uint64), np.full(300, 7, np.uint64)])
    for span in (1, 2, 5, 69):
        order = hashes >> np.uint64(20)
        want = [i + int(np.argmin(order[i : i + span])) for i in range(len(hashes) - span + 1)]
        assert passages.triggers(hashes, span).tolist() == want


@pytest.mark.parametrize("operator", [exact.exact_dedup, minhash.near_duplicates, passages.repeated_passages])
def test_empty_tables(none, operator):
    assert operator(none).count() == 0


def test_extra_columns_pass_unread(spark):
    rows = spark.createDataFrame(odd_rows(), CLASHING)
    plan = exact.exact_dedup(rows.withColumn("poison", F.raise_error(F.lit("read")).cast("string")))
    assert plan.count() == len(odd_rows())


def test_texts_that_share_an_id_are_judged_apart(spark):
    near = edited(prose(1, 60), 30)
    rows = [(1, prose(1, 60)), (1, prose(2, 60)), (2, near), (3, edited(prose(2, 60), 10)), (1, None), (7, prose(9, 60)), (7, prose(8, 60))]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in found)
    assert got == [(1, 0, 1, True), (1, 56, 1, True), (1, 56, 1, True), (2, 56, 1, False), (3, 56, 1, False), (7, 56, 7, True), (7, 56, 7, True)]
    assert len({r["text_sha256"] for r in found}) == 7


def test_marks_of_fine_sketches_count_their_differences(spark):
    draw = np.random.Generator(np.random.PCG64(4))
    pool = draw.integers(0, 2**64, 900, dtype=np.uint64)
    for shared, limit in ((600, True), (520, False)):  # of 700 each: similarity 0.75 and 0.59
        a, b = pool[:700], np.concatenate([pool[:shared], pool[700 : 1400 - shared]])
        x, y = (minhash.fine_marks(minhash.sketch(s, minhash._FINE_SEEDS)) for s in (a, b))
        frame = spark.createDataFrame([(x.tolist(), y.tolist())], "x array<long>, y array<long>")
        got = frame.select(minhash.fine_differences("x", "y")).first()[0]
        plain = sum(bin(((int(p) ^ int(q)) | ((int(p) ^ int(q)) >> 1)) & minhash._ODD).count("1") for p, q in zip(x, y, strict=True))
        assert got == plain and (got <= minhash.most_differences(75, minhash.FINE_BINS, 2)) == limit
