"""The registered queries and the pipeline."""

from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)

import corpus_pipeline  # noqa: E402
from textloom.llm import queries  # noqa: E402

from . import brute  # noqa: E402
from .conftest import CLASHING, SF, odd_rows, prose  # noqa: E402

needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")


@needs_tables
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_agrees_with_sql(spark, name):
    from tools import check

    con = check.connect(SF)
    want = con.sql(queries.ORACLE_SQL[name]).fetchall()
    columns = [c[0] for c in con.sql(queries.ORACLE_SQL[name]).description]
    found = queries.QUERIES[name](spark, SF).select(*columns).collect()
    order = lambda rows: sorted((tuple(r) for r in rows), key=repr)
    assert order(found) == order(want)


@needs_tables
def test_queries_agree_with_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    near = queries.QUERIES["op2_minhash_near_dedup"](spark, SF).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near} == brute.near(docs)
    cut = queries.QUERIES["op9_repeated_passages"](spark, SF).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in cut} == brute.repeats(docs)


@needs_tables
def test_language_query_is_right_on_held_out_rows(spark):
    lang = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect())
    found = queries.QUERIES["op8_language_id"](spark, SF).filter("held_out").collect()
    assert sum(lang[r["doc_id"]] == r["lang_pred"] for r in found) >= 0.95 * len(found)


def test_pipeline_stages_keep_what_they_should(spark, tmp_path):
    item = prose(60, 30)
    extra = [(500, prose(3, 80), "en", "s", 0), (501, f"{prose(90, 40)} {item}", "en", "s", 0), (502, "1234 !!", "en", "s", 0), (503, prose(91, 70), "en", "s", 0), (503, prose(91, 70), "en", "s", 0), (None, prose(92, 70), "en", "s", 0)]
    rows = [(i, t, "en", "s", 0) for i, t, *_ in odd_rows()] + extra
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns == before.columns
        left[name] = sorted((r["doc_id"] or -1, r["text"]) for r in docs.collect())
    letters = [(i or -1, t) for i, t, *_ in rows if t and any(c.isalpha() for c in t)]
    assert left["language_id"] == sorted(letters)
    best = {}
    for i, t in letters:
        best[brute.lower(t)] = max(best.get(brute.lower(t), -1), i)
    unique = {(i, t) for i, t in letters if best[brute.lower(t)] == i}
    assert set(left["exact_dedup"]) == unique and len(left["exact_dedup"]) == len(best)
    groups = brute.near([(i, t) for i, t in unique if i >= 0])
    near = sorted((i, t) for i, t in unique if i < 0 or groups[i][1] == i)
    assert left["minhash_near_dedup"] == near
    assert left["benchmark_decontamination"] == [x for x in near if x[0] != 501]
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] or -1 for r in packed if r["piece"] == 0} == {i for i, _ in near if i != 501}


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], CLASHING).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
