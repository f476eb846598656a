"""What the registered queries cover, and what their plans must not hold."""

from __future__ import annotations

import os

import pytest

from textloom.plans.registry import load

SF = "/root/testdata/sf0.001"
COUNTS = {"S": 13, "P": 8, "J": 5, "A": 19, "W": 6, "K": 3, "U": 2, "X": 6, "F": 17, "T": 7, "M": 8, "H": 2}


def test_every_surveyed_operator_has_a_query():
    wanted = {f"{kind}{i}" for kind, n in COUNTS.items() for i in range(1, n + 1)}
    wanted = wanted - {"T4"} | {"T4a", "T4b", "T4c", "T4d"}
    assert wanted == {item for q in load().values() for item in q.covers.split()}


def test_only_trained_models_lack_sql():
    without = {q.name for q in load().values() if not q.sql}
    assert without == {"word2vec", "subword_training", "random_forest", "linear_svc", "decision_tree", "embedding_classifier"}


CHEAP = [
    "stratified_split", "positional_split", "token_ids", "tfidf_weights", "bayes_predictions", "nearest_neighbour",
    "confusion_matrix", "class_report", "early_stopping", "stop_and_best", "vocabulary", "embedding_matrix",
    "document_vectors", "subword_vectors", "static_sequences", "reshuffled_train", "batch_loss", "signed_ranks",
]


@pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")
@pytest.mark.parametrize("name", CHEAP)
def test_no_plan_pairs_all_rows(spark, name):
    plan = load()[name].plan(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")
def test_split_reads_no_text(spark):
    plan = load()["stratified_split"].plan(spark, SF)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert scans and not any("text" in line.split("ReadSchema")[1] for line in scans)
