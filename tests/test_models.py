"""TF-IDF, naive Bayes, neighbours and trained models on small tables."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.operators import bayes, embeddings, models, neighbours, tfidf


def study(spark, rows):
    """``rows``: (id, label, text, split) of one seed."""
    frame = spark.createDataFrame(rows, "id long, label int, text string, split string")
    entry = F.struct(F.lit(1).alias("seed"), "split")
    return frame.select("id", "label", F.array(entry).alias("assign"), tx.terms(F.col("text")).alias("terms"))


def random_rows(n, words, length, seed=0, copies=()):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = " ".join(f"w{min(int(rng.expovariate(0.15)), words)}x" for _ in range(rng.randint(0, length)))
        rows.append([i, rng.randint(0, 1), text, "test" if i % 4 == 0 else "train"])
    for a, b in copies:
        rows[b][2] = rows[a][2]
    return [tuple(r) for r in rows]


def test_tfidf_weights(spark):
    docs = study(spark, [(0, 0, "aa bb", "train"), (1, 1, "aa cc", "train")])
    model = tfidf.fit_tfidf(docs, [1])
    rows = tfidf.tfidf_long(tfidf.weigh(docs, model), model).filter("id = 0").collect()
    assert {r["term"]: round(r["weight"], 6) for r in rows} == {"aa": 0.579739, "bb": 0.814802}


def test_tfidf_rows_have_unit_norm_or_none(spark):
    docs = study(spark, random_rows(40, 30, 12))
    rows = tfidf.weigh(docs, tfidf.fit_tfidf(docs, [1])).collect()
    assert len(rows) == 40
    for row in rows:
        norm = sum(p["weight"] ** 2 for p in row["features"])
        assert math.isclose(norm, 1, rel_tol=1e-12) or not row["features"]


@pytest.mark.parametrize("features", [1, 3, 7])
def test_top_terms_are_proven_complete(spark, features):
    """Terms frequent over all seeds but rare in one seed's train rows must not mislead."""
    rng = random.Random(features)
    rows = [(i, i % 2, " ".join(rng.choices([f"t{j:02d}" for j in range(60)], k=6))) for i in range(50)]
    seeds = [1, 2, 3]
    frame = spark.createDataFrame(rows, "id long, label int, text string")
    entries = [
        F.struct(F.lit(s).alias("seed"), F.when(F.col("id") % 5 == s, "train").otherwise("test").alias("split"))
        for s in seeds
    ]
    docs = frame.select("id", "label", F.array(*entries).alias("assign"), tx.terms(F.col("text")).alias("terms"))
    got = tfidf.fit_tfidf(docs, seeds, features).terms.collect()
    for seed in seeds:
        counts = Counter(t for i, _, text in rows if i % 5 == seed for t in text.split())
        best = sorted(counts, key=lambda t: (-counts[t], t))[:features]
        assert {r["term"]: r["cf"] for r in got if r["seed"] == seed} == {t: counts[t] for t in best}


def brute_force(rows):
    def distance(a, b):
        one = lambda v: float(bool(v))
        return round(one(a) + one(b) - 2 * sum(w * b.get(i, 0.0) for i, w in a.items()), 9)

    vectors = {r["id"]: {p["idx"]: p["weight"] for p in r["features"]} for r in rows}
    train = sorted(r["id"] for r in rows if r["split"] == "train")
    return {
        r["id"]: min((distance(vectors[r["id"]], vectors[t]), t) for t in train) for r in rows if r["split"] == "test"
    }


@pytest.mark.parametrize(
    "rows",
    [
        random_rows(120, 40, 15, 1),
        random_rows(120, 400, 4, 2),
        random_rows(90, 8, 3, 3, copies=[(1, i) for i in range(20, 60)]),
    ],
    ids=["dense", "sparse", "copies"],
)
def test_nearest_neighbour_equals_brute_force(spark, rows):
    docs = study(spark, rows)
    weighed = tfidf.weigh(docs, tfidf.fit_tfidf(docs, [1]))
    want = brute_force(weighed.collect())
    got = {r["id"]: (r["dist"], r["nn_id"]) for r in neighbours.nearest_neighbour(weighed).collect()}
    assert got == want


def test_terms_are_counted_once_for_all_seeds(spark):
    docs = study(spark, random_rows(80, 12, 10, 6))
    model = tfidf.fit_tfidf(docs, [1])
    counted = tfidf.counted_once(docs, model)
    assert "terms" not in counted.columns
    key = lambda df: sorted(map(str, df.collect()))
    got = [key(models.predict_splits(d, models.fit_on_tfidf(d, model, 1, "linear_svc"), 1)) for d in (docs, counted)]
    assert got[0] == got[1]


def test_nearest_neighbour_over_parts_and_blocks(spark, monkeypatch):
    rows = random_rows(120, 40, 15, 5, copies=[(1, i) for i in range(20, 40)])
    docs = study(spark, rows)
    weighed = tfidf.weigh(docs, tfidf.fit_tfidf(docs, [1]))
    found = neighbours.nearest_neighbour(weighed, part=16)
    assert {r["id"]: (r["dist"], r["nn_id"]) for r in found.collect()} == brute_force(weighed.collect())
    # Only vectors are shuffled: no plan joins terms with terms.
    assert "idx" not in "".join(line for line in found._jdf.queryExecution().toString().splitlines() if "Join" in line)


def test_bayes_equals_the_dense_formula(spark):
    docs = study(spark, random_rows(80, 12, 10, 4))
    model = tfidf.fit_tfidf(docs, [1])
    weighed = tfidf.weigh(docs, model)
    got = {r["id"]: r["pred"] for r in bayes.predict_bayes(weighed, bayes.fit_bayes(weighed, model.terms)).collect()}

    rows, width = weighed.collect(), len(model.words)
    dense = {r["id"]: [{p["idx"]: p["weight"] for p in r["features"]}.get(j, 0.0) for j in range(width)] for r in rows}
    train = [r for r in rows if r["split"] == "train"]

    def spread(group):
        mean = [sum(dense[r["id"]][j] for r in group) / len(group) for j in range(width)]
        var = [sum((dense[r["id"]][j] - mean[j]) ** 2 for r in group) / len(group) for j in range(width)]
        return mean, var

    floor = 1e-9 * max(spread(train)[1])
    classes = {}
    for label in (0, 1):
        group = [r for r in train if r["label"] == label]
        mean, var = spread(group)
        classes[label] = (math.log(len(group) / len(train)), mean, [v + floor for v in var])
    for r in rows:
        scores = {}
        for label, (prior, mean, var) in classes.items():
            terms = zip(dense[r["id"]], mean, var)
            scores[label] = prior - 0.5 * sum(math.log(2 * math.pi * v) + (x - m) ** 2 / v for x, m, v in terms)
        assert got[r["id"]] == max(scores, key=lambda c: (scores[c], -c))


@pytest.mark.parametrize("name", ["random_forest", "linear_svc", "decision_tree", "gaussian_bayes", "logistic"])
def test_classifiers_by_name_predict_both_held_out_splits(spark, name):
    rows = [(i, i % 2, "good fine nice" if i % 2 else "bad poor weak", ["train", "val", "test"][i % 3]) for i in range(60)]
    docs = study(spark, rows)
    options = {"numTrees": 5} if name == "random_forest" else {}
    fitted = models.fit_on_tfidf(docs, tfidf.fit_tfidf(docs, [1]), 1, name, **options)
    got = models.predict_splits(docs, fitted, 1).collect()
    assert {r["split"] for r in got} == {"val", "test"} and len(got) == 40
    assert all(r["pred"] == r["label"] for r in got)


def test_unknown_classifier_is_refused():
    with pytest.raises(ValueError, match="unknown classifier"):
        models.classifier("gru")


def test_word_vectors_have_the_asked_size(spark):
    frame = spark.createDataFrame([(i, "int a = b ;\n}\nint c = a ;") for i in range(12)], "id long, text string")
    corpus = embeddings.sentences(frame)
    assert corpus.count() == 24
    rows = embeddings.train_word2vec(corpus, dim=7, min_count=12, epochs=1).collect()
    assert {r["word"] for r in rows} == {"int", "a", "b", "c", "=", ";"}
    assert {len(r["vec"]) for r in rows} == {7}
