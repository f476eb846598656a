"""Worked answers on small tables."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from textloom.functions import arrays as ar
from textloom.functions import text as tx
from textloom.operators import clean, embeddings, experiment, metrics, ordering, profile, sequences, signedrank, split, tfidf
from textloom.operators import vocabulary as vo
from textloom.schemas import SEEDS


def one(spark, column, **values):
    schema = ", ".join(f"{k} {_kind(v)}" for k, v in values.items())
    frame = spark.createDataFrame([tuple(values.values())], schema) if values else spark.range(1)
    return frame.select(column.alias("x")).first()["x"]


def _kind(value):
    if isinstance(value, list):
        return f"array<{_kind(value[0])}>"
    return {str: "string", int: "int", float: "double"}[type(value)]


def ints(spark, values):
    return spark.createDataFrame([(list(values),)], "ids array<int>")


def texts(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "id long, text string")


# ---- predicates


def test_excluding_a_project_keeps_rows_without_one(spark):
    rows = spark.createDataFrame([(None,), ("Chrome",), ("x",)], "project string")
    assert {r[0] for r in clean.exclude_project(rows, "Chrome").collect()} == {None, "x"}


def test_null_and_empty_text_is_dropped_blank_and_words_stay(spark):
    rows = texts(spark, None, "", "  ", "null", "a")
    assert [r["text"] for r in clean.drop_null_text(rows).orderBy("id").collect()] == ["  ", "null", "a"]


def test_threshold_is_strict(spark):
    assert one(spark, ar.class_at(F.col("p")), p=0.5) == 0
    assert one(spark, ar.class_at(F.col("p")), p=0.500001) == 1


def test_first_maximum_wins(spark):
    assert one(spark, ar.argmax(F.col("s")), s=[0.4, 0.4, 0.2]) == 0


def test_union_fills_missing_columns(spark):
    a = spark.createDataFrame([(1, "x")], "id int, k string")
    b = spark.createDataFrame([(2,)], "id int")
    assert {tuple(r) for r in clean.union_all([a, b]).collect()} == {(1, "x"), (2, None)}


def test_majority_and_minority_ties_go_to_the_lower_label(spark):
    rows = spark.createDataFrame([(0,), (1,), (2,), (2,)], "label int")
    assert tuple(profile.majority_minority(rows).first()) == (2, 2, 0, 1)


# ---- order and splits


def labelled(spark, sizes):
    rows = [(n, label) for n, label in enumerate(lab for lab, k in enumerate(sizes) for _ in range(k))]
    return spark.createDataFrame(rows, "id long, label int")


def test_positional_split_of_twelve(spark):
    rows = split.positional_split(spark.range(1, 13)).collect()
    got = {r["id"]: r["split"] for r in rows}
    assert got == {**{i: "train" for i in range(1, 11)}, 11: "val", 12: "test"}


@pytest.mark.parametrize("ids", [[-(10**15) * i for i in range(1, 31)], [7 + (1 << 40) * (i % 3) + i for i in range(30)]])
def test_positional_split_of_sparse_ids(spark, ids):
    rows = split.positional_split(spark.createDataFrame([(i,) for i in ids], "id long")).collect()
    order = sorted(ids)
    got = {r["id"]: r["split"] for r in rows}
    assert [got[i] for i in order] == ["train"] * 24 + ["val"] * 3 + ["test"] * 3


def test_positional_split_refuses_nine_rows(spark):
    with pytest.raises(ValueError, match="too few"):
        split.positional_split(spark.range(9))


def test_stratified_quotas(spark):
    rows = split.class_quotas(labelled(spark, [14, 6])).orderBy("label").collect()
    assert [tuple(r) for r in rows] == [(0, 14, 1, 1), (1, 6, 1, 1)]
    counts = split.stratified_split(labelled(spark, [14, 6]), [1]).groupBy("split", "label").count().collect()
    assert {(r[0], r[1]): r[2] for r in counts} == {
        ("train", 0): 12, ("train", 1): 4, ("val", 0): 1, ("val", 1): 1, ("test", 0): 1, ("test", 1): 1,
    }


def test_stratified_split_is_disjoint_complete_and_same_for_any_partitioning(spark):
    rows = labelled(spark, [300, 45, 7])
    first = split.stratified_split(rows.repartition(1), SEEDS[:3])
    second = split.stratified_split(rows.repartition(8), SEEDS[:3])
    a = {(r["seed"], r["id"]): r["split"] for r in first.collect()}
    assert len(a) == 3 * 352 == first.count()
    assert a == {(r["seed"], r["id"]): r["split"] for r in second.collect()}
    assert len({tuple(sorted(i for (s, i), v in a.items() if s == seed and v == "test")) for seed in SEEDS[:3]}) == 3


@pytest.mark.parametrize("k,expected", [(1, {0: 2, 1: 2}), (2, {0: 4, 1: 2}), (5, {0: 9, 1: 2})])
def test_undersampling(spark, k, expected):
    train = labelled(spark, [9, 2]).withColumn("seed", F.lit(123))
    got = split.undersample(train, k).groupBy("label").count().collect()
    assert {r[0]: r[1] for r in got} == expected
    report = split.undersample_report(train, k).first()
    assert (report["target"], report["reachable"]) == (2 * k, 2 * k <= 9)


def test_three_classes_are_not_undersampled(spark):
    train = labelled(spark, [9, 2, 3]).withColumn("seed", F.lit(1))
    assert split.undersample(train, 1).count() == 14


def test_treatments_share_one_split(spark):
    rows = split.assign_treatments(labelled(spark, [60, 20]), [5, 6], [None, 1])
    long = rows.select("id", "label", F.inline("assign"))
    numbered = {(place, seed): run for run, place, seed in split.runs_of([5, 6], [None, 1])}
    runs = list(numbered.values())
    assert sorted(r[0] for r in long.select("seed").distinct().collect()) == sorted(runs)
    for seed in (5, 6):
        plain = {r["id"]: r["split"] for r in long.filter(F.col("seed") == numbered[0, seed]).collect()}
        equal = {r["id"]: r["split"] for r in long.filter(F.col("seed") == numbered[1, seed]).collect()}
        assert {i: s for i, s in plain.items() if s != "train"} == {
            i: s for i, s in equal.items() if s in ("val", "test")
        }
        kept = [i for i, s in equal.items() if s == "train"]
        assert set(kept) <= {i for i, s in plain.items() if s == "train"}
        assert sum(i < 60 for i in kept) == sum(i >= 60 for i in kept)


def test_shuffle_is_the_same_for_any_partitioning(spark):
    rows = spark.range(500)
    a = [r["id"] for r in ordering.seeded_shuffle(rows.repartition(1), 3).collect()]
    b = [r["id"] for r in ordering.seeded_shuffle(rows.repartition(8), 3).collect()]
    places = {r["id"]: r["pos"] for r in ordering.shuffled_position(rows, 3).collect()}
    assert a == b == sorted(places, key=places.get) and a != sorted(a)
    assert sorted(places.values()) == list(range(1, 501))


def test_global_rank_of_a_table_with_one_hot_count(spark):
    rows = spark.createDataFrame([(f"w{i:04d}", 1 if i > 5 else 9) for i in range(2000)], "word string, n long")
    got = ordering.global_rank(rows.repartition(7), [F.desc("n"), F.col("word")]).collect()
    order = sorted(got, key=lambda r: (-r["n"], r["word"]))
    assert [r["rank"] for r in order] == list(range(1, 2001))


# ---- text


@pytest.mark.parametrize(
    "text,expected", [(" a  b\tc\n", ["a", "b", "c"]), ("a b c\x1fd", ["a", "b", "c", "d"]), ("", [])]
)
def test_words(spark, text, expected):
    assert one(spark, tx.words(F.col("t")), t=text) == expected == text.split()


@pytest.mark.parametrize("text", ["a\r\nb\n\nc", "a\n", "", "\n", "x\x0by z\x85"])
def test_lines_are_those_of_splitlines(spark, text):
    assert one(spark, tx.lines(F.col("t")), t=text) == text.splitlines()


def test_brace_sentences(spark):
    got = one(spark, tx.brace_sentences(F.col("t")), t="f(){\n a;\n}\ng(){}\nh")
    assert got == ["f(){\n a;\n", "g(){", "h\n"]


def test_terms(spark):
    assert one(spark, tx.terms(F.col("t")), t="Ab c d_1 é é2") == ["ab", "d_1", "é2"]


def test_code_tokens(spark):
    assert one(spark, tx.code_tokens(F.col("t")), t="int X_1=a->b;") == ["int", "x_1", "=", "a", "-", ">", "b", ";"]


def test_term_counts(spark):
    rows = one(spark, tx.term_counts(tx.words(F.col("t"))), t="b a b c b a")
    assert [tuple(r) for r in rows] == [("a", 2), ("b", 3), ("c", 1)]
    assert one(spark, tx.term_counts(tx.words(F.col("t"))), t="") == []


def test_vocabulary_lookup_and_extension(spark):
    rows = texts(spark, "b a B c a b")
    words = vo.build_vocabulary(rows, tx.lower_words(F.col("text")))
    assert {r["word"]: (r["id"], r["n"]) for r in words.collect()} == {"b": (1, 3), "a": (2, 2), "c": (3, 1)}
    assert vo.encode(texts(spark, "a q b"), tx.words(F.col("text")), words).first()["ids"] == [2, 1]
    assert vo.encode(texts(spark, "q"), tx.words(F.col("text")), words).first()["ids"] == []
    known = spark.createDataFrame([("a", 1, 5)], "word string, id long, n long")
    grown = vo.extend_vocabulary(known, ["a", "strId$"])
    assert {r["word"]: r["id"] for r in grown.collect()} == {"a": 1, "strId$": 2}


def test_lookup_beyond_the_broadcast_limit(spark, monkeypatch):
    rows = texts(spark, *["hot hot rare%d" % (i % 7) for i in range(40)], "unseen")
    tokens = rows.select("id", F.explode(tx.words(F.col("text"))).alias("word"))
    words = vo.build_vocabulary(rows.filter("id < 40"), tx.words(F.col("text")))
    whole = sorted(tuple(r) for r in vo.lookup_tokens(tokens, words, "left").select("id", "word", "token").collect())
    monkeypatch.setattr(vo, "broadcast_if_small", lambda table, max_rows: table)
    monkeypatch.setattr(vo, "HEAD_WORDS", 1)
    parts = vo.lookup_tokens(tokens, words, "left").select("id", "word", "token").collect()
    assert sorted(map(tuple, parts)) == whole


# ---- sequences and vectors


def test_truncation_and_padding(spark):
    seven, two = ints(spark, range(1, 8)), ints(spark, [1, 2])
    static = lambda df: sequences.static_sequences(df, 5, 3).first()["seq"]
    assert static(seven) == [3, 4, 5] and static(two) == [1, 2, 0]
    encoder = sequences.encoder_sequences(seven.withColumn("split", F.lit("train")), 3)
    assert encoder.first()["seq"] == [1, 2, 3]
    assert sequences.decoder_sequences(seven, 1024, 3).first()["seq"] == [5, 6, 7]
    assert sequences.decoder_sequences(seven, 4, 3).first()["seq"] == [2, 3, 4]
    assert one(spark, ar.attention_mask(F.col("a"), 4), a=[5, 6]) == [1, 1, 0, 0]


def test_batch_sequences_follow_the_longest_train_row(spark):
    rows = spark.createDataFrame([(0, [1, 2], "train"), (1, [1, 2, 3, 4], "test")], "id long, ids array<int>, split string")
    got = {r["id"]: (r["seq"], r["mask"]) for r in sequences.batch_sequences(rows, 8, 9).collect()}
    assert got == {0: ([8, 1, 2, 9], [1] * 4), 1: ([8, 1, 2, 9], [1] * 4)}
    got = {r["id"]: (r["seq"], r["mask"]) for r in sequences.batch_sequences(rows, None, None, 3).collect()}
    assert got == {0: ([1, 2], [1, 1]), 1: ([1, 2], [1, 1])}


def test_embedding_matrix_has_zeros_for_misses_and_padding(spark):
    words = spark.createDataFrame([("a", 1, 1), ("z", 2, 1)], "word string, id long, n long")
    vectors = spark.createDataFrame([("a", [1.0, 2.0])], "word string, vec array<float>")
    got = {r["id"]: r["vec"] for r in embeddings.embedding_matrix(words, vectors, 2).collect()}
    assert got == {0: [0.0, 0.0], 1: [1.0, 2.0], 2: [0.0, 0.0]}


def test_subwords_cover_unseen_words(spark):
    vectors = spark.createDataFrame([("abc", [2.0]), ("abd", [4.0])], "word string, vec array<float>")
    wanted = spark.createDataFrame([("abx",), ("qqq",)], "word string")
    # "abx" shares only the n-gram "<ab" with both known words.
    # Nothing of "qqq" is known: zeros, as in a lookup that misses.
    found = embeddings.subword_vectors(wanted, vectors).collect()
    assert sorted((r["word"], r["vec"]) for r in found) == [("abx", [3.0]), ("qqq", [0.0])]


# ---- metrics


def predictions(spark, tn, fp, fn, tp):
    rows = [(0, 0)] * tn + [(0, 1)] * fp + [(1, 0)] * fn + [(1, 1)] * tp
    return spark.createDataFrame(rows, "label int, pred int")


def test_binary_report(spark):
    row = metrics.binary_report(predictions(spark, 5, 1, 2, 2), []).first()
    assert [round(v, 6) for v in row] == [0.7, 0.666667, 0.5, 0.571429, 0.526316, 0.666667]


def test_binary_report_without_positive_predictions(spark):
    row = metrics.binary_report(predictions(spark, 6, 0, 4, 0), []).first().asDict()
    assert (row["precision"], row["recall"], row["f1"], row["f2"], row["roc_auc"]) == (0, 0, 0, None, 0.5)


def test_auc_needs_both_classes(spark):
    assert metrics.binary_report(predictions(spark, 3, 1, 0, 0), []).first()["roc_auc"] is None


def test_confusion_matrix_is_dense(spark):
    cells = metrics.confusion_matrix(predictions(spark, 6, 0, 4, 0), []).collect()
    assert {(r["label"], r["pred"]): r["n"] for r in cells} == {(0, 0): 6, (1, 0): 4, (0, 1): 0, (1, 1): 0} or {
        (r["label"], r["pred"]): r["n"] for r in cells
    } == {(0, 0): 6, (0, 1): 0, (1, 0): 4, (1, 1): 0}


def test_macro_report_counts_classes_that_are_only_predicted(spark):
    rows = spark.createDataFrame([(0, 0), (0, 2), (1, 1)], "label int, pred int")
    row = metrics.macro_report(rows, []).first()
    assert math.isclose(row["precision"], 2 / 3) and math.isclose(row["recall"], 0.5)
    assert metrics.report(rows, [], 3).first()["roc_auc"] is None


def test_batch_loss_is_a_mean_of_means(spark):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, 1.0, 1.0, 1.0, 5.0])], "id long, loss double")
    row = metrics.batch_loss(metrics.in_batches(rows, 4), F.col("loss")).first()
    assert (row["loss"], row["n_batches"]) == (3.0, 2)


def test_score_auc_counts_ties_half(spark):
    rows = spark.createDataFrame([(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1)], "label int, score double")
    assert metrics.score_auc(rows, []).first()["auc"] == 0.875


@pytest.mark.parametrize("share", [0.04975, 0.0585, 0.00125, 0.5, 2 / 3, 0.28150000000000003, 0.02815, 1.0, 0.0])
def test_percent_is_formatted_as_python_does(spark, share):
    assert one(spark, ar.percent(F.col("x")), x=float(share)) == "%.2f%%" % (share * 100)


# ---- runs


def epochs(spark, scores):
    rows = [("r", i + 1, s) for i, s in enumerate(scores)]
    return spark.createDataFrame(rows, "run string, epoch long, val_f1 double")


def test_early_stopping(spark):
    row = experiment.stop_and_best(epochs(spark, [0.1, 0.3, 0.3, 0.2, 0.25, 0.9]), 3).first()
    assert (row["best_epoch"], row["stop_epoch"], row["last_epoch"]) == (2, 5, 5)
    row = experiment.stop_and_best(epochs(spark, [0.1, 0.2, 0.3]), 3).first()
    assert (row["best_epoch"], row["stop_epoch"], row["last_epoch"]) == (3, None, 3)


def test_early_stopping_of_a_run_longer_than_a_span(spark):
    scores = [((i * 7919) % 10007) / 10007 for i in range(3000)]
    rows = experiment.early_stopping(epochs(spark, scores), 5).orderBy("epoch").collect()
    best, last = None, 0
    for i, row in enumerate(rows):
        assert row["best_before"] == best
        if best is None or scores[i] > best:
            best, last = scores[i], i + 1
        assert row["waited"] == i + 1 - last


def test_average_divides_by_files(spark):
    rows = [("a", 0.4), ("b", 0.6)]
    frame = spark.createDataFrame(rows, "file string, f1 double")
    for name in ("accuracy", "precision", "recall", "f2", "roc_auc"):
        frame = frame.withColumn(name, F.lit(0.0))
    assert experiment.average_metrics(frame, [], "file").first()["f1"] == 0.5


def test_describe(spark):
    row = experiment.describe(spark.createDataFrame([(float(i),) for i in (1, 2, 3, 4)], "value double"), []).first()
    assert (row["mean"], round(row["std"], 6), row["q25"], row["q50"], row["q75"]) == (2.5, 1.290994, 1.75, 2.5, 3.25)


def test_of(spark, differences):
    rows = spark.createDataFrame([("p", float(d)) for d in differences], "pair string, diff double")
    return signedrank.wilcoxon(rows, ["pair"]).first()


test_of.__test__ = False


@pytest.mark.parametrize(
    "differences,n,w,p",
    [
        ([1, 2, 3, 4, 5], 5, 0, 0.0625),
        ([1, -2, 3, 4, 5], 5, 2, 0.1875),
        ([0, 1, 2, 3, 4, 5], 5, 0, 0.043114),
        ([1, -2, 3], 3, 2, 0.75),
        ([-1, -2, 3], 3, 3, 1.0),
    ],
)
def test_signed_rank(spark, differences, n, w, p):
    row = test_of(spark, differences)
    assert (row["n"], row["w"], round(row["p"], 6)) == (n, w, p)
    assert row["significant"] == (p < 0.05)


def test_signed_rank_of_equal_runs(spark):
    row = test_of(spark, [0, 0, 0])
    assert (row["n"], row["n_zero"], row["w"], row["p"], row["significant"]) == (0, 3, None, None, None)


def test_signed_rank_of_many_pairs_is_normal(spark):
    differences = [(-1) ** (i % 3 == 0) * (i + 1) for i in range(60)]
    w = min(sum(d for d in differences if d > 0), -sum(d for d in differences if d < 0))
    z = (w - 60 * 61 / 4) / math.sqrt(60 * 61 * 121 / 24)
    assert math.isclose(test_of(spark, differences)["p"], math.erfc(abs(z) / math.sqrt(2)), rel_tol=1e-9)


def test_vector_means_beyond_the_broadcast_limit(spark, monkeypatch):
    rows = texts(spark, *["hot hot rare%d" % (i % 7) for i in range(40)])
    vectors = [("hot", [1.0, 2.0])] + [(f"rare{i}", [float(i), 0.0]) for i in range(5)]
    table = spark.createDataFrame(vectors, "word string, vec array<float>")
    mean = lambda: sorted(
        (r["id"], r["n_known"], tuple(round(x, 9) for x in r["vec"]))
        for r in embeddings.document_vectors(rows, tx.words(F.col("text")), table).collect()
    )
    whole = mean()
    assert whole[3] == (3, 3, (round(5 / 3, 9), round(4 / 3, 9))) and whole[5][1] == 2
    monkeypatch.setattr(embeddings, "MAX_BROADCAST_VECTORS", 2)
    monkeypatch.setattr(embeddings, "FREQUENT", 1)
    assert mean() == whole


def test_documents_and_words_of_unknown_tokens_stay(spark):
    rows = texts(spark, "hot", "unheard of", "")
    table = spark.createDataFrame([("hot", [1.0, 2.0])], "word string, vec array<float>")
    found = embeddings.document_vectors(rows, tx.words(F.col("text")), table).collect()
    assert sorted((r["id"], r["n_known"], tuple(r["vec"])) for r in found) == [(0, 1, (1.0, 2.0)), (1, 0, (0.0, 0.0)), (2, 0, (0.0, 0.0))]
    words = spark.createDataFrame([("hot",), ("zzzzz",)], "word string")
    found = {r["word"]: tuple(r["vec"]) for r in embeddings.subword_vectors(words, table).collect()}
    assert found == {"hot": (1.0, 2.0), "zzzzz": (0.0, 0.0)}


def test_quotas_of_billions(spark):
    counts = spark.createDataFrame([(0, 12_000_000_000, 1), (1, 3_000_000_000, 1)], "label int, n long, _one int")
    found = split._quotas(counts.withColumn("size", F.lit(1_500_000_001)), "size", "take").collect()
    assert {r["label"]: r["take"] for r in found} == {0: 1_200_000_001, 1: 300_000_000}


def test_runs_keep_large_seeds(spark):
    seeds = [20240601, 3_000_000_000]
    runs = split.runs_of(seeds, [None, 1, 2])
    assert len({run for run, _, _ in runs}) == 6 and {s for _, _, s in runs} == set(seeds)
    assert split.runs_of(seeds, [1]) == [(s, 0, s) for s in seeds]
    rows = split.assign_treatments(labelled(spark, [60, 20]), seeds, [None, 1])
    assert {r[0] for r in rows.select(F.explode("assign.seed")).distinct().collect()} == {run for run, _, _ in split.runs_of(seeds, [None, 1])}


def test_rows_without_a_label_are_refused(spark):
    rows = labelled(spark, [30, 10]).withColumn("label", F.when(F.col("id") >= 4, F.col("label")))
    with pytest.raises(ValueError, match="4 rows have no label"):
        split.assign_stratified(rows, [1])


def test_score_auc_of_billions_does_not_overflow(spark):
    from textloom.operators import metrics

    one = spark.createDataFrame([(1, 1, 0.9), (1, 0, 0.1), (1, 0, 0.9)], "seed int, label int, score double")
    assert metrics.score_auc(one, ["seed"]).first()["auc"] == 0.75


def test_buckets_stay_bounded():
    from textloom.operators.ordering import digest_digits

    assert digest_digits(0) == digest_digits(10**8) == 3
    assert all(n / 16 ** digest_digits(n) <= 2**16 + 1 for n in (10**9, 10**11, 10**14))


def test_large_tables_are_not_pinned(spark):
    from textloom.operators.bounded import pin_small

    rows = spark.range(20)
    assert pin_small(rows, 19) is rows
    pinned = pin_small(rows, 20)
    assert pinned is not rows and pinned.count() == 20


def test_words_are_counted_by_row_and_texts_cut_once(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "a b a"), (1, "a"), (2, None), (3, ""), (None, "b b")], "id long, text string")
    tokens = tx.words(F.col("text"))
    found = vo.bags(rows, tokens).collect()
    assert sorted((r["id"] or 0, r["word"], r["tf"]) for r in found) == [(0, "b", 2), (1, "a", 1), (1, "a", 2), (1, "b", 1)]
    stats = vo.term_statistics(rows, tokens).collect()
    assert sorted(tuple(r) for r in stats) == [("a", 3, 2), ("b", 3, 2)]
    monkeypatch.setattr(embeddings, "MAX_BROADCAST_VECTORS", 1)
    table = spark.createDataFrame([("a", [1.0]), ("b", [4.0])], "word string, vec array<double>")
    means = embeddings.document_vectors(rows, tokens, table)
    assert "split(" not in means._jdf.queryExecution().analyzed().toString()
    assert sorted((r["id"] or 0, r["n_known"], r["vec"]) for r in means.collect()) == [(0, 0, [0.0]), (1, 4, [1.75]), (1, 4, [1.75]), (2, 0, [0.0]), (3, 0, [0.0])]


@pytest.mark.parametrize("among", [100_000, 1])
def test_candidate_terms_are_counted_by_seed_without_sorting_the_row(spark, monkeypatch, among):
    monkeypatch.setattr(tfidf, "MOST_AMONG", among)
    data = [(["a", "b", "a"], ["train", "test"]), (["b", "c"], ["train", "train"]), (None, ["train", "train"]), ([], ["val", "train"])]
    docs = spark.createDataFrame([(t, [(s, x) for s, x in zip((7, 9), xs)]) for t, xs in data], "terms array<string>, assign array<struct<seed:int,split:string>>")
    found = tfidf._counts_per_seed(docs, [7, 9], spark.createDataFrame([("a", 2), ("b", 2)], "term string, cf long"))
    assert "array_sort" not in (plan := found._jdf.queryExecution().analyzed().toString()) and "sort_array" not in plan
    assert sorted(tuple(r[c] for c in ("seed", "term", "cf", "df")) for r in found.collect()) == [(7, "a", 2, 1), (7, "b", 2, 2), (9, "b", 1, 1)]
