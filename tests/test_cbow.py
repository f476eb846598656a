"""Token codes, and CBOW training over parameters in a table."""

from __future__ import annotations

import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom import session
from textloom.operators import cbow, embeddings
from textloom.operators import vocabulary as vo


@pytest.mark.parametrize("heads", [100_000, 2, 0])
def test_codes_are_the_same_wherever_words_are_looked_up(spark, monkeypatch, heads):
    monkeypatch.setattr(vo, "HEAD_WORDS", heads)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)] + ["é" * 70]
    texts = [(i // 2, [rng.choice([*words, "new", None, ""]) for _ in range(rng.randint(0, 30))]) for i in range(60)] + [(99, None), (None, ["w1"])]
    known = [(w, i + 1, 100 - i) for i, w in enumerate(words)]
    frame = spark.createDataFrame(texts, "id long, tokens array<string>").repartition(4)
    got = vo.encode(frame, F.col("tokens"), spark.createDataFrame(known, "word string, id long, n long"))
    ids = {w: i for w, i, _ in known}
    want = sorted((i or -1, [ids[t] for t in ts or [] if t in ids]) for i, ts in texts)
    assert sorted((r["id"] if r["id"] is not None else -1, r["ids"]) for r in got.collect()) == sorted((-1 if i is None else i, [ids[t] for t in ts or [] if t in ids]) for i, ts in texts)
    assert len(want) == 62


def test_coded_rows_of_a_small_vocabulary_are_not_shuffled(spark):
    frame = spark.range(10).select("id", F.array(F.lit("a"), F.lit("b")).alias("tokens"))
    words = spark.createDataFrame([("a", 1, 1)], "word string, id long, n long")
    plan = vo.encode(frame, F.col("tokens"), words)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_rare_words_are_shuffled_once_a_row_and_places_never(spark, monkeypatch):
    monkeypatch.setattr(vo, "HEAD_WORDS", 1)
    words = spark.createDataFrame([("a", 1, 9), ("b", 2, 1)], "word string, id long, n long")
    frame = spark.createDataFrame([(1, ["b", "a"] * 500)], "id long, tokens array<string>")
    plan = vo.encode(frame, F.col("tokens"), words)
    assert plan.first()["ids"] == [2, 1] * 500
    assert "pos" not in plan._jdf.queryExecution().optimizedPlan().toString().split()


def test_a_batch_is_worked_on_in_parts_of_bounded_tokens(monkeypatch):
    monkeypatch.setattr(vo, "PART_TOKENS", 50)
    monkeypatch.setattr(vo, "TaskContext", type("Context", (), {"get": classmethod(lambda c: c), "partitionId": staticmethod(lambda: 0)}))
    tokens = [["a", "b", "rare"] * (i % 7) for i in range(60)] + [None, [None, "b"], ["a"] * 300]
    batch = pa.RecordBatch.from_arrays([pa.array(range(63)), pa.array(tokens, pa.list_(pa.string()))], names=["id", "tokens"])
    heads = pa.table({"word": ["a", "b"], "id": pa.array([1, 2], pa.int64())})
    found = list(vo._coder(heads, True)(iter([batch])))
    assert len(found) > 8 and all(b.num_rows == 1 or len(b.column("ids").flatten()) <= 50 + 18 for b in found)
    rows = pa.Table.from_batches(found).to_pylist()
    assert [r["row"] for r in rows] == list(range(63)) == [r["id"] for r in rows]
    known = {"a": 1, "b": 2, "rare": -1}
    assert [r["ids"] for r in rows] == [[known[t] for t in ts or [] if t] for ts in tokens]

    answers = pa.RecordBatch.from_arrays(
        [pa.array(range(63)), pa.array([r["ids"] for r in rows], pa.list_(pa.int32())), pa.array([len(r["rare"]) for r in rows], pa.int32()),
         pa.array([list(range(len(r["rare"]))) for r in rows], pa.list_(pa.int32())), pa.array([[9] * len(r["rare"]) for r in rows], pa.list_(pa.int32()))],
        names=["id", "ids", "n_rare", "places", "tokens"],
    )
    found = list(vo._resolved(iter([answers])))
    assert len(found) > 8
    known["rare"] = 9
    assert pa.Table.from_batches(found).column("ids").to_pylist() == [[known[t] for t in ts or [] if t] for ts in tokens]


def loss(inputs, outputs, context, ends, targets):
    total, start = 0.0, 0
    for end, row in zip(ends, targets, strict=True):
        mean = inputs[context[start:end]].mean(axis=0)
        for k, t in enumerate(row):
            if t >= 0:
                score = mean @ outputs[t]
                total += np.log1p(np.exp(-score if k == 0 else score))
        start = end
    return total


def test_a_step_follows_the_finite_differences():
    draw = np.random.default_rng(0)
    inputs, outputs = draw.normal(0, 0.5, (6, 3)), draw.normal(0, 0.5, (5, 3))
    context, ends = np.array([0, 1, 1, 2, 5, 3]), np.array([2, 5, 6])
    targets = np.array([[0, 1, -1], [1, 4, 0], [2, 2, 3]])
    after_in, after_out = inputs.copy(), outputs.copy()
    cbow.descend(after_in, after_out, context, ends, targets, 1.0, None)
    eps = 1e-6
    for i, j in np.ndindex(outputs.shape):
        up, down = outputs.copy(), outputs.copy()
        up[i, j] += eps
        down[i, j] -= eps
        slope = (loss(inputs, up, context, ends, targets) - loss(inputs, down, context, ends, targets)) / (2 * eps)
        assert abs(after_out[i, j] - outputs[i, j] + slope) < 1e-6
    # One example with one unit: the gradient of the mean is that of the unit.
    one_in, one_out = inputs.copy(), outputs.copy()
    cbow.descend(one_in, one_out, np.array([4]), np.array([1]), np.array([[0, 3]]), 1.0, 1)
    for j in range(3):
        up, down = inputs.copy(), inputs.copy()
        up[4, j] += eps
        down[4, j] -= eps
        pair = [loss(x, outputs, np.array([4]), np.array([1]), np.array([[0, 3]])) for x in (up, down)]
        assert abs(one_in[4, j] - inputs[4, j] + (pair[0] - pair[1]) / (2 * eps)) < 1e-6


def test_windows_stay_in_their_sentence():
    tokens, sentence = np.arange(7), np.array([0, 0, 0, 0, 1, 1, 2])
    centres, contexts = cbow.windows(tokens, sentence, 2, None)
    want = sorted((i, j) for i in range(7) for j in range(7) if i != j and abs(i - j) <= 2 and sentence[i] == sentence[j])
    assert list(zip(centres.tolist(), contexts.tolist(), strict=True)) == want


def test_noise_slots_hold_every_word_by_its_weight(spark):
    counts = [1000, 300, 300, 20, 1, 1, 1]
    words = spark.createDataFrame([(i + 1, n) for i, n in enumerate(counts)], "id long, n long")
    rows, slots = cbow.noise_slots(words)
    rows = rows.collect()
    total = sum(n**0.75 for n in counts)
    spans = {(r["id"], r["low"], r["high"]) for r in rows}
    assert len(spans) == len(counts)
    for ident, low, high in spans:
        assert abs(high - low - counts[ident - 1] ** 0.75 / total) < 1e-12
    for u in np.random.default_rng(1).random(200):
        assert sum(r["slot"] == int(u * slots) and r["low"] <= u < r["high"] for r in rows) == 1


def topics(spark, n=400):
    """Sentences over words of one of two topics, so words of a topic share contexts."""
    rng = random.Random(5)
    rows = []
    for i in range(n):
        side = "ab"[i % 2]
        rows.append((i, 0, [f"{side}word{rng.randint(0, 9)}" for _ in range(rng.randint(6, 12))]))
    rows += [(n, 0, []), (n + 1, 0, None), (n + 2, 0, ["seldom", "arare"])]
    return spark.createDataFrame(rows, "id long, piece int, tokens array<string>")


def apart(vectors):
    a = np.array([v for w, v in sorted(vectors.items()) if w[0] == "a"])
    b = np.array([v for w, v in sorted(vectors.items()) if w[0] == "b"])
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    a, b = unit(a), unit(b)
    return min((a @ a.T).mean(), (b @ b.T).mean()) - (a @ b.T).mean()


@pytest.mark.parametrize(("n", "tokens"), [(400, 100_000), (1600, 5000)], ids=["one batch", "several"])
def test_words_of_a_topic_come_together(spark, n, tokens):
    model = cbow.train_cbow(topics(spark, n), 8, 5, 12, 1, sample=0, batch_tokens=tokens)
    vectors = {r["word"]: r["vec"] for r in cbow.word_vectors(model).collect()}
    assert set(vectors) == {f"{s}word{i}" for s in "ab" for i in range(10)}
    assert apart(vectors) > 0.5


def test_training_repeats_itself_and_takes_words_to_unseen_ones(spark):
    first, again = (embeddings.train_subwords(topics(spark), 8, 5, 6, 1, buckets=500) for _ in range(2))
    rows = lambda m: {r["word"]: np.array(r["vec"]) for r in cbow.word_vectors(m).collect()}
    a, b = rows(first), rows(again)
    assert a.keys() == b.keys() and all(np.allclose(a[w], b[w], atol=1e-6) for w in a)
    wanted = spark.createDataFrame([("aword77",), ("bword77",), ("aword1",), ("aword1",), ("zz",)], "word string")
    seen = {r["word"]: np.array(r["vec"]) for r in cbow.word_vectors(first, wanted).collect()}
    assert np.allclose(seen["aword1"], a["aword1"], atol=1e-6) and {"aword77", "bword77"} <= seen.keys()
    near = lambda x, y: x @ y / np.linalg.norm(x) / np.linalg.norm(y)
    assert near(seen["aword77"], a["aword2"]) > near(seen["aword77"], a["bword2"])


def test_no_frequent_word_gives_no_vectors(spark):
    model = cbow.train_cbow(topics(spark, 4), 8, 1000, 2, 1)
    assert cbow.word_vectors(model).count() == 0


def test_a_step_in_parts_is_the_step_in_whole_batches(spark, monkeypatch):
    rng = random.Random(8)
    vectors = [(kind, key, [rng.uniform(-1, 1) for _ in range(3)]) for kind in (cbow.INPUT, cbow.OUTPUT) for key in range(1, 21)]
    vectors += [(cbow.INPUT, -key, [rng.uniform(-1, 1) for _ in range(3)]) for key in range(1, 6)]
    lexicon = [(i, [i] + [-1 - i % 5, -1 - i % 3] * (i % 2)) for i in range(1, 21)]
    word = lambda: rng.randint(1, 20)
    examples = [(i % 3, i, [word() for _ in range(rng.randint(1, 4))], [word() for _ in range(3)]) for i in range(300)]
    given = [
        spark.createDataFrame(vectors, "kind int, key long, vec array<double>"),
        spark.createDataFrame(lexicon, "id long, units array<long>"),
        spark.createDataFrame(examples, "batch long, key long, context array<long>, targets array<long>"),
    ]
    step = lambda: {(r["kind"], r["key"]): r["vec"] for r in cbow.cbow_step(*given, 0.05).collect()}
    whole, run = step(), cbow._batch

    def bounded(*args):
        work = run(*args)

        def checked(key, table):
            assert table.num_rows < 150  # a whole batch has 100 examples and more than 50 words and vectors
            return work(key, table)

        return checked

    monkeypatch.setattr(cbow, "STEP_WORDS", 20)
    monkeypatch.setattr(cbow, "_batch", bounded)
    cut = step()
    assert whole.keys() == cut.keys()
    assert all(np.allclose(whole[k], cut[k], atol=1e-12) for k in whole)


def test_units_of_a_word_are_added_up_once_for_a_minibatch():
    draw = np.random.default_rng(3)
    flat, bounds = np.array([0, 4, 5, 1, 2, 5, 3, 3]), np.array([0, 3, 4, 6, 8])
    context, ends = np.array([0, 2, 0, 3, 1, 2, 2, 0]), np.array([2, 5, 8])
    targets = np.array([[0, 1], [3, 2], [1, 1]])
    sizes = np.diff(bounds)
    units = np.concatenate([flat[bounds[w] : bounds[w + 1]] for w in context])
    unit_ends = np.cumsum(sizes[context])[ends - 1]
    for minibatch in (None, 2):
        one = [draw.normal(0, 0.5, (6, 3)), draw.normal(0, 0.5, (4, 3))]
        two = [x.copy() for x in one]
        cbow.descend(*one, units, unit_ends, targets, 0.5, minibatch)
        cbow.descend(*two, context, ends, targets, 0.5, minibatch, lexicon=(flat, bounds))
        assert all(np.allclose(x, y, atol=1e-12) for x, y in zip(one, two, strict=True))


def test_no_null_lists_are_sent_to_batches(spark, monkeypatch):
    """The Arrow writer's time grows with the square of the null lists in a batch."""
    run = cbow._batch

    def checked(*args):
        work = run(*args)

        def complete(key, table):
            assert not table.column("vec").null_count and not table.column("items").null_count
            return work(key, table)

        return complete

    monkeypatch.setattr(cbow, "_batch", checked)
    assert cbow.word_vectors(cbow.train_cbow(topics(spark, 40), 4, 1, 1, 1)).count() > 0


def test_examples_made_in_tasks_are_those_given_as_rows(spark, monkeypatch):
    """Windows and negatives of long texts, cut into pieces, come to the same step as a row for every example."""
    monkeypatch.setattr(cbow, "STEP_WORDS", 60)
    rng, near, size = random.Random(4), (-2, -1, 1, 2), 20
    texts = [(i - 3, [rng.randint(1, size) for _ in range(n)]) for i, n in enumerate([1, 0, 2, 7, 8, 9, 40, 15, 3, 14])]
    vectors = [(kind, key, [rng.uniform(-1, 1) for _ in range(3)]) for kind in (cbow.INPUT, cbow.OUTPUT) for key in range(1, size + 1)]
    negative = lambda text, place: [np.abs(text * 7 + place * 13 + k * 5) % size + 1 for k in (0, 1)]
    rows = []
    for ident, ids in texts:
        for i, own in enumerate(ids):
            context = [ids[i + d] for d in near if 0 <= i + d < len(ids)]
            if context:
                rows.append((ident % 2, 100 * ident + i, context, [own, *(int(n) for n in negative(ident, i))]))
    given = [
        spark.createDataFrame(vectors, "kind int, key long, vec array<double>"),
        spark.createDataFrame([(i, [i]) for i in range(1, size + 1)], "id long, units array<long>"),
    ]
    step = lambda *args: {(r["kind"], r["key"]): r["vec"] for r in cbow.cbow_step(*given, *args).collect()}
    want = step(spark.createDataFrame(rows, "batch long, key long, context array<long>, targets array<long>"), 0.05)
    pieces = cbow.text_pieces(spark.createDataFrame(texts, "id long, ids array<int>"), 2, 7)
    assert max(len(r["items"]) for r in pieces.collect()) <= 7 + 2 * 2
    pieces = pieces.selectExpr("pmod(id, 2) AS batch", "id AS key", "n", "items")
    got = step(pieces, 0.05, lambda *p: cbow.pieces_examples(*p, near, negative, 7), 4)
    assert want.keys() == got.keys() and all(np.allclose(want[k], got[k], atol=1e-12) for k in want)


def test_a_step_query_has_no_row_for_an_example(spark, monkeypatch):
    from textloom.plans import features

    monkeypatch.setattr(cbow, "_given_examples", None)
    assert features.cbow_step(spark, "/root/testdata/sf0.001").count() > 0


def test_an_epoch_leaves_only_its_vectors(spark, monkeypatch, tmp_path):
    """Neither earlier vectors and draws nor shuffle files add up over epochs."""
    monkeypatch.setattr(session, "scratch_path", lambda _, name: f"{tmp_path}/{name}-{len(list(tmp_path.iterdir()))}-{random.random()}")
    store = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = []
    write = cbow.kept

    def counted(df, name, **options):
        out = write(df, name, **options)
        if name == "vectors":
            time.sleep(1)
            held.append(store.getAllFiles().size())
        return out

    monkeypatch.setattr(cbow, "kept", counted)
    model = cbow.train_cbow(topics(spark, 40), 4, 1, 6, 1, batch_tokens=100)
    assert model.vectors.count() > 0
    names = [p.name.rsplit("-", 2)[0] for p in tmp_path.iterdir()]
    assert names.count("vectors") == 1 and "draws" not in names
    assert held[-1] <= held[1]
