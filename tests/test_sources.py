"""Round trips through every file format."""

from __future__ import annotations

import os

import pytest

from textloom import session
from textloom.schemas import LABELLED, METRICS_CSV, RAW_ONE_JSON, RAW_TWO_JSON
from textloom.sources import files, results, words

TEXTS = ['plain', 'two\nlines', 'quote " and, comma', "  blanks  ", 'back\\slash "x\\"', "tab\té", "}\n}\r\nx", "null"]


def test_csv_keeps_text_exactly(spark, tmp_path):
    rows = [(i, t, i % 2, None if i == 0 else "p") for i, t in enumerate(TEXTS)]
    path = str(tmp_path / "csv")
    files.write_csv(spark.createDataFrame(rows, LABELLED), path)
    got = sorted(tuple(r) for r in files.read_csv(spark, path, LABELLED).collect())
    assert [r[1] for r in got] == TEXTS


def test_csv_written_elsewhere_with_doubled_quotes(spark, tmp_path):
    path = tmp_path / "d.csv"
    path.write_text('id,text,label,project\n1,"a ""b""\nc",1,x\n2,,0,\n', encoding="utf-8")
    rows = files.read_csv(spark, str(path), LABELLED).orderBy("id").collect()
    assert tuple(rows[0]) == (1, 'a "b"\nc', 1, "x") and rows[1]["text"] is None and rows[1]["project"] is None


def test_concatenated_sources_keep_their_order(spark, tmp_path):
    paths = {}
    for name, ids in (("train", [5, 3]), ("val", [9])):
        path = tmp_path / f"{name}.csv"
        path.write_text("id,text,label,project\n" + "".join(f"{i},t,0,p\n" for i in ids), encoding="utf-8")
        paths[name] = str(path)
    rows = files.concat_csv(spark, paths, LABELLED).orderBy("file_no", "file_pos").collect()
    assert [(r["split_file"], r["id"]) for r in rows] == [("train", 5), ("train", 3), ("val", 9)]


def test_columns_are_taken_by_name_and_rows_numbered_in_file_order(spark, tmp_path):
    first, second = tmp_path / "a", tmp_path / "b"
    first.mkdir()
    (first / "part-1.csv").write_text("index,commit_id,text,label,id,project\n" + "".join(f"9,c,t{i},1,{i},p\n" for i in range(3, 40)))
    (first / "part-0.csv").write_text("index,commit_id,text,label,id,project\n0,c,t1,1,1,p\n1,c,t2,x,2,\n")
    second.mkdir()
    (second / "x.csv").write_text("project,id,label,text\nq,40,0,t40\n")
    rows = files.with_ids(files.concat_csv(spark, {"a": str(first), "b": str(second)}, LABELLED).withColumnRenamed("id", "own"))
    found = rows.orderBy("id").collect()
    assert [(r["id"], r["own"], r["text"]) for r in found] == [(i, i + 1, f"t{i + 1}") for i in range(40)]
    assert found[1]["label"] is None and found[1]["project"] is None and found[39]["project"] == "q"


def test_header_of_single_numbers_is_not_a_word(spark, tmp_path):
    path = str(tmp_path / "one")
    words.write_vectors_text(spark.createDataFrame([("a", [1.0]), ("7", [1.0])], "word string, vec array<float>"), path)
    assert sorted(r["word"] for r in words.read_vectors_text(spark, path, 1).collect()) == ["7", "a"]


def test_json_arrays(spark, tmp_path):
    one = tmp_path / "one.json"
    one.write_text('[{"func": "f(){\\n}", "target": 1, "project": "p", "commit_id": "c", "extra": 2}]', encoding="utf-8")
    rows = files.read_labelled_json(spark, str(one), RAW_ONE_JSON).collect()
    assert [tuple(r) for r in rows] == [("f(){\n}", 1)]
    paths = {}
    for label in (1, 0):
        path = tmp_path / f"{label}.json"
        path.write_text('[{"code": "x", "project": "p", "hash": "h", "size": 3}]', encoding="utf-8")
        paths[label] = str(path)
    assert sorted(r["target"] for r in files.read_by_label(spark, paths, RAW_TWO_JSON).collect()) == [0, 1]


def test_vector_header_is_not_a_word(spark, tmp_path):
    path = tmp_path / "v.txt"
    path.write_text("2 3\na 1 2 3\nb 4 5 6\n", encoding="utf-8")
    rows = {r["word"]: r["vec"] for r in words.read_vectors_text(spark, str(path), 3).collect()}
    assert rows == {"a": [1, 2, 3], "b": [4, 5, 6]}


def test_vocabulary_json_is_encoded_twice(spark, tmp_path):
    rows = [('a"b\\', 1, 3), ("é\t", 2, 1)]
    path = str(tmp_path / "v")
    words.write_vocabulary_json(spark.createDataFrame(rows, "word string, id long, n long"), path)
    import json

    lines = [r["value"] for r in spark.read.text(path).collect()]
    assert sorted(json.loads(json.loads(line))["word"] for line in lines) == sorted(r[0] for r in rows)
    assert sorted(tuple(r) for r in words.read_vocabulary_json(spark, path).collect()) == sorted(rows)


def test_results_tree_of_plain_folders(spark, tmp_path):
    header = ",".join(METRICS_CSV.fieldNames())
    for seed, f1 in ((123, 0.4), (456, 0.6)):
        folder = tmp_path / "res" / "bert" / "tuned" / str(seed)
        os.makedirs(folder)
        (folder / f"{seed}.csv").write_text(f"{header}\n0.1,0.2,0.3,{f1},0.5,0.6\n")
    (tmp_path / "res" / "bert" / "tuned" / "avg.csv").write_text(f"{header}\n9,9,9,9,9,9\n")
    rows = results.read_metrics_tree(spark, str(tmp_path / "res")).orderBy("seed").collect()
    assert [(r["model"], r["method"], r["classifier"], r["seed"], r["f1"]) for r in rows] == [
        ("bert", "tuned", None, 123, 0.4),
        ("bert", "tuned", None, 456, 0.6),
    ]


def test_results_tree_without_values(spark, tmp_path):
    folder = tmp_path / "m" / "w2v" / "gru" / "1"
    os.makedirs(folder)
    (folder / "1.csv").write_text(",".join(METRICS_CSV.fieldNames()) + "\n0.1,0.2,0.3,0.4,,0.6\n")
    row = results.read_metrics_tree(spark, str(tmp_path)).first()
    assert (row["classifier"], row["seed"], row["f2"]) == ("gru", 1, None)


def test_epochs_are_appended(spark, tmp_path):
    log = spark.createDataFrame([("r", 1, 0.1, 0.2, 0.3, 0.4)], "run string, epoch long, loss double, f1 double, val_loss double, val_f1 double")
    for _ in range(2):
        results.append_epochs(log, str(tmp_path / "log"))
    assert results.read_epochs(spark, str(tmp_path / "log")).count() == 2


class Context:
    """Stands for the parts of a session that name the shared folder."""

    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


class Session:
    def __init__(self, context, configured=None):
        self.sparkContext, self.configured = context, configured
        self.conf = self

    def get(self, key, default):
        return self.configured if key == "spark.checkpoint.dir" else default


def test_shared_folder_is_the_configured_one():
    context = Context("spark://host:7077")
    assert session.shared_dir(Session(context, "hdfs://shared/x")) == "hdfs://shared/x"
    assert context.folder == "hdfs://shared/x"


def test_cluster_without_a_shared_folder_is_refused():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session(Context("spark://host:7077")))


def test_local_session_gets_its_own_folder():
    assert os.path.isdir(session.shared_dir(Session(Context("local[2]"))))


def test_scratch_paths_differ(spark):
    assert session.scratch_path(spark, "x") != session.scratch_path(spark, "x")
