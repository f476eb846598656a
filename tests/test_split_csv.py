"""Quoted CSV in splits against the reader that takes a file whole."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import types as T

from textloom.plans import files as plans
from textloom.schemas import LABELLED
from textloom.sources import files, split_csv

SCHEMA = T.StructType().add("id", "long").add("text", "string").add("n", "integer")


def quoted(value):
    return '"' + value.replace('"', '""') + '"'


def texts(n, seed):
    rng = random.Random(seed)
    parts = ["plain", "two\nlines", 'a "word"', '"', "\n", ",", "é中", "x" * 120, "", '""\n""', "end\n"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 6))) for _ in range(n)]


def write(folder, name, rows, end="\n", header="text,extra,id,n", last=True):
    lines = [header] + [f"{quoted(t)},{quoted('e')},{i},{i % 7 if i % 5 else 'no'}" for i, t in rows]
    (folder / name).write_bytes((end.join(lines) + (end if last else "")).encode())


@pytest.mark.parametrize(("end", "last"), [("\n", True), ("\n", False), ("\r\n", True)])
def test_splits_give_the_rows_of_the_whole(spark, tmp_path, tiny_splits, end, last):
    own = list(enumerate(texts(60, 1)))
    write(tmp_path, "a.csv", own[:45], end, last=last)
    write(tmp_path, "b.csv", own[45:], end)
    got = sorted(tuple(r) for r in split_csv.read_split_csv(spark, str(tmp_path), SCHEMA).collect())
    assert got == [(i, t or None, i % 7 if i % 5 else None) for i, t in own] or got == [(i, t, i % 7 if i % 5 else None) for i, t in own]
    if end == "\n":
        assert got == sorted(tuple(r) for r in files.read_csv(spark, str(tmp_path), SCHEMA).collect())
    assert spark.read.text(str(tmp_path), lineSep="\n").rdd.getNumPartitions() > 10


def test_a_shuffle_takes_the_place_of_a_large_broadcast(spark, tmp_path, tiny_splits, monkeypatch):
    write(tmp_path, "a.csv", list(enumerate(texts(40, 2))))
    want = sorted(tuple(r) for r in split_csv.read_split_csv(spark, str(tmp_path), SCHEMA).collect())
    monkeypatch.setattr(split_csv, "pin_small", lambda df: df)
    assert sorted(tuple(r) for r in split_csv.read_split_csv(spark, str(tmp_path), SCHEMA).collect()) == want and len(want) == 40


def test_header_only_blank_lines_and_missing_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("text,id,n\n")
    assert split_csv.read_split_csv(spark, str(tmp_path), SCHEMA).count() == 0
    (tmp_path / "a.csv").write_text('text,id,n\n\n"a",1,2\n\n"b\n\nc",2,3\n')
    assert sorted(tuple(r) for r in split_csv.read_split_csv(spark, str(tmp_path), SCHEMA).collect()) == [(1, "a", 2), (2, "b\n\nc", 3)]
    (tmp_path / "a.csv").write_text("text,n\na,1\n")
    with pytest.raises(Exception, match="id"):
        split_csv.read_split_csv(spark, str(tmp_path), SCHEMA).collect()


def test_csv_of_much_text_goes_to_several_files(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"line {i}\n\"quoted\", {i}", i % 2, "p") for i in range(60)], LABELLED)
    assert plans.in_large_files(rows).rdd.getNumPartitions() == 1
    files.write_csv(plans.in_large_files(rows, 200), str(tmp_path / "csv"))
    assert len(list((tmp_path / "csv").glob("part-*"))) > 1
    back = split_csv.read_split_csv(spark, str(tmp_path / "csv"), LABELLED)
    assert sorted(back.collect()) == sorted(rows.collect())
