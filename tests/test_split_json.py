"""JSON arrays in splits against the reader that takes a file whole."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import types as T

from textloom.sources import files, split_json

SCHEMA = T.StructType().add("func", "string").add("target", "integer").add("inner", T.StructType().add("a", "string"))


def objects(n, seed):
    rng = random.Random(seed)
    parts = ["plain", "{", "}", "}}{", '"', "\\", '\\"}', "\n", ",", "é中", "x" * 90, "[", "},{"]
    some = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(0, 6)))
    return [{"func": some(), "other": {"deep": {"er": [{"q": some()}]}}, "target": i, **({"inner": {"a": some()}} if i % 3 else {})} for i in range(n)]


@pytest.mark.parametrize("indent", [None, 2])
def test_splits_give_the_objects_of_the_whole(spark, tmp_path, tiny_splits, indent):
    rows = objects(50, 1)
    (tmp_path / "a.json").write_text(json.dumps(rows[:40], indent=indent, ensure_ascii=False))
    (tmp_path / "b.json").write_text(json.dumps(rows[40:], indent=indent) + "\n")
    got = sorted((r["target"], r["func"], r["inner"] and r["inner"]["a"]) for r in split_json.read_split_json(spark, str(tmp_path), SCHEMA).collect())
    assert got == [(o["target"], o["func"], o.get("inner", {}).get("a")) for o in rows]
    assert got == sorted((r["target"], r["func"], r["inner"] and r["inner"]["a"]) for r in files.read_json_array(spark, str(tmp_path), SCHEMA).collect())
    assert spark.read.text(str(tmp_path), lineSep="}").rdd.getNumPartitions() > 10


def test_empty_arrays_have_no_rows(spark, tmp_path):
    for text in ("[]", "[ ]\n", ""):
        (tmp_path / "a.json").write_text(text)
        assert split_json.read_split_json(spark, str(tmp_path), SCHEMA).count() == 0
