"""Toxicity by compression distance: two zstandard dictionaries, window by window.

A text is cut into windows of some ``WINDOWS`` bytes at word ends, and each window
is compressed with a dictionary of ordinary text and with one of toxic text. What
the toxic one saves, window by window, gives the features of a logistic
calibration: the largest saving, the two largest, the mean, and the savings above
a few bytes.

Both dictionaries are trained by zstandard. The toxic one is trained on the words
of toxic texts that occur there significantly more often than in ordinary ones (by
the log-likelihood ratio of document counts), and it carries the ordinary one's
content and entropy tables as well: the two then differ by what toxic text adds and
nothing else, so other windows save nothing. Dictionaries and calibration are fitted
on separate parts of a bounded sample of labelled rows; scoring is one pass over
whole texts.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared_files import ready
from .text_arrays import slices

WINDOWS = (32, 64)
#: Labelled rows to fit on, of each class: for the dictionaries, and for the calibration.
FIT_ROWS, CALIBRATE_ROWS = 3000, 2000
#: Windows of one row that the dictionaries learn from, evenly spaced.
FIT_WINDOWS = 256
ORDINARY_BYTES, TOXIC_BYTES = 110_000, 1024
LEVEL = 3
#: Least log-likelihood ratio of a word, some one in a million by chance.
SIGNIFICANT = 25.0
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def cut(text: str | None, size: int) -> list[bytes]:
    """Windows of whole words, A-Z lowered, each with a space in front; the last may be short, an empty text is one."""
    out, held, n = [], [b""], 0
    for word in (text or "").encode().translate(_LOWER).split():
        held.append(word)
        n += len(word) + 1
        if n >= size:
            out.append(b" ".join(held))
            held, n = [b""], 0
    if n or not out:
        out.append(b" ".join(held))
    return out


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    base: float


class Scorer:
    """Savings of a text's windows, as features."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.plain, self.marked = self._compressor(ordinary), self._compressor(toxic)

    @staticmethod
    def _compressor(content: bytes):
        setting = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=0, write_checksum=0, write_dict_id=0)
        kind = zstandard.DICT_TYPE_AUTO if content else zstandard.DICT_TYPE_RAWCONTENT
        held = zstandard.ZstdCompressionDict(content or b"\0" * 8, dict_type=kind)
        held.precompute_compress(compression_params=setting)
        return zstandard.ZstdCompressor(dict_data=held, compression_params=setting).compress

    def features(self, text: str | None) -> list[float]:
        out = []
        for size in WINDOWS:
            saved = sorted((len(self.plain(w)) - len(self.marked(w)) for w in cut(text, size)), reverse=True)
            n = len(saved)
            above = sum(s - 2 for s in saved if s > 2)
            out += [saved[0], sum(saved[:2]) / 2, sum(saved) / n, above / math.sqrt(n), math.log1p(above)]
        return [*out, math.log(n)]


def significance(a: int, b: int, n_a: int, n_b: int) -> float:
    """Log-likelihood ratio of a of n_a against b of n_b; 0 if the first isn't the larger share."""
    if a * n_b <= b * n_a:
        return 0.0
    share = (a + b) / (n_a + n_b)
    parts = ((a, n_a * share), (b, n_b * share))
    return 2 * sum(seen * math.log(seen / due) for seen, due in parts if seen)


def _trained(size: int, samples: list[bytes]) -> bytes:
    """A trained dictionary; empty if there is too little to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def train(rows: list[tuple[int, list[bytes]]]) -> tuple[bytes, bytes]:
    """Ordinary and toxic dictionary of rows (class, windows)."""
    n = Counter(label for label, _ in rows)
    held = {0: Counter(), 1: Counter()}
    for label, windows in rows:
        held[label].update({w for x in windows for w in x.split()})
    mark = {w: significance(k, held[0][w], n[1], n[0]) for w, k in held[1].items()}
    mark = {w: s for w, s in mark.items() if s >= SIGNIFICANT}
    seen = [b" " + w + b" " for label, windows in rows if label for x in windows for w in x.split() if w in mark]
    added = _trained(TOXIC_BYTES, seen)[-TOXIC_BYTES:]
    if not added:  # too few to train on: the words themselves, the most telling last, where matches cost least
        added = b"".join(b" " + w + b" " for w in sorted(mark, key=mark.get)[-TOXIC_BYTES // 8 :])
    ordinary = _trained(ORDINARY_BYTES, [x for label, windows in rows if not label for x in windows])
    return ordinary, ordinary + added


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, scales and weights (the last is the constant) of a ridge logistic regression, by Newton steps."""
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    ridge = np.full(z.shape[1], 1.0)
    ridge[-1] = 1e-6
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (weight * (p - y)) + ridge * w
        curve = (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + np.diag(ridge)
        step = np.linalg.solve(curve, slope)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> Model:
    """Fit on the rows of ``docs`` that ``labels`` marks with 0 or 1; null labels and ids teach nothing.

    Of each class about ``FIT_ROWS`` and ``CALIBRATE_ROWS`` rows are taken, by a hash of
    the id; the calibration is weighted back to all rows. Without rows of both
    classes every score is the share of class 1 (0 without rows).
    """
    spark = docs.sparkSession
    ready(spark)
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("id IS NOT NULL AND label IN (0, 1)").distinct()
    counts = {r["label"]: r["count"] for r in marked.groupBy("label").count().collect()}
    n = sum(counts.values())
    base = counts.get(1, 0) / n if n else 0.0
    size = 5 * len(WINDOWS) + 1
    if len(counts) < 2:
        return Model(b"", b"", np.zeros(size), np.ones(size), np.zeros(size + 1), base)
    share = {k: min(1.0, (FIT_ROWS + CALIBRATE_ROWS) / counts[k]) for k in counts}
    draw = F.xxhash64(F.lit("toxicity"), F.col("id").cast("string"))
    limit = F.element_at(F.create_map(*[x for k in counts for x in (F.lit(k), F.lit(int(-(2**63) + share[k] * (2**64 - 2**11))))]), F.col("label"))
    part = F.pmod(F.xxhash64(F.lit("part"), F.col("id").cast("string")), F.lit(FIT_ROWS + CALIBRATE_ROWS)) < FIT_ROWS
    sample = marked.filter(draw <= limit).select("id", "label", part.alias("fit"))
    # Some twice 5,000 rows at most, by the thresholds above: small enough to send to every task.
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [cut(t, WINDOWS[-1]) for t in batch.column("text").to_pylist()]
            found = [x if len(x) <= FIT_WINDOWS else [x[i * len(x) // FIT_WINDOWS] for i in range(FIT_WINDOWS)] for x in found]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(found, pa.list_(pa.binary()))], names=["label", "windows"])

    chosen = rows.filter("fit").mapInArrow(windows, "label int, windows array<binary>").toArrow()
    pairs = sorted(zip(chosen.column("label").to_pylist(), chosen.column("windows").to_pylist(), strict=True))
    ordinary, toxic = train(pairs)
    held = spark.sparkContext.broadcast((ordinary, toxic))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*held.value)
        for batch in slices(batches, "text"):
            x = [scorer.features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(x, pa.list_(pa.float64()))], names=["label", "x"])

    back = rows.filter("NOT fit").mapInArrow(scored, "label int, x array<double>").toArrow()
    y = np.array(back.column("label").to_pylist(), float)
    if len(set(y)) < 2:
        return Model(ordinary, toxic, np.zeros(size), np.ones(size), np.append(np.zeros(size), math.log(base / (1 - base))), base)
    x = np.array(back.column("x").to_pylist(), float)
    weight = np.where(y == 1, base / (y == 1).mean(), (1 - base) / (y == 0).mean())
    return Model(ordinary, toxic, *calibrate(x, y, weight), base)


def predict_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, score)``: the calibrated probability of class 1, one row per input row; null text counts as empty."""
    spark = docs.sparkSession
    ready(spark)
    held = spark.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        scorer = Scorer(m.ordinary, m.toxic) if m.weights.any() else None
        for batch in slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            if scorer:
                x = (np.array([scorer.features(t) for t in texts]) - m.mean) / m.scale
                score = 1 / (1 + np.exp(-np.clip(x @ m.weights[:-1] + m.weights[-1], -30, 30)))
            else:
                score = np.full(len(texts), m.base)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(score)], names=["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(predict, f"id {kind}, score double").withColumnRenamed("id", id_col)
