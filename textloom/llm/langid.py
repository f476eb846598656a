"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Features are hashed n-grams of one to three characters of the lower-cased text, with
every run of characters that aren't letters taken as one gap. Document frequencies
come from all labelled rows in training, summed task by task. Weights are fitted on
a sample of about ``SAMPLE`` of these rows, chosen by a hash, by FTRL-proximal
updates with an elastic net: ``SHARDS`` learners run in parallel on their own part
of the sample, and their weights are averaged. The temperature is then set on rows
of the sample that no learner saw. Scoring is one pass over whole texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import kept
from .shared_files import ready
from .text_arrays import slices

FEATURES = 1 << 13
GRAMS = (1, 2, 3)
#: Rows to fit on, the learners that share them, and one in so many held back for the temperature.
SAMPLE, SHARDS, HELD_BACK = 4000, 4, 5
#: FTRL-proximal: rate, offset of the rate, elastic net, passes.
ALPHA, BETA, L1, L2, PASSES = 0.5, 1.0, 2e-2, 1e-3, 3
UNKNOWN = "und"
_GAP = 1


_LETTERS: list[np.ndarray] = []


def _codes(text: str) -> np.ndarray:
    """Lower-cased code points; each run of others than letters is one gap."""
    if not _LETTERS:
        _LETTERS.append(np.array([chr(c).isalpha() for c in range(0x110000)], bool))
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _LETTERS[0][codes]
    keep = np.ones(len(codes), bool)
    keep[1:] = letter[1:] | letter[:-1]
    return np.where(letter, codes, _GAP)[keep].astype(np.uint64)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Hashed n-grams that occur, and how often; None if the text has no letter."""
    codes = _codes(text or "")
    if not (codes != _GAP).any():
        return None
    codes = np.concatenate(([_GAP], codes, [_GAP])).astype(np.uint64)
    total = np.zeros(FEATURES, np.int64)
    h = np.zeros(len(codes), np.uint64)
    for n in GRAMS:
        h = (h[: len(codes) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :]) * np.uint64(0xBF58476D1CE4E5B9)
        total += np.bincount((h >> np.uint64(51)).astype(np.int64), minlength=FEATURES)
    at = np.flatnonzero(total)
    return at, total[at]


def weighted(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF of the n-grams that occur, of length 1."""
    x = np.log1p(counts) * idf[at]
    return x / max(float(np.linalg.norm(x)), 1e-12)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int) -> np.ndarray:
    """Weights (feature, class) after ``PASSES`` over sparse rows (indices, values)."""
    z, n, w = (np.zeros((FEATURES, classes)) for _ in range(3))
    for _ in range(PASSES):
        for (at, x), label in zip(rows, labels, strict=True):
            own_z, own_n = z[at], n[at]
            weights = np.where(
                np.abs(own_z) <= L1, 0.0, (np.sign(own_z) * L1 - own_z) / ((BETA + np.sqrt(own_n)) / ALPHA + L2)
            )
            p = softmax(x @ weights)
            p[label] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(own_n + g * g) - np.sqrt(own_n)) / ALPHA
            z[at] += g - sigma * weights
            n[at] += g * g
    w = np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    return w


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by search over a grid and around its best point.

    Targets leave the share of one row in n + 2 to the other classes, so rows that are
    all right don't make the scores certain.
    """
    n, k = logits.shape
    target = np.full((n, k), 1 / (n + 2) / max(1, k - 1))
    target[np.arange(n), labels] = 1 - 1 / (n + 2) if k > 1 else 1
    loss = lambda t: -(target * np.log(softmax(logits / t) + 1e-300)).sum()
    grid = np.exp(np.linspace(np.log(0.02), np.log(20), 61))
    best = min(grid, key=loss)
    return float(min(best * np.exp(np.linspace(-0.12, 0.12, 25)), key=loss))


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float


def fold(ident: Column) -> Column:
    """crc32 of an id as text."""
    return F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary"))


def _document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = np.zeros(FEATURES, np.int64), 0
        for batch in slices(batches, "text"):
            for text in batch.column("text").to_pylist():
                own = features(text)
                if own is not None:
                    held[own[0]] += 1
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(FEATURES + 1)), pa.array(np.append(held, n))], names=["feature", "n"])

    sums = rows.select("text").mapInArrow(count, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    out = np.zeros(FEATURES + 1, np.int64)
    for feature, n in sums.toPandas().itertuples(index=False):  # FEATURES + 1 rows, whatever the corpus
        out[feature] = n
    return out[:-1], int(out[-1])


def fit_langid(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on rows with text and a language; rows without a letter teach nothing.

    About ``SAMPLE`` rows are fitted on, as many of each language, chosen by a hash of
    id and length. No such row gives a model without languages.
    """
    spark = labelled.sparkSession
    ready(spark)
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.filter("text IS NOT NULL AND lang IS NOT NULL")
    df, n = _document_frequencies(rows)
    idf = np.log((1 + n) / (1 + df)) + 1
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(counts)
    if not n:
        return Model([], idf, np.zeros((FEATURES, 0)), 1.0)

    # The same number of every language's rows, about: those whose hash is below a threshold.
    order = F.xxhash64(F.lit("sample"), F.col("id").cast("string"), F.octet_length("text"))
    share = {lang: min(1.0, SAMPLE / len(languages) / counts[lang]) for lang in languages}
    limits = [x for lang in languages for x in (F.lit(lang), F.lit(int(-(2**63) + share[lang] * (2**64 - 2**11))))]
    chosen = rows.filter(order <= F.element_at(F.create_map(*limits), F.col("lang")))
    shard = F.pmod(F.xxhash64(F.lit("shard"), F.col("id").cast("string"), F.octet_length("text")), F.lit(SHARDS * HELD_BACK)).cast("int")
    place = {lang: i for i, lang in enumerate(languages)}

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out: list[list] = [[], [], [], []]
            for text, lang, part in zip(*(batch.column(c).to_pylist() for c in ("text", "lang", "part")), strict=True):
                counts = features(text)
                if counts is None:
                    continue
                for values, value in zip(out, (part, place[lang], counts[0], weighted(*counts, idf)), strict=True):
                    values.append(value)
            kinds = [pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names=["part", "label", "at", "x"])

    sample = chosen.select("text", "lang", shard.alias("part")).mapInArrow(sparse, "part int, label int, at array<int>, x array<double>")
    sample = kept(sample, "langid-sample")
    classes = len(languages)

    def learn(key, pdf):
        import pandas as pd

        # An order of the rows' own: learners see the same sequence however the rows were dealt.
        own = [zlib.crc32(np.asarray(x, float).tobytes(), zlib.crc32(np.asarray(a, np.int32).tobytes())) for a, x in zip(pdf["at"], pdf["x"], strict=True)]
        pdf = pdf.assign(k=own).sort_values("k", kind="stable")
        rows = [(np.asarray(a, np.int64), np.asarray(x, float)) for a, x in zip(pdf["at"], pdf["x"], strict=True)]
        w = fit_ftrl(rows, pdf["label"].to_numpy(), classes)
        return pd.DataFrame({"n": [len(pdf)], "w": [w.ravel()]})

    train = sample.filter(F.col("part") % HELD_BACK != 0).withColumn("shard", F.pmod("part", F.lit(SHARDS)))
    learned = train.groupBy("shard").applyInPandas(learn, "n long, w array<double>").collect()
    total = sum(r["n"] for r in learned)
    weights = np.zeros((FEATURES, classes))
    for r in learned:
        weights += np.array(r["w"]).reshape(FEATURES, classes) * (r["n"] / total)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = [np.asarray(x, float) @ weights[np.asarray(a, np.int64)] for a, x in zip(batch.column("at").to_pylist(), batch.column("x").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(z, pa.list_(pa.float64()))], names=["label", "z"])

    back = sample.filter(F.col("part") % HELD_BACK == 0).mapInArrow(scored, "label int, z array<double>").collect()
    heat = temperature(np.array([r["z"] for r in back]), np.array([r["label"] for r in back])) if back else 1.0
    return Model(languages, idf, weights, heat)


def language(spark: SparkSession, model: Model, text: Column) -> Column:
    """Struct of ``lang_pred`` and ``score`` of a text column, computed where the row is."""
    ready(spark)
    held = spark.sparkContext.broadcast(model)

    def predict(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = held.value
        for column in columns:
            names, scores = [], []
            for own in column.to_pylist():
                counts = features(own) if m.languages else None
                if counts is None:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                p = softmax(weighted(*counts, m.idf) @ m.weights[counts[0]] / m.temperature)
                best = int(p.argmax())
                names.append(m.languages[best])
                scores.append(float(p[best]))
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    return F.arrow_udf(predict, "lang_pred string, score double")(text)


def predict_langid(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, lang_pred, score)``, one row per input row.

    The score is the calibrated probability of the language. Null text, and text
    without a letter, is ``und`` with score 0; so is everything if no language was learned.
    """
    found = docs.select(F.col(id_col).alias("id"), language(docs.sparkSession, model, F.col(text_col)).alias("found"))
    return found.select(F.col("id").alias(id_col), "found.lang_pred", "found.score")
