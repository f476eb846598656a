"""Shared steps of the classification studies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import bayes, clean, split, tfidf
from ..operators import vocabulary as vo
from ..schemas import SEEDS
from ..session import kept
from .tables import documents, labelled, table


def tokenized(spark: SparkSession, sf: str, seeds=SEEDS, treatments=(None,)) -> DataFrame:
    """Labelled documents with terms and one split per run.

    Splits are drawn over all rows; rows with null or empty text then leave every one.
    """
    rows = clean.drop_null_text(split.assign_treatments(labelled(spark, sf), seeds, list(treatments)))
    return rows.select("id", "label", "assign", tx.terms(F.col("text")).alias("terms"))


def weighed(spark: SparkSession, sf: str, seeds=SEEDS, treatments=(None,)):
    docs = kept(tokenized(spark, sf, seeds, treatments), "tokenized")
    runs = [run for run, _, _ in split.runs_of(list(seeds), list(treatments))]
    model = tfidf.fit_tfidf(docs, runs)
    return tfidf.weigh(docs, model), model


#: Bins of a TF-IDF weight between 0 and 1; bin 0 is an absent term.
BINS = 255


def binned(spark: SparkSession, sf: str, seeds=SEEDS, with_terms: bool = False):
    """``(run, id, label, split, features)`` with weights as bins, the number of features, and the terms if asked for."""
    rows, model = weighed(spark, sf, seeds)
    number = lambda w: F.ceil(F.round(w, 9) * BINS).cast("int")
    features = F.transform("features", lambda f: F.struct(f["idx"].alias("idx"), number(f["weight"]).alias("bin")))
    rows = kept(rows.select(F.col("seed").cast("long").alias("run"), "id", "label", "split", features.alias("features")), "binned")
    return (rows, len(model.words), model.terms) if with_terms else (rows, len(model.words))


def bayes_predictions(spark: SparkSession, sf: str, seeds=SEEDS, treatments=(None,)) -> DataFrame:
    """Gaussian naive Bayes over TF-IDF on val and test of every run."""
    rows, model = weighed(spark, sf, seeds, treatments)
    fitted = bayes.fit_bayes(rows, model.terms)
    return bayes.predict_bayes(rows.filter(F.col("split").isin("val", "test")), fitted)


def word_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """A word-vector table for words seen ten times as code tokens.

    Three whole numbers per word stand for trained ones, so that joins and
    means have one right answer.
    """
    stats = vo.term_statistics(documents(spark, sf), tx.code_tokens(F.col("text"))).filter(F.col("cf") >= 10)
    vec = F.array(F.length("term").cast("float"), (F.col("cf") % 97).cast("float"), (F.col("df") % 89).cast("float"))
    return stats.select(F.col("term").alias("word"), vec.alias("vec"))


def flagged(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions ``(lang, id, label, pred)`` that need no model: the toxic flag as guess of low quality."""
    labels = table(spark, sf, "labels")
    langs = table(spark, sf, "documents").select("doc_id", "lang")
    return langs.join(labels, "doc_id").select(
        "lang", F.col("doc_id").alias("id"), (1 - F.col("quality")).alias("label"), F.col("toxic").alias("pred")
    )


# Order of event types as classes.
EVENT_TYPES = ["view", "click", "purchase", "signup", "error"]


def guessed_events(spark: SparkSession, sf: str) -> DataFrame:
    """Five-class predictions over events."""
    place = F.array_position(F.lit(EVENT_TYPES), F.col("event_type")) - 1
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"), place.cast("int").alias("label"), (F.col("user_id") % 5).cast("int").alias("pred")
    )


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """``(id, label, score)``: a logistic score of the first embedding value."""
    first = F.get("embedding", 0).cast("double")
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"),
        (F.col("label") % 2).alias("label"),
        F.round(1 / (1 + F.exp(-8 * first)), 3).alias("score"),
    )
