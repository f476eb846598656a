"""TF-IDF fitted on each seed's train rows and applied to all splits.

A few scans of the terms and shuffles of the vocabulary only. Documents are counted
against the union of the seeds' top terms inside their own row; weights of all
seeds follow from that one count with a table of idf arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.arrays import dense
from ..functions.rows import unnest, unnest_structs
from ..session import import_in_workers, kept
from .bounded import pin_small
from .vocabulary import counted, parts, top_terms_within

FEATURES = 1000
#: Candidates that tasks are told, so that they count nothing else; more are picked out by a join.
MOST_AMONG = 100_000


@dataclass(frozen=True)
class Tfidf:
    """``words``: union vocabulary; ``terms``: ``(seed, term, idx, cf, df, idf)``.

    ``idf`` has one array per seed over the union vocabulary, zero at words that
    are not the seed's own.
    """

    seeds: list[int]
    words: list[str]
    terms: DataFrame
    idf: DataFrame


def _in_train(seeds: list[int]) -> list:
    return [(F.get("assign", i)["split"] == "train").alias(f"t{i}") for i in range(len(seeds))]


def _sums_per_seed(n_seeds: int, among: pa.Array | None):
    """Batches ``(terms, flags by seed)`` to each term's counts by seed, summed over the rows of a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 0):
            row, code, count, words = counted(batch.column(0), among)
            found, code = np.unique(code, return_inverse=True)
            flags = pc.fill_null(batch.column(1).flatten(), False).to_numpy(zero_copy_only=False).reshape(-1, n_seeds)
            columns, names = [words.take(pa.array(found)).cast(pa.string())], ["term"]
            for i in range(n_seeds):
                own = flags[row, i]
                sums = np.bincount(code[own], count[own], len(found)), np.bincount(code[own], minlength=len(found))
                columns += [pa.array(x.astype(np.int64)) for x in sums]
                names += [f"cf{i}", f"df{i}"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _counts_per_seed(docs: DataFrame, seeds: list[int], candidates: DataFrame) -> DataFrame:
    """``(seed, term, cf, df)`` of the candidate terms over each seed's train rows."""
    import_in_workers(docs.sparkSession)
    among = candidates.select("term").limit(MOST_AMONG + 1).toArrow().column("term").combine_chunks()
    names = [f"{c}{i}" for i in range(len(seeds)) for c in ("cf", "df")]
    flagged = docs.select("terms", F.array(*_in_train(seeds)).alias("flags"))
    step = _sums_per_seed(len(seeds), among if len(among) <= MOST_AMONG else None)
    rows = flagged.mapInArrow(step, ", ".join(["term string", *[f"{n} long" for n in names]]))
    wide = rows.join(candidates.select("term"), "term").groupBy("term").agg(*[F.sum(n).alias(n) for n in names])
    per_seed = F.array(
        *[
            F.struct(F.lit(seed).alias("seed"), F.col(f"cf{i}").alias("cf"), F.col(f"df{i}").alias("df"))
            for i, seed in enumerate(seeds)
        ]
    )
    return unnest_structs(wide, ["term"], per_seed).filter(F.col("cf") > 0)


def train_top_terms(docs: DataFrame, seeds: list[int], features: int) -> DataFrame:
    """The ``features`` most frequent train terms of each seed.

    Only counts over all seeds' train rows are taken for the whole vocabulary.
    A term's count for one seed cannot exceed that total, so the candidates, the
    terms with the largest totals, are complete once every seed's last chosen
    count is above the smallest candidate total; else more candidates are taken.
    """
    anywhere = F.exists("assign", lambda a: a["split"] == "train")
    tokens = unnest(docs.filter(anywhere), [], "terms", "term")
    totals = kept(tokens.groupBy("term").agg(F.count("*").alias("cf")), "totals")
    width = 16 * features
    while True:
        candidates = pin_small(totals.orderBy(F.desc("cf"), "term").limit(width))
        found, smallest = candidates.agg(F.count("*"), F.min("cf")).first()
        counts = _counts_per_seed(docs, seeds, candidates)
        top = pin_small(top_terms_within(counts, ["seed"], features), len(seeds) * features)
        if found < width:
            return top
        settled = top.groupBy("seed").agg((F.count("*") == features) & (F.min("cf") > smallest))
        if all(row[1] for row in settled.collect()):
            return top
        width *= 4


def fit_tfidf(docs: DataFrame, seeds: list[int], features: int = FEATURES) -> Tfidf:
    """``docs`` has ``terms`` (tokens) and ``assign`` (one split per seed)."""
    sizes = unnest_structs(docs, [], "assign").filter(F.col("split") == "train")
    sizes = sizes.groupBy("seed").agg(F.count("*").alias("n_train"))
    idf = F.log((1 + F.col("n_train")) / (1 + F.col("df"))) + 1
    top = train_top_terms(docs, seeds, features)
    terms = pin_small(top.join(sizes, "seed").withColumn("idf", idf), len(seeds) * features)

    # Rare words first, the order the neighbour search probes them in.
    ordered = terms.groupBy("term").agg(F.sum("df").alias("df")).orderBy("df", "term")
    words = [r["term"] for r in ordered.collect()]
    spark = docs.sparkSession
    numbered = spark.createDataFrame(list(enumerate(words)), "idx int, term string")
    terms = pin_small(terms.join(numbered, "term"), len(seeds) * features)
    entries = F.sort_array(F.collect_list(F.struct("idx", "idf")))
    idf_rows = terms.groupBy("seed").agg(entries.alias("e")).select("seed", dense(F.col("e"), "idf").alias("idf"))
    return Tfidf(seeds, words, terms, pin_small(idf_rows))


def count_terms(docs: DataFrame, model: Tfidf) -> DataFrame:
    """Adds ``counts``: sparse term counts over the union vocabulary, in the row."""
    counter = CountVectorizerModel.from_vocabulary(model.words, inputCol="terms", outputCol="counts")
    return counter.transform(docs)


def counted_once(docs: DataFrame, model: Tfidf) -> DataFrame:
    """Documents with ``counts`` in place of ``terms``, kept for several uses."""
    return kept(count_terms(docs, model).drop("terms"), "counted")


def weigh(docs: DataFrame, model: Tfidf) -> DataFrame:
    """One row per seed and document with ``features``: ``array<struct<idx, weight>>`` of unit norm."""
    counted = count_terms(docs, model).withColumn("_raw", F.unwrap_udt("counts"))
    keep = [c for c in counted.columns if c not in ("terms", "counts", "assign", "_raw", "text")]
    pairs = F.zip_with(
        F.col("_raw.indices"),
        F.col("_raw.values"),
        lambda i, v: F.struct(i.alias("idx"), (v * F.coalesce(F.get("idf", i), F.lit(0.0))).alias("weight")),
    )
    rows = (
        unnest_structs(counted, [*keep, "_raw"], "assign")
        .filter(F.col("split") != "dropped")
        .join(model.idf, "seed", "left")
        .select("seed", *keep, "split", F.filter(pairs, lambda p: p["weight"] > 0).alias("_w"))
    )
    norm = F.sqrt(F.aggregate("_w", F.lit(0.0), lambda acc, p: acc + p["weight"] * p["weight"]))
    unit = tx.let(
        norm,
        lambda n: F.transform(
            "_w", lambda p: F.struct(p["idx"].alias("idx"), (p["weight"] / n).alias("weight"))
        ),
    )
    return rows.select("seed", *keep, "split", unit.alias("features"))


def tfidf_long(weighed: DataFrame, model: Tfidf) -> DataFrame:
    """``(seed, id, split, term, weight)``."""
    vocabulary = model.terms.select("idx", "term").distinct()
    return unnest_structs(weighed, ["seed", "id", "split"], "features").join(vocabulary, "idx").drop("idx")


def vector_stages(model: Tfidf, seed: int, counted: bool = False) -> list:
    """Spark ML stages that turn ``terms``, or ``counts`` if these are there, into a unit-norm sparse vector ``features``."""
    idf = model.idf.filter(F.col("seed") == seed).first()["idf"]
    idf = idf + [0.0] * (len(model.words) - len(idf))
    counter = [] if counted else [CountVectorizerModel.from_vocabulary(model.words, inputCol="terms", outputCol="counts")]
    return [
        *counter,
        ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="counts", outputCol="weighted"),
        Normalizer(p=2.0, inputCol="weighted", outputCol="features"),
    ]
