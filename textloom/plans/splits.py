"""Order, splits and rebalancing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import clean, ordering, profile, split
from ..schemas import SEEDS
from . import sql
from .registry import query
from .tables import documents, labelled, table

SEED = SEEDS[0]


@query(
    "K1 W1",
    f"""SELECT doc_id AS id, row_number() OVER (ORDER BY md5(concat({SEED}, '|', doc_id)), doc_id) AS pos
    FROM documents""",
)
def shuffled_positions(spark, sf):
    rows = documents(spark, sf).select("id")
    return ordering.shuffled_position(rows, SEED).select("id", "pos")


@query("W1", "SELECT event_id AS id, row_number() OVER (ORDER BY event_id) AS pos FROM events")
def row_positions(spark, sf):
    return ordering.row_position(table(spark, sf, "events").select(F.col("event_id").alias("id")))


@query("K1", f"SELECT event_id AS id, md5(concat({SEED}, '|', event_id)) AS key FROM events")
def seeded_shuffle(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_id").alias("id"))
    rows = rows.withColumn("key", ordering.seeded_key(SEED, F.col("id")))
    return ordering.seeded_shuffle(rows, SEED)


_POSITIONAL = f"""{sql.DOCS}, t AS (SELECT count(*) AS total, floor(0.1::DOUBLE * count(*))::BIGINT AS n FROM docs),
p AS (SELECT *, row_number() OVER (ORDER BY id) AS pos FROM docs),
placed AS (SELECT p.*, CASE WHEN pos > total - n THEN 'test' WHEN pos > total - 2 * n THEN 'val' ELSE 'train' END AS split
  FROM p, t)"""


@query("X1 W1", f"WITH {_POSITIONAL} SELECT id, split FROM placed")
def positional_split(spark, sf):
    return split.positional_split(documents(spark, sf)).select("id", "split")


@query(
    "X1 P2 P3 A2 A5",
    f"""WITH {_POSITIONAL} SELECT split, count(*) AS n, min(id) AS first_id, max(id) AS last_id,
    max(len({sql.words()}))::BIGINT AS max_words FROM placed WHERE project IS DISTINCT FROM 'src0' AND text <> ''
    GROUP BY split""",
)
def positional_split_filtered(spark, sf):
    """Split first, filter after, as a positional study does."""
    rows = split.positional_split(documents(spark, sf))
    rows = clean.drop_null_text(clean.exclude_project(rows, "src0"))
    return rows.groupBy("split").agg(
        F.count("*").alias("n"),
        F.min("id").alias("first_id"),
        F.max("id").alias("last_id"),
        F.max(F.size(tx.words(F.col("text")))).cast("long").alias("max_words"),
    )


@query("X2", f"WITH {sql.QUOTAS} SELECT label, n, n_test, n_val FROM quotas")
def class_quotas(spark, sf):
    return split.class_quotas(labelled(spark, sf))


@query("X2 X6", f"WITH {sql.SPLIT} SELECT seed, id, label, split FROM split")
def stratified_split(spark, sf):
    rows = labelled(spark, sf).select("id", "label")
    return split.stratified_split(rows, SEEDS).select("seed", "id", "label", "split")


@query(
    "X2 X6 A1 A3 A5",
    f"""WITH {sql.SPLIT}, w AS (SELECT id, len({sql.words()})::BIGINT AS n_words FROM labelled)
    SELECT seed, split, count(*) FILTER (label = 1) AS n_positive, count(*) FILTER (label = 0) AS n_negative,
    round(100 * count(*) FILTER (label = 1) / nullif(count(*) FILTER (label = 0), 0)::DOUBLE, 6) AS imbalance_pct,
    max(n_words) AS max_words FROM split JOIN w USING (id) GROUP BY seed, split""",
)
def split_profile(spark, sf):
    """Class sizes, imbalance and longest text of every split of every seed."""
    rows = labelled(spark, sf).select("id", "label", F.size(tx.words(F.col("text"))).alias("n_words"))
    rows = split.stratified_split(rows, SEEDS)
    balance = profile.class_balance(rows, ["seed", "split"]).drop("n_classes")
    longest = rows.groupBy("seed", "split").agg(F.max("n_words").cast("long").alias("max_words"))
    return balance.join(longest, ["seed", "split"]).withColumn("imbalance_pct", F.round("imbalance_pct", 6))


def _multiclass_quota_sql() -> str:
    return sql.QUOTAS.replace(sql.LABELLED, "labelled AS (SELECT vec_id AS id, label FROM embeddings)")


@query("X2 P7", f"WITH {_multiclass_quota_sql()} SELECT label, n, n_test, n_val FROM quotas")
def multiclass_quotas(spark, sf):
    return split.class_quotas(table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label"))


def _undersample(name: str, k: int):
    statement = f"""WITH {sql.SPLIT}, {sql.undersampled(k)} SELECT seed, id, label, split FROM sampled"""

    def plan(spark, sf):
        rows = labelled(spark, sf).select("id", "label")
        return split.stratified_split(rows, SEEDS, undersample=k).select("seed", "id", "label", "split")

    plan.__name__ = name
    return query("X4 A7", statement)(plan)


undersample_equal = _undersample("undersample_equal", 1)
undersample_double = _undersample("undersample_double", 2)
undersample_fourfold = _undersample("undersample_fourfold", 4)


@query(
    "X4",
    f"""WITH {sql.SPLIT}, {sql.undersampled(20)} SELECT seed, majority, n_majority, target, n_classes,
    n_classes = 2 AND target <= n_majority AS reachable FROM sampled_goal""",
)
def undersample_unreachable(spark, sf):
    """A target above the class size is reported, and no row is dropped."""
    rows = split.stratified_split(labelled(spark, sf).select("id", "label"), SEEDS)
    return split.undersample_report(rows.filter(F.col("split") == "train"), 20)


@query(
    "X5 X4 K1",
    f"""WITH {sql.SPLIT}, {sql.undersampled(2)} SELECT seed, id, label,
    row_number() OVER (PARTITION BY seed ORDER BY md5(concat(seed, 'r|', id)), id) AS pos FROM sampled
    WHERE split = 'train'""",
)
def reshuffled_train(spark, sf):
    rows = split.stratified_split(labelled(spark, sf).select("id", "label"), SEEDS, undersample=2)
    rows = rows.filter(F.col("split") == "train").drop("split")
    rows = rows.withColumn("key", ordering.seeded_key(F.col("seed"), F.col("id"), "r"))
    placed = ordering.position_within(rows, ["seed"], ordering.digest_bucket(F.col("key")), ["key", "id"])
    return placed.select("seed", "id", "label", "pos")
