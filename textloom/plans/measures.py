"""Classification metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as ar
from ..operators import metrics as me
from . import sql, study
from .registry import query

_FLAGGED = """flagged AS (SELECT d.lang, d.doc_id AS id, 1 - l.quality AS label, l.toxic AS pred
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""
_GUESSED = """guessed AS (SELECT event_id AS id,
  list_position(['view', 'click', 'purchase', 'signup', 'error'], event_type) - 1 AS label, user_id % 5 AS pred FROM events)"""
_SCORED = """scored AS (SELECT vec_id AS id, label % 2 AS label,
  round(1 / (1 + exp(-8 * embedding[1]::DOUBLE)), 3) AS score FROM embeddings)"""


def rounded(df, names, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in names})


@query(
    "A10",
    f"""WITH {_FLAGGED}, c AS (SELECT DISTINCT lang, label AS class FROM flagged UNION SELECT DISTINCT lang, pred FROM flagged),
    n AS (SELECT lang, label, pred, count(*) AS n FROM flagged GROUP BY ALL)
    SELECT a.lang, a.class AS label, b.class AS pred, coalesce(n.n, 0) AS n FROM c a JOIN c b ON a.lang = b.lang
    LEFT JOIN n ON n.lang = a.lang AND n.label = a.class AND n.pred = b.class""",
)
def confusion_matrix(spark, sf):
    return me.confusion_matrix(study.flagged(spark, sf), ["lang"])


@query(
    "A11",
    f"""WITH {_FLAGGED} SELECT lang, count(*) FILTER (label = 0 AND pred = 0) AS tn,
    count(*) FILTER (label = 0 AND pred = 1) AS fp, count(*) FILTER (label = 1 AND pred = 0) AS fn,
    count(*) FILTER (label = 1 AND pred = 1) AS tp FROM flagged GROUP BY lang""",
)
def confusion_cells(spark, sf):
    return me.confusion_cells(study.flagged(spark, sf), ["lang"])


@query("A12 A14 P7", f"WITH {_FLAGGED} SELECT lang, {sql.rounded(sql.METRICS)} FROM ({sql.binary('flagged', 'lang')})")
def binary_report(spark, sf):
    return rounded(me.report(study.flagged(spark, sf), ["lang"], 2), sql.METRICS)


def _per_class(source: str, by: str) -> str:
    return f"""counts AS (SELECT {by}, label, pred, count(*) AS n FROM {source} GROUP BY ALL),
    sides AS (SELECT {by}, label AS class, n AS support, 0 AS predicted, CASE WHEN label = pred THEN n ELSE 0 END AS tp
      FROM counts UNION ALL SELECT {by}, pred, 0, n, 0 FROM counts),
    sums AS (SELECT {by}, class, sum(support) AS support, sum(predicted) AS predicted, sum(tp) AS tp FROM sides GROUP BY ALL),
    pr AS (SELECT *, CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted::DOUBLE END AS precision,
      CASE WHEN support = 0 THEN 0 ELSE tp / support::DOUBLE END AS recall FROM sums),
    per_class AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1
      FROM pr)"""


@query(
    "A13 P7",
    f"""WITH {_GUESSED}, tagged AS (SELECT *, id % 3 AS part FROM guessed), {_per_class('tagged', 'part')},
    m AS (SELECT part, sum(tp) / sum(support)::DOUBLE AS accuracy, avg(precision) AS precision, avg(recall) AS recall,
      avg(f1) AS f1 FROM per_class GROUP BY part)
    SELECT part, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall,
    round(f1, 6) AS f1, round(5 * precision * recall / (4 * precision + recall), 6) AS f2, NULL::DOUBLE AS roc_auc FROM m""",
)
def macro_report(spark, sf):
    rows = study.guessed_events(spark, sf).withColumn("part", F.col("id") % 3)
    return rounded(me.report(rows, ["part"], 5), sql.METRICS[:5])


@query(
    "A15",
    f"""WITH {_FLAGGED}, {_per_class('flagged', 'lang')},
    t AS (SELECT lang, sum(support) AS support, sum(tp) / sum(support)::DOUBLE AS accuracy, avg(precision) AS mp,
      avg(recall) AS mr, avg(f1) AS mf, sum(precision * support) / sum(support)::DOUBLE AS wp,
      sum(recall * support) / sum(support)::DOUBLE AS wr, sum(f1 * support) / sum(support)::DOUBLE AS wf
      FROM per_class GROUP BY lang),
    u AS (SELECT lang, class::VARCHAR AS class, precision, recall, f1, support FROM per_class
      UNION ALL SELECT lang, 'accuracy', NULL, NULL, accuracy, support FROM t
      UNION ALL SELECT lang, 'macro avg', mp, mr, mf, support FROM t
      UNION ALL SELECT lang, 'weighted avg', wp, wr, wf, support FROM t)
    SELECT lang, class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
    support::BIGINT AS support FROM u""",
)
def class_report(spark, sf):
    return rounded(me.class_report(study.flagged(spark, sf), ["lang"]), ["precision", "recall", "f1"])


@query(
    "A15 F14",
    f"""WITH {_GUESSED}, {_per_class('guessed', '1 AS one').replace('SELECT 1 AS one,', 'SELECT')}
    SELECT class::INTEGER AS class, printf('%.2f%%', 100 * precision) AS precision, printf('%.2f%%', 100 * recall) AS recall,
    support::BIGINT AS support FROM per_class""",
)
def class_percentages(spark, sf):
    rows = me.per_class(study.guessed_events(spark, sf), [])
    return rows.select(
        "class",
        ar.percent(F.col("precision")).alias("precision"),
        ar.percent(F.col("recall")).alias("recall"),
        "support",
    )


@query(
    "A14",
    f"""WITH {_SCORED} SELECT round(sum(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END)
    / count(*), 6) AS auc FROM scored p, scored n WHERE p.label = 1 AND n.label = 0""",
)
def score_auc(spark, sf):
    return rounded(me.score_auc(study.scored(spark, sf), []), ["auc"])


_BATCHES = f"""{_SCORED}, batched AS (SELECT *, (row_number() OVER (ORDER BY id) - 1) // 64 AS batch FROM scored)"""


@query(
    "A16 F17",
    f"""WITH {_BATCHES}, s AS (SELECT batch,
      sum(round_even(least(greatest(label * score, 0), 1), 0)) AS tp, sum(round_even(label::DOUBLE, 0)) AS pos,
      sum(round_even(least(greatest(score, 0), 1), 0)) AS pred FROM batched GROUP BY batch),
    r AS (SELECT batch, (tp + 1e-7) / (pos + 1e-7) AS recall, (tp + 1e-7) / (pred + 1e-7) AS precision FROM s),
    m AS (SELECT *, 2 * (precision * recall / (precision + recall + 1e-7)) AS f1,
      5 * (precision * recall / (4 * precision + recall + 1e-7)) AS f2 FROM r)
    SELECT round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision, round(avg(f1), 6) AS f1,
    round(avg(f2), 6) AS f2 FROM m""",
)
def smoothed_epoch_metrics(spark, sf):
    per_batch = me.smoothed_batch_metrics(me.in_batches(study.scored(spark, sf), 64))
    return rounded(me.epoch_mean(per_batch), ["recall", "precision", "f1", "f2"])


@query(
    "A17 W1",
    f"""WITH {_BATCHES}, l AS (SELECT batch, avg(-ln(CASE WHEN label = 1 THEN score ELSE 1 - score END)) AS loss
      FROM batched GROUP BY batch) SELECT round(avg(loss), 6) AS loss, count(*) AS n_batches FROM l""",
)
def batch_loss(spark, sf):
    batched = me.in_batches(study.scored(spark, sf), 64)
    return rounded(me.batch_loss(batched, me.cross_entropy(F.col("label"), F.col("score"))), ["loss"])
