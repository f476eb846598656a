"""Epoch logs, averages over seeds and paired tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import experiment as ex
from ..operators import metrics as me
from ..operators import ordering
from ..operators import signedrank as sr
from ..operators import split
from ..schemas import SEEDS
from . import sql, study
from .registry import query
from .tables import table


def epoch_log(spark: SparkSession, sf: str) -> DataFrame:
    """Every user's events in time order as the epochs of a run."""
    events = table(spark, sf, "events")
    minute = F.unix_micros(F.col("ts").cast("timestamp"))
    placed = ordering.position_within(
        events, ["user_id"], F.floor(minute / 60_000_000), ["ts", "event_id"], "epoch", paged=True
    )
    value = F.col("value")
    return placed.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("run"),
        F.col("epoch").cast("long").alias("epoch"),
        (1 / (1 + value)).alias("loss"),
        (value / 2).alias("f1"),
        (2 / (1 + value)).alias("val_loss"),
        value.alias("val_f1"),
    )


LOG = """log AS (SELECT concat('u', user_id) AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch,
  1 / (1 + value) AS loss, value / 2 AS f1, 2 / (1 + value) AS val_loss, value AS val_f1 FROM events)"""

_REPLAY = f"""{LOG}, b AS (SELECT run, epoch, val_f1, max(val_f1) OVER (PARTITION BY run ORDER BY epoch
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM log),
i AS (SELECT *, best_before IS NULL OR val_f1 > best_before AS improved FROM b),
w AS (SELECT *, epoch - max(CASE WHEN improved THEN epoch END) OVER (PARTITION BY run ORDER BY epoch) AS waited FROM i)"""


@query(
    "W3",
    f"""WITH {_REPLAY} SELECT run, epoch, round(best_before, 6) AS best_before, improved, waited, waited >= 10 AS stops FROM w""",
)
def early_stopping(spark, sf):
    rows = ex.early_stopping(epoch_log(spark, sf), 10)
    return rows.select("run", "epoch", F.round("best_before", 6).alias("best_before"), "improved", "waited", "stops")


@query(
    "W3 W4",
    f"""WITH {_REPLAY}, s AS (SELECT run, min(epoch) FILTER (waited >= 10) AS stop_epoch, max(epoch) AS end_epoch
      FROM w GROUP BY run)
    SELECT run, stop_epoch, coalesce(stop_epoch, end_epoch) AS last_epoch,
    max(epoch) FILTER (improved AND (stop_epoch IS NULL OR epoch <= stop_epoch)) AS best_epoch,
    round(max(val_f1) FILTER (improved AND (stop_epoch IS NULL OR epoch <= stop_epoch)), 6) AS best_val_f1
    FROM w JOIN s USING (run) GROUP BY run, stop_epoch, end_epoch""",
)
def stop_and_best(spark, sf):
    return ex.stop_and_best(epoch_log(spark, sf), 10).withColumn("best_val_f1", F.round("best_val_f1", 6))


@query(
    "W4",
    f"""WITH {LOG} SELECT run, first(epoch ORDER BY val_f1 DESC, epoch) AS best_epoch, round(max(val_f1), 6) AS best_val_f1
    FROM log GROUP BY run""",
)
def best_epoch(spark, sf):
    return ex.best_epoch(epoch_log(spark, sf)).withColumn("best_val_f1", F.round("best_val_f1", 6))


@query(
    "W6",
    f"""WITH {LOG} SELECT run, epoch, curve, round(value, 6) AS value FROM
    (SELECT run, epoch, loss, f1, val_loss, val_f1 FROM log) UNPIVOT (value FOR curve IN (loss, f1, val_loss, val_f1))""",
)
def training_curves(spark, sf):
    return ex.curves(epoch_log(spark, sf)).withColumn("value", F.round("value", 6))


# The compared treatments of the train split and their ratios.
METHODS = {"as_is": None, "equal": 1, "double": 2}


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Test metrics per method and seed: naive Bayes on differently balanced train rows."""
    numbered = split.runs_of(SEEDS, list(METHODS))
    names = F.create_map(*[F.lit(x) for run, place, _ in numbered for x in (run, list(METHODS)[place])])
    seeds = F.create_map(*[F.lit(x) for run, _, seed in numbered for x in (run, seed)])
    preds = study.bayes_predictions(spark, sf, treatments=list(METHODS.values()))
    report = me.binary_report(preds.filter(F.col("split") == "test"), ["seed"])
    report = report.withColumn("method", names[F.col("seed")]).withColumn("seed", seeds[F.col("seed")])
    report = report.withColumns({c: F.round(c, 9) for c in sql.METRICS})
    return report.select(F.lit("tfidf").alias("model"), "method", F.lit("bayes").alias("classifier"), "seed", *sql.METRICS)


def _method_sql(method: str, k: int | None) -> str:
    source, first = ("split", "") if k is None else (f"{method}_split", f"{sql.undersampled(k, f'{method}_split')},")
    prefix = f"{method}_"
    return f"{first} {sql.tfidf(source, prefix)}, {sql.bayes(source, prefix)}"


def _runs_sql() -> str:
    parts = ", ".join(_method_sql(m, k) for m, k in METHODS.items())
    unions = " UNION ALL ".join(
        f"SELECT '{m}' AS method, * FROM ({sql.binary(f'(SELECT * FROM {m}_nb WHERE split = {chr(39)}test{chr(39)})', 'seed')})"
        for m in METHODS
    )
    return f"{sql.SPLIT}, {parts}, runs AS (SELECT method, seed, {sql.rounded(sql.METRICS, 9)} FROM ({unions}))"


RUNS = _runs_sql()
VALUES = """vals AS (SELECT method, seed, metric, value FROM
  (SELECT method, seed, accuracy, precision, recall, f1, f2, roc_auc FROM runs)
  UNPIVOT (value FOR metric IN (accuracy, precision, recall, f1, f2, roc_auc)))"""


def values(spark: SparkSession, sf: str) -> DataFrame:
    rows = ex.metric_rows(runs(spark, sf), ["method", "seed"])
    return rows.filter(F.col("value").isNotNull())


@query("F15 A12", f"WITH {RUNS}, {VALUES} SELECT method, seed, metric, round(value, 6) AS value FROM vals")
def metric_rows(spark, sf):
    """Metric columns to rows, to one map per run, and back to rows."""
    maps = ex.metric_map(values(spark, sf), ["method", "seed"])
    rows = maps.select("method", "seed", F.explode("metrics").alias("metric", "value"))
    return rows.withColumn("value", F.round("value", 6))


@query(
    "A19",
    f"""WITH {RUNS}, {VALUES} SELECT method, metric, count(*) AS n, round(avg(value), 6) AS mean,
    round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min, round(quantile_cont(value, 0.25), 6) AS q25,
    round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.75), 6) AS q75, round(max(value), 6) AS max,
    round(avg(value), 6) AS mean_rounded FROM vals GROUP BY method, metric""",
)
def describe_runs(spark, sf):
    rows = ex.describe(values(spark, sf), ["method", "metric"])
    return rows.withColumns({c: F.round(c, 6) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")})


PAIRS = """pairs AS (SELECT a.method AS method_a, b.method AS method_b, a.metric, a.seed, round(a.value - b.value, 12) AS diff
  FROM vals a JOIN vals b ON a.seed = b.seed AND a.metric = b.metric AND a.method < b.method)"""


@query(
    "J3 H2",
    f"""WITH {RUNS}, {VALUES}, {PAIRS} SELECT method_a, method_b, metric, seed, round(diff, 6) AS diff FROM pairs
    WHERE metric IN ('f1', 'accuracy') AND method_a IN ('as_is', 'double') AND method_b IN ('as_is', 'double')""",
)
def paired_runs(spark, sf):
    rows = sr.paired_runs(values(spark, sf), ["f1", "accuracy"], ["as_is", "double"])
    return rows.select("method_a", "method_b", "metric", "seed", F.round("diff", 6).alias("diff"))


RANKS = """ranks AS (SELECT *, abs(diff) AS size, rank() OVER (PARTITION BY method_a, method_b, metric ORDER BY abs(diff))
  + (count(*) OVER (PARTITION BY method_a, method_b, metric, abs(diff)) - 1) / 2.0::DOUBLE AS rank,
  count(*) OVER (PARTITION BY method_a, method_b, metric, abs(diff)) AS n_tied FROM pairs WHERE diff <> 0)"""


@query(
    "W5",
    f"""WITH {RUNS}, {VALUES}, {PAIRS}, {RANKS} SELECT method_a, method_b, metric, round(size, 6) AS size, n_tied,
    count(*) FILTER (diff > 0) AS n_plus, rank FROM ranks GROUP BY method_a, method_b, metric, size, n_tied, rank""",
)
def signed_ranks(spark, sf):
    rows = sr.signed_ranks(sr.paired_runs(values(spark, sf)), sr.PAIR)
    return rows.select(*sr.PAIR, F.round("size", 6).alias("size"), "n_tied", "n_plus", "rank")


# The null distribution by trying every sign pattern of the ranks, and the
# normal tail by a fine midpoint sum, both unlike the Spark side.
TEST = """z AS (SELECT method_a, method_b, metric, count(*) AS n_pairs, count(*) FILTER (diff = 0) AS n_zero
  FROM pairs GROUP BY ALL),
w AS (SELECT method_a, method_b, metric, count(*) AS n, coalesce(sum(rank) FILTER (diff > 0), 0) AS wp,
  coalesce(sum(rank) FILTER (diff < 0), 0) AS wm, sum(n_tied * n_tied - 1) AS ties FROM ranks GROUP BY ALL),
bits AS (SELECT n, pattern, sum(CASE WHEN (pattern >> (k - 1)::INTEGER) & 1 = 1 THEN k ELSE 0 END) AS total
  FROM (SELECT n, unnest(range(0, (1 << n::INTEGER)::BIGINT)) AS pattern FROM (SELECT DISTINCT n FROM w)),
  (SELECT unnest(range(1, 16)) AS k) WHERE k <= n GROUP BY n, pattern),
ex AS (SELECT w.method_a, w.method_b, w.metric, count(*) FILTER (total <= floor(wp)) / count(*)::DOUBLE AS less,
  count(*) FILTER (total >= floor(wp)) / count(*)::DOUBLE AS more FROM w JOIN bits USING (n) GROUP BY ALL),
nz AS (SELECT *, abs(least(wp, wm) - n * (n + 1) / 4.0::DOUBLE) / sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24.0::DOUBLE) AS zz
  FROM w),
nt AS (SELECT method_a, method_b, metric, 1 - 2 * sum(exp(-((((i + 0.5::DOUBLE) * zz / 20000) ^ 2) / 2))) * any_value(zz) / 20000
  / sqrt(2 * pi()) AS p FROM nz, (SELECT unnest(range(0, 20000)) AS i) GROUP BY ALL),
t AS (SELECT z.*, coalesce(w.n, 0) AS n, least(wp, wm) AS w, CASE WHEN w.n IS NULL THEN NULL
  WHEN z.n_zero = 0 THEN CASE WHEN floor(wp) = (w.n * (w.n + 1) // 2) // 2 THEN 1 ELSE 2 * least(less, more) END ELSE nt.p END AS p
  FROM z LEFT JOIN w USING (method_a, method_b, metric) LEFT JOIN ex USING (method_a, method_b, metric)
  LEFT JOIN nt USING (method_a, method_b, metric))"""


@query(
    "H1 H2 J3 W5",
    f"""WITH {RUNS}, {VALUES}, {PAIRS}, {RANKS}, {TEST} SELECT method_a, method_b, metric, n, n_zero, w, round(p, 6) AS p,
    p < 0.05 AS significant FROM t""",
)
def signed_rank_test(spark, sf):
    rows = sr.wilcoxon(sr.paired_runs(values(spark, sf)), sr.PAIR)
    return rows.withColumn("p", F.round("p", 6))
