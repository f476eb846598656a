"""Sources and sinks: each query writes given tables in a format and reads them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import profile, split
from ..operators import experiment as ex
from ..operators import metrics as me
from ..operators import vocabulary as vo
from ..operators import signedrank as sr
from ..schemas import LABELLED, METRIC_NAMES, RAW_ONE_JSON, RAW_SPLIT_CSV, RAW_TWO_JSON, SEEDS
from ..session import scratch_path
from ..sources import files, results, split_csv, split_json, words
from . import sql
from .experiments import LOG, PAIRS, RANKS, TEST, epoch_log
from .registry import query
from .tables import documents, labelled, table


@query("S1 S4", f"WITH {sql.LABELLED} SELECT id, md5(text) AS digest, label, project FROM labelled")
def csv_round_trip(spark, sf):
    path = scratch_path(spark, "labelled-csv")
    files.write_csv(labelled(spark, sf).select("id", "text", "label", "project"), path)
    rows = files.read_csv(spark, path, LABELLED)
    return rows.select("id", F.md5("text").alias("digest"), "label", "project")


#: Characters of text in one file: several of the splits that Spark makes of it, and no more than a task may write.
FILE_CHARS = 400_000_000


def in_large_files(rows: DataFrame, most: int = FILE_CHARS) -> DataFrame:
    """Rows ``(id, text, …)`` for one file of at most about so many characters, or for as many as it takes."""
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    return rows.repartition(-(-size // most), "id") if size > most else rows.coalesce(1)


@query("S1 S4", f"WITH {sql.LABELLED} SELECT id, md5(text) AS digest, label, project FROM labelled")
def csv_in_splits(spark, sf):
    """Large files of quoted records with line breaks, one if it is enough, each read by several tasks."""
    path = scratch_path(spark, "one-csv")
    files.write_csv(in_large_files(labelled(spark, sf).select("id", "text", "label", "project")), path)
    rows = split_csv.read_split_csv(spark, path, LABELLED)
    return rows.select("id", F.md5("text").alias("digest"), "label", "project")


def write_json_arrays(df: DataFrame, columns: list[str], path: str) -> None:
    """Files of one JSON array each, as many as there are shuffle partitions."""
    files_wanted = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = df.withColumn("_chunk", F.pmod(F.xxhash64("id"), F.lit(files_wanted))).groupBy("_chunk")
    arrays = chunks.agg(F.to_json(F.collect_list(F.struct(*columns))).alias("value"))
    arrays.write.mode("overwrite").partitionBy("_chunk").text(path)


@query("S2 P1", f"WITH {sql.LABELLED} SELECT md5(text) AS digest, label AS vul, project, md5(id::VARCHAR) AS commit_id FROM labelled")
def json_array_source(spark, sf):
    path = scratch_path(spark, "one-json")
    rows = labelled(spark, sf).select(
        "id",
        F.col("text").alias("func"),
        F.col("label").alias("target"),
        "project",
        F.md5(F.col("id").cast("string")).alias("commit_id"),
    )
    write_json_arrays(rows, ["func", "target", "project", "commit_id"], path)
    back = files.read_json_array(spark, path, RAW_ONE_JSON)
    return back.select(F.md5("func").alias("digest"), F.col("target").alias("vul"), "project", "commit_id")


@query("S2 P1", f"WITH {sql.LABELLED} SELECT md5(text) AS digest, label AS vul, project, md5(id::VARCHAR) AS commit_id FROM labelled")
def json_in_splits(spark, sf):
    """Files of one JSON array each, read by several tasks a file."""
    path = scratch_path(spark, "split-json")
    rows = labelled(spark, sf).select(
        "id", F.col("text").alias("func"), F.col("label").alias("target"), "project", F.md5(F.col("id").cast("string")).alias("commit_id")
    )
    write_json_arrays(rows, ["func", "target", "project", "commit_id"], path)
    back = split_json.read_split_json(spark, path, RAW_ONE_JSON)
    return back.select(F.md5("func").alias("digest"), F.col("target").alias("vul"), "project", "commit_id")


@query(
    "S2 P4 U1 A1",
    f"""WITH {sql.LABELLED} SELECT label AS target, project, count(*) AS n, sum(length(text))::BIGINT AS size FROM labelled
    GROUP BY label, project""",
)
def json_per_class_source(spark, sf):
    """One JSON source per class; the label is the source."""
    paths = {label: scratch_path(spark, f"class-{label}") for label in (1, 0)}
    rows = labelled(spark, sf).select(
        "id",
        F.col("text").alias("code"),
        "project",
        F.md5("text").alias("hash"),
        F.length("text").alias("size"),
        "label",
    )
    for label, path in paths.items():
        write_json_arrays(rows.filter(F.col("label") == label), ["code", "project", "hash", "size"], path)
    back = files.read_by_label(spark, paths, RAW_TWO_JSON)
    return back.groupBy("target", "project").agg(F.count("*").alias("n"), F.sum("size").alias("size"))


def _three_files(spark, sf) -> dict[str, str]:
    """The documents as train, val and test CSVs with the raw column names."""
    docs = split.positional_split(documents(spark, sf))
    raw = docs.select(
        F.col("text").alias("processed_func"), (F.col("id") % 2).cast("int").alias("target"), "project", "split"
    )
    paths = {}
    for name in ("train", "val", "test"):
        paths[name] = scratch_path(spark, f"{name}-csv")
        files.write_csv(raw.filter(F.col("split") == name).drop("split"), paths[name])
    return paths


_THREE = """t AS (SELECT count(*) AS total, floor(0.1::DOUBLE * count(*))::BIGINT AS n FROM documents),
p AS (SELECT doc_id % 2 AS target, source AS project, text, row_number() OVER (ORDER BY doc_id) AS pos FROM documents),
three AS (SELECT target, project, text, CASE WHEN pos > total - n THEN 'test' WHEN pos > total - 2 * n THEN 'val'
  ELSE 'train' END AS split FROM p, t)"""


@query("S1 S3 U1 A2", f"WITH {_THREE} SELECT split AS split_file, target::INTEGER AS target, md5(text) AS digest, project FROM three")
def concat_csv_sources(spark, sf):
    rows = files.concat_csv(spark, _three_files(spark, sf), RAW_SPLIT_CSV)
    return rows.select("split_file", "target", F.md5("processed_func").alias("digest"), "project")


@query(
    "S13 X3 A1 A3",
    f"""WITH {_THREE} SELECT split, count(*) FILTER (target = 1) AS n_positive, count(*) FILTER (target = 0) AS n_negative
    FROM three GROUP BY split""",
)
def pre_split_sources(spark, sf):
    paths = _three_files(spark, sf)
    rows = split.given_split({name: files.read_csv(spark, path, RAW_SPLIT_CSV) for name, path in paths.items()})
    rows = rows.withColumnRenamed("target", "label")
    return profile.class_balance(rows, ["split"]).select("split", "n_positive", "n_negative")


@query(
    "S1 S3 X1",
    """WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id % 2, doc_id) - 1 AS id FROM documents),
    t AS (SELECT count(*) AS total, floor(0.1::DOUBLE * count(*))::BIGINT AS n FROM documents)
    SELECT id, md5(text) AS digest, (doc_id % 2)::INTEGER AS target, source AS project,
    CASE WHEN id >= total - n THEN 'test' WHEN id >= total - 2 * n THEN 'val' ELSE 'train' END AS split
    FROM p JOIN documents USING (doc_id), t""",
)
def positional_split_of_files(spark, sf):
    """Two CSV sources with other columns in other orders, put in file order and split by position."""
    docs = documents(spark, sf).select(
        "id", F.col("text").alias("processed_func"), (F.col("id") % 2).cast("int").alias("target"), "project", F.md5("text").alias("commit_id")
    )
    orders = {0: ["id", "commit_id", "processed_func", "target", "project"], 1: ["project", "target", "commit_id", "processed_func"]}
    paths = {}
    for part, columns in orders.items():
        paths[f"part{part}"] = scratch_path(spark, f"part{part}-csv")
        rows = docs.filter(F.col("target") == part).orderBy("id")
        files.write_csv(rows.select(*columns), paths[f"part{part}"])
    rows = split.positional_split(files.with_ids(files.concat_csv(spark, paths, RAW_SPLIT_CSV)))
    return rows.select("id", F.md5("processed_func").alias("digest"), "target", "project", "split")


@query("S4 P1", f"WITH {sql.LABELLED} SELECT md5(text) AS func, label AS vul FROM labelled")
def flat_dataset(spark, sf):
    path = scratch_path(spark, "dataset")
    files.write_dataset(labelled(spark, sf).select(F.col("text").alias("func"), F.col("label").alias("vul")), path)
    return spark.read.parquet(path).select(F.md5("func").alias("func"), "vul")


def rule_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Test metrics of two rules per seed."""
    docs = labelled(spark, sf).select("id", "label", F.length("text").alias("n"), "project")
    rows = split.stratified_split(docs, SEEDS).filter(F.col("split") == "test")
    guesses = F.array(
        F.struct(F.lit("long").alias("method"), (F.col("n") > 1500).cast("int").alias("pred")),
        F.struct(F.lit("project").alias("method"), F.col("project").isin("src1", "src2").cast("int").alias("pred")),
    )
    preds = rows.select("seed", "label", F.inline(guesses))
    report = me.binary_report(preds, ["method", "seed"])
    return report.select(F.lit("rules").alias("model"), "method", F.lit("none").alias("classifier"), "seed", *sql.METRICS)


_RULES = f"""{sql.SPLIT}, guess AS (SELECT s.seed, s.label, m.method, CASE WHEN m.method = 'long'
  THEN (length(d.text) > 1500)::INTEGER ELSE (d.project IN ('src1', 'src2'))::INTEGER END AS pred
  FROM split s JOIN labelled d USING (id), (VALUES ('long'), ('project')) m(method) WHERE s.split = 'test'),
rules AS ({sql.binary('guess', 'method, seed')})"""


def rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in sql.METRICS})


@query("S5 A12", f"WITH {_RULES} SELECT 'rules' AS model, method, 'none' AS classifier, seed, {sql.rounded(sql.METRICS)} FROM rules")
def metrics_store(spark, sf):
    """Written twice: the second write replaces its own runs only."""
    path = scratch_path(spark, "metrics")
    runs = rule_runs(spark, sf)
    results.write_metrics(runs, path)
    results.write_metrics(runs.filter(F.col("method") == "long"), path)
    return rounded(results.read_metrics(spark, path)).select("model", "method", "classifier", "seed", *sql.METRICS)


def _tree(spark, sf) -> str:
    """Folder of a results tree with its averages."""
    path = scratch_path(spark, "results")
    results.write_metrics_csv(rule_runs(spark, sf), path)
    rows = results.read_metrics_tree(spark, path)
    averages = ex.average_metrics(rows, ["model", "method"], "file")
    results.write_average_csv(averages.select(*METRIC_NAMES, "n_files", "model", "method"), path)
    return path


@query("S6 F13", f"WITH {_RULES} SELECT 'rules' AS model, method, 'none' AS classifier, seed, {sql.rounded(sql.METRICS)} FROM rules")
def metrics_tree(spark, sf):
    return rounded(results.read_metrics_tree(spark, _tree(spark, sf))).drop("file")


@query(
    "S7 A18",
    f"""WITH {_RULES} SELECT 'rules' AS model, method, {', '.join(f'round(sum({m}) / count(DISTINCT seed), 6) AS {m}' for m in sql.METRICS)},
    count(DISTINCT seed) AS n_files FROM rules GROUP BY method""",
)
def metrics_average(spark, sf):
    """Averages per model and method, written beside the runs and read back."""
    return rounded(results.read_average_csv(spark, _tree(spark, sf)))


_TWO_MODELS = f"""{sql.SPLIT}, guess AS (SELECT s.seed, s.label, m.method, (length(d.text) > m.bound)::INTEGER AS pred
  FROM split s JOIN labelled d USING (id), (VALUES ('rules/long/none', 1500), ('shorter/long/none', 800)) m(method, bound)
  WHERE s.split = 'test'),
vals AS (SELECT method, seed, metric, round(value, 9) AS value FROM ({sql.binary('guess', 'method, seed')})
  UNPIVOT (value FOR metric IN (accuracy, f1)))"""


@query(
    "S5 S6 J3 H1 H2",
    f"""WITH {_TWO_MODELS}, {PAIRS}, {RANKS}, {TEST} SELECT method_a, method_b, metric, n, n_zero, w, round(p, 6) AS p,
    p < 0.05 AS significant FROM t""",
)
def compare_result_trees(spark, sf):
    """Two models of one method in a results tree, chosen by path and compared over the seeds."""
    path = scratch_path(spark, "results")
    rows = split.stratified_split(labelled(spark, sf).select("id", "label", F.length("text").alias("n")), SEEDS)
    rows = rows.filter(F.col("split") == "test")
    for model, bound in (("rules", 1500), ("shorter", 800), ("other", 100)):
        preds = rows.select("seed", "label", (F.col("n") > bound).cast("int").alias("pred"))
        report = me.binary_report(preds, ["seed"])
        named = [F.lit(model).alias("model"), F.lit("long").alias("method"), F.lit("none").alias("classifier")]
        results.write_metrics_csv(report.select(*named, "seed", *METRIC_NAMES), path)
    tree = results.read_metrics_tree(spark, path).withColumn("method", sr.run_path())
    values = ex.metric_rows(tree, ["method", "seed"]).withColumn("value", F.round("value", 9))
    pairs = sr.paired_runs(values, ["accuracy", "f1"], ["rules/long/none", "shorter/long/none"])
    return sr.wilcoxon(pairs, sr.PAIR).withColumn("p", F.round("p", 6))


@query(
    "S8 S9",
    """SELECT concat('v', vec_id) AS word, len(embedding)::INTEGER AS dim,
    round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total FROM embeddings""",
)
def vectors_text(spark, sf):
    path = scratch_path(spark, "vectors")
    rows = table(spark, sf, "embeddings")
    dim = len(rows.select("embedding").first()[0])
    words.write_vectors_text(
        rows.select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("word"), F.col("embedding").alias("vec")), path
    )
    back = words.read_vectors_text(spark, path, dim)
    total = F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return back.select("word", F.size("vec").alias("dim"), F.round(total, 4).alias("total"))


@query(
    "S10 F2",
    r"""SELECT line, count(*) AS n FROM (SELECT unnest(string_split(text, E'\n')) AS line FROM documents) GROUP BY line""",
)
def corpus_text(spark, sf):
    path = scratch_path(spark, "corpus")
    words.write_corpus(documents(spark, sf), path)
    return words.read_corpus_lines(spark, path).groupBy("line").agg(F.count("*").alias("n"))


@query(
    "S11 F16 A9",
    f"""WITH {sql.DOCS} SELECT word, row_number() OVER (ORDER BY n DESC, word) AS id, n FROM
    (SELECT word, count(*) AS n FROM (SELECT unnest({sql.words('lower(text)')}) AS word FROM docs) GROUP BY word)""",
)
def vocabulary_json(spark, sf):
    path = scratch_path(spark, "vocabulary")
    rows = vo.build_vocabulary(documents(spark, sf), tx.lower_words(F.col("text")))
    words.write_vocabulary_json(rows, path)
    return words.read_vocabulary_json(spark, path)


@query("S12", f"WITH {LOG} SELECT run, count(*) AS n, max(epoch) AS last, round(sum(val_f1), 4) AS total FROM log GROUP BY run")
def epoch_log_store(spark, sf):
    """Appended in two parts."""
    path = scratch_path(spark, "epochs")
    log = epoch_log(spark, sf)
    results.append_epochs(log.filter(F.col("epoch") <= 10), path)
    results.append_epochs(log.filter(F.col("epoch") > 10), path)
    rows = results.read_epochs(spark, path)
    return rows.groupBy("run").agg(
        F.count("*").alias("n"), F.max("epoch").alias("last"), F.round(F.sum("val_f1"), 4).alias("total")
    )
