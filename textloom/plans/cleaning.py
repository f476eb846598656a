"""Column choice, filters and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as ar
from ..functions import text as tx
from ..operators import clean, profile
from . import sql
from .registry import query
from .tables import documents, labelled, table


@query("P1", "SELECT doc_id AS id, md5(text) AS digest, n_chars::INTEGER AS label, source AS project FROM documents")
def select_rename(spark, sf):
    rows = clean.as_labelled(table(spark, sf, "documents"), "doc_id", "text", "n_chars", "source")
    return rows.select("id", F.md5("text").alias("digest"), "label", "project")


@query(
    "P2",
    """SELECT lang, count(*) AS n FROM (SELECT lang, nullif(source, 'src1') AS project FROM documents)
    WHERE project IS DISTINCT FROM 'src0' GROUP BY lang""",
)
def exclude_project(spark, sf):
    rows = documents(spark, sf).withColumn("project", F.nullif(F.col("project"), F.lit("src1")))
    return clean.exclude_project(rows, "src0").groupBy("lang").agg(F.count("*").alias("n"))


@query(
    "P3",
    """SELECT lang, count(*) AS n FROM (SELECT lang, CASE WHEN n_chars % 7 = 0 THEN NULL
    WHEN n_chars % 7 = 1 THEN '' ELSE text END AS text FROM documents) WHERE text <> '' GROUP BY lang""",
)
def drop_null_text(spark, sf):
    left = F.col("n_chars") % 7
    text = F.when(left == 0, F.lit(None)).when(left == 1, F.lit("")).otherwise(F.col("text"))
    rows = table(spark, sf, "documents").withColumn("text", text)
    return clean.drop_null_text(rows).groupBy("lang").agg(F.count("*").alias("n"))


@query(
    "P4 U1 A1",
    """SELECT label, lang IS NULL AS no_lang, count(*) AS n, sum(length(text))::BIGINT AS chars FROM (
      SELECT text, lang, 1 AS label FROM documents UNION ALL
      SELECT text, NULL, 0 FROM benchmark UNION ALL SELECT text, NULL, 2 FROM conversations) GROUP BY ALL""",
)
def union_labelled_sources(spark, sf):
    frames = [
        clean.with_label(table(spark, sf, "documents").select("text", "lang"), 1),
        clean.with_label(table(spark, sf, "benchmark").select("text"), 0),
        clean.with_label(table(spark, sf, "conversations").select("text"), 2),
    ]
    rows = clean.union_all(frames)
    return rows.groupBy("label", F.col("lang").isNull().alias("no_lang")).agg(
        F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")
    )


@query("P5", "SELECT event_id, (CASE WHEN value / 20 > 0.5 THEN 1 ELSE 0 END)::INTEGER AS pred FROM events")
def probability_to_class(spark, sf):
    return table(spark, sf, "events").select("event_id", ar.class_at(F.col("value") / 20).alias("pred"))


@query(
    "P6",
    "SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INTEGER AS pred FROM embeddings",
)
def argmax_class(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", ar.argmax(F.col("embedding")).alias("pred"))


@query("P8", "SELECT doc_id AS id, lang, source AS project FROM documents ORDER BY doc_id LIMIT 5")
def preview_rows(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang", F.col("source").alias("project"))
    return clean.preview(rows)


@query("A1 K3", "SELECT source AS project, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1")
def project_counts(spark, sf):
    return profile.value_counts(table(spark, sf, "documents").withColumnRenamed("source", "project"), "project")


@query("A1 K3", "SELECT n_chars, count(*) AS n FROM documents GROUP BY 1")
def size_counts(spark, sf):
    return profile.value_counts(table(spark, sf, "documents"), "n_chars")


@query(
    "A2",
    """SELECT lang, count(*) AS n_before, count(*) FILTER (source IS DISTINCT FROM 'src0') AS n_after
    FROM documents GROUP BY lang""",
)
def row_counts(spark, sf):
    keep = ~F.col("source").eqNullSafe("src0")
    return profile.kept_counts(table(spark, sf, "documents"), keep, ["lang"])


@query(
    "A3 A4",
    f"""WITH {sql.LABELLED} SELECT lang, count(*) FILTER (label = 1) AS n_positive,
    count(*) FILTER (label = 0) AS n_negative,
    round(100 * count(*) FILTER (label = 1) / nullif(count(*) FILTER (label = 0), 0)::DOUBLE, 6) AS imbalance_pct,
    count(DISTINCT label) AS n_classes FROM labelled GROUP BY lang""",
)
def class_balance(spark, sf):
    rows = profile.class_balance(labelled(spark, sf), ["lang"])
    return rows.withColumn("imbalance_pct", F.round("imbalance_pct", 6))


@query("A5 F1", f"WITH {sql.DOCS} SELECT lang, max(len({sql.words()}))::BIGINT AS max_words FROM docs GROUP BY lang")
def longest_text(spark, sf):
    return profile.longest_text(documents(spark, sf), ["lang"])


@query(
    "A6",
    f"""WITH {sql.DOCS}, n AS (SELECT id, len(list_filter({sql.words()}, lambda x: x <> 'the'))::BIGINT AS n FROM docs)
    SELECT n AS max_len, id FROM n ORDER BY n DESC, id LIMIT 1""",
)
def longest_sequence(spark, sf):
    rows = documents(spark, sf).select("id", tx.words(F.col("text")).alias("ids"))
    return profile.longest_sequence(rows, "ids", "the")


@query(
    "A7",
    """SELECT e.label % 2 AS part, first(label ORDER BY n DESC, label) AS majority, max(n) AS n_majority,
    first(label ORDER BY n, label) AS minority, min(n) AS n_minority
    FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label) e GROUP BY 1""",
)
def majority_minority(spark, sf):
    rows = table(spark, sf, "embeddings").withColumn("part", F.col("label") % 2)
    return profile.majority_minority(rows, ["part"])
