"""Text formats of corpora, word vectors and vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_vectors_text(vectors: DataFrame, path: str) -> None:
    """Lines ``word f1 … fdim`` and one header line ``V dim``."""
    header = vectors.agg(
        F.concat_ws(" ", F.count("*").cast("string"), F.max(F.size("vec")).cast("string")).alias("value")
    )
    body = vectors.select(F.concat_ws(" ", "word", F.col("vec").cast("array<string>")).alias("value"))
    header.coalesce(1).union(body).write.mode("overwrite").text(path)


def read_vectors_text(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """``(word, vec)``; lines without exactly ``dim`` numbers, as the header, are left out.

    With one number per word the header looks like a word; it is the first line of
    the first file if that is a count and the dimension.
    """
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path)
    if dim == 1:
        place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
        rows = rows.select("value", *place, F.monotonically_increasing_id().alias("pos"))
        first = rows.filter("block = 0").agg(F.min(F.struct("file", "pos")).alias("at")).first()["at"]
        if first:
            header = (F.col("file") == first["file"]) & (F.col("pos") == first["pos"]) & F.col("value").rlike(r"^\d+\s+1\s*$")
            rows = rows.filter(~header)
    rows = rows.select(parts.alias("parts")).filter(F.size("parts") == dim + 1)
    return rows.select(
        F.get("parts", 0).alias("word"), F.slice("parts", 2, dim).cast("array<float>").alias("vec")
    )


def write_corpus(df: DataFrame, path: str) -> None:
    """Each text followed by a line end."""
    df.select("text").write.mode("overwrite").text(path)


def read_corpus_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, lineSep="\n").withColumnRenamed("value", "line")


def write_vocabulary_json(vocabulary: DataFrame, path: str) -> None:
    """One word per line: a JSON object encoded as a JSON string."""
    inner = F.to_json(F.struct("word", "id", "n"))
    text = F.concat(F.lit('"'), F.regexp_replace(inner, r'(["\\])', r"\\$1"), F.lit('"'))
    vocabulary.select(text.alias("value")).write.mode("overwrite").text(path)


def read_vocabulary_json(spark: SparkSession, path: str) -> DataFrame:
    wrapped = F.concat(F.lit('{"s":'), F.col("value"), F.lit("}"))
    inner = F.from_json(wrapped, "s string")["s"]
    row = F.from_json(inner, "word string, id long, n long")
    return spark.read.text(path).select(row.alias("row")).select("row.*")
