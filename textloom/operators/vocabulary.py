"""Vocabularies, term statistics and token lookup."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rows import unnest
from ..session import import_in_workers, kept
from .bounded import SMALL_ROWS, broadcast_if_small, pin_small
from .ordering import global_rank, top_within

#: Words that are looked up in the row (by rank; of at most so many characters), 25 MB at most.
HEAD_WORDS, LONGEST_HEAD = 100_000, 64
#: Tokens of an Arrow batch that are worked on at once; a longer row is a part of its own.
PART_TOKENS = 1 << 19


def term_statistics(df: DataFrame, tokens: Column) -> DataFrame:
    """Corpus frequency ``cf`` and document frequency ``df`` of each term.

    Counts are taken per document inside the row and summed over many rows, then combined
    map-side; only the vocabulary is shuffled, so a term in every document costs no more.
    """
    import_in_workers(df.sparkSession)
    sums = df.select(tokens.alias("tokens")).mapInArrow(_statistics, "term string, cf long, df long")
    return sums.groupBy("term").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df"))


def top_terms(stats: DataFrame, n: int = 1000) -> DataFrame:
    """The ``n`` most frequent terms (a top-k, not a full sort)."""
    return stats.orderBy(F.desc("cf"), "term").limit(n)


def top_terms_within(stats: DataFrame, key: list[str], n: int = 1000) -> DataFrame:
    return top_within(stats, key, [F.desc("cf"), F.col("term")], F.col("term"), n)


def build_vocabulary(df: DataFrame, tokens: Column) -> DataFrame:
    """``(word, id, n)``: ids from 1 by falling count, then by word; 0 is padding."""
    counts = unnest(df, [], tokens, "word").groupBy("word").agg(F.count("*").alias("n"))
    return global_rank(counts, [F.desc("n"), F.col("word")], "id").select("word", "id", "n")


def extend_vocabulary(vocabulary: DataFrame, extra: list[str]) -> DataFrame:
    """Append words that are missing, with ids after the largest one."""
    spark = vocabulary.sparkSession
    wanted = spark.createDataFrame([(i, w) for i, w in enumerate(extra)], "place int, word string")
    present = vocabulary.filter(F.col("word").isin(extra)).select("word")
    missing = [r["word"] for r in wanted.join(present, "word", "left_anti").orderBy("place").collect()]
    last = vocabulary.agg(F.max("id")).first()[0] or 0
    rows = [(word, last + i + 1, 0) for i, word in enumerate(missing)]
    return vocabulary.unionByName(spark.createDataFrame(rows, "word string, id long, n long"))


def join_words(
    rows: DataFrame, table: DataFrame, frequent, how: str = "inner", max_rows: int = SMALL_ROWS
) -> DataFrame:
    """Join ``(…, word)`` with a table of one row per word, without a hot key.

    A table within the broadcast limit is broadcast whole. Beyond it only the
    rows of ``frequent()`` words are, a fixed number of them; each remaining
    word is rare, so their shuffle join has no hot key.
    """
    hinted = broadcast_if_small(table, max_rows)
    if hinted is not table:
        return rows.join(hinted, "word", how)
    heads = pin_small(frequent().select("word"))
    head = F.broadcast(table.join(heads, "word", "left_semi"))
    common = rows.join(heads, "word", "left_semi").join(head, "word", how)
    rest = rows.join(heads, "word", "left_anti").join(table, "word", how)
    return common.unionByName(rest)


def lookup_tokens(tokens: DataFrame, vocabulary: DataFrame, how: str = "inner") -> DataFrame:
    """Join ``(…, word)`` with vocabulary ids; ids are frequency ranks."""
    table = vocabulary.select("word", F.col("id").alias("token"))
    return join_words(tokens, table, lambda: vocabulary.filter(F.col("id") <= HEAD_WORDS), how)


def parts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in slices of bounded tokens, in order: a batch is bounded in rows only."""
    for batch in batches:
        part = np.cumsum(pc.fill_null(batch.column(column).value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // PART_TOKENS
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)
    pa.default_memory_pool().release_unused()


def counted(lists: pa.Array, among: pa.Array | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Row, place in ``words`` and count of each distinct word of each row, by row, and ``words`` itself; ``among``: the only words counted."""
    flat, sizes = lists.flatten(), pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    if flat.null_count:
        owner, flat = owner[flat.is_valid().to_numpy(zero_copy_only=False)], flat.drop_null()
    coded = flat.dictionary_encode()
    code, words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    if among is not None:
        stays = pc.is_in(words, value_set=among).to_numpy(zero_copy_only=False)[code]
        owner, code = owner[stays], code[stays]
    n = max(1, len(words))
    pairs, count = np.unique(owner * n + code, return_counts=True)
    return pairs // n, pairs % n, count, words


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches ``(tokens)`` to ``(term, cf, df)``, summed over the rows of a part."""
    for batch in parts(batches, 0):
        _, code, count, words = counted(batch.column(0))
        cf, df = np.bincount(code, count, len(words)).astype(np.int64), np.bincount(code, minlength=len(words))
        yield pa.RecordBatch.from_arrays([words.cast(pa.string()), pa.array(cf), pa.array(df.astype(np.int64))], names=["term", "cf", "df"])


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches ``(id, tokens)`` to ``(id, word, tf)``."""
    for batch in parts(batches, 1):
        row, code, count, words = counted(batch.column(1))
        columns = [batch.column(0).take(pa.array(row)), words.take(pa.array(code)).cast(pa.string()), pa.array(count.astype(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "word", "tf"])


def bags(df: DataFrame, tokens: Column) -> DataFrame:
    """``(id, word, tf)``: the distinct words of each row with their counts; null words vanish."""
    import_in_workers(df.sparkSession)
    id_type = df.schema["id"].dataType.simpleString()
    return df.select("id", tokens.alias("tokens")).mapInArrow(_bags, f"id {id_type}, word string, tf long")


def _coder(heads: pa.Table, keep_rare: bool):
    """Arrow batches ``(id, tokens)`` to ``(row, id, ids, rare)``; a word that isn't among the heads is the negative place of it in ``rare``."""
    words, numbers = heads.column("word").combine_chunks(), heads.column("id").to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in parts(batches, 1):
            lists = pc.fill_null(batch.column(1), []) if batch.column(1).null_count else batch.column(1)
            flat = lists.flatten()
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            at = pc.index_in(flat, value_set=words)
            known = at.is_valid().to_numpy(zero_copy_only=False)
            ids = np.zeros(len(flat), np.int64)
            ids[known] = numbers[at.drop_null().to_numpy()]
            stays, rare = known, pa.array([[]] * batch.num_rows, pa.list_(pa.string()))
            if keep_rare:
                other = ~known & flat.is_valid().to_numpy(zero_copy_only=False)
                coded = flat.filter(pa.array(other)).dictionary_encode()
                n = max(1, len(coded.dictionary))
                pairs, back = np.unique(owner[other] * n + coded.indices.to_numpy(zero_copy_only=False), return_inverse=True)
                first = np.searchsorted(pairs // n, np.arange(batch.num_rows + 1))
                ids[other] = first[owner[other]] - back - 1
                rare = pa.ListArray.from_arrays(first.astype(np.int32), coded.dictionary.take(pa.array(pairs % n)).cast(pa.string()))
                stays = known | other
            ends = np.concatenate(([0], np.cumsum(np.bincount(owner[stays], minlength=batch.num_rows)))).astype(np.int32)
            rows = pa.array(np.arange(row, row + batch.num_rows))
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [rows, batch.column(0), pa.ListArray.from_arrays(ends, pa.array(ids[stays], pa.int32())), rare], names=["row", "id", "ids", "rare"]
            )

    return run


def _resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches ``(id, ids, n_rare, places, tokens)`` to ``(id, ids)``: negative codes are looked up among the row's own answers or vanish."""
    for batch in parts(batches, 1):
        id_, ids, n_rare, places, tokens = batch.columns
        flat = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        owner = np.repeat(np.arange(batch.num_rows), ids.value_lengths().to_numpy(zero_copy_only=False))
        base = np.concatenate(([0], np.cumsum(n_rare.to_numpy(zero_copy_only=False))))
        answers = np.zeros(int(base[-1]), np.int64)
        given = pc.fill_null(places.value_lengths(), 0).to_numpy(zero_copy_only=False)
        answers[base[np.repeat(np.arange(batch.num_rows), given)] + places.flatten().to_numpy(zero_copy_only=False)] = tokens.flatten().to_numpy(zero_copy_only=False)
        unknown = flat < 0
        flat[unknown] = answers[base[owner[unknown]] - flat[unknown] - 1]
        stays = flat > 0
        ends = np.concatenate(([0], np.cumsum(np.bincount(owner[stays], minlength=batch.num_rows)))).astype(np.int32)
        yield pa.RecordBatch.from_arrays([id_, pa.ListArray.from_arrays(ends, pa.array(flat[stays], pa.int32()))], names=["id", "ids"])


def encode(df: DataFrame, tokens: Column, vocabulary: DataFrame) -> DataFrame:
    """``(id, ids)``: token ids in text order; unseen and null tokens vanish.

    Frequent words, a fixed number of bounded length, are looked up where the row is.
    A vocabulary without other words needs no shuffle at all. Else each row's other
    words, once each, are joined with the vocabulary, and only the answers and coded rows
    meet again by row; places never leave the row. Documents without a known token,
    or with a null token array, keep an empty array; rows that share an id stay apart.
    """
    spark = df.sparkSession
    import_in_workers(spark)
    short = F.length("word") <= LONGEST_HEAD
    heads = vocabulary.filter((F.col("id") <= HEAD_WORDS) & short).select("word", "id").toArrow()
    rest = vocabulary.filter((F.col("id") > HEAD_WORDS) | ~short).select("word", F.col("id").alias("token"))
    more = not rest.isEmpty()
    id_type = df.schema["id"].dataType.simpleString()
    coded = df.select("id", tokens.alias("tokens")).mapInArrow(_coder(heads, more), f"row long, id {id_type}, ids array<int>, rare array<string>")
    if not more:
        return coded.select("id", "ids")
    coded = kept(coded, "coded")
    asked = coded.select("row", F.posexplode("rare").alias("place", "word"))
    found = asked.join(rest, "word").groupBy("row").agg(F.collect_list(F.struct("place", "token")).alias("found"))
    none = F.array().cast("array<int>")
    rows = coded.join(found, "row", "left").select(
        "id", "ids", F.size("rare").alias("n_rare"),
        F.coalesce(F.col("found.place"), none).alias("places"), F.coalesce(F.col("found.token").cast("array<int>"), none).alias("tokens"),
    )
    return rows.mapInArrow(_resolved, f"id {id_type}, ids array<int>")
