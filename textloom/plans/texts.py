"""Tokens, vocabularies and their statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as ar
from ..functions import text as tx
from ..operators import vocabulary as vo
from ..operators.clean import union_all
from . import sql
from .registry import query
from .tables import documents, labelled, spread, table


def joined(column, sep="|"):
    return F.md5(F.concat_ws(sep, column.cast("array<string>")))


@query("F1", f"WITH {sql.DOCS} SELECT id, len(w)::INTEGER AS n, md5(array_to_string(w, '|')) AS digest "
             f"FROM (SELECT id, {sql.words()} AS w FROM docs)")
def split_words(spark, sf):
    w = tx.words(F.col("text"))
    return documents(spark, sf).select("id", w.alias("w")).select("id", F.size("w").alias("n"), joined(F.col("w")).alias("digest"))


_SQL_LINES = f"regexp_split_to_array(html, '{sql.LINE_END}')"


@query(
    "F2 F4",
    f"""SELECT page_id, len(l)::INTEGER AS n, len(list_filter(l, lambda x: x <> ''))::INTEGER AS n_nonblank,
    md5(array_to_string(list_filter(l, lambda x: x <> ''), '|')) AS digest
    FROM (SELECT page_id, CASE WHEN a[-1] = '' THEN a[:-2] ELSE a END AS l
          FROM (SELECT page_id, {_SQL_LINES} AS a FROM pages))""",
)
def split_lines(spark, sf):
    rows = spread(table(spark, sf, "pages"), "page_id").select("page_id", tx.lines(F.col("html")).alias("l"))
    rows = rows.withColumn("kept", tx.drop_blank(F.col("l")))
    return rows.select(
        "page_id", F.size("l").alias("n"), F.size("kept").alias("n_nonblank"), joined(F.col("kept")).alias("digest")
    )


@query(
    "F3 F4",
    r"""SELECT page_id, len(s)::INTEGER AS n, md5(array_to_string(s, '|')) AS digest FROM (SELECT page_id,
    list_filter(string_split(concat(replace(html, ';', E';}\n'), E'\n'), E'}\n'), lambda x: x <> '') AS s FROM pages)""",
)
def split_brace_sentences(spark, sf):
    """Pages carry no code, so every semicolon is made to end a block."""
    html = F.replace(F.col("html"), F.lit(";"), F.lit(";}\n"))
    rows = spread(table(spark, sf, "pages"), "page_id").select("page_id", tx.brace_sentences(html).alias("s"))
    return rows.select("page_id", F.size("s").alias("n"), joined(F.col("s")).alias("digest"))


@query(
    "F5 F6",
    f"""WITH {sql.DOCS} SELECT id, len(t)::INTEGER AS n, md5(array_to_string(t, '|')) AS digest
    FROM (SELECT id, {sql.code_tokens()} AS t FROM docs)""",
)
def split_code_tokens(spark, sf):
    rows = documents(spark, sf).select("id", tx.code_tokens(F.col("text")).alias("t"))
    return rows.select("id", F.size("t").alias("n"), joined(F.col("t")).alias("digest"))


@query(
    "F5 F7",
    f"""WITH {sql.DOCS} SELECT id, len(t)::INTEGER AS n, md5(array_to_string(t, '|')) AS digest
    FROM (SELECT id, {sql.terms()} AS t FROM docs)""",
)
def split_terms(spark, sf):
    rows = documents(spark, sf).select("id", tx.terms(F.col("text")).alias("t"))
    return rows.select("id", F.size("t").alias("n"), joined(F.col("t")).alias("digest"))


_TERM_STATS = f"""SELECT term, sum(tf)::BIGINT AS cf, count(*) AS df FROM (SELECT id, term, count(*) AS tf FROM
  (SELECT id, unnest({sql.terms()}) AS term FROM docs) GROUP BY ALL) GROUP BY term"""


@query("A8", f"WITH {sql.DOCS} {_TERM_STATS}")
def term_frequencies(spark, sf):
    return vo.term_statistics(documents(spark, sf), tx.terms(F.col("text")))


@query("K2 W2", f"WITH {sql.DOCS} SELECT term, cf FROM ({_TERM_STATS}) ORDER BY cf DESC, term LIMIT 1000")
def top_terms(spark, sf):
    stats = vo.term_statistics(documents(spark, sf), tx.terms(F.col("text")))
    return vo.top_terms(stats, 1000).select("term", "cf")


_VOCABULARY = f"""vocabulary AS (SELECT word, row_number() OVER (ORDER BY n DESC, word) AS id, n FROM
  (SELECT word, count(*) AS n FROM (SELECT unnest({sql.words('lower(text)')}) AS word FROM docs) GROUP BY word))"""


@query("A9 W2 F5", f"WITH {sql.DOCS}, {_VOCABULARY} SELECT word, id, n FROM vocabulary")
def vocabulary(spark, sf):
    return vo.build_vocabulary(documents(spark, sf), tx.lower_words(F.col("text")))


@query(
    "U2 A9 J2",
    f"""WITH {sql.DOCS}, {_VOCABULARY},
    tok AS (SELECT 'documents' AS part, doc_id AS id, unnest({sql.words('lower(text)')}) AS word FROM documents
      UNION ALL SELECT 'benchmark', item_id, unnest({sql.words('lower(text)')}) FROM benchmark
      UNION ALL SELECT 'conversations', conv_id, unnest({sql.words('lower(text)')}) FROM conversations)
    SELECT part, count(*) AS n_tokens, count(v.id) AS n_known, sum(v.id)::BIGINT AS id_sum
    FROM tok LEFT JOIN vocabulary v USING (word) GROUP BY part""",
)
def union_tokens_lookup(spark, sf):
    docs = documents(spark, sf)
    words = vo.build_vocabulary(docs, tx.lower_words(F.col("text")))
    parts = {
        "documents": docs.select("text"),
        "benchmark": table(spark, sf, "benchmark").select("text"),
        "conversations": table(spark, sf, "conversations").select("text"),
    }
    tokens = union_all([frame.withColumn("part", F.lit(name)) for name, frame in parts.items()])
    rows = tokens.select("part", F.explode(tx.lower_words(F.col("text"))).alias("word"))
    found = vo.lookup_tokens(rows, words, "left")
    return found.groupBy("part").agg(
        F.count("*").alias("n_tokens"), F.count("token").alias("n_known"), F.sum("token").alias("id_sum")
    )


@query(
    "J2",
    f"""WITH {sql.DOCS}, {sql.LABELLED}, known AS (SELECT word, id FROM (SELECT word, row_number() OVER (ORDER BY n DESC, word) AS id, n
      FROM (SELECT word, count(*) AS n FROM (SELECT unnest({sql.words('lower(text)')}) AS word FROM labelled)
      GROUP BY word))),
    tok AS (SELECT id, generate_subscripts(w, 1) AS pos, unnest(w) AS word
      FROM (SELECT id, {sql.words('lower(text)')} AS w FROM docs)),
    enc AS (SELECT t.id, string_agg(k.id::VARCHAR, '|' ORDER BY pos) AS ids, count(*) AS n
      FROM tok t JOIN known k ON t.word = k.word GROUP BY t.id)
    SELECT d.id, coalesce(n, 0)::INTEGER AS n, md5(coalesce(ids, '')) AS digest FROM docs d LEFT JOIN enc e ON d.id = e.id""",
)
def token_ids(spark, sf):
    """All documents encoded with the vocabulary of the labelled ones, so some tokens are unseen."""
    words = tx.lower_words(F.col("text"))
    known = vo.build_vocabulary(labelled(spark, sf), words)
    rows = vo.encode(documents(spark, sf), words, known)
    return rows.select("id", F.size("ids").alias("n"), joined(F.col("ids")).alias("digest"))


@query(
    "J5",
    f"""WITH {sql.DOCS}, {_VOCABULARY},
    extra AS (SELECT * FROM (VALUES (0, 'the'), (1, 'strId$'), (2, 'numId$')) AS t(place, word)),
    added AS (SELECT word, (SELECT max(id) FROM vocabulary) + row_number() OVER (ORDER BY place) AS id, 0 AS n
      FROM extra WHERE word NOT IN (SELECT word FROM vocabulary))
    SELECT word, id, n FROM vocabulary UNION ALL SELECT word, id, n::BIGINT FROM added""",
)
def extended_vocabulary(spark, sf):
    words = vo.build_vocabulary(documents(spark, sf), tx.lower_words(F.col("text")))
    return vo.extend_vocabulary(words, ["the", "strId$", "numId$"])


@query(
    "F8 F17",
    """SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 6) AS norm2,
    round(list_sum(list_transform(u, lambda x: x * x)), 6) AS unit, round(u[1], 6) AS first
    FROM (SELECT vec_id, embedding, list_transform(embedding, lambda x: x::DOUBLE /
      sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS u FROM embeddings)""",
)
def unit_vectors(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.withColumn("u", ar.l2_normalize(F.col("v")))
    norm, unit = ar.l2_norm(F.col("v")), ar.l2_norm(F.col("u"))
    return rows.select(
        "vec_id",
        F.round(norm * norm, 6).alias("norm2"),
        F.round(unit * unit, 6).alias("unit"),
        F.round(F.get("u", 0), 6).alias("first"),
    )


@query(
    "F9 F10 F11",
    f"""WITH {sql.DOCS}, ids AS (SELECT id, list_transform({sql.words()}, lambda x: length(x)) AS a FROM docs),
    cut AS (SELECT id, a[1:512] AS head, a[-512:] AS tail FROM ids)
    SELECT id, md5(array_to_string(list_resize(head, 512, 0), '|')) AS head,
      md5(array_to_string(list_resize(tail, 512, 0), '|')) AS tail,
      list_sum(list_resize(list_transform(head, lambda x: 1), 512, 0))::INTEGER AS mask_sum FROM cut""",
)
def pad_truncate_mask(spark, sf):
    """Word lengths stand for ids."""
    ids = F.transform(tx.words(F.col("text")), lambda w: F.length(w))
    rows = documents(spark, sf).select("id", ids.alias("a"))
    head, tail = ar.keep_first(F.col("a"), 512), ar.keep_last(F.col("a"), 512)
    mask = ar.attention_mask(head, 512)
    return rows.select(
        "id",
        joined(ar.pad_end(head, 512)).alias("head"),
        joined(ar.pad_end(tail, 512)).alias("tail"),
        F.aggregate(mask, F.lit(0), lambda acc, x: acc + x).alias("mask_sum"),
    )


@query(
    "F13 F14 F17",
    """SELECT page_id, string_split(url, '/')[-1] AS model, printf('%.2f%%', (length(html) / 20000.0::DOUBLE) * 100) AS share,
    floor(length(html) * 0.1::DOUBLE)::BIGINT AS tenth, round(ln(length(html)), 6) AS log_len,
    least(greatest(length(html) / 10000.0::DOUBLE, 0.2::DOUBLE), 0.8::DOUBLE) AS clipped FROM pages""",
)
def scalar_functions(spark, sf):
    n = F.length("html")
    return table(spark, sf, "pages").select(
        "page_id",
        ar.last_path_part(F.col("url")).alias("model"),
        ar.percent(n / F.lit(20000.0)).alias("share"),
        F.floor(n * F.lit(0.1)).alias("tenth"),
        F.round(F.log(n), 6).alias("log_len"),
        F.least(F.greatest(n / F.lit(10000.0), F.lit(0.2)), F.lit(0.8)).alias("clipped"),
    )
