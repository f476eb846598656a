"""TF-IDF, word vectors and sequences."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import cbow
from ..operators import embeddings as em
from ..operators import sequences as sq
from ..operators import split
from ..operators import tfidf as tf
from ..operators import vocabulary as vo
from ..schemas import SEEDS
from ..session import kept
from . import sql, study
from .registry import query
from .tables import documents, labelled, table
from .texts import joined

SEED = SEEDS[0]


@query(
    "T1 A8 K2 W2",
    f"WITH {sql.SPLIT}, {sql.tfidf()} SELECT seed, term, cf::BIGINT AS cf, df, round(idf, 6) AS idf FROM idf",
)
def tfidf_terms(spark, sf):
    docs = kept(study.tokenized(spark, sf), "tokenized")
    terms = tf.fit_tfidf(docs, SEEDS).terms
    return terms.select("seed", "term", "cf", "df", F.round("idf", 6).alias("idf"))


@query(
    "T1 F7 F8",
    f"WITH {sql.SPLIT}, {sql.tfidf()} SELECT seed, id, split, term, round(weight, 6) AS weight FROM feat",
)
def tfidf_weights(spark, sf):
    rows, model = study.weighed(spark, sf)
    return tf.tfidf_long(rows, model).select("seed", "id", "split", "term", F.round("weight", 6).alias("weight"))


@query(
    "T1 X4",
    f"""WITH {sql.SPLIT}, {sql.undersampled(1)}, {sql.tfidf('sampled')}
    SELECT seed, split, count(*) AS n_weights, count(DISTINCT id) AS n_rows, round(sum(weight), 4) AS total
    FROM feat GROUP BY seed, split""",
)
def tfidf_undersampled(spark, sf):
    rows, _ = study.weighed(spark, sf, treatments=[1])
    long = rows.select("seed", "id", "split", F.inline("features"))
    return long.groupBy("seed", "split").agg(
        F.count("*").alias("n_weights"),
        F.count_distinct("id").alias("n_rows"),
        F.round(F.sum("weight"), 4).alias("total"),
    )


_VECTORS = f"""vectors AS (SELECT term AS word, [length(term), cf % 97, df % 89] AS vec FROM
  (SELECT term, sum(tf)::BIGINT AS cf, count(*) AS df FROM (SELECT id, term, count(*) AS tf FROM
    (SELECT id, unnest({sql.code_tokens()}) AS term FROM docs) GROUP BY ALL) GROUP BY term) WHERE cf >= 10)"""

_VOCABULARY = f"""vocabulary AS (SELECT word, row_number() OVER (ORDER BY n DESC, word) AS id, n FROM
  (SELECT word, count(*) AS n FROM (SELECT unnest({sql.words('lower(text)')}) AS word FROM docs) GROUP BY word))"""


def spelled(vec="vec", digits=4):
    return [F.round(F.round(F.get(vec, i).cast("double"), 9), digits).alias(f"v{i}") for i in range(3)]


@query(
    "J1 T5 F12",
    f"""WITH {sql.DOCS}, {_VECTORS}, {_VOCABULARY}
    SELECT id, coalesce(vec[1], 0)::DOUBLE AS v0, coalesce(vec[2], 0)::DOUBLE AS v1, coalesce(vec[3], 0)::DOUBLE AS v2
    FROM vocabulary LEFT JOIN vectors USING (word) UNION ALL SELECT 0, 0, 0, 0""",
)
def embedding_matrix(spark, sf):
    words = vo.build_vocabulary(documents(spark, sf), tx.lower_words(F.col("text")))
    matrix = em.embedding_matrix(words, study.word_vectors(spark, sf), 3)
    return matrix.select("id", *spelled())


@query(
    "T6",
    f"""WITH {sql.DOCS}, {_VECTORS}, {_VOCABULARY} SELECT n_words, n_words_hit, n_tokens, n_tokens_hit,
    round(n_words_hit / n_words::DOUBLE, 6) AS word_share, round(n_tokens_hit / n_tokens::DOUBLE, 6) AS token_share
    FROM (SELECT count(*) AS n_words, count(vec) AS n_words_hit, sum(n)::BIGINT AS n_tokens,
      (sum(n) FILTER (vec IS NOT NULL))::BIGINT AS n_tokens_hit FROM vocabulary LEFT JOIN vectors USING (word))""",
)
def embedding_coverage(spark, sf):
    words = vo.build_vocabulary(documents(spark, sf), tx.lower_words(F.col("text")))
    rows = em.coverage(words, study.word_vectors(spark, sf))
    return rows.withColumns({c: F.round(c, 6) for c in ("word_share", "token_share")})


@query(
    "T7",
    f"""WITH {sql.DOCS}, {_VECTORS}, tok AS (SELECT id, unnest({sql.words('lower(text)')}) AS word FROM docs)
    SELECT d.id, count(vec) AS n_known, coalesce(round(round(avg(vec[1]), 9), 4), 0) AS v0, coalesce(round(round(avg(vec[2]), 9), 4), 0) AS v1,
    coalesce(round(round(avg(vec[3]), 9), 4), 0) AS v2
    FROM docs d LEFT JOIN (SELECT * FROM tok JOIN vectors USING (word)) k USING (id) GROUP BY d.id""",
)
def document_vectors(spark, sf):
    rows = em.document_vectors(documents(spark, sf), tx.lower_words(F.col("text")), kept(study.word_vectors(spark, sf), "vectors"))
    return rows.select("id", "n_known", *spelled())


_GRAMS = """SELECT DISTINCT word, substr(m, i, n) AS gram FROM (SELECT word, m, n, unnest(range(1, length(m) - n + 2)) AS i
  FROM (SELECT word, m, unnest(range(3, least(6, length(m)) + 1)) AS n
    FROM (SELECT word, concat('<', word, '>') AS m FROM {source})))"""


@query(
    "T3",
    f"""WITH {sql.DOCS}, {_VECTORS}, wanted AS (SELECT DISTINCT unnest({sql.words('lower(text)')}) AS word FROM benchmark),
    known AS (SELECT gram, avg(vec[1]) AS a, avg(vec[2]) AS b, avg(vec[3]) AS c FROM ({_GRAMS.format(source='vectors')})
      JOIN vectors USING (word) GROUP BY gram),
    parts AS (SELECT word, a, b, c FROM ({_GRAMS.format(source='wanted')}) JOIN known USING (gram)
      UNION ALL SELECT word, vec[1], vec[2], vec[3] FROM wanted JOIN vectors USING (word))
    SELECT word, coalesce(round(round(avg(a), 9), 4), 0) AS v0, coalesce(round(round(avg(b), 9), 4), 0) AS v1,
    coalesce(round(round(avg(c), 9), 4), 0) AS v2 FROM wanted LEFT JOIN parts USING (word) GROUP BY word""",
)
def subword_vectors(spark, sf):
    """Vectors for the words of another table, most of them without one of their own."""
    wanted = table(spark, sf, "benchmark").select(F.explode(tx.lower_words(F.col("text"))).alias("word")).distinct()
    rows = em.subword_vectors(wanted, kept(study.word_vectors(spark, sf), "vectors"))
    return rows.select("word", *spelled())


@query("T2 F3 F6")
def word2vec(spark, sf):
    """Vectors of the words that the train rows of one seed hold ten times."""
    docs = split.stratified_split(labelled(spark, sf), [SEED]).filter(F.col("split") == "train")
    return em.train_word2vec(em.sentences(docs))


@query("T3 F3 F6")
def subword_training(spark, sf):
    """Vectors for the words of another table from trained n-gram buckets; words training didn't meet have some too."""
    docs = split.stratified_split(labelled(spark, sf), [SEED]).filter(F.col("split") == "train")
    wanted = table(spark, sf, "benchmark").select(F.explode(tx.lower_words(F.col("text"))).alias("word"))
    return cbow.word_vectors(em.train_subwords(em.sentences(docs)), wanted)


# One step of training on fixed vectors, windows of two words and fixed negatives, in four batches.
_BUCKETS, _STEP_RATE, _NEAR = 1000, 0.05, (-2, -1, 1, 2)
_START = {
    "in": lambda j: f"((((key * 31 + {j * 17}) % 101 + 101) % 101) - 50) / 50.0::DOUBLE",
    "out": lambda j: f"((((key * 13 + {j * 29}) % 97 + 97) % 97) - 48) / 48.0::DOUBLE",
}


def _step_sql(units: str) -> str:
    """``units``: SQL for ``(wid, key)``, the input units of each word."""
    per = lambda form, sep=", ": sep.join(form.format(j=j) for j in range(3))
    start = lambda side: ", ".join(f"{_START[side](j)} AS {side[0]}{j}" for j in range(3))
    return f"""WITH {sql.DOCS}, {sql.LABELLED},
    lw AS (SELECT id, {sql.words('lower(text)')} AS w FROM labelled),
    vocabulary AS (SELECT word, row_number() OVER (ORDER BY n DESC, word) AS wid FROM
      (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM lw) GROUP BY word)),
    tok AS MATERIALIZED (SELECT id, pos, wid FROM (SELECT id, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS word FROM lw) JOIN vocabulary USING (word)),
    units AS MATERIALIZED ({units}),
    inputs AS MATERIALIZED (SELECT key, {start('in')} FROM (SELECT DISTINCT key FROM units)),
    outputs AS MATERIALIZED (SELECT key, {start('out')} FROM (SELECT wid AS key FROM vocabulary)),
    ctx AS MATERIALIZED (SELECT t.id, t.pos, u.key FROM (SELECT *, unnest([-2, -1, 1, 2]) AS d FROM tok) t
      JOIN tok c ON c.id = t.id AND c.pos = t.pos + t.d JOIN units u ON u.wid = c.wid),
    hid AS MATERIALIZED (SELECT id, pos, {per('avg(i{j}) AS h{j}')} FROM ctx JOIN inputs USING (key) GROUP BY ALL),
    asked AS (SELECT id, pos, wid, wid AS key, 1 AS label FROM tok UNION ALL
      SELECT id, pos, wid, (id * 7 + pos * 13 + k * 5) % (SELECT count(*) FROM vocabulary) + 1, 0
      FROM (SELECT *, unnest([0, 1]) AS k FROM tok)),
    g AS MATERIALIZED (SELECT id, pos, key, {per('h{j}')}, {per('o{j}')}, {_STEP_RATE} * (label - 1 / (1 + exp(-({per('h{j} * o{j}', ' + ')})))) AS g
      FROM asked JOIN hid USING (id, pos) JOIN outputs USING (key) WHERE label = 1 OR key <> wid),
    back AS MATERIALIZED (SELECT id, pos, {per('sum(g * o{j}) AS b{j}')} FROM g GROUP BY ALL),
    moves AS (SELECT 1 AS kind, id % 4 AS batch, key, count(*) AS m, {per('sum(g * h{j}) AS d{j}')} FROM g GROUP BY ALL UNION ALL
      SELECT 0, id % 4, key, count(*), {per('sum(b{j})')} FROM ctx JOIN back USING (id, pos) GROUP BY 1, 2, 3),
    means AS (SELECT kind, key, {per('sum(m * d{j}) / sum(m) AS d{j}')} FROM moves GROUP BY ALL),
    before AS (SELECT 0 AS kind, key, {per('i{j} AS v{j}')} FROM inputs UNION ALL SELECT 1, key, {per('o{j}')} FROM outputs)
    SELECT kind, key, {per('round(v{j} + coalesce(d{j}, 0), 6) AS v{j}')} FROM before LEFT JOIN means USING (kind, key)"""


_OWN_UNIT = "SELECT wid, wid AS key FROM vocabulary"
_GRAM_UNITS = f"""{_OWN_UNIT} UNION ALL
      SELECT DISTINCT wid, -1 - ('0x' || substr(md5(gram), 1, 8))::BIGINT % {_BUCKETS}
      FROM ({_GRAMS.format(source='vocabulary')}) JOIN vocabulary USING (word)"""


def _step(spark, sf, units):
    docs = labelled(spark, sf)
    words = tx.lower_words(F.col("text"))
    vocabulary = kept(vo.build_vocabulary(docs, words), "vocabulary")
    size = vocabulary.count()
    # A vocabulary of few file splits: cutting its words into n-grams is work for all cores.
    spelled_ = vocabulary.repartition(spark.sparkContext.defaultParallelism, "id")
    lexicon = kept(spelled_.select("id", units(F.col("word"), F.col("id")).alias("units")), "lexicon")
    start = lambda a, b, m, h: F.array(*[((F.pmod(F.col("key") * a + j * b, F.lit(m)) - h) / float(h)) for j in range(3)]).alias("vec")
    inputs = lexicon.select(F.explode("units").alias("key")).distinct().select(F.lit(cbow.INPUT).alias("kind"), "key", start(31, 17, 101, 50))
    outputs = lexicon.select(F.lit(cbow.OUTPUT).alias("kind"), F.col("id").alias("key"), start(13, 29, 97, 48))
    coded = vo.encode(docs, words, vocabulary).filter(F.size("ids") > 1)  # a text of one word has no context
    pieces = kept(cbow.text_pieces(coded, max(_NEAR)), "pieces")
    pieces = pieces.select((F.col("id") % 4).alias("batch"), F.col("id").alias("key"), "n", "items")

    def expand(*pieces):
        # fmod: the sign of the remainder is that of SQL.
        return cbow.pieces_examples(*pieces, _NEAR, lambda text, place: [np.fmod(text * 7 + place * 13 + k * 5, size) + 1 for k in (0, 1)])

    after = cbow.cbow_step(inputs.unionByName(outputs), lexicon, pieces, _STEP_RATE, expand, len(_NEAR))
    return after.select("kind", "key", *[F.round(F.get("vec", j), 6).alias(f"v{j}") for j in range(3)])


@query("T2", _step_sql(_OWN_UNIT))
def cbow_step(spark, sf):
    """One step of training on every word of the labelled texts, from given vectors and on given negatives."""
    return _step(spark, sf, cbow.word_unit)


@query("T3", _step_sql(_GRAM_UNITS))
def subword_step(spark, sf):
    """The same with n-gram buckets beside the words."""
    return _step(spark, sf, cbow.subword_units(em.grams, _BUCKETS))


_IDS = f"""{sql.SPLIT}, one AS (SELECT id, split FROM split WHERE seed = {SEED}),
lw AS (SELECT id, {sql.words('lower(text)')} AS w FROM labelled),
vocabulary AS (SELECT word, row_number() OVER (ORDER BY n DESC, word) AS wid FROM
  (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM lw) GROUP BY word)),
enc AS (SELECT id, list(wid ORDER BY pos) AS ids FROM (SELECT id, generate_subscripts(w, 1) AS pos, unnest(w) AS word FROM lw)
  JOIN vocabulary USING (word) GROUP BY id),
rows AS (SELECT o.id, o.split, coalesce(e.ids, []) AS ids FROM one o LEFT JOIN enc e USING (id))"""


def _encoded(spark, sf):
    """Ids of the labelled documents with the split of one seed; vocabulary of all splits."""
    docs = labelled(spark, sf)
    words = tx.lower_words(F.col("text"))
    vocabulary = vo.build_vocabulary(docs, words)
    ids = vo.encode(docs, words, vocabulary)
    placed = split.stratified_split(docs.select("id", "label"), [SEED]).select("id", "split")
    # Read twice: for the longest train row and for the sequences themselves.
    return kept(ids.join(placed, "id"), "ids"), vocabulary


def _sequence_rows(rows):
    return rows.select("id", "split", F.size("seq").alias("width"), joined(F.col("seq")).alias("digest"))


@query(
    "T4a F9 F10",
    f"""WITH {_IDS}, m AS (SELECT max(len(ids)) AS longest FROM rows WHERE split = 'train')
    SELECT id, split, least(longest, 512)::INTEGER AS width, md5(array_to_string(list_resize(
      ids[greatest(len(ids) - longest, 0) + 1:greatest(len(ids) - longest, 0) + least(longest, 512)],
      least(longest, 512), 0), '|')) AS digest FROM rows, m""",
)
def static_sequences(spark, sf):
    rows, _ = _encoded(spark, sf)
    longest = sq.longest_train(rows, F.size("ids"))
    return _sequence_rows(sq.static_sequences(rows, longest))


@query(
    "T4b F9 F10",
    f"""WITH {_IDS}, m AS (SELECT least(max(len(ids)), 510) AS width FROM rows WHERE split = 'train')
    SELECT id, split, width::INTEGER AS width, md5(array_to_string(list_resize(ids[1:width], width, 0), '|')) AS digest
    FROM rows, m""",
)
def encoder_sequences(spark, sf):
    rows, _ = _encoded(spark, sf)
    return _sequence_rows(sq.encoder_sequences(rows))


@query(
    "T4c F9 F10",
    f"""WITH {_IDS}, cut AS (SELECT id, split, ids[1:1024] AS c FROM rows)
    SELECT id, split, 512::INTEGER AS width,
    md5(array_to_string(list_resize(c[greatest(len(c) - 512, 0) + 1:], 512, 0), '|')) AS digest FROM cut""",
)
def decoder_sequences(spark, sf):
    rows, _ = _encoded(spark, sf)
    return _sequence_rows(sq.decoder_sequences(rows))


@query(
    "T4d F9 F10 F11 A6",
    f"""WITH {_IDS}, v AS (SELECT max(wid) AS n FROM vocabulary),
    m AS (SELECT least(max(len(ids)) + 2, 512) AS width FROM rows WHERE split = 'train'),
    f AS (SELECT id, split, width, list_concat(list_concat([n + 1], ids[1:width - 2]), [n + 2]) AS k FROM rows, m, v)
    SELECT id, split, width::INTEGER AS width, md5(array_to_string(list_resize(k, width, 0), '|')) AS digest,
    len(k)::INTEGER AS mask_sum FROM f""",
)
def batch_sequences(spark, sf):
    rows, vocabulary = _encoded(spark, sf)
    last = vocabulary.agg(F.max("id")).first()[0]
    rows = sq.batch_sequences(rows, last + 1, last + 2)
    total = F.aggregate("mask", F.lit(0), lambda acc, x: acc + x)
    return rows.select(
        "id", "split", F.size("seq").alias("width"), joined(F.col("seq")).alias("digest"), total.alias("mask_sum")
    )
