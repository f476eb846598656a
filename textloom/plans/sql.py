"""Shared pieces of the comparison SQL."""

from __future__ import annotations

from ..schemas import SEEDS

SPACE = r"[\t-\r\x1C-\x1F \x{85}\p{Z}]+"
LINE_END = r"\r\n|[\n-\r\x1C-\x1E\x{85}\x{2028}\x{2029}]"
WORD = r"[\p{L}\p{N}_]{2,}"
CODE_TOKEN = r"[\p{L}\p{N}_]+|[^\t-\r\x1C-\x1F \x{85}\p{Z}\p{L}\p{N}_]"


def words(text: str = "text") -> str:
    return f"list_filter(regexp_split_to_array({text}, '{SPACE}'), lambda x: x <> '')"


def terms(text: str = "text") -> str:
    return f"regexp_extract_all(lower({text}), '{WORD}')"


def code_tokens(text: str = "text") -> str:
    return f"regexp_extract_all(lower({text}), '{CODE_TOKEN}')"


SEED_ROWS = f"seeds AS (SELECT unnest({SEEDS})::INTEGER AS seed)"

DOCS = "docs AS (SELECT doc_id AS id, text, lang, source AS project FROM documents)"

LABELLED = """labelled AS (
  SELECT d.doc_id AS id, d.text, 1 - l.quality AS label, d.source AS project, d.lang
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

QUOTAS = f"""{LABELLED},
classes AS (SELECT label, count(*) AS n FROM labelled GROUP BY label),
total AS (SELECT sum(n)::BIGINT AS total, ceil(0.1::DOUBLE * sum(n)::BIGINT)::BIGINT AS size FROM classes),
q1 AS (SELECT label, n, size, (size * n) // total AS fl, (size * n) % total AS rest FROM classes, total),
q2 AS (SELECT *, row_number() OVER (ORDER BY rest DESC, label) AS rk, size - sum(fl) OVER () AS remain FROM q1),
q3 AS (SELECT label, n, fl + (rk <= remain)::BIGINT AS n_test FROM q2),
v0 AS (SELECT *, n - n_test AS m, (sum(n - n_test) OVER ())::BIGINT AS total FROM q3),
v1 AS (SELECT *, ceil(0.1::DOUBLE * total)::BIGINT AS size FROM v0),
v2 AS (SELECT *, (size * m) // total AS fl, (size * m) % total AS rest FROM v1),
v3 AS (SELECT *, row_number() OVER (ORDER BY rest DESC, label) AS rk, size - sum(fl) OVER () AS remain FROM v2),
quotas AS (SELECT label, n, n_test, fl + (rk <= remain)::BIGINT AS n_val FROM v3)"""

SPLIT = f"""{QUOTAS},
{SEED_ROWS},
ranked AS (SELECT seed, id, label,
  row_number() OVER (PARTITION BY seed, label ORDER BY md5(concat(seed, '|', id)), id) AS rn FROM labelled, seeds),
split AS (SELECT seed, id, label,
  CASE WHEN rn <= n_test THEN 'test' WHEN rn <= n_test + n_val THEN 'val' ELSE 'train' END AS split
  FROM ranked JOIN quotas USING (label))"""


def undersampled(k: int, name: str = "sampled") -> str:
    """CTEs after SPLIT: the split with the surplus train rows removed."""
    return f"""{name}_counts AS (SELECT seed, label, count(*) AS n FROM split WHERE split = 'train' GROUP BY ALL),
{name}_goal AS (SELECT seed, first(label ORDER BY n DESC, label) AS majority, max(n) AS n_majority,
  min(n) * {k} AS target, count(*) AS n_classes FROM {name}_counts GROUP BY seed),
{name}_rank AS (SELECT *, row_number() OVER (PARTITION BY seed, label, split
  ORDER BY md5(concat(seed, 'u|', id)), id) AS rk FROM split),
{name} AS (SELECT seed, id, label, split FROM {name}_rank JOIN {name}_goal USING (seed)
  WHERE NOT (split = 'train' AND n_classes = 2 AND target <= n_majority AND label = majority AND rk > target))"""


def tfidf(split: str = "split", prefix: str = "") -> str:
    """CTEs after a split: ``feat(seed, id, label, split, term, weight)``."""
    p = prefix
    return f"""{p}tf AS (SELECT id, term, count(*) AS tf FROM
  (SELECT id, unnest({terms()}) AS term FROM labelled) GROUP BY ALL),
{p}cf AS (SELECT s.seed, t.term, sum(t.tf) AS cf, count(*) AS df FROM {p}tf t JOIN {split} s USING (id)
  WHERE s.split = 'train' GROUP BY ALL),
{p}top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY cf DESC, term) AS rn FROM {p}cf)
  WHERE rn <= 1000),
{p}size AS (SELECT seed, count(*) AS n_train FROM {split} WHERE split = 'train' GROUP BY seed),
{p}idf AS (SELECT seed, term, cf, df, ln((1 + n_train) / (1 + df)::DOUBLE) + 1 AS idf FROM {p}top JOIN {p}size USING (seed)),
{p}raw AS (SELECT s.seed, s.id, s.label, s.split, t.term, t.tf * i.idf AS w
  FROM {split} s JOIN {p}tf t USING (id) JOIN {p}idf i USING (seed, term)),
{p}feat AS (SELECT seed, id, label, split, term, w / sqrt(sum(w * w) OVER (PARTITION BY seed, id)) AS weight FROM {p}raw)"""


def bayes(split: str = "split", prefix: str = "") -> str:
    """CTEs after ``tfidf``: ``nb(seed, id, split, label, pred)``."""
    p = prefix
    return f"""{p}nc AS (SELECT seed, label, count(*) AS n FROM {split} WHERE split = 'train' GROUP BY ALL),
{p}s AS (SELECT seed, label, term, sum(weight) AS s1, sum(weight * weight) AS s2 FROM {p}feat
  WHERE split = 'train' GROUP BY ALL),
{p}grid AS (SELECT c.seed, c.label, c.n, i.term, coalesce(s.s1, 0) AS s1, coalesce(s.s2, 0) AS s2
  FROM {p}nc c JOIN {p}idf i ON c.seed = i.seed
  LEFT JOIN {p}s s ON s.seed = c.seed AND s.label = c.label AND s.term = i.term),
{p}whole AS (SELECT seed, term, sum(s2) / sum(n) - (sum(s1) / sum(n)) ^ 2 AS var FROM {p}grid GROUP BY ALL),
{p}eps AS (SELECT seed, 1e-9 * max(var) AS eps FROM {p}whole GROUP BY seed),
{p}stat AS (SELECT g.seed, g.label, g.n, g.term, s1 / n AS mu, s2 / n - (s1 / n) * (s1 / n) + eps AS var
  FROM {p}grid g JOIN {p}eps e ON g.seed = e.seed),
{p}base AS (SELECT seed, label, ln(max(n) / sum(max(n)) OVER (PARTITION BY seed))
  - 0.5 * sum(ln(2 * pi() * var) + mu * mu / var) AS base FROM {p}stat GROUP BY seed, label),
{p}gain AS (SELECT f.seed, f.id, t.label AS cls, sum((f.weight * t.mu - f.weight * f.weight / 2) / t.var) AS gain
  FROM {p}feat f JOIN {p}stat t ON f.seed = t.seed AND f.term = t.term WHERE f.split <> 'train' GROUP BY ALL),
{p}score AS (SELECT s.seed, s.id, s.split, s.label, b.label AS cls, b.base + coalesce(g.gain, 0) AS score
  FROM {split} s JOIN {p}base b ON s.seed = b.seed
  LEFT JOIN {p}gain g ON g.seed = s.seed AND g.id = s.id AND g.cls = b.label WHERE s.split <> 'train'),
{p}nb AS (SELECT seed, id, split, label, first(cls ORDER BY score DESC, cls) AS pred FROM {p}score
  GROUP BY seed, id, split, label)"""


def binary(source: str, by: str) -> str:
    """A SELECT of the six metrics from ``source(label, pred)``."""
    return f"""SELECT {by}, accuracy, precision, recall,
  CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1,
  CASE WHEN 4 * precision + recall <> 0 THEN 5 * precision * recall / (4 * precision + recall) END AS f2,
  CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN (tp / (tp + fn)::DOUBLE + tn / (tn + fp)::DOUBLE) / 2 END AS roc_auc
FROM (SELECT *, (tp + tn) / (tn + fp + fn + tp)::DOUBLE AS accuracy,
  CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp)::DOUBLE END AS precision,
  CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn)::DOUBLE END AS recall
  FROM (SELECT {by}, count(*) FILTER (label = 0 AND pred = 0) AS tn, count(*) FILTER (label = 0 AND pred = 1) AS fp,
    count(*) FILTER (label = 1 AND pred = 0) AS fn, count(*) FILTER (label = 1 AND pred = 1) AS tp
    FROM {source} GROUP BY {by}))"""


METRICS = ["accuracy", "precision", "recall", "f1", "f2", "roc_auc"]


def rounded(names: list[str], digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)
