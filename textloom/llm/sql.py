"""DuckDB SQL that the registered queries must agree with."""

from __future__ import annotations

from .clusters import CLUSTERS, DIM, ROUNDS, SCALE
from .license_rules import RULES, spread
from .licenses import SEPARATORS
from .secret_scan import BASE, KINDS, LIVE_OWNERS, LIVE_REPOSITORIES

EXACT_DEDUP = """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
), g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
"""


def _spans(number: int) -> str:
    name, pattern, group, least = KINDS[number]
    p = pattern.replace("'", "''")
    return f"""
SELECT doc_id, source, lang, {number} AS kind, '{name}' AS name, value,
       sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id ORDER BY i) AS stop, length(hit) AS n
FROM (
  SELECT doc_id, source, lang, unnest(hits) AS hit, unnest(vals) AS value, unnest(gaps[:len(hits)]) AS gap,
         unnest(range(len(hits))) AS i
  FROM (SELECT doc_id, source, lang, regexp_extract_all(text, '{p}') AS hits,
               regexp_extract_all(text, '{p}', {group}) AS vals, string_split_regex(text, '{p}') AS gaps
        FROM documents WHERE regexp_matches(text, '{p}'))
)
QUALIFY length(value) >= {least}
"""


SECRET_SCAN = f"""
WITH found AS ({" UNION ALL ".join(f"({_spans(n)})" for n in range(len(KINDS)))}),
spans AS (SELECT *, stop - n AS start, concat_ws(':', name, stop - n, stop) AS s FROM found),
held AS (SELECT value, count(DISTINCT source) AS owners, count(DISTINCT concat_ws('/', source, lang)) AS repos FROM spans GROUP BY 1),
judged AS (
  SELECT spans.*, owners <= {LIVE_OWNERS} AND repos <= {LIVE_REPOSITORIES} AS live FROM spans JOIN held USING (value)
),
per AS (
  SELECT doc_id,
    {", ".join(f"count(*) FILTER (kind = {n}) AS n_{name}" for n, name in enumerate(BASE))},
    coalesce(string_agg(s, ',' ORDER BY start, kind) FILTER (kind < {len(BASE)}), '') AS base,
    coalesce(string_agg(s, ',' ORDER BY start, kind) FILTER (kind < {len(BASE)} OR live), '') AS spans,
    count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example
  FROM judged GROUP BY 1
)
SELECT doc_id, {", ".join(f"coalesce(n_{name}, 0) AS n_{name}" for name in BASE)},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM documents LEFT JOIN per USING (doc_id)
"""

WARC = """
WITH t AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM t WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to
FROM t LEFT JOIN f USING (payload_digest)
"""


def _license_scan() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rules = ",\n".join(
        f"({i}, {quote(r.label)}, {quote(spread(r.pattern))}, [{', '.join(map(quote, r.keywords.split()))}], {r.priority}, {r.relevance}::DOUBLE, {r.base})"
        for i, r in enumerate(RULES)
    )
    levels = sorted({r.priority for r in RULES})
    suppressed = " OR ".join(
        f"(priority = {n} AND coalesce(max(CASE WHEN priority <= {n} THEN stop END) OVER before, -1) >= stop)" for n in levels
    )
    return f"""
WITH rules(rule, label, regex, keywords, priority, relevance, base) AS (VALUES {rules}),
t AS (
  SELECT doc_id, regexp_replace(' ' || translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || ' ',
    '{SEPARATORS}', '  ', 'g') AS words FROM documents
),
opened AS (SELECT doc_id, words, rules.* FROM t JOIN rules ON list_has_any(string_split(words, '  '), keywords)),
parts AS (
  SELECT * EXCLUDE (words, regex, hits, gaps), unnest(hits) AS hit, unnest(gaps[:len(hits)]) AS gap, unnest(range(len(hits))) AS i
  FROM (SELECT *, regexp_extract_all(words, regex) AS hits, string_split_regex(words, regex) AS gaps FROM opened
    WHERE regexp_matches(words, regex))
),
counted AS (SELECT *, length(hit) - length(replace(hit, ' ', '')) AS own, length(gap) - length(replace(gap, ' ', '')) AS free FROM parts),
spans AS (
  SELECT *, (after - own) // 2 AS start, after // 2 AS stop
  FROM (SELECT *, sum(own + free) OVER (PARTITION BY doc_id, rule ORDER BY i)::BIGINT AS after FROM counted)
),
judged AS (
  SELECT *, ({suppressed}) AS inside FROM spans
  WINDOW before AS (PARTITION BY doc_id ORDER BY start, stop DESC, priority, rule ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
per AS (
  SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base OR NOT inside) AS labels,
    max(relevance) FILTER (NOT inside) AS score FROM judged GROUP BY 1
)
SELECT doc_id, (length(words) - length(replace(words, ' ', '')) - 2) // 2 AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score
FROM t LEFT JOIN per USING (doc_id)
"""


LICENSE_SCAN = _license_scan()


def _clusters() -> str:
    rounds = [f"""
x AS (
  SELECT vec_id, list_transform(embedding, lambda c: floor(c::DOUBLE * {SCALE})::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda c: isfinite(c))) = {DIM}
),
c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), x) - 1 AS k, x AS c FROM x
  WHERE vec_id IS NOT NULL ORDER BY k LIMIT {CLUSTERS}
)"""]
    apart = "list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    for n in range(ROUNDS + 1):
        rounds.append(f"""
a{n} AS MATERIALIZED (
  SELECT vec_id, x, first(k ORDER BY d, k) AS k, min(d) AS d FROM (SELECT vec_id, x, k, {apart} AS d FROM x CROSS JOIN c{n}) GROUP BY ALL
)""")
        if n < ROUNDS:
            rounds.append(f"""
m{n} AS (
  SELECT k, list(((s - ((s % m) + m) % m) // m)::BIGINT ORDER BY j) AS c FROM (
    SELECT k, j, sum(v)::HUGEINT AS s, count(*)::HUGEINT AS m FROM (SELECT k, unnest(x) AS v, generate_subscripts(x, 1) AS j FROM a{n}) GROUP BY k, j
  ) GROUP BY k
),
c{n + 1} AS MATERIALIZED (SELECT k, coalesce(m{n}.c, c{n}.c) AS c FROM c{n} LEFT JOIN m{n} USING (k))""")
    return f"""
WITH {",".join(rounds)}
SELECT vec_id, k::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia,
  (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} USING (k)
"""


CLUSTERING = _clusters()
