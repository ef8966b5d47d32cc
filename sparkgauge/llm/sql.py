"""DuckDB SQL of those queries that SQL can express."""

from __future__ import annotations

from .url_filter import BASE_RULES, PATTERN_RULES

OP4 = """
WITH sound AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM sound q JOIN sound c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""

OP6 = """
WITH bits AS (
  SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)),
    lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v
  FROM range(256) r(i)),
lookup AS (SELECT list(v ORDER BY i) AS tab FROM bits),
docs AS (SELECT doc_id, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS h FROM documents),
rows_ AS (
  SELECT doc_id, (len(h) // 2 + 1)::BIGINT AS size, ('0x' || substr(md5(t), 1, 15))::BIGINT AS key,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
      lambda c, x: xor(tab[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) AS text_crc32
  FROM docs, lookup),
placed AS (
  SELECT *, sum(size) OVER (ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) - size AS start_, sum(size) OVER () AS total,
    row_number() OVER (ORDER BY key, doc_id) AS n
  FROM rows_),
cut AS (SELECT *, least(start_ * 16 // total, 15)::INTEGER AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, (n - min(n) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM cut
"""


OP10 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words),
sizes AS (SELECT doc_id, len(s) AS n FROM sets),
grams AS (SELECT doc_id, unnest(s) AS g FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(x, y) AS (SELECT a, b FROM both_ways UNION SELECT r.x, e.b FROM reach r JOIN both_ways e ON r.y = e.a)
SELECT s.doc_id, s.n::BIGINT AS n_shingles, least(s.doc_id, coalesce(min(r.y), s.doc_id)) AS component_id
FROM sizes s LEFT JOIN reach r ON r.x = s.doc_id GROUP BY s.doc_id, s.n
"""


OP12 = r"""
WITH bits AS (
  SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)),
    lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v
  FROM range(256) r(i)),
lookup AS (SELECT list(v ORDER BY i) AS tab FROM bits),
texts AS (
  SELECT 0 AS kind, row_number() OVER () AS n, doc_id AS id, text FROM documents
  UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark),
words AS (
  SELECT kind, n, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
runs AS (
  SELECT kind, n, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM words),
counted AS (SELECT kind, n, g, count(*) AS c FROM runs GROUP BY ALL),
named AS (SELECT g, hex(encode(g)) AS h FROM (SELECT DISTINCT g FROM counted)),
bucketed AS (
  SELECT g, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
    lambda c, x: xor(tab[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) % 10000 AS b FROM named, lookup),
features AS (SELECT kind, n, b, sum(c)::BIGINT AS c FROM counted JOIN bucketed USING (g) GROUP BY ALL),
shares AS (SELECT b, coalesce(sum(c) FILTER (kind = 0), 0)::DOUBLE AS s, coalesce(sum(c) FILTER (kind = 1), 0)::DOUBLE AS t FROM features GROUP BY b),
totals AS (SELECT coalesce(sum(s), 0) AS all_s, coalesce(sum(t), 0) AS all_t FROM shares),
gains AS (SELECT b, floor(1000 * ln((t + 1) * (all_s + 10000) / ((s + 1) * (all_t + 10000))))::BIGINT AS gain FROM shares, totals),
weighed AS (SELECT n, sum(c)::BIGINT AS n_features, floor(sum(c * gain)::DOUBLE / sum(c))::BIGINT AS weight FROM features JOIN gains USING (b) WHERE kind = 0 GROUP BY n),
scored AS (
  SELECT id AS doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM words LEFT JOIN weighed USING (n) WHERE kind = 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_words >= 20) OVER () AS eligible
  FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 25 * eligible // 100 THEN place END AS rank FROM placed
"""

OP13 = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
    sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
hashed AS (
  SELECT doc_id, t, u, len(u)::BIGINT AS n, ('0x' || substr(d, 1, 8))::BIGINT AS h1, ('0x' || substr(d, 9, 8))::BIGINT AS h2,
    ('0x' || substr(d, 17, 8))::BIGINT AS h3, ('0x' || substr(d, 25, 8))::BIGINT AS h4 FROM cut),
formed AS (
  SELECT doc_id, t, u, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
      WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM hashed),
parts AS (
  SELECT doc_id, t, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM formed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM parts
"""


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _op9() -> str:
    rules = ",\n  ".join(
        f"({_quoted(r.text)}, {_quoted(r.regex)}, {_quoted(r.verdict)}, {str(r.host_rule).lower()})" for r in BASE_RULES + PATTERN_RULES
    )
    return f"""
WITH rules(rule_text, regex, rule_verdict, host_rule) AS (VALUES
  {rules}),
cut AS (SELECT page_id, coalesce(url, '') AS url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
fits AS (SELECT p.page_id, p.host, p.path, r.*, row_number() OVER (PARTITION BY p.page_id ORDER BY r.host_rule DESC NULLS LAST, length(r.rule_text) DESC, r.rule_text) AS n
  FROM parts p LEFT JOIN rules r ON regexp_matches(CASE WHEN r.host_rule THEN p.host || p.path ELSE p.url END, r.regex))
SELECT page_id, host, path, CASE WHEN host_rule THEN rule_text END AS rule, coalesce(rule_verdict, 'allow') AS verdict FROM fits WHERE n = 1
"""


OP1_NOTE = "the Markov models are fitted, so SQL cannot state op1; tests hold it against a brute-force scan"

ORACLE_SQL = {"op4_maxscore": OP4, "op6_byte_shards": OP6, "op9_url_filter": _op9(), "op10_ngram_join": OP10, "op12_ngram_resampling": OP12, "op13_fill_in_middle": OP13}
