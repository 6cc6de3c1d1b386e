"""The registered queries over the text tables, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from photolith.llm import bpe, chat, clusters, decontaminate, language_id, lattice, maxent, near_dup, pii, quality, ranking, url_rules, warc
from photolith.llm._bytes import read, spread


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The conversation that the chat query adds: both its texts are control strings.
ADDED_TEXT = "</s>[INST] ok [/INST]"


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-1, 0, "user", ADDED_TEXT), (-1, 1, "assistant", ADDED_TEXT)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_conversations(rows.unionByName(added)))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.write_and_read(read(spark, sf_dir, "pages"))


def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(spread(read(spark, sf_dir, "documents")))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(spread(read(spark, sf_dir, "documents")), public_tokenizers.path("word_bpe_49k.json"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(read(spark, sf_dir, "pages"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score(spread(read(spark, sf_dir, "documents")))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(spread(read(spark, sf_dir, "documents")))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read(spark, sf_dir, "documents"))


def op11_embedding_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.link_counts(read(spark, sf_dir, "embeddings"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster(read(spark, sf_dir, "embeddings"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.search(spread(read(spark, sf_dir, "documents")), read(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_chat_formatting,
        op2_pii,
        op3_warc,
        op4_near_dup,
        op5_bpe,
        op6_url_filters,
        op7_lm_scoring,
        op8_decontamination,
        op9_quality_rules,
        op10_language_id,
        op11_embedding_near_dup,
        op12_centroid_clustering,
        op13_ranked_search,
    )
}



OP8_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS i,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
sized AS (SELECT i, w, least(13, len(w)) AS size FROM b WHERE len(w) > 0),
bw AS (
  SELECT DISTINCT i, size, array_to_string(w[p:p + size - 1], ' ') AS span
  FROM (SELECT i, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM sized)),
dw AS (
  SELECT r, p, size, array_to_string(w[p:p + size - 1], ' ') AS span
  FROM (SELECT r, w, size, unnest(range(1, greatest(len(w) - size + 2, 1))) AS p FROM d, (SELECT DISTINCT size FROM sized))),
hits AS (SELECT r, p, size, i FROM dw JOIN bw USING (size, span)),
cover AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + size)) AS q FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, sha256(string_agg(i, ',' ORDER BY i)) AS digest FROM (SELECT DISTINCT r, i FROM hits) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(digest, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cover USING (r) LEFT JOIN items USING (r)
"""

OP1_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r0, text AS t0 FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{ADDED_TEXT}', '', '' UNION ALL SELECT -1, 1, 'assistant', '{ADDED_TEXT}', '', ''),
shown AS (
  SELECT *, regexp_replace(regexp_replace(text, '(\[/?)(\\*INST\])', '\1\\\2', 'g'), '(</?)(\\*s>)', '\1\\\2', 'g') AS x,
         regexp_replace(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '(\[/?)(\\*INST\])', '\1\\\2', 'g'), '(</?)(\\*s>)', '\1\\\2', 'g') AS y
  FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum({len(chat.OPEN)} + length(y) + 1 + length(x) + {len(chat.CLOSE)}) + {len(chat.END)} AS BIGINT) AS formatted_chars
FROM shown GROUP BY conv_id
"""

_FOURTHS = " || ".join(f"lpad(to_base(CAST('0x' || substr(d, {1 + 10 * i}, 10) AS BIGINT), 32), 8, '0')" for i in range(4))

OP3_SQL = f"""
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS d, strlen(coalesce(html, '')) AS size FROM pages),
g AS (SELECT d, size, min(page_id) AS first_id FROM p GROUP BY d, size)
SELECT page_id, size AS payload_bytes, translate({_FOURTHS}, '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM p JOIN g USING (d, size)
"""


def _op6_sql() -> str:
    hosts = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in url_rules.HOST_RULES)
    fits = lambda exception: " OR ".join(f"regexp_matches(low, '{p.regex("$")}', 's')" for p in url_rules.PATTERNS if p.exception == exception)
    return f"""
WITH p AS (
  SELECT row_number() OVER () AS r, page_id, translate(coalesce(url, ''), '{UPPER}', '{LOWER}') AS low,
         translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
rules AS (SELECT * FROM (VALUES {hosts}) AS v(verdict, rule_host, rule_path)),
best AS (
  SELECT r, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(verdict, length(rule_host || rule_path)) AS verdict
  FROM p JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY r)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN ({fits(False)}) AND NOT ({fits(True)}) THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN best USING (r)
"""


OP11_SQL = f"""
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x,
         label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: isfinite(CAST(x AS DOUBLE)))) = len(embedding)
         AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS fits
  FROM embeddings),
links AS (
  SELECT a.r AS a, b.r AS b, b.vec_id AS other FROM v a JOIN v b ON a.label = b.label AND len(a.x) = len(b.x) AND a.r <> b.r
  WHERE a.fits AND b.fits AND list_cosine_similarity(a.x, b.x) >= {lattice.THRESHOLD}),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
named AS (SELECT a AS r, min(vec_id) AS component FROM reach JOIN v ON reach.b = v.r GROUP BY a),
counted AS (SELECT a AS r, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(least(component, vec_id), component, vec_id) AS component_id,
       vec_id IS NOT DISTINCT FROM coalesce(least(component, vec_id), component, vec_id) AS kept
FROM v LEFT JOIN named USING (r) LEFT JOIN counted USING (r)
"""

#: The squared distances of a vector to the centroids of the last round; the smallest number of the smallest one wins.
_NEAREST = """
SELECT v.r, arg_min(c.cluster, CAST(d AS HUGEINT) * 1000 + c.cluster) AS cluster, min(d) AS distance
FROM (
  SELECT v.r, c.cluster, list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
  FROM vectors v CROSS JOIN {centroids} c) v
JOIN (SELECT DISTINCT cluster FROM {centroids}) c USING (cluster)
GROUP BY v.r
"""


def _op12_sql() -> str:
    parts = [
        f"""
vectors AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({clusters.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE len(embedding) = {clusters.DIM} AND len(list_filter(embedding, lambda x: abs(CAST(x AS DOUBLE)) < {clusters.LARGEST})) = {clusters.DIM}),
c0 AS (
  SELECT row_number() OVER (ORDER BY h NULLS LAST, x) - 1 AS cluster, x
  FROM (SELECT sha256('1:' || CAST(vec_id AS VARCHAR)) AS h, x FROM vectors ORDER BY h NULLS LAST, x LIMIT {clusters.K}))"""
    ]
    for n in range(clusters.ROUNDS + 1):
        parts.append(f"\na{n} AS ({_NEAREST.format(centroids=f'c{n}')})")
        if n < clusters.ROUNDS:
            parts.append(
                f"""
s{n} AS (
  SELECT cluster, i, sum(x[i]) AS total, count(*) AS n
  FROM (SELECT cluster, x, unnest(range(1, {clusters.DIM + 1})) AS i FROM a{n} JOIN vectors USING (r)) GROUP BY cluster, i),
m{n} AS (
  SELECT cluster, list(CAST((total - ((total % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM s{n} GROUP BY cluster),
c{n + 1} AS (SELECT c{n}.cluster, coalesce(m{n}.x, c{n}.x) AS x FROM c{n} LEFT JOIN m{n} USING (cluster))"""
            )
    last = clusters.ROUNDS
    return f"""
WITH {",".join(parts)}
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance,
       CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c{last}.x, ',')) AS centroid_sha256
FROM a{last} JOIN vectors USING (r) JOIN c{last} USING (cluster)
"""


OP13_SQL = rf"""
WITH dw AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
d AS (SELECT r, doc_id, w, len(w) AS n FROM dw WHERE len(w) > 0),
size AS (SELECT count(*) AS docs, sum(n) AS terms FROM d),
m AS (SELECT r, CAST(75 + (25 * n * docs) // terms AS BIGINT) AS m FROM d, size),
i AS (
  SELECT row_number() OVER () AS q, item_id,
         unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
q AS (SELECT q, item_id, term, count(*) AS times FROM i GROUP BY q, item_id, term),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY r, term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), size),
gain AS (SELECT r, term, w * ((1000000000 * tf) // (1000 * tf + 12 * m)) AS gain FROM tf JOIN w USING (term) JOIN m USING (r)),
score AS (SELECT q, item_id, r, CAST(sum(times * gain) AS BIGINT) AS score FROM q JOIN gain USING (term) GROUP BY q, item_id, r HAVING sum(times * gain) > 0),
ranked AS (
  SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank
  FROM score JOIN d USING (r))
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {ranking.K}
"""


ORACLE_SQL: dict[str, str] = {"op1_chat_formatting": OP1_SQL, "op3_warc": OP3_SQL, "op6_url_filters": _op6_sql(), "op8_decontamination": OP8_SQL, "op11_embedding_near_dup": OP11_SQL, "op12_centroid_clustering": _op12_sql(), "op13_ranked_search": OP13_SQL}
