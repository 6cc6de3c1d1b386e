"""The catalogue's queries as DuckDB SQL."""

from __future__ import annotations

_ITEMS = """
raw AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
items AS (
  SELECT CAST(event_id AS VARCHAR) AS uuid, 'E' || event_id AS original_filename, CASE WHEN k % 10 <> 0 THEN ts END AS date, k, event_type, value,
         CASE WHEN event_type = 'signup' THEN 'Subject One' WHEN event_type = 'purchase' AND k % 2 = 0 THEN 'Subject One; Subject Three' ELSE '' END AS subjects,
         k % 13 = 0 AS album, event_type = 'view' AS is_screenshot, value < 5 AS is_hidden, event_type = 'error' AS is_shared,
         k % 3 = 0 AS is_movie, k % 5 = 1 AS is_live, k % 4 = 0 AS is_missing, CAST(floor(value * 1000) AS BIGINT) AS filesize
  FROM raw),
ruled AS (
  SELECT *, CASE WHEN is_shared THEN 'EXCLUDE_NOT_OWNED' WHEN is_hidden OR album THEN 'EXCLUDE_ALBUM' WHEN date IS NULL THEN 'REVIEW_UNKNOWN_DATE'
                 WHEN CAST(date AS DATE) < DATE '2024-01-16' THEN 'INCLUDE_PRE_CUTOFF' WHEN is_screenshot THEN 'EXCLUDE_SCREENSHOT'
                 WHEN subjects <> '' THEN 'INCLUDE_TAGGED' ELSE 'EXCLUDE_UNTAGGED' END AS disposition
  FROM items),
decided AS (SELECT *, disposition = 'EXCLUDE_UNTAGGED' AND CAST(date AS DATE) < DATE '2025-07-16' AS in_window, disposition LIKE 'INCLUDE%' AS is_in FROM ruled)
"""

_DOCS = "d AS (SELECT doc_id, lang, source, n_chars, sha256(coalesce(text, '')) AS sha FROM documents)"

_PRINTS = """
bits AS (
  SELECT vec_id, CAST(sum(CASE WHEN embedding[i + 1] > 0 THEN CAST(1 AS UBIGINT) << i ELSE 0 END) AS UBIGINT) AS bits
  FROM (SELECT vec_id, embedding, unnest(range(64)) AS i FROM embeddings) GROUP BY vec_id)
"""

_FILES = f"""
{_PRINTS},
contents AS (SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN vec_id WHEN vec_id % 10 = 5 THEN vec_id - 5 ELSE vec_id // 6 * 6 + 1 END AS content FROM bits),
sized AS (SELECT f.vec_id, b.bits, CAST(content % 9 * 100 AS INTEGER) AS w, CAST(content % 7 * 100 AS INTEGER) AS h, content % 11 * 1000 AS size, sha256(CAST(content AS VARCHAR)) AS sha FROM contents f JOIN bits b ON b.vec_id = content),
inc AS (SELECT * FROM sized WHERE vec_id % 2 = 1),
arc AS (SELECT * FROM sized WHERE vec_id % 2 = 0)
"""


def _verdict(w: str, h: str, size: str, mw: str, mh: str, msize: str) -> str:
    known = f"{w} > 0 AND {h} > 0 AND {mw} > 0 AND {mh} > 0"
    return f"CASE WHEN {known} AND {w} < {mw} AND {h} < {mh} AND {size} < {msize} THEN 'low_res_twin' WHEN {known} AND {w} > {mw} AND {h} > {mh} THEN 'higher_res_arrived' ELSE 'ambiguous_match' END"


def _against(files: str, assets: str) -> str:
    """Verdicts of files against fixed assets (vec_id, sha, bits, ...)."""
    return f"""
same AS (SELECT sha, min(vec_id) AS same_id FROM {assets} GROUP BY sha),
near AS (
  SELECT i.vec_id, arg_min(a.vec_id, (CAST(bit_count(xor(i.bits, a.bits)) AS BIGINT) * 100000000000 + a.vec_id)) AS near_id, min(bit_count(xor(i.bits, a.bits))) AS distance
  FROM {files} i JOIN {assets} a ON bit_count(xor(i.bits, a.bits)) <= 20 GROUP BY i.vec_id),
joined AS (
  SELECT i.*, same_id, near_id, n.distance AS distance, a.w AS mw, a.h AS mh, a.size AS msize
  FROM {files} i LEFT JOIN same USING (sha) LEFT JOIN near n ON n.vec_id = i.vec_id LEFT JOIN {assets} a ON a.vec_id = n.near_id),
classified AS (
  SELECT vec_id, size, CASE WHEN same_id IS NOT NULL THEN 'exact_duplicate' WHEN near_id IS NULL THEN 'new' ELSE {_verdict("w", "h", "size", "mw", "mh", "msize")} END AS verdict,
         coalesce(same_id, near_id) AS master_id, CASE WHEN same_id IS NOT NULL THEN 0 ELSE distance END AS distance
  FROM joined)
"""


_CLASSIFIED = f"{_FILES}, {_against('inc', 'arc')}"

# The sequential rules, one file a step: the state is the list of the files imported so far.
_GREEDY = f"""
{_FILES},
ranked AS (
  SELECT *, row_number() OVER (ORDER BY w * h DESC, size DESC, vec_id) AS n,
         EXISTS (SELECT 1 FROM arc a WHERE a.sha = inc.sha OR bit_count(xor(a.bits, inc.bits)) <= 20) AS known
  FROM inc),
walk AS (
  SELECT CAST(0 AS BIGINT) AS step, CAST([] AS STRUCT(n BIGINT, sha VARCHAR, bits UBIGINT)[]) AS taken
  UNION ALL
  SELECT step + 1, CASE WHEN f.known OR len(list_filter(taken, lambda m: m.sha = f.sha OR bit_count(xor(m.bits, f.bits)) <= 20)) > 0 THEN taken
                        ELSE list_append(taken, {{'n': f.n, 'sha': f.sha, 'bits': f.bits}}) END
  FROM walk JOIN ranked f ON f.n = step + 1),
numbers AS (SELECT unnest(taken).n AS n FROM (SELECT taken FROM walk ORDER BY step DESC LIMIT 1)),
fresh AS (SELECT r.* FROM ranked r JOIN numbers USING (n)),
rest AS (SELECT * FROM ranked WHERE n NOT IN (SELECT n FROM numbers)),
masters AS (
  SELECT vec_id AS id, CAST(NULL AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS master_path, vec_id, sha, bits, w, h, size FROM arc
  UNION ALL SELECT NULL, n, 'in/' || vec_id || '/' || (vec_id % 197) || '.jpg', vec_id, sha, bits, w, h, size FROM fresh),
met AS (
  SELECT r.*, m.id AS master_id, m.n AS mn, m.master_path, m.w AS mw, m.h AS mh, m.size AS msize, m.sha = r.sha AS is_same, bit_count(xor(m.bits, r.bits)) AS apart
  FROM rest r JOIN masters m ON (m.n IS NULL OR m.n < r.n) AND (m.sha = r.sha OR bit_count(xor(m.bits, r.bits)) <= 20)),
best AS (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY n ORDER BY is_same DESC, CASE WHEN is_same THEN 0 ELSE apart END, mn IS NOT NULL, master_id, mn) = 1),
verdicts AS (
  SELECT vec_id, n, size, CASE WHEN is_same THEN 'exact_duplicate' ELSE {_verdict("w", "h", "size", "mw", "mh", "msize")} END AS verdict, master_id, master_path,
         CAST(CASE WHEN is_same THEN 0 ELSE apart END AS INTEGER) AS distance FROM best
  UNION ALL SELECT vec_id, n, size, 'new', NULL, NULL, NULL FROM fresh)
"""

_PLACES = f"""
{_GREEDY},
dated AS (SELECT *, 'in/' || vec_id || '/' || (vec_id % 197) || '.jpg' AS path, CASE WHEN vec_id % 4 = 1 THEN '2020/0' || (vec_id % 3 + 1) ELSE 'undated' END AS folder, CAST(vec_id % 197 AS VARCHAR) AS stem FROM fresh),
wished AS (SELECT d.*, a.sha AS old, row_number() OVER (PARTITION BY folder, stem ORDER BY n) AS nth FROM dated d LEFT JOIN arc a ON folder || '/' || stem = '2020/02/' || a.vec_id),
places AS (SELECT *, NOT (old IS NULL AND nth = 1 OR coalesce(old = sha, false)) AS renamed FROM wished)
"""

_QUEUED = f"""
{_PLACES},
queued AS (
  SELECT 'in/' || v.vec_id || '/' || (v.vec_id % 197) || '.jpg' AS original_path, verdict AS kind,
         coalesce('2020/02/' || v.master_id || '.jpg', (SELECT folder || '/' || stem || CASE WHEN renamed THEN '-' || sha[:8] ELSE '' END || '.jpg' FROM places p WHERE p.path = v.master_path)) AS master
  FROM verdicts v WHERE verdict IN ('ambiguous_match', 'higher_res_arrived')
  UNION ALL SELECT path, 'unknown_date', NULL FROM places WHERE folder = 'undated')
"""

_LOCATED = """
a AS (
  SELECT event_id AS id, CASE WHEN event_id % 50 <> 0 THEN ts END AS taken_at,
         CASE WHEN event_type = 'signup' THEN value WHEN event_type <> 'error' THEN 0.5 END AS lat,
         CASE WHEN event_type = 'signup' THEN -value WHEN event_type <> 'error' THEN 0.25 END AS lon,
         CASE WHEN event_type = 'signup' THEN 'exif' WHEN event_type <> 'error' THEN 'inferred' END AS gps_source
  FROM events),
anchors AS (SELECT id, taken_at, lat, lon FROM a WHERE gps_source = 'exif' AND taken_at IS NOT NULL),
targets AS (SELECT id, taken_at FROM a WHERE lat IS NULL AND taken_at IS NOT NULL),
gaps AS (
  SELECT t.id, n.id AS anchor_id, n.lat, n.lon, abs(epoch_us(n.taken_at) - epoch_us(t.taken_at)) AS gap_us, n.taken_at AS anchor_at
  FROM targets t JOIN anchors n ON CAST(t.taken_at AS DATE) = CAST(n.taken_at AS DATE)),
best AS (SELECT * FROM gaps QUALIFY row_number() OVER (PARTITION BY id ORDER BY gap_us, anchor_at, anchor_id) = 1),
inferred AS (SELECT * FROM best WHERE gap_us < 21589200000)
"""

_TAGS = """
pairs AS (SELECT CAST(l_partkey AS VARCHAR) AS sha, l_partkey, CASE WHEN l_suppkey % 4 <> 0 THEN string_split(p_name, ' ') ELSE [] END AS names FROM lineitem JOIN part ON l_partkey = p_partkey),
read AS (SELECT *, l_partkey % 5 <> 0 AS there FROM pairs WHERE len(names) > 0)
"""

_DAYS = """
days AS (SELECT event_id AS n, strftime(ts, '%Y/%m/%d/') || event_id || '.jpg' AS path, day(ts) = 5 AS fifth, strftime(ts, '%Y/%m/%d') AS folder FROM events),
hit AS (SELECT DISTINCT folder FROM days WHERE fifth AND n % 4 > 0),
marked AS (SELECT path, CASE WHEN NOT fifth OR n % 4 = 0 THEN 'ok' WHEN n % 4 = 1 THEN 'corrupted' ELSE 'missing' END AS status FROM days WHERE folder IN (SELECT folder FROM hit)
  UNION ALL SELECT path || '.new', 'unlisted' FROM days WHERE fifth AND n % 4 = 3)
"""
_VAULT = """
assets AS (SELECT CAST(o_orderkey AS VARCHAR) AS path, o_custkey AS size, sha256(CAST(o_orderkey AS VARCHAR)) AS sha FROM orders WHERE o_orderkey % 10 <> 3),
files AS (SELECT CAST(o_orderkey AS VARCHAR) AS path, CASE WHEN o_orderkey % 10 = 5 THEN o_custkey + 1 ELSE o_custkey END AS size, CASE WHEN o_orderkey % 10 = 6 THEN 'x' ELSE sha256(CAST(o_orderkey AS VARCHAR)) END AS sha FROM orders WHERE o_orderkey % 10 <> 4)
"""


def _statuses(differs: str, extra: str) -> str:
    return f"statuses AS (SELECT coalesce(a.path, f.path) AS path, CASE WHEN a.path IS NULL THEN '{extra}' WHEN f.path IS NULL THEN 'missing' WHEN {differs} THEN 'corrupted' ELSE 'ok' END AS status FROM assets a FULL OUTER JOIN files f ON a.path = f.path)"


_COUNTS = """
SELECT count(*) FILTER (WHERE status NOT IN ('unlisted', 'untracked')) AS checked, count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status = 'corrupted') AS corrupted,
       count(*) FILTER (WHERE status = 'missing') AS missing, count(*) FILTER (WHERE status IN ('unlisted', 'untracked')) AS extra, count(*) FILTER (WHERE status <> 'ok') = 0 AS passed FROM statuses
"""

_BACKFILL = """
a AS (SELECT event_id AS id, CASE WHEN event_id % 50 <> 0 THEN ts END AS taken_at, CASE WHEN event_type = 'signup' THEN value WHEN event_type <> 'error' THEN 0.5 END AS lat FROM events),
wanted AS (SELECT id FROM a WHERE lat IS NULL),
said AS (SELECT id, id % 3 <> 0 AS there, id % 3 <> 0 AND id % 5 <> 0 AND {more} AS located FROM wanted)
"""

ORACLE_SQL: dict[str, str] = {
    "q01_contract": f"WITH {_ITEMS} SELECT uuid, disposition, subjects, coalesce(in_window, false) AS in_untagged_window FROM decided",
    "q02_untagged_window": """
        SELECT CAST(o_orderkey AS VARCHAR) AS uuid, CASE WHEN o_orderdate < DATE '1998-01-31' THEN 'INCLUDE_PRE_CUTOFF' ELSE 'EXCLUDE_UNTAGGED' END AS disposition,
               o_orderdate >= DATE '1998-01-31' AND CAST(o_orderdate AS DATE) < DATE '1998-01-31' + INTERVAL 13 MONTH AS in_untagged_window FROM orders""",
    "q03_by_disposition": f"""WITH {_ITEMS}
        SELECT v.disposition, CAST(count(x.uuid) AS BIGINT) AS n, CAST(coalesce(sum(x.filesize), 0) AS BIGINT) AS n_bytes
        FROM (VALUES ('INCLUDE_PRE_CUTOFF'), ('INCLUDE_TAGGED'), ('EXCLUDE_NOT_OWNED'), ('EXCLUDE_ALBUM'), ('EXCLUDE_SCREENSHOT'), ('EXCLUDE_UNTAGGED'), ('REVIEW_UNKNOWN_DATE')) v(disposition)
        LEFT JOIN decided x ON x.disposition = v.disposition GROUP BY v.disposition""",
    "q04_inventory_summary": f"""WITH {_ITEMS}
        SELECT count(*) AS scanned, count(*) FILTER (WHERE is_in) AS included_count, CAST(sum(filesize) FILTER (WHERE is_in) AS BIGINT) AS included_bytes,
               count(*) FILTER (WHERE disposition LIKE 'EXCLUDE%') AS excluded_count, count(*) FILTER (WHERE disposition LIKE 'REVIEW%') AS review_count,
               count(*) FILTER (WHERE is_in AND NOT is_movie) AS included_photos, count(*) FILTER (WHERE is_in AND is_movie) AS included_movies, count(*) FILTER (WHERE is_in AND is_live) AS included_live_photos,
               count(*) FILTER (WHERE is_in AND is_missing) AS cloud_only_count, CAST(coalesce(sum(filesize) FILTER (WHERE is_in AND is_missing), 0) AS BIGINT) AS cloud_only_bytes,
               count(*) FILTER (WHERE in_window) AS window_count, CAST(coalesce(sum(filesize) FILTER (WHERE in_window), 0) AS BIGINT) AS window_bytes,
               min(date) FILTER (WHERE is_in) AS earliest, max(date) FILTER (WHERE is_in) AS latest,
               round(CAST(coalesce(sum(filesize) FILTER (WHERE is_in AND is_missing), 0) AS DOUBLE) * 8 / 25e6 / 3600, 9) AS estimated_hours
        FROM decided""",
    "q05_by_subject": """
        WITH w AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS x FROM part),
        s AS (SELECT DISTINCT p_partkey, CASE lower(x) WHEN 'ring' THEN 'Ring' WHEN 'widget' THEN 'Widget' WHEN 'gadget' THEN 'Widget' WHEN 'red' THEN 'Red' END AS subject FROM w)
        SELECT subject, count(*) AS n FROM s WHERE subject IS NOT NULL GROUP BY subject""",
    "q06_stats": """
        SELECT count(*) AS assets, CAST(sum(floor(o_totalprice)) AS BIGINT) AS total_bytes, count(*) FILTER (WHERE o_orderstatus <> 'F') AS photos, count(*) FILTER (WHERE o_orderstatus = 'F') AS videos,
               count(*) FILTER (WHERE o_orderkey % 7 = 0) AS undated, count(*) FILTER (WHERE o_custkey % 3 = 0) AS located, count(*) FILTER (WHERE o_custkey % 6 = 0) AS located_inferred,
               min(o_orderdate) FILTER (WHERE o_orderkey % 7 <> 0) AS earliest, max(o_orderdate) FILTER (WHERE o_orderkey % 7 <> 0) AS latest FROM orders""",
    "q07_distinct_people": "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type",
    "q08_grouped_counts": "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY o_orderpriority",
    "q09_month_folders": "SELECT CASE WHEN o_orderkey % 11 = 0 THEN 'undated' ELSE strftime(o_orderdate, '%Y/%m') END AS folder, count(*) AS n FROM orders GROUP BY 1",
    "q10_checksums": "SELECT doc_id, sha256(coalesce(text, '')) AS sha256 FROM documents",
    "q11_exact_duplicates": f"WITH {_DOCS} SELECT doc_id, min(doc_id) OVER s AS master_id, count(*) OVER s AS copies, doc_id <> min(doc_id) OVER s AS is_duplicate FROM d WINDOW s AS (PARTITION BY sha)",
    "q12_best_first": f"WITH {_DOCS} SELECT source, doc_id, n_chars FROM d QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) = 1",
    "q13_strictly_smaller": f"""WITH {_DOCS}, s AS (SELECT *, CAST(doc_id % 5 AS INTEGER) AS w, CAST(doc_id % 7 AS INTEGER) AS h FROM d),
        m AS (SELECT lang, source, doc_id AS master_id, w AS mw, h AS mh, n_chars AS ms FROM s QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) = 1),
        j AS (SELECT *, w > 0 AND h > 0 AND mw > 0 AND mh > 0 AS known FROM s JOIN m USING (lang, source)),
        v AS (SELECT *, known AND w < mw AND h < mh AND n_chars < ms AS smaller FROM j)
        SELECT doc_id, master_id, smaller, CASE WHEN smaller THEN 'low_res_twin' WHEN known AND w > mw AND h > mh THEN 'higher_res_arrived' ELSE 'ambiguous_match' END AS verdict,
               CASE WHEN w > 0 AND h > 0 THEN CAST(w * h AS BIGINT) END AS pixels FROM v""",
    "q14_collision_names": f"""WITH {_DOCS}, f AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY sha ORDER BY doc_id) = 1),
        w AS (SELECT *, CASE lang WHEN 'en' THEN 'undated' WHEN 'de' THEN '2020/01' ELSE '2020/02' END AS folder FROM f),
        r AS (SELECT *, row_number() OVER (PARTITION BY folder, source ORDER BY n_chars DESC, doc_id || '/' || source) AS nth FROM w),
        x AS (SELECT *, nth > 1 OR folder || '/' || source = 'undated/src0' AS renamed FROM r)
        SELECT doc_id, folder || '/' || source || CASE WHEN renamed THEN '-' || sha[:8] ELSE '' END || '.jpg' AS vault_path, renamed FROM x""",
    "q15_names": "SELECT p_partkey, array_to_string(string_split(p_name, ' '), '; ') AS names, CAST(len(string_split(p_name, ' ')) AS BIGINT) AS n FROM part",
    "q16_normalized_tags": "SELECT c_custkey, lower(c_mktsegment) || ' ' || lower(c_mktsegment) AS tag FROM customer",
    "q17_embedded_dates": """
        WITH s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y:%m:%d') || ' 0' || (o_orderkey % 10) || ':30:15.25'
            ELSE ['2015:06:15 12:00:00', '2015-06-15T12:00:00.123', '0000:00:00 00:00:00', '2015:02:30 10:00:00', '2015:06:15 24:00:00', '2015:06:15 23:59:60', 'not a date', '2016:02:29 01:02:03+07:00', '', NULL, '2015:06:15 12:00:00', '2015:06:15 12:00:01'][o_orderkey % 12 + 1] END AS raw FROM orders),
        p AS (SELECT o_orderkey, replace(replace(raw[1:10], ':', '-'), 'T', ' ') || ' ' || raw[12:19] AS t FROM s)
        SELECT o_orderkey, strftime(CASE WHEN t[18:19] < '60' AND t[12:13] < '24' AND t[1:4] > '0000' THEN try_strptime(t, '%Y-%m-%d %H:%M:%S') END, '%Y-%m-%d %H:%M:%S') AS taken_at FROM p""",
    "q18_add_months": "SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE) + to_months(CAST(o_orderkey % 19 AS INTEGER)), '%Y-%m-%d') AS later FROM orders",
    "q19_coordinates": """
        WITH s AS (SELECT s_suppkey, s_acctbal / 100 AS la, CASE WHEN s_suppkey % 5 <> 0 THEN s_acctbal / 50 END AS lo FROM supplier),
        f AS (SELECT *, coalesce(la BETWEEN -90 AND 90 AND lo BETWEEN -180 AND 180 AND NOT (la = 0 AND lo = 0), false) AS fine FROM s)
        SELECT s_suppkey, CASE WHEN fine THEN la END AS lat, CASE WHEN fine THEN lo END AS lon, CASE WHEN s_suppkey % 7 <> 0 THEN CAST(1.5 AS DOUBLE) END AS lat0, CASE WHEN s_suppkey % 7 <> 0 THEN CAST(2.5 AS DOUBLE) END AS lon0,
               CASE WHEN s_suppkey > 5 THEN CAST(s_suppkey - 5 AS INTEGER) END AS width FROM f""",
    "q20_hamming_pairs": f"""WITH {_PRINTS}, h AS (SELECT bits, min(vec_id) AS lead FROM bits GROUP BY bits)
        SELECT least(l.lead, r.lead) AS a, greatest(l.lead, r.lead) AS b, CAST(bit_count(xor(l.bits, r.bits)) AS INTEGER) AS distance FROM h l JOIN h r ON l.lead < r.lead AND bit_count(xor(l.bits, r.bits)) <= 20
        UNION ALL SELECT lead, vec_id, 0 FROM bits JOIN h USING (bits) WHERE vec_id <> lead""",
    "q21_classify": f"WITH {_CLASSIFIED} SELECT vec_id, verdict, master_id, CAST(distance AS INTEGER) AS distance FROM classified",
    "q22_greedy": f"WITH RECURSIVE {_GREEDY} SELECT vec_id, verdict, master_id, master_path, distance FROM verdicts",
    "q24_rerun": f"""WITH RECURSIVE {_GREEDY}, full_archive AS (SELECT vec_id, sha, bits, w, h, size FROM arc UNION ALL SELECT vec_id + 1000000000, sha, bits, w, h, size FROM fresh), {_against("inc", "full_archive")}
        SELECT vec_id, verdict, master_id, CAST(distance AS INTEGER) AS distance FROM classified""",
    "q25_ingest_plan": f"""WITH RECURSIVE {_PLACES}
        SELECT count(*) AS scanned, count(*) FILTER (WHERE verdict = 'new') AS imported, count(*) FILTER (WHERE verdict IN ('exact_duplicate', 'low_res_twin')) AS linked,
               count(*) FILTER (WHERE verdict IN ('ambiguous_match', 'higher_res_arrived')) AS deferred, CAST(coalesce(sum(size) FILTER (WHERE verdict = 'new'), 0) AS BIGINT) AS imported_bytes,
               CAST(coalesce(sum(size) FILTER (WHERE verdict IN ('exact_duplicate', 'low_res_twin')), 0) AS BIGINT) AS linked_bytes,
               count(*) FILTER (WHERE verdict = 'new' AND vec_id % 4 <> 1) AS undated, (SELECT count(*) FROM places WHERE renamed) AS renamed, true AS balanced FROM verdicts""",
    "q26_ingest_reasons": f"""WITH RECURSIVE {_QUEUED}
        SELECT kind, count(*) AS n FROM (SELECT kind FROM queued UNION ALL SELECT verdict FROM verdicts WHERE verdict IN ('exact_duplicate', 'low_res_twin')) GROUP BY kind""",
    "q27_ingest_places": f"WITH RECURSIVE {_PLACES} SELECT path, folder || '/' || stem || CASE WHEN renamed THEN '-' || sha[:8] ELSE '' END || '.jpg' AS vault_path, renamed, stem || '.jpg' AS original_filename, 'photo' AS media_type FROM places",
    "q28_ingest_reviews": f"WITH RECURSIVE {_QUEUED} SELECT original_path, kind, master FROM queued",
    "q23_verdict_counts": f"WITH {_CLASSIFIED} SELECT verdict, count(*) AS n, CAST(sum(size) AS BIGINT) AS n_bytes FROM classified GROUP BY verdict",
    "q30_nearest_in_time": f"WITH {_LOCATED} SELECT id, anchor_id, gap_us FROM best WHERE gap_us <= 7200000000",
    "q31_location_bands": f"WITH {_LOCATED} SELECT CASE WHEN gap_us <= 3600000000 THEN 'high' ELSE 'low' END AS band, count(*) AS n FROM inferred GROUP BY 1",
    "q32_set_locations": f"""WITH {_LOCATED}, more AS (SELECT id FROM a WHERE id % 9 = 0 AND lat IS NOT NULL AND gps_source <> 'exif')
        SELECT a.id, CASE WHEN m.id IS NOT NULL THEN 9.0 WHEN i.id IS NOT NULL THEN i.lat ELSE a.lat END AS gps_latitude, CASE WHEN m.id IS NOT NULL THEN 8.0 WHEN i.id IS NOT NULL THEN i.lon ELSE a.lon END AS gps_longitude,
               CASE WHEN m.id IS NOT NULL OR i.id IS NOT NULL THEN 'inferred' ELSE a.gps_source END AS gps_source
        FROM a LEFT JOIN more m ON a.id = m.id LEFT JOIN inferred i ON a.id = i.id""",
    "q33_location_counts": f"""WITH {_LOCATED}, c AS (SELECT (SELECT count(*) FROM targets) AS considered, count(*) AS inferred, count(*) FILTER (WHERE gap_us <= 3600000000) AS high, count(*) FILTER (WHERE gap_us > 3600000000) AS low FROM inferred)
        SELECT *, considered - inferred AS skipped, round(inferred / considered, 9) AS coverage FROM c""",
    "q40_person_tags": f"""WITH {_TAGS}, e AS (SELECT unnest(names) AS raw FROM read WHERE there),
        p AS (SELECT raw, CASE lower(raw) WHEN 'ring' THEN 'Ring' WHEN 'widget' THEN 'Widget' WHEN 'gadget' THEN 'Widget' WHEN 'red' THEN 'Red' END AS subject FROM e)
        SELECT coalesce(subject, raw) AS person, count(*) AS n, count(*) FILTER (WHERE subject IS NULL) AS n_unknown FROM p GROUP BY 1""",
    "q41_person_counts": f"WITH {_TAGS} SELECT count(*) AS files_read, count(*) FILTER (WHERE there) AS matched, count(*) FILTER (WHERE NOT there) AS unmatched, round(count(*) FILTER (WHERE there) / count(*), 9) AS coverage FROM read",
    "q42_names_of_assets": "SELECT n_nationkey AS asset_id, r_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey",
    "q43_verify_vault": f"WITH {_VAULT}, {_statuses('a.size <> f.size OR a.sha <> f.sha', 'untracked')} SELECT path, status FROM statuses",
    "q44_verify_vault_shallow": f"WITH {_VAULT}, {_statuses('a.size <> f.size', 'untracked')} {_COUNTS}",
    "q45_verify_manifest": f"WITH {_VAULT}, {_statuses('a.sha <> f.sha', 'unlisted')} {_COUNTS}",
    "q91_verify_changed_folders": f"WITH {_DAYS} SELECT path, status FROM marked",
    "q92_verify_by_tree": f"""WITH {_DAYS}, c AS (SELECT count(*) FILTER (WHERE status = 'corrupted') AS corrupted, count(*) FILTER (WHERE status = 'missing') AS missing, count(*) FILTER (WHERE status = 'unlisted') AS extra FROM marked)
        SELECT (SELECT count(*) FROM days) AS checked, (SELECT count(*) FROM days) - corrupted - missing AS ok, corrupted, missing, extra, corrupted + missing + extra = 0 AS passed FROM c""",
    "q46_orphans": "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
    "q47_orphan_sidecars": "SELECT 'd/I_' || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN '.jpg.json' ELSE '.json' END AS path FROM orders WHERE o_orderkey % 3 = 0",
    "q48_get_or_create": """
        WITH known AS (SELECT CAST(id AS BIGINT) AS id, name FROM (VALUES (1, 'MACHINERY'), (7, 'HOUSEHOLD')) v(id, name)),
        fresh AS (SELECT DISTINCT c_mktsegment AS name FROM customer WHERE c_mktsegment NOT IN (SELECT name FROM known))
        SELECT id, name FROM known UNION ALL SELECT 7 + row_number() OVER (ORDER BY name), name FROM fresh""",
    "q49_insert_or_ignore": "SELECT user_id AS asset_id, event_type AS kind, event_id, value FROM events WHERE user_id % 4 <> 0 QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1",
    "q50_union_first_wins": "SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN 'live' ELSE 'trash' END AS origin FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 2 = 0",
    "q51_path_predicates": """
        WITH r AS (SELECT page_id, regexp_replace(regexp_extract(url, '://([^?#]*)', 1), '/$', '') || ['.JPG', '.mov', '.heic', '.txt', '', '.trashes/a.png', '/__MACOSX/b.jpeg', '/.x.jpg'][page_id % 8 + 1] AS rel FROM pages),
        n AS (SELECT *, regexp_extract(rel, '([^/]*)$', 1) AS name, string_split(rel, '/')[:-2] AS above FROM r),
        e AS (SELECT *, lower(regexp_extract(name, '^.+(\\.[^.]+)$', 1)) AS ext FROM n),
        f AS (SELECT *, ext IN ('.jpg', '.jpeg', '.png', '.gif', '.bmp', '.tif', '.tiff', '.webp', '.heic', '.heif', '.dng', '.raw', '.cr2', '.cr3', '.nef', '.arw', '.orf', '.rw2', '.mov', '.mp4', '.m4v', '.avi', '.mkv', '.mts', '.m2ts', '.3gp') AS media,
                     len(list_filter(above, lambda x: starts_with(x, '.') OR lower(x) IN ('$recycle.bin', 'recycler', 'system volume information', '__macosx', 'lost+found'))) > 0 AS system FROM e)
        SELECT page_id, ext, name[:length(name) - length(ext)] AS stem, media, CASE WHEN ext IN ('.mov', '.mp4', '.m4v', '.avi', '.mkv', '.mts', '.m2ts', '.3gp') THEN 'video' ELSE 'photo' END AS kind,
               ext IN ('.jpg', '.jpeg', '.png', '.gif', '.bmp', '.tif', '.tiff', '.webp') AS hashable, system, media AND NOT system AND NOT starts_with(name, '.') AS content FROM f""",
    "q52_json_detail": "SELECT event_id, CASE WHEN event_id % 3 > 0 THEN json_extract_string(props, '$.k') END AS k, CAST(CASE WHEN event_id % 3 > 0 THEN 1 ELSE 0 END AS BIGINT) AS n FROM events",
    "q53_filtered_listing": "SELECT event_id, event_type, user_id FROM events WHERE event_type = 'purchase' ORDER BY event_id LIMIT 50",
    "q54_count_listing": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type",
    "q55_date_precedence": """
        WITH s AS (SELECT l_orderkey, min(l_shipdate) AS ship FROM lineitem GROUP BY l_orderkey)
        SELECT o_orderkey, strftime(CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate ELSE ship END, '%Y-%m-%d %H:%M:%S') AS taken_at,
               CASE WHEN o_orderkey % 4 = 0 THEN 'sidecar' WHEN ship IS NOT NULL THEN 'exif' ELSE 'unknown' END AS source FROM orders LEFT JOIN s ON o_orderkey = l_orderkey""",
    "q56_estimates": """
        SELECT l_returnflag, CAST(sum(CAST(l_quantity * 1000000 AS BIGINT)) AS BIGINT) AS n_bytes, round(CAST(sum(CAST(l_quantity * 1000000 AS BIGINT)) AS DOUBLE) * 8 / 25e6 / 3600, 6) AS hours,
               round(count(*) FILTER (WHERE l_linestatus = 'F') / count(*), 9) AS share, CAST(0 AS DOUBLE) AS nothing FROM lineitem GROUP BY l_returnflag""",
    "q57_album_overlap": "SELECT p_partkey, len(list_filter(string_split(p_name, ' '), lambda x: lower(x) IN ('red', 'bolt'))) > 0 AS excluded FROM part",
    "q58_backfill": f"WITH {_BACKFILL.format(more='id % 7 <> 0')} SELECT count(*) FILTER (WHERE there) AS examined, count(*) FILTER (WHERE located) AS located, count(*) FILTER (WHERE there AND NOT located) AS still_unlocated, count(*) FILTER (WHERE NOT there) AS missing_files FROM said",
    "q59_backfill_updates": f"WITH {_BACKFILL.format(more='true')} SELECT id, CAST(12.5 AS DOUBLE) AS latitude, CASE WHEN true THEN CAST(-3.25 AS DOUBLE) END AS longitude, 'exif' AS source FROM said WHERE located UNION ALL SELECT id, 0.0, -3.25, 'exif' FROM said WHERE there AND id % 5 = 0",
    "q60_constraints": """
        SELECT 'orders_unique' AS rule, count(*) AS n FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)
        UNION ALL SELECT 'lineitem_unique', count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)
        UNION ALL SELECT 'lineitem_orders', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
        UNION ALL SELECT 'orders_customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 20 <> 1)""",
    "q61_latest_version": "SELECT max(event_id) AS version FROM events",
    "q62_library_flags": """
        SELECT event_id AS uuid, event_id % 6 IN (0, 1, 4, 5) AS is_screenshot, true AS is_shared, true AS is_photo, event_id % 9 = 0 AS undated, event_type AS persons, CAST(0 AS BIGINT) AS filesize FROM events""",
    "q63_selected": f"WITH {_ITEMS} SELECT uuid FROM decided WHERE is_in",
    "q64_unknown_dates": f"WITH {_ITEMS} SELECT uuid, original_filename AS name FROM decided WHERE disposition = 'REVIEW_UNKNOWN_DATE'",
}
