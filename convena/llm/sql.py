"""DuckDB SQL for the queries that SQL can express."""

OP2 = r"""
WITH parsed AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(rule_host, rule_path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits AS (
  SELECT page_id, rule_host || rule_path AS rule, verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC) AS place
  FROM parsed JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parsed p LEFT JOIN (SELECT * FROM fits WHERE place = 1) f USING (page_id)
"""

OP3 = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

OP5 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
windows AS (SELECT doc_id, i, hash(substr(x, 2 * i + 1, 400)) AS h FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 199)) AS i FROM d)),
recurring AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
hits AS (SELECT doc_id, i FROM windows SEMI JOIN recurring USING (h)),
breaks AS (SELECT doc_id, i, CAST(coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200, false) AS INTEGER) AS new FROM hits),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM breaks) GROUP BY doc_id, run),
gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM runs),
kept AS (
  SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS front, max(b) AS last
  FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(front || substr(x, 2 * last + 1), x))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP7 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w
  FROM documents),
sets AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i + 2], ' ') FOR i IN range(1, len(w) - 1)] END)) AS s
  FROM words),
classes AS (SELECT min(doc_id) AS c, count(*) AS copies, s FROM sets WHERE len(s) > 0 GROUP BY s),
grams AS (SELECT c, len(s) AS n, unnest(s) AS g FROM classes),
pairs AS (
  SELECT a.c AS x, b.c AS y FROM grams a JOIN grams b ON a.g = b.g AND a.c < b.c AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
links AS (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
reach(c, r) AS (SELECT c, c FROM classes UNION SELECT reach.c, links.y FROM reach JOIN links ON links.x = reach.r),
components AS (SELECT c, min(r) AS component_id FROM reach GROUP BY c),
linked AS (SELECT x AS c, CAST(sum(copies) AS BIGINT) AS n FROM links JOIN classes ON classes.c = links.y GROUP BY x)
SELECT sets.doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, coalesce(components.component_id, sets.doc_id) AS component_id, coalesce(classes.copies - 1 + coalesce(linked.n, 0), 0) AS n_links
FROM sets LEFT JOIN classes ON classes.s = sets.s LEFT JOIN components ON components.c = classes.c LEFT JOIN linked ON linked.c = classes.c
"""

ORACLE = {"op2_url_filter": OP2, "op3_exact_dedup": OP3, "op5_repeats": OP5, "op7_jaccard_join": OP7}
