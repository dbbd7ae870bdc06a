"""SQL forms of the operators that SQL can express, by their definitions rather than their methods; DuckDB runs them."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower(text: str) -> str:
    return f"translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}')"


def _blank_words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"


def _windows(size: str) -> str:
    """Texts of all windows of ``size`` words in the list t."""
    return f"list_transform(range(1, len(t) - {size} + 2), lambda k: array_to_string(t[k : k + {size} - 1], ' '))"


def _components_sql(percent: int, columns: str) -> str:
    """Components of documents whose sets of 4-word shingles have a Jaccard similarity of ``percent`` or more."""
    return f"""
WITH RECURSIVE words AS (SELECT doc_id, {_blank_words(_lower('text'))} AS t FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 4 THEN [array_to_string(t, ' ')] ELSE list_distinct({_windows('4')}) END AS s
         FROM words),
shingles AS (SELECT doc_id, unnest(s) AS x FROM sets),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sets p ON p.doc_id = a JOIN sets q ON q.doc_id = b WHERE 100 * c >= {percent} * (len(p.s) + len(q.s) - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other),
names AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, len(s)::BIGINT AS n_shingles, {columns} FROM sets JOIN names USING (doc_id)
"""


NEAR_SQL = _components_sql(80, "component_id, doc_id = component_id AS kept")
JOIN_SQL = _components_sql(85, "component_id")

EXACT_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

_BENCH_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

CONTAMINATION_SQL = f"""
WITH items AS (SELECT item_id, regexp_extract_all({_lower('text')}, '{_BENCH_WORD}') AS t FROM benchmark),
sized AS (SELECT item_id, t, least(10, len(t)) AS size FROM items WHERE len(t) > 0),
windows AS (SELECT DISTINCT item_id, size, unnest({_windows('size')}) AS g FROM sized),
words AS (SELECT doc_id, regexp_extract_all({_lower('text')}, '{_BENCH_WORD}') AS t FROM documents),
grams AS (SELECT doc_id, size, unnest({_windows('size')}) AS g, unnest(range(1, len(t) - size + 2)) AS k
          FROM words, (SELECT DISTINCT size FROM sized) WHERE len(t) >= size),
hits AS (SELECT doc_id, k, size, item_id FROM grams JOIN windows USING (size, g)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
          FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(t)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM words LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""

REPEATS_SQL = f"""
WITH words AS (SELECT doc_id, {_blank_words("coalesce(text, '')")} AS t FROM documents),
windows AS (SELECT doc_id, unnest(list_transform(range(1, len(t) - 48), lambda k: md5(array_to_string(t[k : k + 49], ' ')))) AS h,
                   unnest(range(1, len(t) - 48)) AS k FROM words WHERE len(t) >= 50),
firsts AS (SELECT h, min(doc_id) AS first FROM windows GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 50)) AS p FROM windows JOIN firsts USING (h) WHERE doc_id > first),
placed AS (SELECT doc_id, unnest(t) AS w, generate_subscripts(t, 1) AS p FROM words),
kept AS (SELECT doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY p) AS kept FROM placed ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(t)::BIGINT AS n_words, (len(t) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

SEARCH_SQL = f"""
WITH wanted AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_lower('text')}, '{_TERM}')) AS term FROM benchmark),
words AS (SELECT doc_id, regexp_extract_all({_lower('text')}, '{_TERM}') AS t FROM documents),
totals AS (SELECT count(*)::BIGINT AS n_docs, sum(len(t))::BIGINT AS n_words FROM words WHERE len(t) > 0),
counts AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, len(t)::BIGINT AS n, unnest(t) AS term FROM words) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * max(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM counts, totals GROUP BY term),
scores AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_words))))::BIGINT AS score
           FROM wanted JOIN counts USING (term) JOIN weights USING (term), totals GROUP BY item_id, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 10
"""


def _host(url: str) -> str:
    return f"translate(coalesce(regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}')"


def url_sql(rules, damping: float, threshold: float, rounds: int = 120) -> str:
    """Rules and propagation of op 10; the walks take a fixed number of rounds, after which 3e-9 of the mass still moves."""
    fits = [
        (f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')", host + path, verdict)
        for verdict, host, path in sorted(rules, key=lambda r: -len(r[1] + r[2]))
    ]
    cases = lambda k: "CASE " + " ".join(f"WHEN {f[0]} THEN '{f[k]}'" for f in fits) + " END"
    rest = 1 - damping
    return f"""
WITH RECURSIVE parsed AS (SELECT page_id, {_host('url')} AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, html FROM pages),
ruled AS (SELECT page_id, host, path, {cases(1)} AS rule, {cases(2)} AS ruled FROM parsed),
hrefs AS (SELECT host AS src, unnest(regexp_extract_all(coalesce(html, ''), '(?is)<a\\s[^<>]*?\\bhref\\s*=\\s*["'']?([^"''>\\s]+)', 1)) AS link FROM parsed WHERE host <> ''),
links AS (SELECT src, CASE WHEN regexp_matches(link, '(?i)^[a-z][a-z0-9+.-]*://') THEN {_host('link')} WHEN starts_with(link, '//') THEN {_host("('x:' || link)")}
          WHEN regexp_matches(link, '(?i)^(mailto|javascript|tel|data):') THEN '' ELSE src END AS dst, count(*)::DOUBLE AS n FROM hrefs GROUP BY ALL HAVING dst <> ''),
edges AS (SELECT 'trust' AS kind, src AS host, dst AS target, n FROM links UNION ALL SELECT 'distrust', dst, src, n FROM links),
shares AS MATERIALIZED (SELECT kind, host, target, n / sum(n) OVER (PARTITION BY kind, host) AS share FROM edges),
seeds AS MATERIALIZED (SELECT host, max(a) AS allowed, max(b) AS blocked FROM (SELECT host, avg(CASE WHEN ruled = 'allow' THEN 1.0 ELSE 0 END) AS a,
          avg(CASE WHEN ruled = 'block' THEN 1.0 ELSE 0 END) AS b FROM ruled GROUP BY host UNION ALL SELECT DISTINCT dst, 0.0, 0.0 FROM links) GROUP BY host),
walk AS (
  SELECT 0 AS round, kind, host, seed, seed AS mass, 1.0::DOUBLE AS whole
  FROM (SELECT 'trust' AS kind, host, allowed AS seed FROM seeds UNION ALL SELECT 'distrust', host, blocked FROM seeds)
  UNION ALL
  SELECT w.round + 1, w.kind, w.host, w.seed, {rest} * w.seed + {damping} * coalesce(g.mass, 0), {rest} + {damping} * coalesce(g.whole, 0)
  FROM walk w LEFT JOIN (SELECT e.kind, e.target, sum(q.mass * e.share) AS mass, sum(q.whole * e.share) AS whole
                         FROM walk q JOIN shares e ON e.kind = q.kind AND e.host = q.host GROUP BY e.kind, e.target) g
  ON g.kind = w.kind AND g.target = w.host WHERE w.round < {rounds}),
judged AS (SELECT kind, host, greatest(seed, CASE WHEN whole - {rest} > 1e-9 THEN (mass - {rest} * seed) / (whole - {rest}) ELSE 0 END) AS score
           FROM walk WHERE round = {rounds}),
scores AS (SELECT host, max(score) FILTER (kind = 'trust') AS favour, max(score) FILTER (kind = 'distrust') AS suspicion FROM judged GROUP BY host)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN suspicion - favour > {threshold} THEN 'block' ELSE 'allow' END) AS verdict,
       round(favour, 4) AS favour, round(suspicion, 4) AS suspicion FROM ruled LEFT JOIN scores USING (host)
"""


def license_sql(templates, speaks: str, licence_file: str, threshold: float) -> str:
    """Op 3 over documents as files."""
    given = ", ".join(f"({k}, '{name}', '{body}')" for k, (name, body) in enumerate(templates))
    terms = lambda x: f"regexp_extract_all(lower({x}), '[a-z]+|[0-9]+(?:\\.[0-9]+)*')"
    return f"""
WITH files AS (SELECT source || '/' || lang || '/' || (doc_id // 1000)::VARCHAR || '/' || CASE WHEN regexp_matches(string_split(coalesce(text, ''),
       chr(10))[-1], '{speaks}') THEN 'LICENSE-' ELSE 'doc-' END || doc_id::VARCHAR AS path, coalesce(text, '') AS text FROM documents),
placed AS (SELECT path, regexp_replace(path, '/?[^/]*$', '') AS directory FROM files),
lines AS (SELECT DISTINCT path, line FROM (SELECT path, unnest(string_split(text, chr(10))) AS line FROM files) WHERE regexp_matches(line, '{speaks}')),
different AS (SELECT line, count(*) AS n FROM lines GROUP BY line), total AS (SELECT sum(n) AS total FROM different),
tf AS (SELECT line, n, term, count(*) AS tf FROM (SELECT line, n, unnest({terms('line')}) AS term FROM different) GROUP BY ALL),
idf AS (SELECT term, ln((max(total) + 1) / (sum(n) + 1)) + 1 AS idf FROM tf, total GROUP BY term),
weights AS (SELECT line, term, tf * idf AS w FROM tf JOIN idf USING (term)),
norms AS (SELECT line, sqrt(sum(w * w)) AS norm FROM weights GROUP BY line),
given(k, licence, body) AS (VALUES {given}),
wanted AS (SELECT k, licence, term, count(*) * coalesce(max(idf), max(ln(total + 1) + 1)) AS w FROM (SELECT k, licence, unnest({terms('body')}) AS term FROM given)
           LEFT JOIN idf USING (term), total GROUP BY ALL),
lengths AS (SELECT k, sqrt(sum(w * w)) AS norm FROM wanted GROUP BY k),
scores AS (SELECT a.line, b.licence, round(sum(a.w * b.w) / (max(n.norm) * max(l.norm)), 9) AS score FROM weights a JOIN wanted b USING (term)
           JOIN norms n ON n.line = a.line JOIN lengths l ON l.k = b.k GROUP BY a.line, b.k, b.licence),
best AS (SELECT line, licence, score FROM scores WHERE score >= {threshold} QUALIFY row_number() OVER (PARTITION BY line ORDER BY score DESC, licence) = 1),
own AS (SELECT path, licence, score FROM lines JOIN best USING (line) QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, licence) = 1),
spoken AS (SELECT directory, licence, score FROM own JOIN placed USING (path) WHERE regexp_matches(regexp_extract(path, '[^/]*$'), '{licence_file}')
           QUALIFY row_number() OVER (PARTITION BY directory ORDER BY score DESC, licence) = 1),
near AS (SELECT p.path, s.directory AS origin, s.licence, s.score FROM placed p JOIN spoken s ON p.directory = s.directory OR s.directory = ''
         OR starts_with(p.directory, s.directory || '/') QUALIFY row_number() OVER (PARTITION BY p.path ORDER BY len(s.directory) DESC) = 1)
SELECT p.path, coalesce(o.licence, n.licence) AS licence, coalesce(o.score, n.score) AS score, CASE WHEN o.path IS NOT NULL THEN 'own' ELSE n.origin END AS origin
FROM placed p LEFT JOIN own o USING (path) LEFT JOIN near n USING (path)
"""
