"""DuckDB SQL for the queries that it can express. It states results, not methods."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Sets of shingles, pairs that share one, then components by a recursive closure.
NEAR_DEDUP = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN []
    WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_distinct([words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] for i in range(1, len(words) - 1)]) END AS sh FROM w
), r AS (
  SELECT min(doc_id) AS rep, list_sort(sh) AS sh FROM s WHERE len(sh) > 0 GROUP BY list_sort(sh)
), x AS (SELECT rep, len(sh) AS n, unnest(sh) AS g FROM r
), p AS (
  SELECT a.rep AS a, b.rep AS b FROM x a JOIN x b ON a.g = b.g AND a.rep < b.rep
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), e AS (SELECT a, b FROM p UNION SELECT b, a FROM p
), c(node, reach) AS (
  SELECT rep, rep FROM r UNION SELECT c.node, e.b FROM c JOIN e ON c.reach = e.a
), k AS (SELECT node, min(reach) AS component_id FROM c GROUP BY node)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(k.component_id, s.doc_id) AS component_id,
  s.doc_id = coalesce(k.component_id, s.doc_id) AS kept
FROM s LEFT JOIN r ON list_sort(s.sh) = r.sh LEFT JOIN k ON r.rep = k.node
"""

#: Vectors as whole numbers, all scores of the queries, the best five.
TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, r.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.w, r.w), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM v q JOIN v r ON q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id
), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM k WHERE n <= 5
"""


def _licenses() -> str:
    from gazetta.llm.licenses import DIGESTS, IDENTIFIERS, KNOWN, SPELLINGS

    def digest(x: str) -> str:
        x = rf"regexp_replace(lower({x}), '(?m)^[ \t]*(copyright[ \t]*(\(c\)|©|[0-9]{{4}})|\(c\)|©)[^\n]*$', '', 'g')"
        for old, new in SPELLINGS:
            x = f"replace({x}, '{old}', '{new}')"
        x = f"trim(regexp_replace({x}, '[^a-z0-9]+', ' ', 'g'))"
        return f"CASE WHEN {x} <> '' THEN sha256({x}) END"

    known = ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in (*KNOWN, *IDENTIFIERS))
    digests = ", ".join(f"('{k}', '{d}')" for k, d in DIGESTS)
    return f"""
WITH known AS (SELECT {digest("body")} AS digest, min(license) AS license FROM (VALUES {known}) t(license, body) GROUP BY 1 UNION ALL SELECT d, l FROM (VALUES {digests}) t(l, d)
), d AS (SELECT row_number() OVER () AS r, doc_id, text, {digest("text")} AS digest FROM documents
), l AS (SELECT r, {digest("line")} AS digest FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE line <> ''
), f AS (SELECT r, array_to_string(list_sort(list_distinct(list(license))), ',') AS line_licenses, count(*) AS n_lines FROM l JOIN known USING (digest) GROUP BY r)
SELECT d.doc_id, d.digest, known.license, coalesce(f.line_licenses, '') AS line_licenses, coalesce(f.n_lines, 0) AS n_lines
FROM d LEFT JOIN known USING (digest) LEFT JOIN f USING (r)
"""


LICENSES = _licenses()

#: Matches marked in the text, places from running lengths, owners per value.
SECRETS = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, CAST(doc_id AS VARCHAR) AS repo, source AS owner, translate(coalesce(text, ''), chr(1) || chr(2) || chr(3), chr(4) || chr(4) || chr(4)) AS t FROM documents
), m AS (
  SELECT r, repo, owner, 'assign' AS kind, 1 AS o, 12 AS least, regexp_replace(t, '((?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?)([A-Za-z0-9+/_.=-]+)', chr(1) || '\1' || chr(2) || '\2' || chr(3), 'g') AS x FROM d
  UNION ALL SELECT r, repo, owner, 'access', 2, 18, regexp_replace(t, '(AKIA[A-Z0-9]+)', chr(1) || chr(2) || '\1' || chr(3), 'g') FROM d
  UNION ALL SELECT r, repo, owner, 'hex', 3, 16, regexp_replace(t, '([0-9a-f]{16,})', chr(1) || chr(2) || '\1' || chr(3), 'g') FROM d
  UNION ALL SELECT r, repo, owner, 'token', 4, 24, regexp_replace(t, '([A-Za-z0-9_-]{24,})', chr(1) || chr(2) || '\1' || chr(3), 'g') FROM d
), p AS (
  SELECT r, repo, owner, kind, o, least, unnest(string_split(x, chr(1))) AS part, generate_subscripts(string_split(x, chr(1)), 1) AS i FROM m WHERE contains(x, chr(1))
), q AS (
  SELECT *, CASE WHEN i > 1 THEN split_part(part, chr(2), 1) ELSE '' END AS head, CASE WHEN i > 1 THEN split_part(split_part(part, chr(2), 2), chr(3), 1) END AS value,
    coalesce(sum(length(part) - CASE WHEN i > 1 THEN 2 ELSE 0 END) OVER (PARTITION BY r, kind ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM p
), s AS (
  SELECT r, repo, owner, kind, o, CAST(start AS BIGINT) AS start, CAST(start + length(head) + length(value) AS BIGINT) AS stop, value FROM q
  WHERE i > 1 AND length(value) >= least AND (kind <> 'token' OR (regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[0-9]')))
), w AS (SELECT value, count(DISTINCT owner) + CAST(bool_or(owner IS NULL) AS INTEGER) AS owners, count(DISTINCT (owner, repo)) AS repos FROM s GROUP BY value
), f AS (SELECT s.*, owners = 1 AND repos <= 3 AS live, owners >= 3 AS copied FROM s JOIN w USING (value)
), k AS (
  SELECT * FROM f WHERE kind <> 'token' OR (live AND NOT EXISTS (SELECT 1 FROM f b WHERE b.r = f.r AND b.kind <> 'token' AND b.start < f.stop AND f.start < b.stop))
), g AS (
  SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, o) FILTER (kind <> 'token') AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, o) AS spans,
    count(*) FILTER (live) AS n_live, count(*) FILTER (copied) AS n_copied FROM k GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied FROM d LEFT JOIN g USING (r)
"""

#: Kept terms per language, counts of every group and term, then all pairs and the first ten terms.
DIVERGENCE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), t AS (SELECT r, lang, source, unnest(w) AS term FROM d
), kept AS MATERIALIZED (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10
), v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang
), c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL
), g AS MATERIALIZED (
  SELECT lang, source, coalesce(v, 0) AS v, coalesce((SELECT sum(n) FROM c WHERE c.lang = x.lang AND c.source = x.source), 0)::HUGEINT AS total
  FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN v USING (lang)
), p AS MATERIALIZED (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.total + 2 * g.v) AS p
  FROM g JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term
), q AS (
  SELECT c.lang, c.term, 1 + (1000000000::HUGEINT * (sum(c.n) + 2)) // (any_value(l.total) + 2 * any_value(l.v)) AS q
  FROM c JOIN (SELECT lang, sum(total) AS total, any_value(v) AS v FROM g GROUP BY lang) l USING (lang) GROUP BY c.lang, c.term
), s AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), f AS (
  SELECT p.lang, p.source, 'term' AS part, p.term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p > q
), k AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM f)
)
SELECT lang, source, part, item, value, rank FROM k WHERE part = 'pair' OR rank <= 10
"""


def _clusters(rounds: int = 5) -> str:
    """Every round compares all vectors with all centroids."""
    steps = []
    for i in range(rounds + 1):
        steps.append(
            f"""a{i} AS MATERIALIZED (
  SELECT r, min((list_sum(list_transform(list_zip(v.w, c{i}.w), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), c)) AS best FROM v, c{i} GROUP BY r
)"""
        )
        if i < rounds:
            steps.append(
                f"""m{i} AS (
  SELECT best[2] AS c, j, sum(w[j])::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{i} JOIN v USING (r), (SELECT unnest(range(1, 65)) AS j) GROUP BY best[2], j
), n{i} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS w FROM m{i} GROUP BY c
), c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(n{i}.w, c{i}.w) AS w FROM c{i} LEFT JOIN n{i} USING (c))"""
            )
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS INTEGER) AS c, w FROM v QUALIFY c < 40
), {", ".join(steps)}
SELECT vec_id, best[2] AS cluster, best[1] AS distance, CAST(sum(best[1]) OVER (PARTITION BY best[2]) AS BIGINT) AS cluster_inertia,
  CAST(sum(best[1]) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{rounds}.w, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (r) JOIN c{rounds} ON c = best[2]
"""


CLUSTERS = _clusters()
