"""SQL of the queries that SQL can express, for a second engine: substrings, Jaccard components, decontamination, url filters, collocations."""

from __future__ import annotations

LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACED = r"'[^\x20\x09-\x0D]+'"
LETTERS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def words(text: str, pattern: str) -> str:
    return f"coalesce(regexp_extract_all({text}, {pattern}), [])"


def joined(start: str, n: str) -> str:
    """``n`` words from the one at ``start``; words hold no space."""
    return f"array_to_string(w[{start}:{start} + {n} - 1], ' ')"


OP1 = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words('text', SPACED)} AS w FROM documents),
 runs AS (SELECT r, s, sha256({joined('s', '35')}) AS h FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS s FROM d)),
 gone AS (SELECT DISTINCT r, unnest(range(s, s + 35)) AS i FROM runs SEMI JOIN (SELECT h FROM runs GROUP BY h HAVING count(*) > 1) USING (h)),
 each_word AS (SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
 sums AS (SELECT e.r, count(g.i) AS n_removed, string_agg(word, ' ' ORDER BY e.i) FILTER (WHERE g.i IS NULL) AS kept FROM each_word e LEFT JOIN gone g USING (r, i) GROUP BY e.r)
 SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN sums USING (r)"""

OP2 = f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {words(LOWER, SPACED)} AS w FROM documents),
 shingles AS (SELECT DISTINCT r, sha256({joined('s', '5')}) AS h FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS s FROM d WHERE len(w) > 0)),
 sets AS (SELECT r, count(*) AS n, sha256(string_agg(h, '' ORDER BY h)) AS class FROM shingles GROUP BY r),
 classes AS (SELECT class, min(r) AS r, any_value(n) AS n FROM sets GROUP BY class),
 own AS (SELECT class, n, h FROM classes JOIN shingles USING (r)),
 pairs AS (SELECT a.class AS x, b.class AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS both_have FROM own a JOIN own b ON a.h = b.h AND a.class <> b.class GROUP BY ALL),
 links AS (SELECT x, y FROM pairs WHERE 100 * both_have >= 75 * (nx + ny - both_have)),
 reach AS (SELECT class AS x, class AS y FROM classes UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y),
 least AS (SELECT reach.x AS class, min(d.doc_id) AS c FROM reach JOIN sets s ON s.class = reach.y JOIN d ON d.r = s.r GROUP BY reach.x)
 SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, doc_id) AS component_id FROM d LEFT JOIN sets USING (r) LEFT JOIN least USING (class)"""

OP8 = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words(LOWER, LETTERS)} AS w FROM documents),
 b AS (SELECT item_id, w, least(len(w), 10) AS n FROM (SELECT item_id, {words(LOWER, LETTERS)} AS w FROM benchmark) WHERE len(w) > 0),
 asked AS (SELECT DISTINCT item_id, n, {joined('s', 'n')} AS run FROM (SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) AS s FROM b)),
 said AS (SELECT r, n, s, {joined('s', 'n')} AS run FROM (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM asked))),
 met AS (SELECT r, n, s, item_id FROM said JOIN asked USING (n, run)),
 hit AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(s, s + n)) AS i FROM met) GROUP BY r),
 items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM met) GROUP BY r)
 SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)"""

LOWER_URL = LOWER.replace("text", "{0}")


def address(url: str) -> str:
    """Without scheme and fragment, host in lower case."""
    host, rest = f"regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1)", f"regexp_extract({url}, '(?s)^.*?://[^/?#]*([^#]*)', 1)"
    return f"CASE WHEN {host} <> '' THEN {LOWER_URL.format(host)} || CASE WHEN {rest} = '' THEN '/' ELSE {rest} END END"


def ruled(host: str, path: str, verdict: int) -> str:
    """The rule that wins (verdict 0) or its verdict (1)."""
    by_length = ["example.org/en/1 block", "example.org/es/ block", "com/fr/ allow", "com/de/ block", "org/ allow"]
    when = []
    for rule, says in map(str.split, by_length):
        h, p = rule.split("/", 1)
        when.append(f"WHEN ({host} = '{h}' OR ends_with({host}, '.{h}')) AND starts_with({path}, '/{p}') THEN '{says if verdict else rule}'")
    return f"CASE {' '.join(when)} END"


TAG = "unnest(regexp_extract_all(html, '(?i)<{0}\\b[^>]*>'))"
OP11 = rf"""WITH RECURSIVE p AS (SELECT page_id, url, html, {LOWER_URL.format("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")} AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, {address('url')} AS node FROM pages),
 named AS (SELECT url, regexp_extract(tag, '(?i)\bhref\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', 1) || regexp_extract(tag, '(?i)\bhref\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', 2) || regexp_extract(tag, '(?i)\bhref\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', 3) AS t FROM (SELECT url, {TAG.format('link')} AS tag FROM pages) WHERE regexp_matches(tag, '(?i)\brel\s*=\s*["'']?canonical["''\s/>]')
  UNION ALL SELECT url, regexp_extract(tag, '(?i)\burl\s*=\s*["'']?([^"''>]+)', 1) FROM (SELECT url, {TAG.format('meta')} AS tag FROM pages) WHERE regexp_matches(tag, '(?i)\bhttp-equiv\s*=\s*["'']?refresh["''\s/>]')),
 spelled AS (SELECT url, trim(replace(t, '&amp;', '&')) AS t FROM named WHERE t <> ''),
 whole AS (SELECT url, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t WHEN starts_with(t, '//') THEN regexp_extract(url, '(?s)^(.*?):', 1) || ':' || t
   WHEN starts_with(t, '/') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*') || t WHEN regexp_matches(t, '^[?#]') THEN regexp_extract(url, '(?s)^.*?://[^?#]*') || t
   ELSE regexp_extract(url, '(?s)^.*?://[^/?#]*') || coalesce(nullif(regexp_extract(url, '(?s)^.*?://[^/?#]*(/(?:[^?#]*/)?)', 1), ''), '/') || t END AS t FROM spelled),
 half AS (SELECT DISTINCT {address('url')} AS a, {address('t')} AS b FROM whole),
 edges AS (SELECT a, b FROM half WHERE a IS NOT NULL AND b IS NOT NULL UNION SELECT b, a FROM half WHERE a IS NOT NULL AND b IS NOT NULL),
 nodes AS (SELECT DISTINCT a AS node, regexp_extract(a, '^[^/?]*') AS host, regexp_extract(a, '(?s)^[^/?]*([^?]*)', 1) AS path FROM edges),
 blocked AS (SELECT node FROM nodes WHERE {ruled('host', 'path', 1)} = 'block' UNION SELECT b FROM blocked JOIN edges ON a = node)
 SELECT page_id, host, path, {ruled('host', 'path', 0)} AS rule, coalesce({ruled('host', 'path', 1)}, CASE WHEN blocked.node IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict FROM p LEFT JOIN blocked USING (node)"""

OP13 = f"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
 w AS (SELECT lang, {words('piece', r"'[^\x20\x09]+'")} AS w FROM pieces),
 runs AS (SELECT lang, m, {joined('s', 'm')} AS p FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM w, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(w) >= m)),
 f AS (SELECT lang, m, p, count(*) AS c FROM runs GROUP BY ALL),
 n AS (SELECT lang, sum(c) AS n FROM f WHERE m = 1 GROUP BY lang),
 c AS (SELECT lang, m, p, c AS a, string_split(p, ' ') AS w FROM f WHERE m > 1 AND c >= 30),
 inner_ AS (SELECT lang, p, max(a) AS most FROM (SELECT lang, a, array_to_string(w[s:s + k - 1], ' ') AS p FROM (SELECT lang, a, w, k, unnest(range(1, m - k + 2)) AS s FROM c, (SELECT unnest([2, 3]) AS k) WHERE k < m)) GROUP BY lang, p),
 kept AS (SELECT c.* FROM c LEFT JOIN inner_ i USING (lang, p) WHERE most IS NULL OR 100 * most::HUGEINT < 80 * a::HUGEINT),
 cuts AS (SELECT lang, m, p, a, k, array_to_string(w[1:k], ' ') AS lp, array_to_string(w[k + 1:m], ' ') AS rp FROM (SELECT *, unnest(range(1, m)) AS k FROM kept)),
 scored AS (SELECT x.lang, x.p, x.a, x.k, l.c AS l, r.c AS r, 2000000::HUGEINT * a // (l.c::HUGEINT + r.c) AS score FROM cuts x JOIN f l ON l.lang = x.lang AND l.p = x.lp JOIN f r ON r.lang = x.lang AND r.p = x.rp),
 worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1)
 SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank, p AS phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM worst JOIN n USING (lang) QUALIFY rank <= 2000"""

ORACLES = {"op1_substring_dedup": OP1, "op2_jaccard_join": OP2, "op8_decontamination": OP8, "op11_url_filters": OP11, "op13_collocations": OP13}
