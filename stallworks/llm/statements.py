"""SQL of the operators that SQL can express, over the same tables."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"

# Every 13 aligned words with at most two differences, or whole items of 9 to 12 words with at
# most one, on any alignment that shares a word.
DECONTAMINATION = rf"""
WITH doc AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w
    FROM documents
), item AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w
    FROM benchmark
), item_size AS (
    SELECT item_id, len(w) AS n, least(13, len(w)) AS width FROM item WHERE len(w) >= 9
), doc_word AS (
    SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS at FROM doc
), item_word AS (
    SELECT item_id, unnest(w) AS word, generate_subscripts(w, 1) AS at
    FROM item SEMI JOIN item_size USING (item_id)
), equal AS (
    SELECT doc_id, item_id, d.at - i.at AS shift, i.at AS item_at
    FROM doc_word AS d JOIN item_word AS i USING (word)
), run AS (
    SELECT doc_id, item_id, shift, width, n,
        count(*) OVER (PARTITION BY doc_id, item_id, shift) AS matched,
        count(*) OVER (PARTITION BY doc_id, item_id, shift ORDER BY item_at
            RANGE BETWEEN CURRENT ROW AND 12 FOLLOWING) AS near
    FROM equal JOIN item_size USING (item_id)
)
SELECT doc_id, item_id, max(matched) AS matched_words
FROM run WHERE near >= width - floor(width * 2 / 13) GROUP BY doc_id, item_id
"""

MIXING = rf"""
WITH doc AS (
    SELECT doc_id, source,
        len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size
    FROM documents
), source_total AS (
    SELECT source, sum(size)::BIGINT AS source_size,
        row_number() OVER (ORDER BY source NULLS LAST) AS place
    FROM doc GROUP BY source
), weighed AS (
    SELECT *, [5, 2, 1][(place - 1) % 3 + 1] AS weight, 2 * source_size AS cap,
        sum(source_size) OVER () * 150 AS budget
    FROM source_total
), filled AS (
    SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, place
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
        sum(weight) OVER (ORDER BY cap / weight, place
            ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_on
    FROM weighed
), decided AS (
    SELECT *, (cap::HUGEINT * weight_on + full_before * weight) * 100 <= budget * weight AS is_full
    FROM filled
), target AS (
    SELECT source, source_size, budget, CASE WHEN is_full THEN cap::DOUBLE ELSE
        ((budget - 100 * sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ()) * weight)::DOUBLE
        / (100 * sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ())::DOUBLE END AS target
    FROM decided
), queued AS (
    SELECT doc.*, source_size, target, budget,
        sum(size) OVER (PARTITION BY doc.source
            ORDER BY md5('mix' || coalesce(doc_id::VARCHAR, '')), doc_id, size)::BIGINT AS offered
    FROM doc JOIN target ON doc.source IS NOT DISTINCT FROM target.source
), entry AS (
    SELECT queued.*, pass,
        CASE WHEN target > 0 THEN (offered + pass * source_size)::DOUBLE / target ELSE 0 END AS finish
    FROM queued, (VALUES (0), (1)) AS passes(pass)
), spent AS (
    SELECT *, sum(size) OVER (ORDER BY finish, source NULLS FIRST, pass, offered, doc_id, size
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS spent
    FROM entry
)
SELECT doc_id, size, source_size, target,
    sum(CASE WHEN 100 * spent <= budget THEN size ELSE 0 END)::BIGINT AS taken
FROM spent GROUP BY doc_id, size, source_size, target, source
"""

# Rules as text are host and path together; links that pages declare, all tags of both kinds, join
# addresses. Targets are resolved against the first base of their page, or its url.
_AFTER = "CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END"
_ASCII = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_FORMS = rf'''
    SELECT url, translate(regexp_extract({_AFTER}, '^([^/?#]*)', 1), {_ASCII}) AS host,
        regexp_extract({_AFTER}, '^[^/?#]*([^?#]*)', 1) AS path,
        regexp_extract({_AFTER}, '^[^?#]*(\?[^#]*)?', 1) AS query
    FROM place'''


def _resolved(base: str, target: str) -> str:
    named = f"regexp_extract({target}, '^[^?#]*')"
    folder = f"regexp_extract({base}, '^[^/?#]*://[^/?#]*([^?#]*/)?', 1)"
    rooted = f'''CASE WHEN {named} LIKE '/%' THEN {named}
        WHEN {folder} = '' THEN '/' || {named} ELSE {folder} || {named} END'''
    parts = f"string_split({rooted}, '/')"
    undotted = f'''array_to_string(list_reduce(list_transform({parts}, lambda x: [x]), lambda done, part:
        CASE WHEN part[1] = '..' THEN done[1:greatest(len(done) - 1, 1)]
             WHEN part[1] = '.' THEN done ELSE list_concat(done, part) END), '/')
        || CASE WHEN {parts}[-1] IN ('.', '..') THEN '/' ELSE '' END'''
    site = f"regexp_extract({base}, '^[^/?#]*://[^/?#]*')"
    return rf'''CASE WHEN {target} = '' THEN NULL
        WHEN regexp_matches({target}, '^[^/?#]*://') THEN {target}
        WHEN regexp_matches({target}, '^[A-Za-z][A-Za-z0-9+.\-]*:') THEN NULL
        WHEN coalesce({site}, '') = '' THEN NULL
        WHEN {target} LIKE '//%' THEN regexp_extract({base}, '^([^/?#]*:)//', 1) || {target}
        WHEN {named} = '' THEN {site} || regexp_extract({base}, '^[^/?#]*://[^/?#]*([^?#]*)', 1)
            || regexp_extract({target}, '[?#].*')
        ELSE {site} || {undotted} || regexp_extract({target}, '[?#].*') END'''


URL_FILTER = rf'''
WITH RECURSIVE declared AS (
    SELECT url, unnest(list_concat(
        list_transform(regexp_extract_all(html, '(?i)<link\b[^>]*\brel=["'']?canonical\b[^>]*>'),
            lambda tag: regexp_extract(tag, '(?i)\bhref=["'']?([^"''\s>]+)', 1)),
        list_transform(regexp_extract_all(html, '(?i)<meta\b[^>]*\bhttp-equiv=["'']?refresh\b[^>]*>'),
            lambda tag: regexp_extract(tag, '(?i)\burl=["'']?([^"''\s>;]+)', 1)))) AS target,
        regexp_extract(regexp_extract(html, '(?i)<base\b[^>]*\bhref=[^>]*>'),
            '(?i)\bhref=["'']?([^"''\s>]+)', 1) AS named
    FROM pages
), based AS (
    SELECT url, target, coalesce({_resolved('url', 'named')}, url) AS base FROM declared
), link AS (
    SELECT url, {_resolved('base', 'target')} AS target FROM based
), place AS (
    SELECT url FROM pages WHERE url IS NOT NULL
    UNION SELECT url FROM link WHERE target IS NOT NULL AND url IS NOT NULL
    UNION SELECT target FROM link WHERE target IS NOT NULL
), form AS ({_FORMS}
), plain AS (
    SELECT *, CASE WHEN url LIKE '%://%'
        THEN translate(substr(url, 1, strpos(url, '://') + 2), {_ASCII}) || host
            || CASE WHEN path = '' THEN '/' ELSE path END || query END AS plain FROM form
), rule(verdict, rule_host, rule_path) AS (VALUES
    ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
    ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), fitting AS (
    SELECT url, rule_host || rule_path AS rule, verdict, row_number() OVER (
        PARTITION BY url ORDER BY length(rule_host || rule_path) DESC) AS nth
    FROM plain JOIN rule ON (host = rule_host OR ends_with(host, '.' || rule_host))
        AND starts_with(path, rule_path)
), ruled AS (
    SELECT plain.*, rule, verdict FROM plain LEFT JOIN fitting ON plain.url = fitting.url AND nth = 1
), edge AS (
    SELECT a.plain AS a, b.plain AS b FROM link
    JOIN plain AS a ON a.url = link.url JOIN plain AS b ON b.url = link.target
    WHERE a.plain <> b.plain
), both_ways AS (
    SELECT a, b FROM edge UNION SELECT b, a FROM edge
), reach AS (
    SELECT a AS node, a AS other FROM both_ways
    UNION SELECT node, b FROM reach JOIN both_ways ON other = a
), component AS (
    SELECT node, min(other) AS component FROM reach GROUP BY node
), grouped AS (
    SELECT ruled.*, coalesce(component, plain) AS component
    FROM ruled LEFT JOIN component ON plain = node
), decided AS (
    SELECT component, bool_or(verdict = 'allow') AS allowed
    FROM grouped WHERE verdict IS NOT NULL GROUP BY component
)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule,
    coalesce(verdict, CASE WHEN NOT allowed THEN 'block' ELSE 'allow' END) AS verdict
FROM pages LEFT JOIN grouped USING (url) LEFT JOIN decided USING (component)
'''

# Sets of 2-word shingles, links by counting shared ones, components by reachability.
NEAR_DUPLICATES = rf"""
WITH RECURSIVE doc AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w
    FROM documents
), shingle AS (
    SELECT DISTINCT doc_id, w[pos] || ' ' || w[pos + 1] AS s
    FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS pos FROM doc)
    UNION SELECT doc_id, w[1] FROM doc WHERE len(w) = 1
), size AS (
    SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
), shared AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n
    FROM shingle AS x JOIN shingle AS y ON x.s = y.s AND x.doc_id < y.doc_id
    GROUP BY x.doc_id, y.doc_id
), link AS (
    SELECT a, b FROM shared JOIN size AS x ON x.doc_id = a JOIN size AS y ON y.doc_id = b
    WHERE 100 * shared.n >= 80 * (x.n + y.n - shared.n)
), both_ways AS (
    SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach AS (
    SELECT a AS node, a AS other FROM both_ways
    UNION SELECT node, b FROM reach JOIN both_ways ON other = a
), component AS (
    SELECT node, min(other) AS least FROM reach GROUP BY node
)
SELECT doc.doc_id, coalesce(n, 0) AS n_shingles, coalesce(least, doc.doc_id) AS component_id,
    doc.doc_id = coalesce(least, doc.doc_id) AS kept
FROM doc LEFT JOIN size USING (doc_id) LEFT JOIN component ON node = doc.doc_id
"""

SUBSTRINGS = rf"""
WITH doc AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents
), block AS (
    SELECT doc_id, pos, array_to_string(list_slice(w, pos, pos + 49), ' ') AS words
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS pos FROM doc)
), repeated AS (
    SELECT doc_id, pos FROM (
        SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY words) AS least FROM block)
    WHERE least < doc_id
), word AS (
    SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM doc
), judged AS (
    SELECT word.doc_id, word.pos, word, coalesce(max(repeated.pos) OVER (
        PARTITION BY word.doc_id ORDER BY word.pos) > word.pos - 50, false) AS gone
    FROM word LEFT JOIN repeated ON word.doc_id = repeated.doc_id AND word.pos = repeated.pos
), kept AS (
    SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed,
        coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone), '') AS text
    FROM judged GROUP BY doc_id
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
    sha256(coalesce(kept.text, '')) AS kept_sha256
FROM doc LEFT JOIN kept USING (doc_id)
"""

EMBEDDINGS = """
WITH RECURSIVE vector AS (
    SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
), link AS (
    SELECT x.vec_id AS a, y.vec_id AS b FROM vector AS x JOIN vector AS y
    ON x.vec_id <> y.vec_id AND list_cosine_similarity(x.v, y.v) >= 0.9
), reach AS (
    SELECT a AS node, a AS other FROM link
    UNION SELECT node, b FROM reach JOIN link ON other = a
), component AS (
    SELECT node, min(other) AS least FROM reach GROUP BY node
), degree AS (
    SELECT a, count(*) AS n FROM link GROUP BY a
)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(least, vec_id) AS component_id,
    vec_id = coalesce(least, vec_id) AS kept
FROM vector LEFT JOIN degree ON a = vec_id LEFT JOIN component ON node = vec_id
"""

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

# Every kept term in every group, also where it does not occur.
SOURCE_DIVERGENCE = rf"""
WITH doc AS (
    SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), {_LOWER}),
            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
), met AS (
    SELECT d, lang, source, unnest(terms) AS term FROM doc
), kept AS (
    SELECT lang, term, count(*) AS n FROM met GROUP BY lang, term HAVING count(DISTINCT d) >= 3
), grp AS (
    SELECT DISTINCT lang, source FROM doc
), counted AS (
    SELECT lang, source, term, count(*) AS n FROM met GROUP BY lang, source, term
), cell AS (
    SELECT kept.lang, grp.source, kept.term, coalesce(counted.n, 0)::HUGEINT AS n, kept.n AS of_lang
    FROM kept JOIN grp ON kept.lang = grp.lang
    LEFT JOIN counted ON counted.lang = kept.lang AND counted.source = grp.source
        AND counted.term = kept.term
), scaled AS (
    SELECT lang, source, term, n,
        1 + (1000000000 * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source)
            + count(*) OVER (PARTITION BY lang, source)) AS p,
        1 + (1000000000 * (of_lang + 1)::HUGEINT) // (sum(of_lang) OVER (PARTITION BY lang, source)
            + count(*) OVER (PARTITION BY lang, source)) AS q
    FROM cell
), pair AS (
    SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value
    FROM scaled AS x JOIN scaled AS y ON x.lang = y.lang AND x.term = y.term
    WHERE x.source <> y.source GROUP BY x.lang, x.source, y.source
), figure AS (
    SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0) AS value
    FROM grp AS x JOIN grp AS y ON x.lang = y.lang AND x.source <> y.source
    LEFT JOIN pair ON pair.lang = x.lang AND pair.source = x.source AND pair.item = y.source
    UNION ALL
    SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM scaled WHERE n > 0 AND p > q
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
    FROM figure
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM ranked WHERE part = 'pair' OR rank <= 200
"""

COLLOCATIONS = rf"""
WITH piece AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
        SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
            translate(coalesce(text, ''), {_LOWER}), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents)
), place AS (
    SELECT lang, w, unnest(range(1, len(w) + 1)) AS pos FROM piece
), phrase AS (
    SELECT lang, size, array_to_string(list_slice(w, pos, pos + size - 1), ' ') AS phrase,
        count(*) AS f, any_value(list_slice(w, pos, pos + size - 1)) AS w
    FROM place, (VALUES (1), (2), (3), (4)) AS sizes(size)
    WHERE pos + size - 1 <= len(w) GROUP BY ALL
), total AS (
    SELECT lang, sum(f)::BIGINT AS n FROM phrase WHERE size = 1 GROUP BY lang
), candidate AS (
    SELECT lang, phrase, w, size, f AS a FROM phrase WHERE size > 1 AND f >= 30
), cut AS (
    SELECT c.lang, c.phrase, c.a, k, x.f AS l, y.f AS r,
        (2000000 * c.a::HUGEINT // (x.f + y.f))::BIGINT AS score
    FROM (SELECT *, unnest(range(1, size)) AS k FROM candidate) AS c
    JOIN phrase AS x ON x.lang = c.lang AND x.size = k
        AND x.phrase = array_to_string(list_slice(c.w, 1, k), ' ')
    JOIN phrase AS y ON y.lang = c.lang AND y.size = c.size - k
        AND y.phrase = array_to_string(list_slice(c.w, k + 1, c.size), ' ')
), scored AS (
    SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
    SELECT lang, array_to_string(list_slice(w, pos, pos + part - 1), ' ') AS phrase, max(a) AS longer
    FROM (SELECT *, unnest(range(1, size - part + 2)) AS pos FROM (
        SELECT *, unnest(range(2, size)) AS part FROM candidate))
    GROUP BY ALL
), ranked AS (
    SELECT scored.*, row_number() OVER (
        PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
    FROM scored LEFT JOIN inside USING (lang, phrase)
    WHERE longer IS NULL OR 100 * longer < 80 * a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""

STATEMENTS: dict[str, str] = {
    "op1_decontamination": DECONTAMINATION,
    "op3_mixing": MIXING,
    "op5_near_duplicates": NEAR_DUPLICATES,
    "op8_url_filter": URL_FILTER,
    "op9_substrings": SUBSTRINGS,
    "op10_embeddings": EMBEDDINGS,
    "op11_source_divergence": SOURCE_DIVERGENCE,
    "op13_collocations": COLLOCATIONS,
}
