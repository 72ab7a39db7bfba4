"""DuckDB SQL for the queries that SQL can express."""

from brindle.llm.licenses import TEMPLATES
from brindle.llm.queries import URL_CHANGES

op8_mix_sources = r"""
WITH sized AS (
    SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
    FROM documents
), per_source AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighted AS (
    SELECT *, CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight,
           2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS words
    FROM per_source
), levelled AS (
    SELECT *, (words - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) > cap / weight AS is_full
    FROM weighted
), targets AS (
    SELECT source, source_size,
           CASE WHEN is_full THEN cap
                ELSE (words - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ()) / sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER () * weight END AS target
    FROM levelled
), expected AS (
    SELECT d.doc_id, d.source, d.size, t.source_size, t.target,
           CASE WHEN t.source_size > 0 THEN least(2.0::DOUBLE, t.target / t.source_size) ELSE 0 END AS copies,
           (CAST('0x' || substr(md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 12) AS BIGINT)::DOUBLE + 0.5) / 281474976710656.0::DOUBLE AS u
    FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), ranked AS (
    SELECT *, copies - floor(copies) AS part, (u / (1 - u)) / ((copies - floor(copies)) / (1 - (copies - floor(copies)))) AS odds FROM expected
), ordered AS (
    SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY odds / (1 + odds), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM ranked
)
SELECT doc_id, size, source_size, target,
       CAST((floor(copies) + CASE WHEN part > 0 AND before + size / 2.0::DOUBLE <= target - floor(copies) * source_size THEN 1 ELSE 0 END) * size AS BIGINT) AS taken,
       CAST(floor(copies) + CASE WHEN part > 0 AND before + size / 2.0::DOUBLE <= target - floor(copies) * source_size THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM ordered
"""

op1_chat_rotation = r"""
WITH turns AS (
    SELECT conv_id, CAST(turn AS BIGINT) AS turn, regexp_replace(coalesce(role, 'unknown'), '[^\p{L}\p{N}_.-]', '_', 'g') AS speaker,
           replace(coalesce(text, ''), '<|', '< |') AS text
    FROM conversations
), once AS (
    SELECT conv_id, turn, speaker, text, count(*) AS n FROM turns GROUP BY ALL
), speakers AS (
    SELECT DISTINCT conv_id, speaker AS perspective FROM turns WHERE speaker <> 'system'
), views AS (
    SELECT o.*, s.perspective, CAST(floor(o.turn / 64.0) AS BIGINT) AS part,
           '<|im_start|>' || CASE WHEN o.speaker = 'system' THEN 'system' WHEN o.speaker = s.perspective THEN 'assistant' ELSE 'user name=' || o.speaker END || chr(10) AS head,
           o.text || '<|im_end|>' AS body
    FROM once o JOIN speakers s ON o.conv_id IS NOT DISTINCT FROM s.conv_id
), placed AS (
    SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective, part ORDER BY turn, speaker, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS start
    FROM views
)
SELECT conv_id, perspective, part, CAST(count(*) AS BIGINT) AS n_messages, CAST(sum(n - 1) AS BIGINT) AS n_repeats,
       CAST(count(*) FILTER (speaker = perspective) AS BIGINT) AS n_trained,
       string_agg(head || body || chr(10), '' ORDER BY turn, speaker, text) AS text,
       coalesce(string_agg(CAST(start AS VARCHAR) || ':' || CAST(start + length(body) AS VARCHAR), ',' ORDER BY turn, speaker, text) FILTER (speaker = perspective), '') AS spans
FROM placed GROUP BY conv_id, perspective, part
"""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

op2_jaccard_join = rf"""
WITH RECURSIVE docs AS (
    SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
), places AS (
    SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM docs WHERE len(w) > 0
), shingles AS MATERIALIZED (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM places
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k
    FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL
), links AS MATERIALIZED (
    SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)
), edges AS (
    SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
    SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a
)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(r.b, d.doc_id)) AS component_id
FROM docs d LEFT JOIN sizes s USING (doc_id) LEFT JOIN (SELECT a, min(b) AS b FROM reach GROUP BY a) r ON r.a = d.doc_id
"""

op3_decontamination = rf"""
WITH docs AS (
    SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
    SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), item_places AS (
    SELECT item, w, least(10, len(w)) AS n, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM items WHERE len(w) > 0
), windows AS (
    SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM item_places
), doc_places AS (
    SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n
), hits AS MATERIALIZED (
    SELECT doc_id, item, p.n, i FROM doc_places p JOIN windows v ON v.n = p.n AND v.s = array_to_string(p.w[p.i:p.i + p.n - 1], ' ')
), words AS (
    SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id
), found AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""


def values(rows) -> str:
    return ", ".join("(" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in row) + ")" for row in rows)


op9_license_scan = rf"""
WITH templates AS (
    SELECT col0 AS template, col1 AS name, col2 AS text FROM (VALUES {values((i, *t) for i, t in enumerate(TEMPLATES))})
), texts AS (
    SELECT NULL::BIGINT AS doc_id, template, regexp_replace(lower(text), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g') AS norm FROM templates
    UNION ALL SELECT doc_id, NULL, regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g') FROM documents
), units AS (
    SELECT doc_id, template, unnest(string_split(norm, chr(10))) AS u FROM texts
    UNION ALL
    SELECT doc_id, template, replace(p, chr(10), ' ') FROM (SELECT doc_id, template, unnest(regexp_split_to_array(norm, '\n ?\n')) AS p FROM texts) WHERE contains(trim(p, ' ' || chr(10)), chr(10))
), numbered AS (
    SELECT row_number() OVER () AS id, doc_id, template, regexp_split_to_array(trim(u, ' '), ' +') AS w FROM units
), bigrams AS MATERIALIZED (
    SELECT DISTINCT id, doc_id, template, w[i] || ' ' || w[i + 1] AS g FROM (SELECT *, unnest(range(1, len(w))) AS i FROM numbered WHERE len(w) > 1)
), sized AS (
    SELECT *, count(*) OVER (PARTITION BY id) AS n FROM bigrams
), matches AS (
    SELECT u.doc_id, u.id, t.template, 2.0::DOUBLE * count(*) / (any_value(u.n) + any_value(t.n)) AS dice
    FROM sized u JOIN sized t ON u.g = t.g AND u.template IS NULL AND t.template IS NOT NULL
    GROUP BY ALL HAVING 2.0::DOUBLE * count(*) / (any_value(u.n) + any_value(t.n)) >= 0.8
), named AS (
    SELECT m.*, t.name FROM matches m JOIN templates t USING (template)
), found AS (
    SELECT doc_id, count(DISTINCT id) AS n_matches, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses,
           max(dice) AS best_dice FROM named GROUP BY doc_id
), best AS (
    SELECT n.doc_id, min(name) AS best_license FROM named n JOIN found f ON f.doc_id = n.doc_id AND f.best_dice = n.dice GROUP BY n.doc_id
)
SELECT d.doc_id, CAST(coalesce(n_matches, 0) AS BIGINT) AS n_matches, coalesce(licenses, '') AS licenses, best_license, best_dice
FROM documents d LEFT JOIN found USING (doc_id) LEFT JOIN best USING (doc_id)
"""

op10_url_filter = rf"""
WITH changes AS (
    SELECT col0 AS entry, col1 AS action, col2 AS list, CAST(col3 AS DATE) AS changed_on FROM (VALUES {values(URL_CHANGES)})
), spans AS (
    SELECT * FROM (SELECT *, lead(changed_on) OVER (PARTITION BY entry, list ORDER BY changed_on) AS until FROM changes) WHERE action = 'add'
), captures AS (
    SELECT page_id, url, DATE '2024-01-01' + CAST((page_id * 7) % 366 AS INTEGER) AS fetched_on,
           lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host,
           lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^?#]*)', 1)) AS path
    FROM pages
), active AS (
    SELECT page_id, entry, list FROM captures JOIN spans
    ON fetched_on >= changed_on AND (until IS NULL OR fetched_on < until) AND host <> ''
    AND CASE WHEN contains(entry, '/') THEN starts_with(rtrim(regexp_replace(host || path, '/+', '/', 'g'), '/') || '/', entry || '/')
             ELSE host = entry OR ends_with(host, '.' || entry) END
)
SELECT c.page_id, c.host, c.fetched_on, CAST(count(a.entry) AS BIGINT) AS n_active, arg_max(entry, (length(entry), list = 'block', entry)) AS decided_by,
       coalesce(arg_max(list, (length(entry), list = 'block', entry)) = 'block', false) AS blocked
FROM captures c LEFT JOIN active a USING (page_id) GROUP BY ALL
"""
