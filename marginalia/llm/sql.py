"""DuckDB SQL for the queries of this subpackage that SQL can express, over the same tables."""

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

NEAR_DEDUP = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, {_WORDS.format(f"translate(coalesce(text, ''), '{_UP}', '{_LOW}')")} AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) ELSE [array_to_string(w, ' ')] END) AS g
  FROM w WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * n_both >= 85 * (x.n + y.n - n_both)),
e2 AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(node, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.node, e2.b FROM r JOIN e2 ON r.reach = e2.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT node, min(reach) AS component_id FROM r GROUP BY node) c ON c.node = d.doc_id
"""

_BENCH_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '" + _UP + "', '" + _LOW + r"'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, {_BENCH_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_BENCH_WORDS} AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, unnest(list_transform(range(1, len(w) - least(len(w), 13) + 2), lambda i: array_to_string(w[i:i + least(len(w), 13) - 1], ' '))) AS g FROM b WHERE len(w) > 0),
g AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS s, w FROM d CROSS JOIN (SELECT DISTINCT n FROM i)),
o AS (SELECT g.doc_id, g.s, g.n, i.item_id FROM g JOIN i ON i.n = g.n AND i.g = array_to_string(g.w[g.s:g.s + g.n - 1], ' ')),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT doc_id, s, n FROM o)) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM o) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id
"""

MIX = rf"""
WITH d AS (SELECT doc_id, source, CAST(len({_WORDS.format("coalesce(text, '')")}) AS BIGINT) AS size, md5('0:' || coalesce(CAST(doc_id AS VARCHAR), 'text:' || coalesce(text, ''))) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
n AS (SELECT *, 3 * source_size AS cap, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
t AS (SELECT *, cap * (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) <= (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) * weight AS capped
      FROM n WINDOW b AS (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT source, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE CAST((sum(source_size) OVER () - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ()) * weight AS DOUBLE) / CAST(sum(CASE WHEN capped THEN 0 ELSE weight END) OVER () AS DOUBLE) END AS target FROM t),
p AS (SELECT d.doc_id, d.source, d.size, g.source_size, g.target, CAST(floor(g.target + 0.5) AS BIGINT) AS budget,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, source, size, source_size, target,
       CAST(CASE WHEN source_size > 0 THEN budget // source_size * size + least(size, greatest(0, budget - budget // source_size * source_size - start)) ELSE 0 END AS BIGINT) AS taken
FROM p
"""

WARC = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT p.page_id, p.payload_bytes, p.payload_digest, CASE WHEN f.first < p.page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN f.first < p.page_id THEN f.first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND p.payload_bytes >= 100
"""

SUBSTRING_DEDUP = rf"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
f AS (SELECT g, min(doc_id) AS first FROM g GROUP BY g),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM g JOIN f USING (g) WHERE f.first < g.doc_id),
n AS (SELECT doc_id, count(*) AS n_removed FROM c GROUP BY doc_id),
e AS (SELECT doc_id, p, w[p] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM e ANTI JOIN c USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n.n_removed, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""


def shard(owners: list[int]) -> str:
    """The placement by a lookup table, which is a list in the statement: slot -> number of the shard."""
    slot = f"CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'text:' || coalesce(text, ''))), 1, 15) AS BIGINT) % {len(owners)} AS INTEGER)"
    return f"""WITH t AS (SELECT {owners} AS owner), d AS (SELECT doc_id, {slot} AS slot FROM documents)
SELECT doc_id, slot, 'shard-' || lpad(CAST(owner[slot + 1] AS VARCHAR), 5, '0') AS shard FROM d, t"""


_BASE = rf"SELECT doc_id, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w FROM documents"
RULE_COUNTS = rf"""
WITH d AS ({_BASE}),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM g JOIN (SELECT doc_id, g FROM g GROUP BY ALL HAVING count(*) > 1) USING (doc_id, g)) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS l FROM d),
c AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words FROM d JOIN l USING (doc_id) LEFT JOIN r USING (doc_id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c
"""

PHRASES = rf"""
WITH p AS (SELECT row_number() OVER () AS id, lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
g AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM p, (SELECT unnest([1, 2, 3]) AS m))),
f AS (SELECT lang, m, phrase, count(*) AS a FROM g GROUP BY ALL),
c AS (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND a >= 10),
k AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
s AS (SELECT k.lang, k.phrase, k.a, k.k, x.a AS l, y.a AS r, CAST((CAST(1000000 AS HUGEINT) * k.a * k.a) // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
  FROM k JOIN f x ON x.lang = k.lang AND x.phrase = k.x JOIN f y ON y.lang = k.lang AND y.phrase = k.y),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
d AS (SELECT DISTINCT i.lang, i.phrase FROM c i JOIN (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM c WHERE m = 3) o ON i.lang = o.lang AND i.phrase = o.phrase AND 100 * o.a >= 50 * i.a),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b ANTI JOIN d USING (lang, phrase))
SELECT lang, rank, phrase, a, l, r, n, score FROM o JOIN t USING (lang) WHERE rank <= 2000
"""


def chat_format(template) -> str:
    """The digests of the turns, and the length of the rendered form by its template."""
    plain = ", ".join(f"'{r}'" for r in template.roles)
    add = lambda c: f"regexp_replace({c}, '{template.pattern()}', '\\1\\\\\\2\\3', 'g')"
    text = "</s>[INST] ok [/INST]"
    return f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '{text}' UNION ALL SELECT -7, 1, 'assistant', '{text}')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(CASE WHEN role IN ({plain}) THEN 4 + length(role) ELSE {len(template.other + template.named)} + length({add("role")}) END + length({add("text")}) + {len(template.end)}) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""
