"""DuckDB SQL pieces and the SQL equivalents of the named queries."""

from __future__ import annotations

from ..functions.vectors import MODULI

FIRST = "split_part(coalesce(text, ''), chr(10), 1)"
FOUND = f"regexp_extract_all({FIRST}, '[A-Za-z]{{5,}}')"
#: The driver's documents as notes, as sources.notes.corpus has them.
CORPUS = f"""corpus AS (SELECT doc_id, 'Notes/' || source || '/doc-' || doc_id || '.md' AS path, 'doc-' || doc_id AS name,
  CASE doc_id % 8 WHEN 1 THEN 'note' WHEN 2 THEN 'term' WHEN 3 THEN 'project' WHEN 4 THEN 'log' WHEN 5 THEN 'lesson' WHEN 6 THEN 'memo' WHEN 7 THEN 'note' END AS type,
  CASE doc_id % 5 WHEN 1 THEN 'active' WHEN 2 THEN 'done' WHEN 3 THEN 'archived' WHEN 4 THEN 'draft' END AS status,
  CASE lang WHEN 'en' THEN 'tech' WHEN 'fr' THEN 'life' WHEN 'de' THEN 'work' WHEN 'es' THEN 'Misc' END AS area,
  CASE WHEN doc_id % 7 <> 0 THEN {FIRST} END AS gist,
  list_filter({FOUND}, lambda x, i: list_position({FOUND}, x) = i)[1:6] AS tags,
  coalesce(text, '') || chr(10) || '[[doc-' || (doc_id * 7 % (doc_id + 3)) || ']] [[ghost-' || (doc_id % 10) || '|ghost]]' AS body,
  TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 400 AS INTEGER)) AS modified, DATE '2024-06-01' + CAST(doc_id % 50 AS INTEGER) AS gist_date, source FROM documents)"""
NOTES = CORPUS + """, notes AS (SELECT *, concat_ws(chr(10), '---', 'note_type: ' || type, 'note_status: ' || status, 'note_area: ' || area, 'note_gist: >' || chr(10) || '  ' || gist,
  CASE WHEN gist IS NOT NULL THEN 'note_gist_source: ai' END, CASE WHEN gist IS NOT NULL THEN 'note_gist_date: ' || strftime(gist_date, '%Y-%m-%d') END,
  CASE WHEN len(tags) > 0 THEN 'note_tags: [' || array_to_string(tags, ', ') || ']' END, '---') || chr(10) || chr(10) || body AS content FROM corpus)"""
LINKS = r"""links AS (SELECT name AS src, trim(regexp_extract(x, '\[\[([^\]|]+)', 1)) AS dst, i - 1 AS pos FROM (SELECT name, unnest(l) AS x, unnest(range(1, len(l) + 1)) AS i
  FROM (SELECT name, regexp_extract_all(content, '\[\[[^\]|]+(?:\|[^\]]+)?\]\]') AS l FROM notes)))"""
TITLE = r"regexp_replace(split_part(path, '/', -1), '(\.md)+$', '')"
FILENAME = r"replace(replace(split_part(regexp_replace(path, '\.md$', ''), '/', -1), '-', ' '), '_', ' ')"


def terms(text: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower(coalesce({text}, '')), '[^\pL\pN]+'), lambda t: t <> '' AND octet_length(encode(t)) <= 40)"


def tokens(text: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower(coalesce({text}, '')), '[\s\pZ\x0b\x85[:punct:]]+'), lambda t: t <> '')"


FIELDS = {"title": TITLE, "gist": "gist", "tags": "array_to_string(tags, ' ')", "body": "body"}


def bm25(query_terms: list[str], boosts: dict[str, float], name: str = "hits") -> str:
    """CTEs that end in ``name`` (path, doc_id, score): all matching notes of ``corpus``."""
    listed = ", ".join(f"'{t}'" for t in query_terms)
    each = " UNION ALL ".join(f"SELECT doc_id, path, '{f}' AS field, {terms(FIELDS[f])} AS t, CAST({b} AS DOUBLE) AS boost FROM corpus" for f, b in boosts.items())
    return f"""f_{name} AS ({each}),
s_{name} AS (SELECT field, count(*) AS n, sum(len(t)) / count(*) AS mean FROM f_{name} GROUP BY field),
p_{name} AS (SELECT doc_id, path, field, boost, len(t) AS dl, q AS term, len(list_filter(t, lambda x: x = q)) AS tf FROM f_{name}, (SELECT unnest([{listed}]) AS q)),
d_{name} AS (SELECT field, term, count(*) AS df FROM p_{name} WHERE tf > 0 GROUP BY 1, 2),
{name} AS (SELECT path, doc_id, round(sum(boost * ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 9) AS score
  FROM p_{name} JOIN d_{name} USING (field, term) JOIN s_{name} USING (field) WHERE tf > 0 GROUP BY 1, 2)"""


def htp(source: str, name: str = "vecs") -> str:
    """CTEs that end in ``name`` (id, m, s, c, norm): the harmonic vectors of ``source`` (id, text), a row a modulus."""
    moduli = ", ".join(map(str, MODULI))
    return f"""t_{name} AS (SELECT id, unnest({tokens("text")}) AS token FROM {source}),
k_{name} AS (SELECT token, list_reduce(list_transform(range(1, length(right(left(token, 64), 4)) + 1), lambda i: CAST(unicode(substr(right(left(token, 64), 4), CAST(i AS INTEGER), 1)) AS HUGEINT)), lambda a, b: a * 65536 + b) % 18446744073709551616 AS n FROM (SELECT DISTINCT token FROM t_{name})),
v_{name} AS (SELECT token, m, sin(2 * pi() / m * CAST(n % m AS DOUBLE)) AS s, cos(2 * pi() / m * CAST(n % m AS DOUBLE)) AS c FROM k_{name}, (SELECT unnest([{moduli}]) AS m)),
a_{name} AS (SELECT id, m, avg(s) AS s, avg(c) AS c FROM t_{name} JOIN v_{name} USING (token) GROUP BY 1, 2),
{name} AS (SELECT id, m, s, c, sqrt(sum(s * s + c * c) OVER (PARTITION BY id)) AS norm FROM a_{name})"""


def semantic(query: str, k: int | None, name: str = "near") -> str:
    """CTEs that end in ``name`` (path, doc_id, score): the notes with the gists nearest to a query."""
    limit = f" ORDER BY score DESC, path LIMIT {k}" if k else ""
    return f"""g AS (SELECT doc_id AS id, gist AS text FROM corpus WHERE gist IS NOT NULL), q AS (SELECT 0 AS id, '{query}' AS text), {htp("g", "gv")}, {htp("q", "qv")},
sim AS (SELECT g.id, coalesce(x.score, 0) AS score FROM g LEFT JOIN (SELECT gv.id, round(sum(gv.s * qv.s + gv.c * qv.c) / any_value(gv.norm * qv.norm), 9) AS score FROM gv JOIN qv USING (m) GROUP BY gv.id) x USING (id)),
{name} AS (SELECT path, doc_id, score FROM sim JOIN corpus ON id = doc_id{limit})"""


COS = "list_sum(list_transform(range(1, len({a}) + 1), lambda i: CAST({a}[i] AS DOUBLE) * CAST({b}[i] AS DOUBLE))) / (sqrt(list_sum(list_transform({a}, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) * sqrt(list_sum(list_transform({b}, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))))"


def cosine(a: str, b: str) -> str:
    return COS.format(a=a, b=b)
