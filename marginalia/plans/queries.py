"""The named queries over the driver's tables and their DuckDB SQL. Scores are rounded, so that ties are ties."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..api import Collection
from ..functions import text as tx
from ..functions import vectors as vx
from ..operators import ann
from ..operators import audit as au
from ..operators import knn, listing, profile, save, search, sync, tags
from ..operators.block_max import BlockIndex
from ..operators.segments import SegmentedIndex
from ..operators.sketches import FieldSketches
from ..operators.smart_save import smart_save
from ..operators.vector_index import VectorIndex
from ..sources import notes as src
from ..sources.shared import shared_folder
from ..streaming import pending, watch
from . import sql

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

WORDS = "that with tion"
TERMS = search.query_terms(WORDS)
CONTEXT = "SELECT path, round(score, 6) AS score FROM"


def query(text: str | None = None):
    """Registers a query under its function's name, with its SQL if it has any."""

    def add(f):
        _QUERIES[f.__name__] = f
        if text:
            _SQL[f.__name__] = text
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    return src.corpus(_table(spark, d, "documents"))


def _corpus_files(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, path, text) of the documents, whole."""
    return _table(spark, d, "documents").select("doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), "text")


def _notes(spark: SparkSession, d: str) -> DataFrame:
    """The documents as markdown, parsed again."""
    files = src.rendered(_corpus(spark, d)).select("doc_id", "path", "name", "content", "modified")
    return src.parse_notes(files)


def _embedded(spark: SparkSession, d: str) -> DataFrame:
    return _corpus(spark, d).withColumn("vec", F.when(F.col("gist").isNotNull(), vx.embed(F.col("gist"))))


def _short(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns, F.round("score", 6).alias("score"))


# Keyword search --------------------------------------------------------------------------------------------------------


@query(f"WITH {sql.CORPUS}, {sql.bm25(TERMS, search.BOOSTS)} {CONTEXT} (SELECT * FROM hits ORDER BY score DESC, path LIMIT 10)")
def bm25_topk(spark, d):
    return _short(search.bm25(_corpus(spark, d), WORDS, 10), "path")


_BOOSTS = {"title": 1.0, "gist": 1.0, "tags": 6.0}


@query(f"WITH {sql.CORPUS}, {sql.bm25(TERMS, _BOOSTS)} {CONTEXT} hits")
def bm25_field_boost(spark, d):
    return _short(search.bm25(_corpus(spark, d), WORDS, None, boosts=_BOOSTS), "path")


@query(
    f"""WITH {sql.CORPUS}, p AS (SELECT doc_id, 'title' AS field, unnest({sql.terms(sql.TITLE)}) AS term FROM corpus UNION ALL SELECT doc_id, 'gist', unnest({sql.terms("gist")}) FROM corpus
UNION ALL SELECT doc_id, 'tags', unnest({sql.terms("array_to_string(tags, ' ')")}) FROM corpus) SELECT field, term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM p GROUP BY 1, 2"""
)
def bm25_df_stats(spark, d):
    return search.df_stats(_corpus(spark, d))


@query(f"WITH {sql.CORPUS}, {sql.bm25(TERMS, {'body': 1.0})} {CONTEXT} hits")
def bm25_body(spark, d):
    """All hits in the whole texts."""
    return _short(search.bm25(_corpus(spark, d), WORDS, None, boosts={"body": 1.0}, columns={"body": F.col("body")}), "path")


@query(
    f"""WITH {sql.CORPUS}, s AS (SELECT path, (CASE WHEN contains(lower(gist), 'the') THEN 1 ELSE 0 END + CASE WHEN contains(lower(gist), 'tion') THEN 1 ELSE 0 END + CASE WHEN contains(lower(gist), 'zebra') THEN 1 ELSE 0 END) / 3.0 AS score FROM corpus)
{CONTEXT} (SELECT * FROM s WHERE score > 0 ORDER BY score DESC, path LIMIT 50)"""
)
def simple_search(spark, d):
    return _short(search.simple_search(_corpus(spark, d), "The tion zebra", 50), "path")


def _kept_up(spark, d) -> tuple[SegmentedIndex, list[int]]:
    """An index of the bodies of all documents, whole, to which others are added later: those of good quality in a second edition,
    while toxic ones are removed."""
    body = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("quality") == 1, F.lit(" that second edition")).otherwise(""))
    index = SegmentedIndex(spark, f"{shared_folder(spark)}/kept-up-{uuid.uuid4().hex}", "doc_id", {"body": F.col("body")}, kind="bigint")
    docs = _table(spark, d, "documents").join(_table(spark, d, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")
    first = index.add(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("body")))
    second = index.add(docs.select("doc_id", body.alias("body")))
    return index, [first, second, index.remove(docs.filter("toxic = 1")), index.compact()]


_EDITIONS = """v1 AS (SELECT 0 AS version, doc_id, coalesce(text, '') AS body FROM documents),
v2 AS (SELECT 1 AS version, d.doc_id, coalesce(text, '') || CASE WHEN quality = 1 THEN ' that second edition' ELSE '' END AS body FROM documents d LEFT JOIN labels USING (doc_id)),
v3 AS (SELECT 2 AS version, doc_id, body FROM v2 WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))"""


@query(f"WITH {_EDITIONS}, corpus AS (SELECT doc_id, doc_id AS path, body FROM v3), {sql.bm25(['that', 'edition', 'tion'], {'body': 1.0})} SELECT doc_id, round(score, 6) AS score FROM hits")
def index_kept_up(spark, d):
    """All hits in an index after additions, changes, removals and a merge, scored as in one that is built anew."""
    index, _ = _kept_up(spark, d)
    return _short(index.search("that edition tion", None, boosts={"body": 1.0}), "doc_id")


@query(
    f"""WITH {_EDITIONS}, every AS (SELECT * FROM v1 UNION ALL SELECT * FROM v2 UNION ALL SELECT * FROM v3 UNION ALL SELECT 3, doc_id, body FROM v3), t AS (SELECT version, doc_id, {sql.terms("body")} AS t FROM every)
SELECT t.version, CAST(n AS BIGINT) AS notes, CAST(words AS BIGINT) AS words, CAST(count(*) FILTER (list_contains(t, 'edition')) AS BIGINT) AS editions FROM t JOIN (SELECT version, count(*) AS n, sum(len(t)) AS words FROM t GROUP BY 1) USING (version) GROUP BY ALL"""
)
def index_versions(spark, d):
    """What readers of each version of an index see: its notes, its words, and the notes with a term."""
    index, versions = _kept_up(spark, d)
    out = None
    for v in versions:
        at = SegmentedIndex(spark, index.folder, "doc_id", index.columns, kind="bigint", version=v)
        sums = at.docs().agg(F.lit(v).alias("version"), F.count("*").alias("notes"), F.coalesce(F.sum(F.col("words")["body"]), F.lit(0)).alias("words"))
        row = sums.crossJoin(at.postings(["edition"]).agg(F.count("*").alias("editions")))  # one row by one row
        out = row if out is None else out.unionByName(row)
    return out


# Vectors ---------------------------------------------------------------------------------------------------------------


def _vectors(spark, d):
    return _table(spark, d, "embeddings")


def _first(spark, d):
    row = _vectors(spark, d).filter("vec_id = 0").select("embedding").first()
    return row[0] if row else [0.0]


@query(f"SELECT vec_id, round(score, 6) AS score FROM (SELECT vec_id, round({sql.cosine('embedding', 'q')}, 9) AS score FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)) ORDER BY score DESC, vec_id LIMIT 10")
def knn_topk(spark, d):
    return _short(knn.knn(_vectors(spark, d), "embedding", _first(spark, d), 10, "vec_id"), "vec_id")


@query(
    f"""SELECT query_id, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, round({sql.cosine('a.embedding', 'b.embedding')}, 9) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)) WHERE rank <= 5"""
)
def knn_join_top5(spark, d):
    rows = _vectors(spark, d)
    return _short(knn.knn_join(rows, rows.filter("vec_id % 20 = 0"), 5, "vec_id", "embedding"), "query_id", "id", "rank")


@query(f"SELECT a, b, round(score, 6) AS score FROM (SELECT x.vec_id AS a, y.vec_id AS b, round({sql.cosine('x.embedding', 'y.embedding')}, 9) AS score FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id) WHERE score >= 0.35")
def knn_threshold_pairs(spark, d):
    return _short(knn.similar_pairs(_vectors(spark, d), "vec_id", "embedding", 0.35), "a", "b")


@query(f"SELECT a, b, round(score, 6) AS score FROM (SELECT x.vec_id AS a, y.vec_id AS b, round({sql.cosine('x.embedding', 'y.embedding')}, 9) AS score FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id) WHERE score >= 0.2")
def knn_pairs_in_blocks(spark, d):
    """All similar pairs, out of blocks of a few vectors, as a large table has many."""
    return _short(knn.similar_pairs(_vectors(spark, d), "vec_id", "embedding", 0.2, rows_a_block=40), "a", "b")


@query(
    f"""SELECT vec_id, round(round(0.7 * score + 0.3 * (CASE WHEN label = 3 THEN 1 ELSE 0 END), 9), 6) AS score FROM (SELECT vec_id, label, round({sql.cosine('embedding', 'q')}, 9) AS score
FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0) ORDER BY score DESC, vec_id LIMIT 20) ORDER BY round(0.7 * score + 0.3 * (CASE WHEN label = 3 THEN 1 ELSE 0 END), 9) DESC, vec_id LIMIT 10"""
)
def boosted_rerank(spark, d):
    return _short(knn.boosted(_vectors(spark, d), "embedding", _first(spark, d), 10, "vec_id", {"label": 3}), "vec_id")


@query(f"SELECT vec_id, round(score, 6) AS score FROM (SELECT vec_id, round({sql.cosine('embedding', 'q')}, 9) AS score FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 7) WHERE vec_id <> 7) ORDER BY score DESC, vec_id LIMIT 10")
def related_notes(spark, d):
    return _short(knn.related(_vectors(spark, d), "embedding", 7, 10, "vec_id"), "vec_id")


def _each(k: int):
    return lambda i: F.get("vec", 2 * i + k)


@query("SELECT d.doc_id, length(d.text) AS chars, e.label, len(e.embedding) AS dimension FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id")
def notes_with_vectors(spark, d):
    joined = _table(spark, d, "documents").join(_vectors(spark, d), F.col("doc_id") == F.col("vec_id"))
    return joined.select("doc_id", F.char_length("text").cast("long").alias("chars"), "label", F.size("embedding").cast("long").alias("dimension"))


@query("SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, round(CAST(embedding[i] AS DOUBLE), 6) AS value FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)")
def vector_blobs(spark, d):
    rows = _vectors(spark, d).withColumn("blob", vx.to_blob(F.col("embedding")))
    return rows.select("vec_id", F.posexplode(vx.from_blob(F.col("blob"))).alias("pos", "value")).withColumn("value", F.round(F.col("value").cast("double"), 6))


@query()
def ivf_knn(spark, d):
    """Rows only, as inverted lists are approximate: the five nearest of every twentieth vector; tests measure the recall."""
    rows = _vectors(spark, d)
    return _short(ann.build(rows, "vec_id", "embedding", 5).search(rows.filter("vec_id % 20 = 0"), 5, "vec_id", "embedding"), "query_id", "id", "rank")


@query(
    f"""WITH RECURSIVE q AS (SELECT vec_id, embedding, row_number() OVER (ORDER BY vec_id) AS n FROM embeddings WHERE vec_id % 20 = 0),
near AS (SELECT DISTINCT q.vec_id FROM q, embeddings e WHERE e.vec_id % 20 <> 0 AND round({sql.cosine('q.embedding', 'e.embedding')}, 9) >= 0.35),
pairs AS (SELECT b.vec_id, list(a.vec_id) AS before FROM q a JOIN q b ON a.vec_id < b.vec_id WHERE round({sql.cosine('a.embedding', 'b.embedding')}, 9) >= 0.35 GROUP BY 1),
r AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS made UNION ALL
  SELECT q.n, CASE WHEN q.vec_id IN (SELECT vec_id FROM near) OR list_has_any(coalesce(p.before, []), r.made) THEN r.made ELSE list_append(r.made, q.vec_id) END FROM r JOIN q ON q.n = r.n + 1 LEFT JOIN pairs p ON p.vec_id = q.vec_id)
SELECT q.vec_id, CASE WHEN list_contains((SELECT made FROM r ORDER BY n DESC LIMIT 1), q.vec_id) THEN 'create' ELSE 'needs_decision' END AS decision FROM q"""
)
def smart_saving(spark, d):
    """Every twentieth vector as a request to save, against all others and the requests before it."""
    rows = _vectors(spark, d).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return smart_save(rows.filter("id % 20 = 0"), rows.filter("id % 20 <> 0"), 0.35).select(F.col("id").alias("vec_id"), "decision")


@query("SELECT count(*) AS vectors, count(*) FILTER (vec_id % 20 = 0) AS queries, 5 * count(*) FILTER (vec_id % 20 = 0) AS neighbours, TRUE AS enough FROM embeddings WHERE label <> 7")
def vector_index_kept_up(spark, d):
    """A stored vector index after insertions (label 3) and deletions (label 7): its vectors, every twentieth of them as queries,
    and whether at least 0.9 of their true neighbours are found."""
    rows, index = _vectors(spark, d).select("vec_id", "embedding", "label"), VectorIndex(spark, f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}")
    index.write(rows.filter("label <> 3"), "vec_id", "embedding", 5)
    index.insert(rows.filter("label = 3"), "vec_id", "embedding")
    index.delete(rows.filter("label = 7").select(F.col("vec_id").alias("id")))
    held = rows.filter("label <> 7")
    queries = held.filter("vec_id % 20 = 0")
    exact = knn.knn_join(held, queries, 5, "vec_id", "embedding").select("query_id", "id")
    hit = exact.join(index.search(queries, 5, "vec_id", "embedding").select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    counts = hit.agg(F.count("*").alias("neighbours"), (10 * F.count("hit") >= 9 * F.count("*")).alias("enough"))
    return index.rows().agg(F.count("*").alias("vectors")).crossJoin(queries.agg(F.count("*").alias("queries"))).crossJoin(counts)  # one row by one row


# Embedding -------------------------------------------------------------------------------------------------------------


@query(
    f"""WITH {sql.CORPUS}, t AS (SELECT DISTINCT unnest({sql.tokens("gist")}) AS token FROM corpus) SELECT token,
CAST(list_reduce(list_transform(range(1, length(right(left(token, 64), 4)) + 1), lambda i: CAST(unicode(substr(right(left(token, 64), 4), CAST(i AS INTEGER), 1)) AS HUGEINT)), lambda a, b: a * 65536 + b) % 18446744073709551616 AS VARCHAR) AS number FROM t"""
)
def htp_token_ids(spark, d):
    words = _corpus(spark, d).select(F.explode(tx.tokenize(F.col("gist"))).alias("token")).distinct()
    return words.select("token", vx.token_number(F.col("token")).cast("string").alias("number"))


@query(f"WITH {sql.CORPUS}, g AS (SELECT doc_id AS id, gist AS text FROM corpus WHERE gist IS NOT NULL), {sql.htp('g')} SELECT id AS doc_id, CAST(m AS INTEGER) AS m, round(s / norm, 6) AS s, round(c / norm, 6) AS c FROM vecs")
def htp_vectors(spark, d):
    rows = _embedded(spark, d).filter("vec is not null and exists(vec, x -> x <> 0)")
    pairs = F.arrays_zip(F.array(*map(F.lit, vx.MODULI)).alias("m"), *[F.transform(F.sequence(F.lit(0), F.lit(vx.PRIMES - 1)), _each(k)).alias(n) for k, n in enumerate("sc")])
    return rows.select("doc_id", F.explode(pairs).alias("x")).select("doc_id", "x.m", F.round("x.s", 6).alias("s"), F.round("x.c", 6).alias("c"))


# Fusion and search -----------------------------------------------------------------------------------------------------

_RANKS = "SELECT path, row_number() OVER (ORDER BY score DESC, path) AS rank FROM"


@query(
    f"""WITH {sql.CORPUS}, {sql.bm25(TERMS, search.BOOSTS, "a")}, {sql.bm25(["doc", "ertion"], search.BOOSTS, "b")}, ra AS ({_RANKS} (SELECT * FROM a ORDER BY score DESC, path LIMIT 30)), rb AS ({_RANKS} (SELECT * FROM b ORDER BY score DESC, path LIMIT 30))
SELECT path, round(round(sum(p), 12), 9) AS score FROM (SELECT path, 0.7 / (60 + rank) AS p FROM ra UNION ALL SELECT path, 0.3 / (60 + rank) FROM rb) GROUP BY path"""
)
def rrf_fusion(spark, d):
    notes = _corpus(spark, d)
    lists = {"semantic": search.ranked(search.bm25(notes, WORDS, 30)), "bm25": search.ranked(search.bm25(notes, "doc ertion", 30))}
    return search.fuse(lists).select("path", F.round("score", 9).alias("score"))


@query(f"WITH {sql.CORPUS}, {sql.bm25(TERMS, search.BOOSTS, 'a')} SELECT path, round(0.7 / (60 + rank), 9) AS score FROM ({_RANKS} (SELECT * FROM a ORDER BY score DESC, path LIMIT 30))")
def rrf_one_sided(spark, d):
    notes = _corpus(spark, d)
    lists = {"semantic": search.ranked(search.bm25(notes, WORDS, 30)), "bm25": search.ranked(notes.limit(0).withColumn("score", F.lit(0.0)))}
    return search.fuse(lists).select("path", F.round("score", 9).alias("score"))


_HYBRID = f"""{sql.semantic(WORDS, 3000, "all_near")}, {sql.bm25(TERMS, search.BOOSTS)},
fused AS (SELECT path, round(sum(p), 12) AS score FROM (SELECT path, 0.7 / (60 + row_number() OVER (ORDER BY score DESC, path)) AS p FROM (SELECT * FROM all_near ORDER BY score DESC, path LIMIT {{n}})
UNION ALL SELECT path, 0.3 / (60 + row_number() OVER (ORDER BY score DESC, path)) FROM (SELECT * FROM hits ORDER BY score DESC, path LIMIT {{n}})) GROUP BY path)"""


@query(f"WITH {sql.CORPUS}, {_HYBRID.format(n=30)} SELECT path, round(score, 9) AS score FROM fused ORDER BY fused.score DESC, path LIMIT 10")
def hybrid_search(spark, d):
    found = search.search(_embedded(spark, d), WORDS, 10, "hybrid")
    return found.select("path", F.round("score", 9).alias("score"))


@query(f"WITH {sql.CORPUS}, {sql.semantic(WORDS, 10)} {CONTEXT} near")
def semantic_search(spark, d):
    return _short(search.search(_embedded(spark, d), WORDS, 10, "semantic"), "path")


@query(f"WITH {sql.CORPUS}, {sql.bm25(TERMS, search.BOOSTS)} {CONTEXT} (SELECT * FROM hits ORDER BY score DESC, path LIMIT 5)")
def keyword_search(spark, d):
    return _short(search.search(_corpus(spark, d), WORDS, 0, "BM25"), "path")


@query(
    f"WITH {sql.CORPUS}, {_HYBRID.format(n=150)} SELECT path, type, area, round(score, 9) AS score FROM (SELECT path, score FROM fused ORDER BY fused.score DESC, path LIMIT 50) JOIN corpus USING (path) WHERE type = 'note' AND area = 'tech' ORDER BY score DESC, path LIMIT 10"
)
def search_filtered(spark, d):
    found = search.search(_embedded(spark, d), WORDS, 10, None, type="note", area="tech")
    return found.select("path", "type", "area", F.round("score", 9).alias("score"))


@query(f"WITH {sql.CORPUS.replace('corpus AS', 'every AS')}, corpus AS (SELECT * FROM every WHERE area = 'tech'), {sql.bm25(TERMS, search.BOOSTS)} {CONTEXT} (SELECT * FROM hits ORDER BY score DESC, path LIMIT 10)")
def search_prefiltered(spark, d):
    return _short(search.search(_corpus(spark, d), WORDS, 10, "keyword", prefilter=True, area="tech"), "path")


@query(f"WITH {sql.CORPUS}, {sql.bm25(['that'], search.BOOSTS)} {CONTEXT} (SELECT h.path, h.score FROM hits h JOIN corpus USING (path) WHERE type = 'term' AND area = 'tech' ORDER BY h.score DESC, path LIMIT 5)")
def query_language(spark, d):
    words, filters = search.parse_query("type:term that", area="tech")
    return _short(search.filter_hits(search.bm25(_corpus(spark, d), words, None), 5, filters), "path")


# Frontmatter -----------------------------------------------------------------------------------------------------------


@query(f"WITH {sql.NOTES} SELECT doc_id, content FROM notes")
def fm_render(spark, d):
    return src.rendered(_corpus(spark, d)).select("doc_id", "content")


@query(
    f"""WITH {sql.NOTES} SELECT doc_id, type, status, area, CASE WHEN trim(gist) <> '' THEN trim(gist) END AS gist, array_to_string(tags, '|') AS tags,
CASE WHEN gist IS NOT NULL THEN strftime(gist_date, '%Y-%m-%d') END AS gist_date FROM notes"""
)
def fm_parse_roundtrip(spark, d):
    n = _notes(spark, d)
    return n.select("doc_id", "type", "status", "area", "gist", F.array_join("tags", "|").alias("tags"), F.col("fields")["gist_date"].alias("gist_date"))


@query(f"WITH {sql.NOTES} SELECT doc_id, CAST(len(list_filter(string_split(content, chr(10)), lambda x: rtrim(x) = '---')) // 2 AS INTEGER) AS blocks FROM notes")
def fm_block_count(spark, d):
    return src.rendered(_corpus(spark, d)).select("doc_id", tx.block_count(F.col("content")).alias("blocks"))


@query(f"WITH {sql.NOTES} SELECT doc_id, 'gist' AS field FROM notes WHERE gist IS NOT NULL")
def fm_folded(spark, d):
    return _notes(spark, d).select("doc_id", F.explode(tx.folded_fields(F.col("raw"), "note_")).alias("field"))


@query(f"WITH {sql.CORPUS} SELECT path, {sql.TITLE} AS title, {sql.FILENAME} AS words FROM corpus UNION ALL SELECT url, {sql.TITLE.replace('path', 'url')}, {sql.FILENAME.replace('path', 'url')} FROM pages")
def title_and_filename(spark, d):
    paths = _corpus(spark, d).select("path").unionAll(_table(spark, d, "pages").select(F.col("url").alias("path")))
    return paths.select("path", tx.title_from_path(F.col("path")).alias("title"), tx.filename_text(F.col("path")).alias("words"))


# Listing ---------------------------------------------------------------------------------------------------------------


@query(f"WITH {sql.CORPUS} SELECT name AS title, path, gist, type, status, area, array_to_string(tags, '|') AS tags FROM corpus WHERE type = 'note' AND area = 'tech' ORDER BY name, path LIMIT 50")
def list_notes(spark, d):
    return listing.list_notes(_corpus(spark, d), "note", "tech", 0, "standard").withColumn("tags", F.array_join("tags", "|"))


@query(f"WITH {sql.CORPUS} SELECT name AS title, path, gist FROM corpus WHERE name = 'doc-12' OR contains(path, 'doc-12') ORDER BY name, path LIMIT 1")
def get_note(spark, d):
    return listing.project(listing.get_note(_corpus(spark, d), "doc-12"))


@query(f"WITH {sql.CORPUS} SELECT name AS title, path, area, status FROM corpus")
def field_presets(spark, d):
    return listing.project(_corpus(spark, d), "area, unknown, status")


@query(f"WITH {sql.CORPUS} SELECT DISTINCT name FROM corpus")
def note_names(spark, d):
    return src.note_names(_corpus(spark, d))


# Status and audit ------------------------------------------------------------------------------------------------------

_STATUS = "count(*) AS total, count(gist) AS with_gist, count(type) AS with_type, count(area) AS with_area, CAST(round((40 * count(gist) + 30 * count(type) + 30 * count(area)) / greatest(count(*), 1)) AS INTEGER) AS health"


@query(f"WITH {sql.CORPUS} SELECT {_STATUS} FROM corpus")
def notes_status(spark, d):
    return au.status(_corpus(spark, d))


@query(f"WITH {sql.CORPUS} SELECT 'type' AS field, type AS value, count(*) AS n FROM corpus WHERE type IS NOT NULL GROUP BY type UNION ALL SELECT 'area', area, count(*) FROM corpus WHERE area IS NOT NULL GROUP BY area")
def counts_by_type_area(spark, d):
    return au.counts_by(_corpus(spark, d), "type", "area")


_TYPES, _STATUSES, _AREAS = (", ".join(f"'{x}'" for x in v) for v in (("note", "term", "project", "log", "lesson"), ("active", "done", "archived"), ("work", "tech", "life", "career", "learning", "reference", "defense", "prosecutor", "judge")))
VIOLATIONS = f"""violations AS (
SELECT name, 'missing_field' AS code, 'error' AS severity, 'note_type' AS arg FROM notes WHERE type IS NULL UNION ALL SELECT name, 'invalid_type', 'error', type FROM notes WHERE type NOT IN ({_TYPES})
UNION ALL SELECT name, 'missing_field', 'error', 'note_status' FROM notes WHERE status IS NULL UNION ALL SELECT name, 'invalid_status', 'error', status FROM notes WHERE status NOT IN ({_STATUSES})
UNION ALL SELECT name, 'missing_field', 'error', 'note_area' FROM notes WHERE area IS NULL UNION ALL SELECT name, 'invalid_area', 'error', area FROM notes WHERE area NOT IN ({_AREAS})
UNION ALL SELECT name, 'missing_field', 'error', 'note_gist' FROM notes WHERE coalesce(trim(gist), '') = ''
UNION ALL SELECT name, 'too_many_tags', 'error', CAST(len(tags) AS VARCHAR) FROM notes WHERE len(tags) > 5
UNION ALL SELECT name, 'non_lowercase_tag', 'error', t FROM (SELECT name, unnest(tags) AS t FROM notes) WHERE t <> lower(t)
UNION ALL SELECT name, 'folded_scalar', 'warning', 'gist' FROM notes WHERE gist IS NOT NULL
UNION ALL SELECT name, 'duplicate_frontmatter', 'error', CAST(len(list_filter(string_split(content, chr(10)), lambda x: rtrim(x) = '---')) // 2 AS VARCHAR) FROM notes WHERE len(list_filter(string_split(content, chr(10)), lambda x: rtrim(x) = '---')) // 2 > 1)"""


@query(f"WITH {sql.NOTES}, {VIOLATIONS} SELECT * FROM violations")
def audit_schema(spark, d):
    return au.violations(_notes(spark, d)).drop("message")


_AUDIT = f"""WITH {sql.NOTES}, {sql.LINKS}, {VIOLATIONS}, t AS (SELECT count(*) AS t, count(*) FILTER (coalesce(trim(gist), '') = '') AS g, count(*) FILTER (len(tags) = 0) AS u, count(*) FILTER (gist IS NOT NULL AND gist_date < CAST(modified AS DATE)) AS s FROM notes),
o AS (SELECT count(*) AS o FROM (SELECT DISTINCT name FROM notes WHERE name NOT IN (SELECT dst FROM links))), l AS (SELECT count(*) AS t, count(*) FILTER (dst NOT IN (SELECT name FROM notes)) AS b FROM links), v AS (SELECT count(*) FILTER (severity = 'error') AS e, count(*) AS n FROM violations)
SELECT 'schema' AS "check", CASE WHEN e > 0 THEN 'fail' WHEN n > 0 THEN 'warn' ELSE 'pass' END AS status, n AS found, t AS total FROM v, t UNION ALL SELECT 'wikilinks', CASE WHEN b > 0 THEN 'fail' ELSE 'pass' END, b, t FROM l
UNION ALL SELECT 'gist', CASE WHEN g > 0 THEN 'fail' ELSE 'pass' END, g, t FROM t UNION ALL SELECT 'tags', CASE WHEN u / greatest(t, 1) < 0.3 THEN 'pass' ELSE 'fail' END, u, t FROM t
UNION ALL SELECT 'orphans', CASE WHEN o / greatest(t, 1) < 0.3 THEN 'pass' ELSE 'fail' END, o, t FROM o, t UNION ALL SELECT 'stale_gists', CASE WHEN s > 0 THEN 'warn' ELSE 'pass' END, s, t FROM t"""


@query(_AUDIT)
def audit_summary(spark, d):
    notes = _notes(spark, d)
    return au.audit(notes, src.links(notes))


@query(f"SELECT count(*) FILTER (status = 'pass') AS passed, count(*) FILTER (status = 'fail') AS failed FROM ({_AUDIT})")
def audit_totals(spark, d):
    return au.audit_totals(audit_summary(spark, d))


@query(f"WITH {sql.NOTES} SELECT name, gist_date, CAST(modified AS DATE) AS modified_date FROM notes WHERE gist IS NOT NULL AND gist_date < CAST(modified AS DATE)")
def audit_stale(spark, d):
    return au.stale(_notes(spark, d))


@query()
def yaml_check(spark, d):
    """Rows only: SQL has no YAML parser."""
    return _notes(spark, d).select("name", au.yaml_error(F.col("raw")).alias("error"))


# Links -----------------------------------------------------------------------------------------------------------------


def _links(spark, d):
    return src.links(src.rendered(_corpus(spark, d)))


@query(f"WITH {sql.NOTES}, {sql.LINKS} SELECT src, dst, CAST(pos AS INTEGER) AS pos FROM links")
def wikilinks(spark, d):
    return _links(spark, d)


@query(f"WITH {sql.NOTES}, {sql.LINKS} SELECT src, dst, CAST(pos AS INTEGER) AS pos FROM links WHERE dst NOT IN (SELECT name FROM notes)")
def broken_links(spark, d):
    return au.broken_links(_links(spark, d), _corpus(spark, d))


@query(f"WITH {sql.NOTES}, {sql.LINKS} SELECT DISTINCT name FROM notes WHERE name NOT IN (SELECT dst FROM links)")
def orphans(spark, d):
    return au.orphans(_links(spark, d), _corpus(spark, d))


@query(
    f"""WITH {sql.NOTES}, {sql.LINKS}, m AS (SELECT *, dst IN (SELECT name FROM notes) AS ok FROM links) SELECT count(*) AS total, count(*) FILTER (ok) AS valid, count(*) FILTER (NOT ok) AS broken, count(DISTINCT CASE WHEN NOT ok THEN src END) AS files_with_broken,
(SELECT count(DISTINCT name) FROM notes WHERE name NOT IN (SELECT dst FROM links)) AS orphans FROM m"""
)
def link_report(spark, d):
    return au.link_report(_links(spark, d), _corpus(spark, d))


@query(f"WITH {sql.NOTES}, {sql.LINKS} SELECT src, CAST(sum(n) AS BIGINT) AS n, string_agg(dst, '|' ORDER BY dst) AS targets FROM (SELECT src, dst, count(*) AS n FROM links WHERE dst NOT IN (SELECT name FROM notes) GROUP BY 1, 2) GROUP BY src")
def broken_links_by_file(spark, d):
    return au.broken_by_file(_links(spark, d), _corpus(spark, d)).withColumn("targets", F.array_join("targets", "|"))


@query("SELECT 'documents' AS name, count(*) AS n, CAST(coalesce(sum(doc_id), 0) AS BIGINT) AS ids FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) UNION ALL SELECT 'embeddings', count(*), CAST(coalesce(sum(vec_id), 0) AS BIGINT) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) UNION ALL SELECT 'labels', count(*), CAST(coalesce(sum(doc_id), 0) AS BIGINT) FROM labels WHERE toxic <> 1")
def delete_with_cascade(spark, d):
    """What is left of notes, their vectors and their labels when toxic notes are deleted."""
    docs, vectors, labels = (_table(spark, d, t) for t in ("documents", "embeddings", "labels"))
    left = save.delete_cascade({"documents": (docs, "doc_id"), "embeddings": (vectors, "vec_id"), "labels": (labels, "doc_id")}, labels.filter("toxic = 1"), "doc_id")
    out = None
    for name, of in (("documents", "doc_id"), ("embeddings", "vec_id"), ("labels", "doc_id")):
        row = left[name].agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.coalesce(F.sum(of), F.lit(0)).alias("ids"))
        out = row if out is None else out.unionByName(row)
    return out


@query(f"WITH {sql.NOTES}, {sql.LINKS} SELECT n.name, count(l.dst) AS incoming FROM (SELECT DISTINCT name FROM notes) n LEFT JOIN links l ON l.dst = n.name GROUP BY n.name")
def incoming_links(spark, d):
    return au.incoming(_links(spark, d), _corpus(spark, d))


# Tags ------------------------------------------------------------------------------------------------------------------

_TAGGED = f"t AS (SELECT path, unnest(list_distinct(list_transform(tags, lambda x: lower(x)))) AS tag, coalesce(gist, name) AS text FROM corpus)"


def _tagged(spark, d):
    return _corpus(spark, d).withColumn("tags", F.transform("tags", F.lower))


@query(
    f"""WITH {sql.CORPUS}, {_TAGGED}, r AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY path) AS r, count(*) OVER (PARTITION BY tag) AS n FROM t)
SELECT tag AS name, tag || '. Used in contexts like: ' || left(string_agg(text, '; ' ORDER BY path), 200) AS description, any_value(n) AS usage_count FROM r WHERE r <= 3 AND n >= 2 GROUP BY tag"""
)
def tag_catalog(spark, d):
    return tags.catalogue(_tagged(spark, d))


@query(
    """WITH g AS (SELECT vec_id % 97 AS k, any_value(label) AS label FROM embeddings GROUP BY 1) SELECT 'tag-' || k AS name, CAST(k * 7 % 13 AS BIGINT) AS usage_count, 'a' || k || '|b' || k AS aliases FROM g ORDER BY usage_count DESC, name"""
)
def tag_list(spark, d):
    ids = _vectors(spark, d).select((F.col("vec_id") % 97).alias("k")).distinct()
    name = F.concat(F.lit("tag-"), F.col("k").cast("string"))
    catalogue = ids.select(name.alias("name"), (F.col("k") * 7 % 13).alias("usage_count"))
    aliases = ids.select(name.alias("name"), F.explode(F.array(F.concat(F.lit("b"), F.col("k").cast("string")), F.concat(F.lit("a"), F.col("k").cast("string")))).alias("alias"))
    return tags.list_tags(catalogue, aliases).withColumn("aliases", F.array_join("aliases", "|"))


_SUGGEST = [("the", ["erth"]), ("tion", []), ("ment", ["eaux", "elle"]), ("schen", ["ung"])]


@query(
    "WITH x AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents) "
    + " UNION ALL ".join(
        f"SELECT doc_id, '{n}' AS tag, CAST(CASE WHEN contains(t, '{n}') THEN 1.0 ELSE 0.95 END AS DOUBLE) AS score, CASE WHEN contains(t, '{n}') THEN 'name' {' '.join(f"WHEN contains(t, '{a}') THEN 'alias:{a}'" for a in al)} END AS reason FROM x WHERE contains(t, '{n}') {' '.join(f"OR contains(t, '{a}')" for a in al)}"
        for n, al in _SUGGEST
    )
)
def tag_suggest(spark, d):
    catalogue = spark.createDataFrame(_SUGGEST, "name string, aliases array<string>")
    return tags.suggest(_table(spark, d, "documents"), catalogue)


@query(
    f"""WITH t AS (SELECT 'tag-' || vec_id AS name, CAST(vec_id * 7 % 13 AS BIGINT) AS usage_count, embedding AS vec FROM embeddings)
SELECT CASE WHEN a.usage_count >= b.usage_count THEN a.name ELSE b.name END AS keep, CASE WHEN a.usage_count >= b.usage_count THEN b.name ELSE a.name END AS merge, round(round({sql.cosine('a.vec', 'b.vec')}, 9), 6) AS score
FROM t a JOIN t b ON a.name < b.name WHERE round({sql.cosine('a.vec', 'b.vec')}, 9) >= 0.4"""
)
def tag_merge_pairs(spark, d):
    rows = _vectors(spark, d)
    catalogue = rows.select(F.concat(F.lit("tag-"), F.col("vec_id").cast("string")).alias("name"), (F.col("vec_id") * 7 % 13).alias("usage_count"), F.col("embedding").alias("vec"))
    return _short(tags.merges(catalogue, 0.4), "keep", "merge")


@query(
    f"""WITH {sql.CORPUS}, {sql.bm25(TERMS, search.BOOSTS)}, own AS (SELECT tags FROM corpus WHERE name = 'doc-1'), s AS (SELECT tags, score FROM (SELECT * FROM hits ORDER BY score DESC, path LIMIT 50) JOIN corpus USING (path)),
e AS (SELECT unnest(list_distinct(tags)) AS tag, score FROM s) SELECT tag, count(*) AS count, round(max(score), 6) AS score FROM e WHERE tag NOT IN (SELECT unnest(tags) FROM own) GROUP BY tag HAVING count(*) >= 2 ORDER BY count DESC, max(e.score) DESC, tag LIMIT 5"""
)
def tag_from_similar(spark, d):
    notes = _corpus(spark, d)
    own = notes.filter("name = 'doc-1'").select("tags").first()
    return _short(tags.from_similar(search.bm25(notes, WORDS, 50), own[0] if own else []), "tag", "count")


@query(
    f"""WITH {sql.CORPUS}, r AS (SELECT doc_id, list_concat(list_filter(list_transform([' ' || type || ' ', area, ''], lambda x: trim(x)), lambda x: x <> ''), tags) AS l FROM corpus)
SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:5], '|') AS tags FROM r"""
)
def tag_resolve(spark, d):
    manual = F.array_compact(F.array(F.concat(F.lit(" "), F.col("type"), F.lit(" ")), F.col("area"), F.lit("")))
    return _corpus(spark, d).select("doc_id", F.array_join(tags.resolve(manual, F.col("tags"), 5), "|").alias("tags"))


_STOP = ", ".join(f"'{x}'" for x in dict.fromkeys(tags.STOPWORDS_EN + tags.STOPWORDS_KO))
_ENDINGS = " OR ".join(f"(ends_with(token, '{e}') AND octet_length(encode(token)) > {len(e.encode()) + n})" for n, es in ((3, tags.VERB_ENDINGS), (1, tags.PARTICLES)) for e in es)


@query(f"WITH t AS (SELECT DISTINCT unnest({sql.tokens('text')}) AS token FROM conversations UNION SELECT unnest(['구조는', '한국어입니다', '검색', 'search', 'the', '모델의']) AS token) SELECT token, token IN ({_STOP}) OR {_ENDINGS} AS stop FROM t")
def stopword_filter(spark, d):
    words = _table(spark, d, "conversations").select(F.explode(tx.tokenize(F.col("text"))).alias("token"))
    words = words.union(spark.createDataFrame([(x,) for x in ("구조는", "한국어입니다", "검색", "search", "the", "모델의")], "token string")).distinct()
    return words.select("token", tags.is_stopword(F.col("token")).alias("stop"))


@query()
def tag_discover(spark, d):
    """Rows only: keywords are found by the embedding."""
    texts = _corpus(spark, d).filter("gist is not null").select("doc_id", F.col("gist").alias("text"))
    suggested = tags.suggest(texts, spark.createDataFrame(_SUGGEST, "name string, aliases array<string>"))
    return tags.discover(suggested, tags.keyword_rows(texts, vx.Embedder()), 5)


# Profiles and migration ------------------------------------------------------------------------------------------------

_FIELDS = """fields AS (SELECT path, 'note_type' AS field, 'string' AS kind, [type] AS vals FROM notes WHERE type IS NOT NULL UNION ALL SELECT path, 'note_status', 'string', [status] FROM notes WHERE status IS NOT NULL
UNION ALL SELECT path, 'note_area', 'string', [area] FROM notes WHERE area IS NOT NULL UNION ALL SELECT path, 'note_gist', 'string', [trim(gist)] FROM notes WHERE gist IS NOT NULL
UNION ALL SELECT path, 'note_gist_source', 'string', ['ai'] FROM notes WHERE gist IS NOT NULL UNION ALL SELECT path, 'note_gist_date', 'string', [strftime(gist_date, '%Y-%m-%d')] FROM notes WHERE gist IS NOT NULL
UNION ALL SELECT path, 'note_tags', 'array', tags FROM notes WHERE len(tags) > 0),
vc AS (SELECT field, value, count(*) AS n FROM (SELECT field, kind, unnest(vals) AS value FROM fields) WHERE kind = 'array' OR length(value) < 100 GROUP BY 1, 2),
profile AS (SELECT f.field, f.n, f.n / (SELECT count(DISTINCT path) FROM fields) AS coverage, f.data_type, coalesce(d.d, 0) AS "distinct", coalesce(d.d, 0) > 15 AS high_cardinality
FROM (SELECT field, count(*) AS n, min(kind) AS data_type FROM fields GROUP BY 1) f LEFT JOIN (SELECT field, count(*) AS d FROM vc GROUP BY 1) d USING (field))"""


def _fields(spark, d):
    return profile.scan_fields(src.rendered(_corpus(spark, d)))


@query(f"WITH {sql.NOTES}, {_FIELDS} SELECT field, n, round(coverage, 6) AS coverage, data_type, \"distinct\", high_cardinality FROM profile")
def field_profile(spark, d):
    return profile.field_profile(_fields(spark, d)).withColumn("coverage", F.round("coverage", 6))


@query(
    f"""WITH {sql.NOTES}, {_FIELDS} SELECT field, value, vc.n, round(100 * vc.n / t.total, 6) AS percentage, row_number() OVER (PARTITION BY field ORDER BY vc.n DESC, value) AS rank FROM vc JOIN (SELECT field, count(*) AS total FROM fields GROUP BY 1) t USING (field) QUALIFY rank <= 10"""
)
def top_values(spark, d):
    return profile.top_values(_fields(spark, d)).withColumn("percentage", F.round("percentage", 6))


_ROLES = " UNION ALL ".join(
    f"SELECT '{role}' AS role, field, n, round(coverage, 6) AS coverage FROM profile WHERE ({' OR '.join(f"contains(lower(field), '{a}') OR contains('{a}', lower(field))" for a in names)})" + (" AND data_type IN ('array', 'mixed')" if role == "tags" else "") + ("" if role == "gist" else ' AND "distinct" > 0')
    for role, names in profile.ALIASES.items()
)


@query(f"WITH {sql.NOTES}, {_FIELDS} {_ROLES}")
def candidate_fields(spark, d):
    rows, out = profile.field_profile(_fields(spark, d)), None
    for role in profile.ALIASES:
        part = profile.candidates(rows, role).select("role", "field", "n", F.round("coverage", 6).alias("coverage"))
        out = part if out is None else out.unionByName(part)
    return out


def _mapped(value: str, recommended: list[str]) -> str:
    low = f"lower({value})"
    exact = " ".join(f"WHEN {low} = '{r}' THEN '{r}'" for r in recommended)
    part = " ".join(f"WHEN contains({low}, '{r}') OR contains('{r}', {low}) THEN '{r}'" for r in recommended)
    return f"CASE {exact} {part} ELSE '{recommended[0]}' END"


@query(
    f"WITH {sql.NOTES}, {_FIELDS} SELECT field, value, n, CASE WHEN field = 'note_type' THEN {_mapped('value', profile.RECOMMENDED['type'])} ELSE {_mapped('value', profile.RECOMMENDED['area'])} END AS mapped FROM vc WHERE field IN ('note_type', 'note_area')"
)
def value_mapping(spark, d):
    fields, out = _fields(spark, d), None
    for role in ("type", "area"):
        part = profile.value_mapping(fields, f"note_{role}", profile.RECOMMENDED[role]).select(F.lit(f"note_{role}").alias("field"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def _plan(spark, d):
    """Both fields are clean, so their recommendations keep all values: the mapping here is the forced one."""
    recs = []
    for role, values in (("type", [*src.TYPES_IN_TURN]), ("area", [*src.AREA_OF_LANG.values()])):
        rows = spark.createDataFrame([(v,) for v in sorted(set(values))], "value string")
        found = {r["value"]: r["mapped"] for r in rows.select("value", profile.map_value(F.col("value"), profile.RECOMMENDED[role]).alias("mapped")).collect()}
        recs.append(profile.Recommendation(f"note_{role}", tuple(profile.RECOMMENDED[role]), found, True))
    notes = _notes(spark, d)
    keyed = notes.withColumn("fields", F.transform_keys("fields", lambda k, v: F.concat(F.lit("note_"), k)))
    return notes, profile.migration_plan(keyed, *recs)


_CHANGES = f"""changes AS (SELECT path, 'note_type' AS field, 'add' AS action, NULL AS old_value, 'note' AS new_value FROM notes WHERE type IS NULL
UNION ALL SELECT path, 'note_type', 'update', type, {_mapped('type', profile.RECOMMENDED['type'])} FROM notes WHERE type <> {_mapped('type', profile.RECOMMENDED['type'])}
UNION ALL SELECT path, 'note_area', 'update', area, {_mapped('area', profile.RECOMMENDED['area'])} FROM notes WHERE area <> {_mapped('area', profile.RECOMMENDED['area'])})"""


@query(f"WITH {sql.NOTES}, {_CHANGES} SELECT * FROM changes")
def migration_plan(spark, d):
    return _plan(spark, d)[1].select("path", F.explode("changes").alias("c")).select("path", "c.field", "c.action", "c.old_value", "c.new_value")


@query(f"WITH {sql.NOTES}, {_CHANGES} SELECT field, action, count(*) AS n FROM changes GROUP BY 1, 2")
def migration_summary(spark, d):
    return profile.migration_summary(_plan(spark, d)[1])


@query(f"WITH {sql.NOTES}, {_CHANGES} SELECT path, CAST(count(*) FILTER (action = 'add') AS INTEGER) AS adds, CAST(count(*) FILTER (action = 'update') AS INTEGER) AS updates FROM changes GROUP BY path ORDER BY path LIMIT 5")
def migration_preview(spark, d):
    return profile.migration_preview(_plan(spark, d)[1])


@query(
    f"""WITH {sql.NOTES}, {_CHANGES}, m AS (SELECT path, max(CASE WHEN field = 'note_type' AND action = 'update' THEN new_value END) AS t, max(CASE WHEN field = 'note_area' THEN new_value END) AS a, max(CASE WHEN action = 'add' THEN new_value END) AS n FROM changes GROUP BY path),
x AS (SELECT path, content, t, a, n, type, area, strpos(substr(content, 5), chr(10) || '---') + 4 AS e FROM notes JOIN m USING (path))
SELECT path, replace(replace(left(content, e - 1), 'note_type: ' || coalesce(type, '#') || chr(10), 'note_type: ' || coalesce(t, type, '#') || chr(10)), 'note_area: ' || coalesce(area, '#') || chr(10), 'note_area: ' || coalesce(a, area, '#') || chr(10)) || coalesce(chr(10) || 'note_type: ' || n, '') || substr(content, e) AS new_content FROM x"""
)
def migration_apply(spark, d):
    return profile.apply_migration(*_plan(spark, d))


@query(
    f"""WITH {sql.NOTES}, {_FIELDS}, h AS (SELECT (SELECT count(DISTINCT path) FROM fields) / (SELECT count(*) FROM notes) AS c, (SELECT coverage FROM profile WHERE field = 'note_type') AS t, (SELECT coverage FROM profile WHERE field = 'note_area') AS a, (SELECT max(coverage) FROM profile WHERE contains(field, 'gist')) AS g)
SELECT round(c, 6) AS coverage, CAST(round(least(100, 30 * c + 20 * t + 10 + 15 * a + 5 + 20 * g)) AS INTEGER) AS score, CASE WHEN round(least(100, 30 * c + 20 * t + 10 + 15 * a + 5 + 20 * g)) >= 70 THEN 'good' WHEN round(least(100, 30 * c + 20 * t + 10 + 15 * a + 5 + 20 * g)) >= 40 THEN 'fair' ELSE 'poor' END AS band FROM h"""
)
def profile_health(spark, d):
    notes = src.rendered(_corpus(spark, d))
    return profile.profile_health(notes, profile.scan_fields(notes)).select(F.round("coverage", 6).alias("coverage"), "score", "band")


@query(f"WITH {sql.CORPUS} SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, count(*) AS n FROM corpus GROUP BY 1")
def folder_histogram(spark, d):
    return profile.folders(_corpus(spark, d))


@query(f"WITH {sql.NOTES}, {_CHANGES} SELECT count(*) FILTER (field = 'note_type') AS type_changes, count(*) FILTER (field = 'note_area') AS area_changes, CAST(0 AS BIGINT) AS new_frontmatter, count(*) AS total FROM changes")
def migration_review(spark, d):
    notes = src.rendered(_corpus(spark, d))
    health = profile.profile_health(notes, profile.scan_fields(notes))
    return profile.review(_plan(spark, d)[1], health).select("type_changes", "area_changes", "new_frontmatter", "total")


@query(r"""WITH x AS (SELECT doc_id, regexp_extract(regexp_replace('see [[' || text, '\r?\n\z', ''), '\[\[([^\]]*)\z', 1) AS found FROM documents)
SELECT doc_id, CASE WHEN length(found) >= 2 THEN found END AS prefix FROM x""")
def completion_prefixes(spark, d):
    line = F.concat(F.lit("see [["), F.col("text"))
    return _table(spark, d, "documents").select("doc_id", tx.completion_prefix(line).alias("prefix"))


@query(r"""WITH x AS (SELECT doc_id, list_transform(regexp_split_to_array(coalesce(text, ''), '\r?\n'), lambda x: trim(x)) AS l FROM documents)
SELECT doc_id, 'note' AS type, nullif(array_to_string(list_filter(l, lambda x: x <> ''), ' '), '') AS gist, CAST(length(array_to_string(l, ' ')) AS INTEGER) AS scanned FROM x""")
def fm_long_blocks(spark, d):
    """Whole texts, up to the longest, as folded gists: through the parser and through the scanner of unknown fields."""
    block = F.regexp_replace(F.coalesce("text", F.lit("")), "\n", "\n  ")
    files = _corpus_files(spark, d).withColumn("content", F.concat(F.lit("---\nnote_gist: >\n  "), block, F.lit("\nnote_type: note\n---\nbody\n")))
    held = profile.scan_fields(files).filter("field = 'note_gist'").select("path", F.char_length(F.get("values", F.lit(0))).alias("scanned"))
    return src.parse_notes(files).join(held, "path").select("doc_id", "type", "gist", "scanned")


# Index upkeep and saving -----------------------------------------------------------------------------------------------

_SNAPSHOTS = """files AS (SELECT path, doc_id % 10 AS mtime, gist AS text FROM corpus WHERE doc_id % 11 <> 0), stored AS (SELECT path, CASE WHEN doc_id % 13 = 0 THEN -1 ELSE doc_id % 10 END AS mtime, gist AS text FROM corpus WHERE doc_id % 17 <> 0),
diff AS (SELECT coalesce(f.path, s.path) AS path, CASE WHEN s.path IS NULL THEN 'added' WHEN f.path IS NULL THEN 'removed' WHEN f.mtime = s.mtime AND f.text IS NOT DISTINCT FROM s.text THEN 'unchanged' ELSE 'updated' END AS action FROM files f FULL OUTER JOIN stored s ON f.path = s.path)"""


def _snapshots(spark, d):
    notes = _corpus(spark, d).select("doc_id", "path", (F.col("doc_id") % 10).alias("mtime"), F.col("gist").alias("text"))
    files = notes.filter("doc_id % 11 <> 0").drop("doc_id")
    stored = notes.filter("doc_id % 17 <> 0").withColumn("mtime", F.when(F.col("doc_id") % 13 == 0, -1).otherwise(F.col("mtime"))).drop("doc_id")
    return files, stored


@query(f"WITH {sql.CORPUS}, {_SNAPSHOTS} SELECT path, action FROM diff")
def sync_diff(spark, d):
    return sync.diff(*_snapshots(spark, d))


@query(f"WITH {sql.CORPUS}, {_SNAPSHOTS} SELECT action, count(*) AS n FROM diff GROUP BY action")
def sync_stats(spark, d):
    return sync.sync_counts(sync.diff(*_snapshots(spark, d)))


@query(f"WITH {sql.CORPUS}, {_SNAPSHOTS} SELECT count(*) AS notes, max(mtime) AS last_indexed, (SELECT count(*) FROM embeddings) AS vectors FROM stored")
def index_stats(spark, d):
    return sync.index_stats(_snapshots(spark, d)[1], _vectors(spark, d))


@query(f"WITH {sql.CORPUS}, {_SNAPSHOTS} SELECT path, mtime, text FROM files")
def sync_apply(spark, d):
    files, stored = _snapshots(spark, d)
    return sync.apply(stored, files, sync.diff(files, stored))


@query(f"WITH {sql.CORPUS}, {_SNAPSHOTS} SELECT path, mtime, text FROM files UNION ALL SELECT path, mtime, text FROM stored WHERE path NOT IN (SELECT path FROM files)")
def upsert_apply(spark, d):
    files, stored = _snapshots(spark, d)
    return save.upsert(stored, files, "path")


@query(f"WITH {sql.CORPUS} SELECT 'missing_gist' AS code, path, CAST(1 AS BIGINT) AS n FROM (SELECT * FROM corpus UNION ALL SELECT * FROM corpus WHERE doc_id % 50 = 1) WHERE gist IS NULL UNION ALL SELECT 'repeated_path', path, CAST(2 AS BIGINT) FROM corpus WHERE doc_id % 50 = 1")
def export_contract(spark, d):
    notes = _corpus(spark, d)
    twice = notes.unionByName(notes.filter("doc_id % 50 = 1"))
    return save.contract_errors(twice, {"version": 1, "embeddingMode": "htp", "dimension": 384, "noteCount": twice.count()})


@query(
    f"""WITH {sql.CORPUS}, r AS (SELECT CASE WHEN doc_id % 3 = 0 THEN name WHEN doc_id % 41 = 1 THEN '../' || name ELSE 'new ' || name END AS title FROM corpus)
SELECT title, CASE WHEN contains(title, '/') THEN 'invalid' WHEN starts_with(title, 'new') THEN 'created' ELSE 'exists' END AS outcome FROM r"""
)
def save_create(spark, d):
    notes = _corpus(spark, d)
    title = F.when(F.col("doc_id") % 3 == 0, F.col("name")).when(F.col("doc_id") % 41 == 1, F.concat(F.lit("../"), F.col("name"))).otherwise(F.concat(F.lit("new "), F.col("name")))
    requests = notes.select(title.alias("title"), F.col("body").alias("content"), "type", "area", "gist", "tags", F.lit(None).cast("array<string>").alias("source"), F.col("gist_date").alias("today"))
    return save.create(requests, notes).select("title", "outcome")


@query(f"WITH {sql.NOTES} SELECT path, CASE WHEN doc_id % 4 = 0 THEN regexp_replace(content, '\\s+$', '') || chr(10) || chr(10) || 'more on ' || name ELSE content END AS content FROM notes")
def save_append(spark, d):
    notes = src.rendered(_corpus(spark, d))
    requests = notes.filter("doc_id % 4 = 0").select(F.col("name").alias("title"), F.concat(F.lit("more on "), F.col("name")).alias("content"))
    return save.append(requests, notes.select("path", "name", "content")).select("path", "content")


@query(
    """SELECT conv_id, turn, chr(10) || '---' || chr(10) || chr(10) || '**2024-05-01 ' || lpad(CAST(turn % 24 AS VARCHAR), 2, '0') || ':00**' || CASE WHEN role <> 'user' THEN ' - ' || role ELSE '' END || chr(10) || chr(10) || text AS entry FROM conversations"""
)
def inbox_memos(spark, d):
    rows = _table(spark, d, "conversations")
    at = F.timestamp_add("HOUR", (F.col("turn") % 24).cast("int"), F.lit("2024-05-01 00:00:00").cast("timestamp"))
    title = F.when(F.col("role") != "user", F.col("role")).otherwise("Inbox")
    return rows.select("conv_id", "turn", save.inbox_entry(F.col("text"), title, at).alias("entry"))


@query(
    """WITH m AS (SELECT conv_id, unnest(list_filter(list_transform(regexp_split_to_array(string_agg(text, chr(10) || '---' || chr(10) ORDER BY turn), '(?m)^---\\r?$'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '')) AS memo FROM conversations WHERE text IS NOT NULL GROUP BY conv_id) SELECT conv_id, count(*) AS memos, CAST(sum(length(memo)) AS BIGINT) AS chars FROM m GROUP BY conv_id"""
)
def inbox_split(spark, d):
    rows = _table(spark, d, "conversations").filter("text is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("l"))
    content = F.array_join(F.transform("l", lambda x: x["text"]), "\n---\n")
    split = rows.select("conv_id", F.explode(src.memos(content)).alias("memo"))
    return split.groupBy("conv_id").agg(F.count("*").alias("memos"), F.sum(F.char_length("memo").cast("long")).alias("chars"))


# Change feeds ----------------------------------------------------------------------------------------------------------

_KIND = "CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete' WHEN 'purchase' THEN 'rename' ELSE 'modify' END"
_FEED = f"feed AS (SELECT 'n' || user_id || '.md' AS path, 'old' || user_id || '.md' AS old_path, {_KIND} AS kind, ts FROM events)"


def _feed(spark, d):
    kinds = F.when(F.col("event_type") == "signup", "create").when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "purchase", "rename").otherwise("modify")
    user = F.col("user_id").cast("string")
    return _table(spark, d, "events").select(F.concat(F.lit("n"), user, F.lit(".md")).alias("path"), F.concat(F.lit("old"), user, F.lit(".md")).alias("old_path"), kinds.alias("kind"), F.col("ts").cast("timestamp").alias("ts"))


_EXPANDED = f"{_FEED}, x AS (SELECT path, CASE WHEN kind = 'rename' THEN 'create' ELSE kind END AS kind, ts FROM feed UNION ALL SELECT old_path, 'delete', ts FROM feed WHERE kind = 'rename')"


@query(f"WITH {_EXPANDED} SELECT path, kind, count(*) AS n FROM x GROUP BY 1, 2")
def rename_expand(spark, d):
    return watch.expand_renames(_feed(spark, d)).groupBy("path", "kind").agg(F.count("*").alias("n"))


_GAP = "6 hours"


def _sessions(keys: str, gap: str = "6 HOUR") -> str:
    by = f"PARTITION BY {keys} " if keys else ""
    return f"s AS (SELECT *, sum(new) OVER ({by}ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN ts < lag(ts) OVER ({by}ORDER BY ts) + INTERVAL {gap} THEN 0 ELSE 1 END AS new FROM x))"


@query(f"WITH {_EXPANDED}, {_sessions('path')} SELECT path, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS \"end\", count(*) AS n FROM s GROUP BY path, g")
def debounce_sessions(spark, d):
    return watch.debounce(watch.expand_renames(_feed(spark, d)), _GAP, per_path=True)


@query(f"WITH {_EXPANDED}, {_sessions('path')}, r AS (SELECT *, row_number() OVER (PARTITION BY path, g ORDER BY ts DESC, kind = 'delete' DESC, kind DESC) AS r, count(*) OVER (PARTITION BY path, g) AS n FROM s) SELECT path, kind, ts, n FROM r WHERE r = 1")
def last_event_wins(spark, d):
    return watch.last_events(watch.expand_renames(_feed(spark, d)), _GAP)


@query(f"WITH {_EXPANDED}, {_sessions('', '2 MINUTE')} SELECT min(ts) AS start, max(ts) + INTERVAL 2 MINUTE AS \"end\", count(*) AS n FROM s GROUP BY g")
def debounce_all(spark, d):
    """One timer for all paths."""
    return watch.debounce(watch.expand_renames(_feed(spark, d)), "2 minutes")


@query(
    f"""WITH {_EXPANDED}, m AS (SELECT path, kind, epoch_us(ts) // 1000 AS ms FROM x), s AS (SELECT *, sum(new) OVER (ORDER BY ms) AS g FROM (SELECT *, CASE WHEN ms <= lag(ms) OVER (ORDER BY ms) + 120000 THEN 0 ELSE 1 END AS new FROM m)),
r AS (SELECT *, row_number() OVER (PARTITION BY path, g ORDER BY ms DESC, kind = 'delete' DESC, kind DESC) AS r, max(ms) OVER (PARTITION BY g) + 120000 AS due FROM s) SELECT path, kind, ms AS ts, due FROM r WHERE r = 1"""
)
def pending_bursts(spark, d):
    """The last event of each path of each burst, by a stream that keeps state with one timer for all paths, in shards; a flush ends
    the last burst. The feed lies by time. Such state needs RocksDB, so the setting is made for the run and put back."""
    old, at = {k: spark.conf.get(k, None) for k in pending.ROCKSDB}, f"{shared_folder(spark)}/pending-{uuid.uuid4().hex}"
    feed, none = _feed(spark, d), F.lit(None).cast("string")
    end = feed.agg((F.max("ts") + F.expr("INTERVAL 2 MINUTES")).alias("ts")).select(none.alias("path"), none.alias("old_path"), F.lit(pending.FLUSH).alias("kind"), "ts")
    feed.unionByName(end).repartitionByRange("ts").write.parquet(f"{at}/feed")
    try:
        for k, v in pending.ROCKSDB.items():
            spark.conf.set(k, v)
        changes = pending.pending_changes(spark.readStream.schema(watch.CHANGES).parquet(f"{at}/feed"), 120_000, shards=64)
        write = lambda rows, n: rows.write.mode("overwrite").parquet(f"{at}/out/batch={n}")
        changes.writeStream.foreachBatch(write).option("checkpointLocation", f"{at}/mark").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(pending.EMITTED).parquet(f"{at}/out").select("path", "kind", "ts", "due")


# Smaller operators -----------------------------------------------------------------------------------------------------


@query("""WITH p AS (SELECT doc_id, 'Notes/' || CASE WHEN doc_id % 4 = 0 THEN '.' ELSE '' END || source || '/' || CASE WHEN doc_id % 9 = 0 THEN '.x.md' ELSE 'x.md' END AS path FROM documents)
SELECT doc_id, contains('/' || path, '/.') AS hidden FROM p""")
def hidden_paths(spark, d):
    dot = lambda n: F.when(F.col("doc_id") % n == 0, ".").otherwise("")
    path = F.concat(F.lit("Notes/"), dot(4), F.col("source"), F.lit("/"), dot(9), F.lit("x.md"))
    return _table(spark, d, "documents").select("doc_id", tx.hidden(path).alias("hidden"))


@query("SELECT doc_id, CASE WHEN length(text) > 20 THEN left(text, 20) || '...' ELSE text END AS short, CAST(round((n_chars % 1001) / 1000 * 100) AS INTEGER) || '%' AS share FROM documents")
def text_formats(spark, d):
    return _table(spark, d, "documents").select("doc_id", tx.ellipsis(F.col("text"), 20).alias("short"), tx.percent((F.col("n_chars") % 1001) / 1000).alias("share"))


@query("SELECT doc_id, CAST(n_chars AS VARCHAR) AS n, 'true' AS b, source || ', ' || lang AS l, 3 AS size FROM documents")
def coerced_fields(spark, d):
    raw = F.concat(F.lit('{"n": '), F.col("n_chars").cast("string"), F.lit(', "b": true, "l": ["'), F.col("source"), F.lit('", "", "'), F.col("lang"), F.lit('"], "o": {"z": 1}, "e": null}'))
    rows = _table(spark, d, "documents").select("doc_id", src.coerce_fields(raw).alias("f"))
    return rows.select("doc_id", F.col("f")["n"].alias("n"), F.col("f")["b"].alias("b"), F.col("f")["l"].alias("l"), F.size("f").alias("size"))


@query(f"""WITH {sql.CORPUS} SELECT path, '{{"title":"' || name || '","path":"' || path || '"' || CASE WHEN status IS NOT NULL THEN ',"status":"' || status || '"' ELSE '' END || CASE WHEN area IS NOT NULL THEN ',"area":"' || area || '"' ELSE '' END || '}}' AS json FROM corpus""")
def notes_json(spark, d):
    return listing.as_json(_corpus(spark, d), "status, area")


@query(f"WITH {sql.NOTES} SELECT doc_id, type, area, CAST((type IS NOT NULL)::INT + (area IS NOT NULL)::INT AS INTEGER) AS size FROM notes")
def picked_fields(spark, d):
    rows = _notes(spark, d).select("doc_id", listing.pick_fields(F.col("fields"), ["type", "area", "nothing"]).alias("f"))
    return rows.select("doc_id", F.col("f")["type"].alias("type"), F.col("f")["area"].alias("area"), F.size("f").alias("size"))


@query(f"WITH {sql.CORPUS} SELECT name AS title, path, gist FROM corpus ORDER BY modified DESC, path LIMIT 10")
def recent_notes(spark, d):
    return Collection(_corpus(spark, d)).recent(10)


@query(f"""WITH {sql.NOTES} SELECT path, CASE WHEN doc_id % 5 = 0 THEN concat_ws(chr(10), '---', 'note_type: log', 'note_status: active', 'note_area: ' || area, '---') || chr(10) || chr(10) || 'anew: ' || name || chr(10) ELSE content END AS content FROM notes""")
def save_update(spark, d):
    notes, none = src.rendered(_corpus(spark, d)), F.lit(None).cast("string")
    requests = notes.filter("doc_id % 5 = 0").select(
        F.col("name").alias("title"), F.concat(F.lit("anew: "), F.col("name")).alias("content"), F.lit("log").alias("type"), "area", none.alias("gist"),
        F.array().cast("array<string>").alias("tags"), F.lit(None).cast("array<string>").alias("source"), F.lit(None).cast("date").alias("today"),
    )
    return save.update(requests, notes.select("path", "name", "content")).select("path", "content")


@query("SELECT vec_id, label FROM embeddings WHERE vec_id % 7 <> 0")
def delete_vectors(spark, d):
    rows = _vectors(spark, d)
    return save.delete(rows, rows.filter("vec_id % 7 = 0"), "vec_id").select("vec_id", "label")


def _labelled_tags(spark, d):
    """A catalogue of as many tags as there are labels of vectors, each with two aliases."""
    label = F.col("label").cast("string")
    rows = _vectors(spark, d).select("label").distinct()
    return rows.select(F.concat(F.lit("tag-"), label).alias("name"), F.concat(F.lit("about "), label).alias("description"), F.array(F.concat(F.lit("a"), label), F.concat(F.lit("b"), label)).alias("aliases"), F.lit(0).cast("long").alias("usage_count"))


@query("SELECT 'tag-' || label AS name, count(*) AS usage_count FROM embeddings GROUP BY label")
def tag_usage(spark, d):
    return save.increment_usage(_labelled_tags(spark, d), _vectors(spark, d).select(F.concat(F.lit("tag-"), F.col("label").cast("string")).alias("name"))).select("name", "usage_count")


@query("SELECT name, aliases FROM (SELECT DISTINCT 'tag-' || label AS name, 'a' || label || '|b' || label || CASE WHEN label = 1 THEN '|more' ELSE '' END AS aliases FROM embeddings UNION ALL SELECT 'fresh', '')")
def tag_additions(spark, d):
    more = tags.add_tag(tags.add_tag(_labelled_tags(spark, d), "fresh", "a new one"), "tag-1", "known already")
    return tags.add_alias(more, "tag-1", "more").select("name", F.array_join("aliases", "|").alias("aliases"))


@query("SELECT * FROM (VALUES ('tag-1', 'a1|b1'), ('tag-2', '')) AS t(name, aliases)")
def find_tag(spark, d):
    """By name, by alias, and not at all."""
    catalogue = _labelled_tags(spark, d)
    found = tags.find_tag(catalogue, "tag-1").unionByName(tags.find_tag(catalogue, "b2")).unionByName(tags.find_tag(catalogue, "nothing"))
    return found.select("name", F.array_join("aliases", "|").alias("aliases"))


@query("SELECT count(DISTINCT label) AS n, count(*) = 0 AS is_empty FROM embeddings")
def tag_count(spark, d):
    return tags.tag_count(_labelled_tags(spark, d))


@query(f"""SELECT doc_id, tag, round(score, 6) AS score, 'semantic' AS reason FROM (SELECT a.vec_id AS doc_id, 'tag-' || b.vec_id AS tag, round({sql.cosine('a.embedding', 'b.embedding')}, 9) AS score
FROM embeddings a JOIN embeddings b ON b.vec_id < 30) WHERE score >= 0.3""")
def tag_semantic(spark, d):
    rows = _vectors(spark, d)
    texts = rows.select(F.col("vec_id").alias("doc_id"), F.lit("").alias("text"), F.col("embedding").cast("array<double>").alias("vec"))
    catalogue = rows.filter("vec_id < 30").select(F.concat(F.lit("tag-"), F.col("vec_id").cast("string")).alias("name"), F.array().cast("array<string>").alias("aliases"), F.col("embedding").cast("array<double>").alias("vec"))
    return _short(tags.suggest(texts, catalogue), "doc_id", "tag", "reason")


@query(f"WITH {sql.NOTES}, {_FIELDS} SELECT coalesce(CAST(sum(n) FILTER ({_mapped('value', profile.RECOMMENDED['type'])} <> value) AS BIGINT), 0) AS n FROM vc WHERE field = 'note_type'")
def mapping_estimate(spark, d):
    return profile.estimate(profile.value_mapping(_fields(spark, d), "note_type", profile.RECOMMENDED["type"]))


@query(f"WITH {sql.NOTES} SELECT 'note_gist' AS gist, 'note_tags' AS tags, (SELECT count(*) FROM notes WHERE concat_ws('', type, status, area, gist) <> '' OR len(tags) > 0) - count(gist) AS notes_without_gist, CAST(0 AS BIGINT) AS type_updates, CAST(0 AS BIGINT) AS area_updates FROM notes")
def schema_recommendation(spark, d):
    found = profile.recommend_schema(src.rendered(_corpus(spark, d)), _fields(spark, d))
    return spark.createDataFrame([(found.gist, found.tags, found.notes_without_gist, found.type_updates, found.area_updates)], "gist string, tags string, notes_without_gist bigint, type_updates bigint, area_updates bigint")


@query("SELECT * FROM (VALUES ('dimension', '64', (SELECT count(*) FROM embeddings)), ('dimension', '128', 0)) AS t(key, value, vectors)")
def index_meta(spark, d):
    """Vectors stay as long as their dimension does."""
    meta, out = sync.set_meta(spark.createDataFrame([("dimension", "32")], "key string, value string"), "dimension", "64"), None
    for dimension in (64, 128):
        new, left = sync.clear_on_dimension_change(meta, _vectors(spark, d), dimension)
        part = new.crossJoin(left.agg(F.count("*").alias("vectors")))  # one row by one row
        out = part if out is None else out.unionByName(part)
    return out


_SCORE = "boost * ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * dl / mean))"


@query(f"""WITH {sql.CORPUS}, {sql.bm25(['that', 'with', 'doc'], search.BOOSTS, 'h')}, ok AS (SELECT doc_id FROM p_h WHERE tf > 0 GROUP BY doc_id HAVING count(*) FILTER (term = 'that') > 0 AND count(*) FILTER (term = 'with') = 0)
SELECT path, round(round(sum({_SCORE}), 9), 6) AS score FROM p_h JOIN d_h USING (field, term) JOIN s_h USING (field) JOIN ok USING (doc_id) WHERE tf > 0 AND term <> 'with' AND (term <> 'doc' OR field = 'title') GROUP BY path""")
def bm25_syntax(spark, d):
    return _short(search.bm25(_corpus(spark, d), "+that -with title:doc", None), "path")


@query(f"WITH {sql.CORPUS}, {sql.bm25(TERMS, search.BOOSTS)} {CONTEXT} hits")
def bm25_stored(spark, d):
    """Out of an inverted index that is written first."""
    index = search.StoredIndex.write(_corpus(spark, d), f"{shared_folder(spark)}/index-{uuid.uuid4().hex}")
    return _short(index.search(WORDS, None), "path")


RARE = "reviewing the benchmark of that tokenizer"


@query(
    f"""WITH {sql.CORPUS}, {sql.bm25(TERMS, {'body': 1.0}, 'a')}, {sql.bm25(search.query_terms(RARE), {'body': 1.0}, 'b')}
SELECT query, path, round(score, 6) AS score FROM ((SELECT '{WORDS}' AS query, path, score FROM a ORDER BY score DESC, path LIMIT 20)
  UNION ALL (SELECT '{RARE}', path, score FROM b ORDER BY score DESC, path LIMIT 20))"""
)
def bm25_block_max(spark, d):
    """The best hits in the whole texts, out of the blocks that can hold them."""
    index, out = BlockIndex.write(_corpus(spark, d), f"{shared_folder(spark)}/blocks-{uuid.uuid4().hex}", columns={"body": F.col("body")}), None
    for words in (WORDS, RARE):
        part = _short(index.search(words, 20, boosts={"body": 1.0}), F.lit(words).alias("query"), "path")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    f"""WITH w AS (SELECT coalesce(lang, 'und') AS field, unnest({sql.terms('text')}) AS value FROM documents),
c AS (SELECT field, value, count(*) AS n FROM w GROUP BY 1, 2), a AS (SELECT field, sum(n) AS total FROM c GROUP BY 1)
SELECT field, value, n, place, CAST(total AS BIGINT) AS total, true AS distinct_is_close FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS place FROM c) JOIN a USING (field) WHERE place <= 10"""
)
def field_sketches(spark, d):
    """The ten most frequent words of each language, and whether their estimated number is within 5 % (six standard errors) of
    the true one, from sketches of the documents of each quality, the other documents being a batch that is replaced."""
    docs = _table(spark, d, "documents").join(_table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    made = docs.select(F.coalesce("quality", F.lit(2)).alias("batch"), F.coalesce("lang", F.lit("und")).alias("field"), F.lit("array").alias("kind"), tx.index_terms(F.col("text")).alias("values"))
    kept = FieldSketches(spark, f"{shared_folder(spark)}/sketches-{uuid.uuid4().hex}")
    kept.add(made, 2)
    for batch in range(3):
        kept.add(made.filter(F.col("batch") == batch), batch)
    true = kept.counts().groupBy("field").agg(F.count("*").alias("true"))
    close = kept.profile().join(true, "field").select("field", F.col("n").alias("total"), (F.abs(F.col("distinct") - F.col("true")) <= 0.05 * F.col("true")).alias("distinct_is_close"))
    return kept.top(10).join(close, "field")
