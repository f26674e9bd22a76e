"""BM25, weighted reciprocal rank fusion, and search in its modes."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import index_terms, once, title_from_path
from ..functions.vectors import Embedder
from .knn import knn

# Field boosts, BM25 and fusion constants, limits.
BOOSTS = {"title": 3.0, "gist": 2.0, "tags": 1.5}
K1, B = 1.2, 0.75
WEIGHTS, RRF_K = {"semantic": 0.7, "bm25": 0.3}, 60
LIMIT, MOST, OVERSAMPLE, MOST_FETCHED, FUSE = 5, 100, 5, 500, 3


def index_fields(notes: DataFrame) -> dict[str, Column]:
    """The indexed text of the fields: the title out of the path, the gist, and the tags joined by spaces."""
    return {"title": title_from_path(F.col("path")), "gist": F.col("gist"), "tags": F.array_join("tags", " ")}


def postings(notes: DataFrame, key: str = "doc_id", columns: dict[str, Column] | None = None) -> DataFrame:
    """(key, field, term, tf, dl, positions): the inverted index, a row for each term of a field of a note."""
    columns = columns or index_fields(notes)
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), index_terms(c).alias("terms")) for f, c in columns.items()])).alias("x")
    rows = notes.select(key, each).select(key, F.col("x.field").alias("field"), F.size("x.terms").alias("dl"), F.posexplode("x.terms").alias("pos", "term"))
    return rows.groupBy(key, "field", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"), F.array_sort(F.collect_list("pos")).alias("positions"))


def postings_by_row(notes: DataFrame, key: str = "doc_id", columns: dict[str, Column] | None = None) -> DataFrame:
    """``postings`` of notes whose key is unique: a row's terms are sorted and grouped in place, so nothing is moved."""
    columns = columns or index_fields(notes)
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), index_terms(c).alias("terms")) for f, c in columns.items()])).alias("x")
    rows = notes.select(key, each).select(key, F.col("x.field").alias("field"), F.size("x.terms").alias("dl"), F.transform("x.terms", lambda t, i: F.struct(t.alias("term"), i.alias("pos"))).alias("at"))
    rows = once(rows.filter("dl > 0"), sorted=F.sort_array("at"))
    starts = F.filter(F.sequence(F.lit(0), F.col("dl") - 1), lambda i: (i == 0) | (F.get("sorted", i)["term"] != F.get("sorted", i - 1)["term"]))
    rows = once(rows, starts=starts)
    ends = F.concat(F.slice("starts", 2, F.size("starts")), F.array("dl"))
    groups = F.zip_with("starts", ends, lambda a, b: F.struct(F.get("sorted", a)["term"].alias("term"), (b - a).cast("long").alias("tf"), F.transform(F.slice("sorted", a + 1, b - a), lambda x: x["pos"]).alias("positions")))
    return rows.select(key, "field", "dl", F.explode(groups).alias("g")).select(key, "field", "g.term", "g.tf", "dl", "g.positions")


def df_stats(notes: DataFrame, columns: dict[str, Column] | None = None, key: str = "doc_id") -> DataFrame:
    """(field, term, df, cf): in how many notes, and how often, a term occurs."""
    columns = columns or index_fields(notes)
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), index_terms(c).alias("terms")) for f, c in columns.items()])).alias("x")
    rows = notes.select(key, each).select(key, F.col("x.field").alias("field"), F.explode("x.terms").alias("term"))
    rows = rows.groupBy(key, "field", "term").agg(F.count("*").alias("tf"))
    return rows.groupBy("field", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def query_terms(query: str) -> list[str]:
    """The distinct terms of a query, as the index has them."""
    return list(dict.fromkeys(x for x in re.split(r"[\W_]+", query.lower()) if x))


@dataclass(frozen=True)
class Clause:
    """A part of a query: one term, or a phrase of several, in one field or any; ``+`` must match and ``-`` must not."""

    terms: tuple[str, ...]
    sign: str = ""
    field: str | None = None


_CLAUSE = re.compile(r"""([+-]?)(?:(\w+):)?(?:"([^"]*)"?|(\S+))""")


def parse_syntax(query: str, fields: Iterable[str]) -> list[Clause]:
    """The clauses of a query: words, ``"phrases"``, ``+must``, ``-not`` and ``field:word``. A word that the index has as several
    terms is a phrase of these. Signs and names that mean nothing are read as words: no query is an error. Of equal
    clauses the first counts."""
    known, out = set(fields), []
    for sign, name, phrase, word in _CLAUSE.findall(query):
        if name and name not in known:
            phrase, word, name = "", f"{name}:{phrase or word}", ""
        if terms := tuple(x for x in re.split(r"[\W_]+", (phrase or word).lower()) if x):
            out.append(Clause(terms, sign, name or None))
    return list(dict.fromkeys(out))


def _is(term: str):
    return lambda x: x == term


def _idf(total: int, df: int) -> float:
    return math.log(1 + (total - df + 0.5) / (df + 0.5))


def _part(tf: Column, dl: Column, mean: float) -> Column:
    return (K1 + 1) * tf / (tf + K1 * (1 - B + B * dl / F.lit(mean or 1.0)))


def bm25(notes: DataFrame, query: str, limit: int | None, key: str = "path", boosts: dict[str, float] | None = None, columns: dict[str, Column] | None = None) -> DataFrame:
    """``notes`` with their BM25 score, best first: the boosted sum over fields and terms, any term may match. Queries may
    have phrases, signs and field names (``parse_syntax``).

    A query of bare words has few terms, so their frequencies are plain columns: one pass gives the statistics, a second
    the scores. Neither shuffles more than a row or ``limit`` rows a task. Other queries go through the postings of
    their terms.
    """
    boosts, columns = boosts or BOOSTS, columns or index_fields(notes)
    names = [f for f in columns if boosts.get(f)]
    clauses = parse_syntax(query, names)
    if not clauses:
        return notes.limit(0).withColumn("score", F.lit(0.0))
    if any(len(c.terms) > 1 or c.sign or c.field for c in clauses):
        sizes = [F.sum(F.size(index_terms(columns[f]))).alias(f) for f in names]
        held = notes.agg(F.count("*").alias("n"), *sizes).first()
        wanted = sorted({t for c in clauses for t in c.terms})
        posts = postings(notes, key, {f: columns[f] for f in names}).filter(F.col("term").isin(*wanted))
        found = score_postings(posts, {f: (held["n"], held[f] or 0) for f in names}, clauses, {f: boosts[f] for f in names}, key)
        out = notes.join(found, key)
        return out.orderBy(F.desc("score"), key).limit(limit) if limit is not None else out
    terms = [c.terms[0] for c in clauses]
    tokens = notes.withColumns({f"_t_{f}": index_terms(columns[f]) for f in names})
    counts = {f"_n_{f}": F.size(f"_t_{f}") for f in names}
    counts |= {f"_f_{f}_{i}": F.size(F.filter(f"_t_{f}", _is(t))) for f in names for i, t in enumerate(terms)}
    counted = tokens.withColumns(counts)
    stats = counted.agg(F.count("*").alias("n"), *[F.sum(f"_n_{f}").alias(f"_n_{f}") for f in names], *[F.count_if(F.col(c) > 0).alias(c) for c in counts if c.startswith("_f_")])
    stats = stats.first()
    total, parts = stats["n"], []
    for f in names:
        mean = (stats[f"_n_{f}"] or 0) / max(total, 1)
        for i, _ in enumerate(terms):
            c, df = F.col(f"_f_{f}_{i}"), stats[f"_f_{f}_{i}"]
            if df:
                parts.append(F.when(c > 0, boosts[f] * _idf(total, df) * _part(c, F.col(f"_n_{f}"), mean)).otherwise(0.0))
    if not parts:
        return notes.limit(0).withColumn("score", F.lit(0.0))
    matched = counted.filter(F.greatest(F.lit(0), *[F.col(c) for c in counts if c.startswith("_f_")]) > 0)
    out = matched.withColumn("score", F.round(sum(parts[1:], parts[0]), 9)).select(*notes.columns, "score")
    return out.orderBy(F.desc("score"), key).limit(limit) if limit is not None else out


def score_postings(posts: DataFrame, sizes: dict[str, tuple[int, int]], clauses: list[Clause], boosts: dict[str, float], key: str = "path") -> DataFrame:
    """(key, score) of all notes that match. ``posts`` are the postings of the clauses' terms, ``sizes`` the notes and the
    words of each field. A phrase counts where its terms follow one another; its weight is the sum of theirs."""
    df = {(r["field"], r["term"]): r["n"] for r in posts.groupBy("field", "term").agg(F.count("*").alias("n")).collect()}  # a row a field and term of the query
    held = posts.groupBy(key, "field").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at"), F.first("dl").alias("dl"))
    none, scored = F.array().cast("array<int>"), held
    for i, clause in enumerate(clauses):
        places = [F.coalesce(F.col("at")[t], none) for t in clause.terms]
        tf = F.size(F.filter(places[0], _follows(places[1:]))).cast("double")
        score = F.lit(0.0)
        for f, boost in boosts.items():
            n, words = sizes.get(f, (0, 0))
            if clause.field in (None, f) and all((f, t) in df for t in clause.terms):
                weight = boost * sum(_idf(n, df[f, t]) for t in clause.terms)
                score = F.when((F.col("field") == f) & (tf > 0), F.lit(weight) * _part(tf, F.col("dl"), words / max(n, 1))).otherwise(score)
        scored = scored.withColumn(f"_s{i}", score)
    sums = scored.groupBy(key).agg(*[F.sum(f"_s{i}").alias(f"_s{i}") for i in range(len(clauses))])
    met = [F.col(f"_s{i}") > 0 for i in range(len(clauses))]
    for m, clause in zip(met, clauses, strict=True):
        sums = sums.filter(m) if clause.sign == "+" else sums.filter(~m) if clause.sign == "-" else sums
    total = F.round(sum((F.col(f"_s{i}") for i, c in enumerate(clauses) if c.sign != "-"), F.lit(0.0)), 9)
    return sums.select(key, total.alias("score")).filter("score > 0")


def _follows(rest: list[Column]):
    def test(p: Column) -> Column:
        out = F.lit(True)
        for j, places in enumerate(rest):
            out = out & F.array_contains(places, p + (j + 1))
        return out

    return test


#: Parts that the terms of a stored index are dealt into.
PARTS = 64


def _term_part(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(PARTS)).cast("int")


class StoredIndex:
    """An inverted index on disk: postings in folders by field and part of the terms, and the sizes of the fields. A query
    reads the parts of its terms alone."""

    def __init__(self, spark: SparkSession, folder: str):
        self.posts = spark.read.parquet(f"{folder}/postings")
        self.sizes = {r["field"]: (r["n"], r["words"]) for r in spark.read.parquet(f"{folder}/fields").collect()}  # a row a field

    @staticmethod
    def write(notes: DataFrame, folder: str, key: str = "path", columns: dict[str, Column] | None = None) -> StoredIndex:
        """Replaces the index in a folder by one of all ``notes``."""
        columns = columns or index_fields(notes)
        part = postings(notes, key, columns).withColumn("part", _term_part(F.col("term")))
        part.repartition("field", "part", F.pmod(F.xxhash64(key), F.lit(4))).sortWithinPartitions("field", "part", "term").write.mode("overwrite").partitionBy("field", "part").parquet(f"{folder}/postings")
        each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.size(index_terms(c)).alias("words")) for f, c in columns.items()])).alias("x")
        notes.select(each).groupBy("x.field").agg(F.count("*").alias("n"), F.sum("x.words").alias("words")).write.mode("overwrite").parquet(f"{folder}/fields")
        return StoredIndex(notes.sparkSession, folder)

    @property
    def notes(self) -> int:
        """How many notes there are."""
        return max((n for n, _ in self.sizes.values()), default=0)

    def search(self, query: str, limit: int | None, key: str = "path", boosts: dict[str, float] | None = None) -> DataFrame:
        """(key, score) of the best notes, as ``bm25`` scores them."""
        boosts = {f: b for f, b in (boosts or BOOSTS).items() if f in self.sizes and b}
        clauses = parse_syntax(query, boosts)
        if not clauses:
            return self.posts.limit(0).select(key, F.lit(0.0).alias("score"))
        terms = sorted({t for c in clauses for t in c.terms})
        wanted = F.col("part").isin(*[_term_part(F.lit(t)) for t in terms]) & F.col("term").isin(*terms) & F.col("field").isin(*boosts)
        out = score_postings(self.posts.filter(wanted), self.sizes, clauses, boosts, key)
        return out.orderBy(F.desc("score"), key).limit(limit) if limit is not None else out


def ranked(hits: DataFrame, key: str = "path") -> DataFrame:
    """(key, rank) of a list of hits, best first; lists are limited, so one task ranks them."""
    return hits.select(key, F.row_number().over(W.orderBy(F.desc("score"), key)).alias("rank"))


def fuse(lists: dict[str, DataFrame], weights: dict[str, float] | None = None, k: int = RRF_K, key: str = "path") -> DataFrame:
    """(key, score) of weighted reciprocal rank fusion over lists (key, rank): a hit of one list counts with that alone."""
    weights, parts = weights or WEIGHTS, None
    for name, rows in lists.items():
        part = rows.select(key, (F.lit(weights[name]) / (k + F.col("rank"))).alias("part"))
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy(key).agg(F.round(F.sum("part"), 12).alias("score"))


def parse_mode(mode: str | None) -> str:
    """semantic, keyword (also bm25) or, for anything else, hybrid."""
    x = (mode or "").lower()
    return "semantic" if x == "semantic" else "keyword" if x in ("keyword", "bm25") else "hybrid"


@dataclass(frozen=True)
class SearchPlan:
    limit: int
    fetch: int
    mode: str
    filters: dict[str, str] = field(default_factory=dict)


def plan_search(limit: int = LIMIT, mode: str | None = None, **filters: str | None) -> SearchPlan:
    """The numbers of a search: the limit from 1 to 100 (0 is the default), and with filters five times as many hits, 500 at most."""
    kept = {k: v for k, v in filters.items() if v is not None}
    limit = min(max(limit or LIMIT, 1), MOST)
    return SearchPlan(limit, min(limit * OVERSAMPLE, MOST_FETCHED) if kept else limit, parse_mode(mode), kept)


def hits(notes: DataFrame, query: str, fetch: int, mode: str, embedder: Embedder, key: str = "path", index: StoredIndex | None = None, near: Callable[[list[float], int], DataFrame] | None = None) -> DataFrame:
    """(key, score) of the ``fetch`` best notes in a mode. ``notes`` have path, gist, tags and the vector ``vec``; with a stored
    index keywords are looked up there. ``near`` gives the notes that may be among the nearest to a vector; without it all are
    compared."""
    scope = (lambda n: near([float(x) for x in embedder.query(query)], n)) if near else (lambda _: notes)
    keyword = (lambda n: index.search(query, n, key)) if index else (lambda n: bm25(notes, query, n, key))
    if mode == "semantic":
        return knn(scope(fetch), "vec", embedder.query(query), fetch, key).select(key, "score")
    if mode == "keyword":
        return keyword(fetch).select(key, "score")
    semantic = knn(scope(FUSE * fetch), "vec", embedder.query(query), FUSE * fetch, key)
    both = {"semantic": ranked(semantic, key), "bm25": ranked(keyword(FUSE * fetch), key)}
    return fuse(both, key=key).orderBy(F.desc("score"), key).limit(fetch)


def search(notes: DataFrame, query: str, limit: int = LIMIT, mode: str | None = None, embedder: Embedder | None = None, prefilter: bool = False, key: str = "path", index: StoredIndex | None = None, near: Callable[[list[float], int], DataFrame] | None = None, **filters: str | None) -> DataFrame:
    """The best notes for a query with their score, best first.

    Filters are equalities on columns such as type and area; null never matches. As a rule they apply to the hits, so
    that fewer than ``limit`` may be left; with ``prefilter`` they apply to the notes, before ranking, and stored indexes
    aren't used.
    """
    plan = plan_search(limit, mode, **filters)
    for name, value in plan.filters.items() if prefilter else ():
        notes = notes.filter(F.col(name) == value)
    found = hits(notes, query, plan.limit if prefilter else plan.fetch, plan.mode, embedder or Embedder(), key, None if prefilter else index, None if prefilter else near)
    out = notes.join(F.broadcast(found), key)  # at most MOST_FETCHED hits
    for name, value in plan.filters.items():
        out = out.filter(F.col(name) == value)
    return out.orderBy(F.desc("score"), key).limit(plan.limit)


_FILTER = re.compile(r"\b(type|status|area|tag):(\S+)")


def parse_query(text: str, **given: str | None) -> tuple[str, dict[str, str]]:
    """The words and the filters of a query such as ``type:term area:tech vectors``: of each kind the first counts, and a
    given filter wins. Without words the query is ``note``."""
    filters: dict[str, str] = {}
    for kind, value in _FILTER.findall(text):
        filters.setdefault(kind, value)
    words = " ".join(_FILTER.sub(" ", text).split())
    return words or "note", filters | {k: v for k, v in given.items() if v}


def filter_hits(found: DataFrame, k: int, filters: dict[str, str], tags: Iterable[str] = (), key: str = "path") -> DataFrame:
    """The first ``k`` of hits that meet equalities and, if there are tags, have one of them."""
    for name, value in filters.items():
        found = found.filter(F.array_contains("tags", value) if name == "tag" else F.col(name) == value)
    wanted = list(tags)
    found = found.filter(F.arrays_overlap("tags", F.array(*map(F.lit, wanted)))) if wanted else found
    return found.orderBy(F.desc("score"), key).limit(k)


def simple_search(notes: DataFrame, query: str, limit: int, key: str = "path") -> DataFrame:
    """Notes by the share of the query's words that occur in the lower-cased gist, best first; none of them: no hit."""
    terms = query.lower().split()
    if not terms:
        return notes.limit(0).withColumn("score", F.lit(0.0))
    low = F.lower(F.coalesce("gist", F.lit("")))
    share = sum((F.contains(low, F.lit(t)).cast("int") for t in terms), F.lit(0)) / len(terms)
    return notes.withColumn("score", F.round(share, 9)).filter("score > 0").orderBy(F.desc("score"), key).limit(limit)
