"""An inverted index on disk that is kept up: a base segment and what was added and removed since.

A segment is a partition of plain Parquet tables: the postings and the notes that it adds, the entries of earlier segments that
it replaces or removes, and, written last, by how much it changes the number and the words of notes in each field. A segment
counts once that last table has it, so a run that stops half-way changes nothing, and running it again under the same number
replaces what it left. A base segment holds all notes, and what is older is no longer read: indexing anew and compaction
write one, while readers of an earlier version go on until old segments are dropped.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import index_terms
from .search import BOOSTS, PARTS, _term_part, index_fields, parse_syntax, postings_by_row, score_postings

#: Words for which the postings of a segment get one more task, and bytes of a row group, of which a task fills one for each part.
WORDS_A_TASK, ROW_GROUP = 1 << 20, 16 << 20
#: Keys that are broadcast at most, so that texts and postings stay where they are; with more, both sides are shuffled.
KEYS = 1 << 21
POSTINGS = "{key} {kind}, field string, term string, tf bigint, dl int, positions array<int>, segment int, part int"
DEAD = "{key} {kind}, of int, segment int"
FIELDS = "field string, n bigint, words bigint, base boolean, segment int"


def read_table(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A table of a known schema; an empty one if nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _sent(keys: DataFrame) -> DataFrame:
    """Keys to join with, broadcast unless they are too many."""
    return F.broadcast(keys) if keys.count() <= KEYS else keys


class SegmentedIndex:
    """The index in a folder, at its last version or at an earlier one. Notes are rows with the column ``key``; ``columns`` are the
    indexed texts by field, by default title, gist and tags; ``kept`` (a schema) are columns that are stored for each note."""

    def __init__(self, spark: SparkSession, folder: str, key: str = "path", columns: dict[str, Column] | None = None, kept: str = "", version: int | None = None, kind: str = "string"):
        self.spark, self.folder, self.key, self.columns, self.version, self.kind = spark, folder.rstrip("/"), key, columns, version, kind
        self.kept = T.StructType.fromDDL(kept) if kept else T.StructType()
        self.docs_schema = T.StructType([*T.StructType.fromDDL(f"{key} {kind}, print string, words map<string,int>").fields, *self.kept.fields, T.StructField("segment", T.IntegerType())])

    # What there is -------------------------------------------------------------------------------------------------------

    def _changes(self) -> DataFrame:
        rows = read_table(self.spark, f"{self.folder}/fields", FIELDS)
        return rows if self.version is None else rows.filter(F.col("segment") <= self.version)

    def segments(self, before: int | None = None) -> list[int]:
        """The segments that count, a base first; with ``before`` those of a smaller number."""
        rows = self._changes().groupBy("segment").agg(F.bool_or("base").alias("base"))
        held = sorted((r["segment"], r["base"]) for r in rows.collect() if before is None or r["segment"] < before)  # a row a segment
        start = max((s for s, base in held if base), default=-1)
        return [s for s, _ in held if s >= start]

    def _of(self, name: str, schema: str | T.StructType, segments: list[int]) -> DataFrame:
        return read_table(self.spark, f"{self.folder}/{name}", schema).filter(F.col("segment").isin(*segments) if segments else F.lit(False))

    def _live(self, rows: DataFrame, segments: list[int]) -> DataFrame:
        """Rows of segments without those that a later segment replaces."""
        dead = self._of("dead", DEAD.format(key=self.key, kind=self.kind), segments[1:]).select(self.key, F.col("of").alias("segment"))
        return rows.join(_sent(dead), [self.key, "segment"], "left_anti") if len(segments) > 1 else rows

    def docs(self, segments: list[int] | None = None) -> DataFrame:
        """(key, print, words, the kept columns, segment) of the notes that are in the index."""
        segments = self.segments() if segments is None else segments
        return self._live(self._of("docs", self.docs_schema, segments), segments)

    def postings(self, terms: list[str] | None = None, segments: list[int] | None = None) -> DataFrame:
        """(key, field, term, tf, dl, positions, segment, part) of the notes in the index; of some terms their parts alone are read."""
        segments = self.segments() if segments is None else segments
        rows = self._of("postings", POSTINGS.format(key=self.key, kind=self.kind), segments)
        if terms is not None:
            parts = {r[0] for r in self.spark.createDataFrame([(t,) for t in terms], "t string").select(_term_part(F.col("t"))).collect()}
            rows = rows.filter(F.col("part").isin(*parts) & F.col("term").isin(*terms))
        return self._live(rows, segments)

    def sizes(self) -> dict[str, tuple[int, int]]:
        """The notes and the words of each field."""
        segments = self.segments()
        rows = self._changes().filter(F.col("segment").isin(*segments)).groupBy("field").agg(F.sum("n").alias("n"), F.sum("words").alias("words")) if segments else None
        return {r["field"]: (r["n"], r["words"]) for r in rows.collect()} if rows is not None else {}  # a row a field

    @property
    def notes(self) -> int:
        return max((n for n, _ in self.sizes().values()), default=0)

    def search(self, query: str, limit: int | None, key: str | None = None, boosts: dict[str, float] | None = None) -> DataFrame:
        """(key, score) of the best notes, as ``bm25`` scores them."""
        sizes = self.sizes()
        boosts = {f: b for f, b in (boosts or BOOSTS).items() if f in sizes and b}
        clauses = parse_syntax(query, boosts)
        if not clauses or not sizes:
            return self.spark.createDataFrame([], f"{self.key} {self.kind}, score double")
        posts = self.postings(sorted({t for c in clauses for t in c.terms})).filter(F.col("field").isin(*boosts))
        out = score_postings(posts, sizes, clauses, boosts, self.key)
        return out.orderBy(F.desc("score"), self.key).limit(limit) if limit is not None else out

    # Changes -------------------------------------------------------------------------------------------------------------

    def _write(self, rows: DataFrame, name: str, segment: int, *by: str) -> None:
        rows.write.mode("overwrite").partitionBy(*by).parquet(f"{self.folder}/{name}/segment={segment}")

    def _file(self, posts: DataFrame, segment: int, written: DataFrame) -> None:
        """Writes postings from where they are: a task has a file open for each part, so nothing is moved or sorted (the writer sorts
        once as many files are open as it may have, hence one more). A segment of few words gets few tasks, and so few files."""
        words = written.select(F.explode_outer(F.map_values("words")).alias("n")).agg(F.sum("n")).first()[0] or 0
        rows, name = posts.coalesce(words // WORDS_A_TASK + 1), "spark.sql.maxConcurrentOutputFileWriters"
        before = self.spark.conf.get(name)
        self.spark.conf.set(name, PARTS + 1)
        try:
            rows.write.mode("overwrite").partitionBy("part").option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(f"{self.folder}/postings/segment={segment}")
        finally:
            self.spark.conf.set(name, before)

    def _changed(self, notes: DataFrame, written: DataFrame) -> DataFrame:
        """The rows of ``notes`` (with their print) that a segment has written, one a key. Texts are moved only of keys with several rows."""
        keys = notes.groupBy(self.key).agg(F.count("*").alias("rows"))
        held = keys.agg(F.count("*").alias("keys"), F.count_if(F.col("rows") > 1).alias("several")).first()
        if not held["several"]:
            return notes if written.count() == held["keys"] else notes.join(_sent(written.select(self.key)), self.key, "left_semi")
        several = keys.filter("rows > 1").select(self.key)
        one = notes.join(_sent(written.select(self.key).join(several, self.key, "left_anti")), self.key, "left_semi")
        more = notes.join(_sent(written.select(self.key, "print").join(several, self.key, "left_semi")), [self.key, "print"], "left_semi")
        return one.unionByName(more.dropDuplicates([self.key, "print"]))

    def _read(self, name: str, segment: int, schema: T.StructType) -> DataFrame:
        return read_table(self.spark, f"{self.folder}/{name}", schema).filter(F.col("segment") == segment)

    def _commit(self, segment: int, added: DataFrame | None, removed: DataFrame | None, base: bool) -> int:
        names = list(self.columns or BOOSTS)
        count = lambda rows, sign: rows.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(sign).alias("n"), (sign * F.coalesce(F.col("words")[f], F.lit(0))).alias("words")) for f in names])).alias("x")).select("x.*")
        parts = [count(rows, sign) for rows, sign in ((added, 1), (removed, -1)) if rows is not None]
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        zero = self.spark.createDataFrame([(f, 0, 0) for f in names], "field string, n int, words int")
        rows = rows.unionByName(zero).groupBy("field").agg(F.sum("n").cast("long").alias("n"), F.sum("words").cast("long").alias("words"))
        self._write(rows.withColumn("base", F.lit(base)).coalesce(1), "fields", segment)
        return segment

    def add(self, notes: DataFrame, segment: int | None = None, base: bool = False, whole: bool = False, order: str | None = None, carry: dict[str, Column] | None = None, needs: list[str] | None = None) -> int:
        """Adds notes, in place of those of the same key, as a segment, whose number is returned. Notes whose indexed texts are
        as they were stay where they are. ``whole``: the notes are all there are, so others go; ``base``: all are written anew.

        Of rows of one key that with the greatest ``order`` counts, then by what it holds; a row without a key is left out.
        ``carry`` gives the kept columns, out of the columns ``needs``, and is computed for changed notes alone. Texts and
        postings stay where they are, but for the texts of keys with several rows.
        """
        earlier = self.segments(segment)
        segment = segment if segment is not None else max([-1, *self.segments()]) + 1
        columns = self.columns or index_fields(notes)
        text = F.to_json(F.struct(*[c.cast("string").alias(f) for f, c in columns.items()], *[F.col(c).alias(f"_{c}") for c in needs or []]))
        notes = notes.filter(F.col(self.key).isNotNull()).withColumn("print", F.sha2(text, 256))
        words = F.create_map(*[x for f, c in columns.items() for x in (F.lit(f), F.size(index_terms(c)))])
        found = notes.select(self.key, "print", words.alias("words"), *(needs or []), (F.col(order) if order else F.lit(0)).alias("_order"))
        found = found.groupBy(self.key).agg(F.max_by(F.struct("print", "words", *(needs or [])), F.struct("_order", "print")).alias("x")).select(self.key, "x.*")
        old = self.docs([] if base else earlier).select(self.key, F.col("print").alias("_print"), F.col("words").alias("_words"), F.col("segment").alias("of"))
        new = found.join(old, self.key, "left").filter(~F.col("print").eqNullSafe(F.col("_print")))
        new = new.withColumns(carry or {}).select(self.key, "print", "words", *self.kept.names)
        self._write(new, "docs", segment)

        written = self._read("docs", segment, self.docs_schema)
        posts = postings_by_row(self._changed(notes, written), self.key, columns)
        self._file(posts.withColumn("part", _term_part(F.col("term"))), segment, written)
        gone = old.join(written.select(self.key), self.key, "left_semi")
        if whole:
            gone = gone.unionByName(old.join(found.select(self.key), self.key, "left_anti"))
        return self._bury(segment, gone, written, base)

    def _bury(self, segment: int, gone: DataFrame, added: DataFrame | None, base: bool = False) -> int:
        self._write(gone.select(self.key, F.col("_words").alias("words"), "of"), "dead", segment)
        schema = T.StructType.fromDDL(f"{self.key} {self.kind}, words map<string,int>, of int, segment int")
        return self._commit(segment, added, self._read("dead", segment, schema), base)

    def remove(self, keys: DataFrame, segment: int | None = None) -> int:
        """Removes the notes with these keys (a column named as the key), as a segment."""
        earlier = self.segments(segment)
        segment = segment if segment is not None else max([-1, *earlier]) + 1
        old = self.docs(earlier).select(self.key, F.col("words").alias("_words"), F.col("segment").alias("of"))
        return self._bury(segment, old.join(keys.select(self.key), self.key, "left_semi"), None)

    def compact(self, segment: int | None = None) -> int:
        """Writes one base segment of all notes out of the segments there are; no text is read again."""
        held = self.segments(segment)
        segment = segment if segment is not None else max([-1, *held]) + 1
        self._write(self.docs(held).select(self.key, "print", "words", *self.kept.names), "docs", segment)
        written = self._read("docs", segment, self.docs_schema)
        self._file(self.postings(segments=held).drop("segment"), segment, written)
        return self._commit(segment, written, None, True)

    def drop_old(self) -> list[int]:
        """Deletes the segments before the last base, which only readers of earlier versions still read; gives their numbers."""
        rows = read_table(self.spark, f"{self.folder}/fields", FIELDS).select("segment").distinct()
        first = min(self.segments(), default=0)
        old = sorted(r[0] for r in rows.collect() if r[0] < first)
        for name in ("fields", "dead", "docs", "postings"):  # the last table first: what is half deleted doesn't count
            for segment in old:
                at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/segment={segment}")
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        return old
