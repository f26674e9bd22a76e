"""One object over a collection of notes with the operations a user asks for; each gives a DataFrame or says what it did."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .config import NotesConfig
from .functions import text as tx
from .functions import vectors as vx
from .operators import audit as au
from .operators import knn, listing, save, search, sync, tags
from .operators.segments import SegmentedIndex
from .operators.vector_index import VectorIndex
from .sources import notes as src


@dataclass
class Collection:
    """Notes (as ``parse_notes`` gives them, with ``vec``) of a folder or of a table."""

    notes: DataFrame
    config: NotesConfig = field(default_factory=NotesConfig)
    embedder: vx.Embedder = field(default_factory=vx.Embedder)
    root: str | None = None
    stored: search.StoredIndex | SegmentedIndex | None = None
    text_source: str = "gist"
    vectors: VectorIndex | None = None

    @classmethod
    def open(cls, spark: SparkSession, root: str, config: NotesConfig | None = None, embedder: vx.Embedder | None = None, text_source: str = "gist") -> Collection:
        """The notes of a folder that all executors share."""
        c, e = config or NotesConfig.load(Path(root, "notes.json")), embedder or vx.Embedder()
        return cls(cls.embed(src.parse_notes(src.read_folder(spark, root), c.field_prefix), e, text_source), c, e, root, text_source=text_source)

    @classmethod
    def of_table(cls, files: DataFrame, config: NotesConfig | None = None, embedder: vx.Embedder | None = None, text_source: str = "gist") -> Collection:
        """The notes of a table (path, name, content, modified)."""
        c, e = config or NotesConfig(), embedder or vx.Embedder()
        return cls(cls.embed(src.parse_notes(files, c.field_prefix), e, text_source), c, e, text_source=text_source)

    @staticmethod
    def embed(notes: DataFrame, embedder: vx.Embedder, text_source: str = "gist") -> DataFrame:
        return notes.withColumn("vec", embedder.column(sync.index_text(F.col("path"), F.col("gist"), text_source)))

    @property
    def links(self) -> DataFrame:
        return src.links(self.notes)

    @property
    def inbox(self) -> str:
        return str(Path(self.root or ".", self.config.inbox))

    def search(self, query: str, limit: int = search.LIMIT, type: str | None = None, area: str | None = None, mode: str | None = None, prefilter: bool = False) -> DataFrame:  # noqa: A002
        found = search.search(self.notes, query, limit, mode, self.embedder, prefilter, index=self.stored, near=self._near if self.vectors else None, type=type, area=area)
        return found.select(F.col("name").alias("title"), "path", "gist", "type", "area", "score")

    def related(self, name: str, limit: int = 10, boost_type: bool = False, boost_area: bool = False) -> DataFrame:
        """The notes most like a note, those of its name left out; with boosts those of its type or area come forward."""
        row = self.notes.filter(F.col("name") == name).orderBy("path").select("vec", "type", "area").first()
        if row is None:
            return self.notes.limit(0).withColumn("score", F.lit(0.0)).select(F.col("name").alias("title"), "path", "gist", "score")
        boosts = {k: row[k] for k, on in (("type", boost_type), ("area", boost_area)) if on and row[k] is not None}
        limit = min(max(limit, 1), 50)
        among = self._near(list(row["vec"]), 2 * limit + self.notes.filter(F.col("name") == name).count()) if self.vectors and row["vec"] is not None else self.notes
        found = knn.boosted(among.filter(F.col("name") != name), "vec", row["vec"], limit, "path", boosts)
        return found.select(F.col("name").alias("title"), "path", "gist", "score")

    def get_note(self, wanted: str, fields: str | None = None) -> DataFrame:
        return listing.project(listing.get_note(self.notes, wanted), fields)

    def list_notes(self, type: str | None = None, area: str | None = None, limit: int = listing.DEFAULT, fields: str | None = None) -> DataFrame:  # noqa: A002
        return listing.list_notes(self.notes, type, area, limit, fields)

    def status(self) -> tuple[DataFrame, DataFrame]:
        """(totals and health, counts by type and area)."""
        return au.status(self.notes), au.counts_by(self.notes, "type", "area")

    def audit(self, quick: bool = False, verbose: bool = False) -> tuple[DataFrame, DataFrame | None]:
        """(checks, with ``verbose`` all violations)."""
        checks = au.audit(self.notes, self.links, self.config, quick, yaml=True)
        return checks, au.violations(self.notes, self.config, yaml=True) if verbose else None

    def get_inbox(self) -> DataFrame:
        return src.read_inbox(self.notes.sparkSession, self.inbox)

    def clear_inbox(self) -> None:
        save.clear_inbox(self.inbox)

    def save(self, title: str, content: str, strategy: str = "create", type: str | None = None, area: str | None = None, tags_: list[str] | None = None, gist: str | None = None, source: list[str] | None = None, similarity: float = save.SIMILAR, auto_tag: bool = True, discover: bool = False, tag_limit: int = 5, catalogue: DataFrame | None = None) -> tuple[str, DataFrame | None]:  # noqa: A002
        """(what was done, similar notes if a decision is needed). Strategies: create, update, append, inbox, smart.

        With ``auto_tag`` and a catalogue the tags that the gist, or else the title, suggests are added to the given ones, up to
        ``tag_limit`` in all; with ``discover`` its own words may become tags too.
        """
        if strategy == "inbox":
            save.append_inbox(self.inbox, content, title)
            return "appended to inbox", None
        if strategy not in ("create", "smart", "update", "append"):
            raise ValueError(f"no strategy {strategy}")
        spark = self.notes.sparkSession
        kept = list(dict.fromkeys(x.strip() for x in tags_ or [] if x.strip()))
        if auto_tag and catalogue is not None and strategy != "append":
            found = self.tags_suggest(gist or title, catalogue, tag_limit, discover).collect()
            kept = list(dict.fromkeys(kept + [r["tag"] for r in found]))[:tag_limit]
        schema = "title string, content string, type string, area string, gist string, tags array<string>, source array<string>, today date"
        request = spark.createDataFrame([(title, content, type, area, gist, kept, source, date.today())], schema)
        if strategy == "smart":
            decision, close = save.smart(title, gist, self.notes, self.embedder, similarity)
            if decision == "needs_decision":
                return decision, close
        if strategy in ("create", "smart"):
            row = save.create(request, self.notes, self.config).first()
            if row["outcome"] != "created":
                return row["outcome"], None
            changed = spark.createDataFrame([(row["path"], row["content"])], "path string, content string")
        else:
            own = self.notes.filter(F.col("name") == title).orderBy("path").limit(1).select("path", "name", "content")
            if own.isEmpty():
                return "not found", None
            changed = (save.update(request, own, self.config) if strategy == "update" else save.append(request, own)).select("path", "content")
        errors = save.write_files(changed, self.root or ".").filter("error is not null").collect()
        return (errors[0]["error"] if errors else {"update": "updated", "append": "appended"}.get(strategy, "created")), None

    def tags_suggest(self, text: str, catalogue: DataFrame, limit: int = 5, discover: bool = False) -> DataFrame:
        """The tags of a text out of a catalogue (name, aliases, vec), with ``discover`` also out of its words."""
        row = self.notes.sparkSession.createDataFrame([(0, text, [float(x) for x in self.embedder.query(text)])], "doc_id bigint, text string, vec array<double>")
        found = tags.suggest(row, catalogue)
        found = tags.discover(found, tags.keyword_rows(row, self.embedder), limit) if discover else tags.best(found, limit)
        return found.select("tag", "score", "reason").orderBy(F.desc("score"), "tag")

    def tags_analyze(self, catalogue: DataFrame, threshold: float = 0.7) -> DataFrame:
        return tags.merges(catalogue, threshold)

    def tags_list(self, catalogue: DataFrame) -> DataFrame:
        return tags.list_tags(catalogue)

    def suggest_tags(self, name: str, limit: int = 5, similar: int = 10, least: int = 2) -> DataFrame:
        """The tags of the notes most like a note, that it lacks."""
        row = self.notes.filter(F.col("name") == name).orderBy("path").select("vec", "tags").first()
        if row is None:
            return tags.from_similar(self.notes.limit(0).withColumn("score", F.lit(0.0)), [], least, limit)
        near = knn.knn(self.notes.filter(F.col("name") != name), "vec", row["vec"], min(max(similar, 1), 50), "path")
        return tags.from_similar(near, row["tags"] or [], least, limit)

    def complete(self, line: str, limit: int = 5) -> DataFrame:
        """The notes for a link that is being typed: what stands after an open ``[[`` is searched for, from two characters on."""
        row = self.notes.sparkSession.createDataFrame([(line,)], "line string").select(tx.completion_prefix(F.col("line")).alias("p")).first()
        return self.search(row["p"], limit, mode="semantic") if row["p"] else self.search("", limit).limit(0)

    def index_rows(self) -> DataFrame:
        """(path, gist, mtime, indexed, fields, tags): the notes as an index has them."""
        return self.notes.select("path", "gist", F.unix_millis("modified").alias("mtime"), F.col("vec").isNotNull().alias("indexed"), "fields", "tags")

    def _plain(self) -> DataFrame:
        """The notes as they are now, without vectors: those of a folder are listed and read again."""
        if self.root is None:
            return self.notes.drop("vec")
        return src.parse_notes(src.read_folder(self.notes.sparkSession, self.root), self.config.field_prefix)

    def _index(self, folder: str) -> SegmentedIndex:
        return SegmentedIndex(self.notes.sparkSession, folder, kept="vec array<double>")

    def _into(self, folder: str, base: bool) -> SegmentedIndex:
        plain, index = self._plain(), self._index(folder)
        vec = self.embedder.column(sync.index_text(F.col("path"), F.col("gist"), self.text_source)).cast("array<double>")
        index.add(plain, base=base, whole=True, carry={"vec": vec}, needs=["gist"])
        return self._search_in(index, plain)

    def _search_in(self, index: SegmentedIndex, plain: DataFrame) -> SegmentedIndex:
        self.stored, self.notes = index, plain.join(index.docs().select("path", "vec"), "path")
        return index

    def reindex(self, folder: str) -> SegmentedIndex:
        """Embeds all notes anew, writes their vectors and postings as a new base below a folder, and searches it from then on. What
        reads the index meanwhile goes on with the one before; ``drop_old`` of the index deletes that."""
        return self._into(folder, True)

    def sync(self, folder: str) -> SegmentedIndex:
        """Brings the index below a folder up to date: new and changed notes are embedded and added, notes that are gone go, and the
        others are left alone. A folder without an index gets one."""
        return self._into(folder, False)

    def open_index(self, folder: str) -> SegmentedIndex:
        """Searches an index that was written before, as it is; notes that it doesn't have aren't found."""
        index = self._index(folder)
        if not index.segments():
            raise ValueError(f"there is no index in {folder}")
        return self._search_in(index, self._plain())

    def index_vectors(self, folder: str) -> VectorIndex:
        """Brings the index of vectors below a folder up to date: vectors that are new or changed are added to its lists, those of
        notes that are gone are removed. Semantic and hybrid searches and related notes look into its lists from then on, about as
        many as nine of ten true neighbours need, and score what they find exactly. Notes go by a 64-bit hash of their path."""
        index = VectorIndex(self.notes.sparkSession, folder)
        rows = self.notes.filter("vec is not null").select(F.xxhash64("path").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
        held = index.rows().select("id", F.col("vec").alias("_vec"))
        if held.isEmpty():
            index.write(rows, "id", "vec")
        else:
            # the last digits of an embedding may depend on the batch that it was made in
            same = F.forall(F.zip_with("vec", "_vec", lambda a, b: F.coalesce(F.abs(a - b) <= 1e-9, F.lit(False))), lambda x: x)
            changed = rows.join(held, "id", "left").filter(~F.coalesce(same, F.lit(False))).drop("_vec")
            gone = held.join(rows, "id", "left_anti").select("id")
            for some, change in ((changed, lambda x: index.insert(x, "id", "vec")), (gone, index.delete)):
                if not some.isEmpty():
                    change(some)
        self.vectors = index
        return index

    def _near(self, vec: list[float], n: int) -> DataFrame:
        query = self.notes.sparkSession.createDataFrame([(0, vec)], "id bigint, vec array<double>")
        found = self.vectors.search(query, n, "id", "vec").select(F.col("id").alias("_id"))
        return self.notes.join(F.broadcast(found), F.xxhash64("path") == F.col("_id"), "left_semi")  # n ids, some hundreds

    def clear_index(self, folder: str) -> None:
        """Removes what ``reindex`` has written; searches read the notes again."""
        spark, self.stored = self.notes.sparkSession, None
        self.notes = self.embed(self._plain(), self.embedder, self.text_source)
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

    def recent(self, limit: int = 10) -> DataFrame:
        return listing.project(self.notes.orderBy(F.desc("modified"), "path").limit(limit))


def register_functions(spark: SparkSession) -> None:
    """SQL functions: htp_embed(text) and cosine(a, b), which run in Arrow batches, so in DataFrame code use the Columns, and
    bm25(tf, dl, mean, df, n), the score of a term met ``tf`` times in a field of ``dl`` terms, which stays in the JVM."""
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series([[float(x) for x in vx.embed_text(t or "")] for t in texts])

    def cosine(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x, y) -> float:
            x, y = np.asarray(x if x is not None else [], float), np.asarray(y if y is not None else [], float)
            size = np.sqrt((x @ x) * (y @ y)) if len(x) == len(y) else 0.0
            return float(x @ y / size) if size else 0.0

        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])

    spark.udf.register("htp_embed", F.pandas_udf(embed, T.ArrayType(T.DoubleType())))
    spark.udf.register("cosine", F.pandas_udf(cosine, T.DoubleType()))
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION bm25(tf DOUBLE, dl DOUBLE, mean DOUBLE, df DOUBLE, n DOUBLE) RETURNS DOUBLE RETURN ln(1 + (n - df + 0.5) / (df + 0.5)) * {search.K1 + 1} * tf / (tf + {search.K1} * (1 - {search.B} + {search.B} * dl / mean))")
