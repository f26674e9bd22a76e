"""Exact nearest neighbours, related notes, boosted ranking and similarity joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.vectors import cosine, vector

#: Four times the rows whose scores are made at once in a similarity join, queries that are broadcast for a pass, and rows of a block of a similarity join.
BLOCK, SENT, ROWS = 1024, 1 << 14, 4096
#: Rows of a batch, and queries, that are scored at once.
PIECE, ASKED = 2048, 256
DIGITS = 9


def score(df: DataFrame, vec: str, query, name: str = "score") -> DataFrame:
    """``df`` with the cosine similarity of its vectors to one query vector, rounded so that equal vectors tie; null for
    rows without a vector."""
    q = vector(query) if not isinstance(query, Column) else query
    return df.withColumn(name, F.when(F.col(vec).isNotNull(), F.round(cosine(F.col(vec), q), DIGITS)))


def check_dimension(df: DataFrame, vec: str, dimension: int) -> None:
    """Raises if any vector has another dimension."""
    if not df.filter(F.size(vec) != dimension).isEmpty():
        raise ValueError(f"the index has vectors of another dimension than {dimension}")


def knn(df: DataFrame, vec: str, query, k: int, key: str = "id") -> DataFrame:
    """The ``k`` rows most similar to a query vector; ties go to the smaller key. One pass, and k rows a task are moved.

    Rows without a vector come last and are left out at the end: a filter before would embed texts a second time.
    """
    return score(df, vec, query).orderBy(F.desc_nulls_last("score"), key).limit(k).filter("score is not null")


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; those without a direction stay."""
    n = np.sqrt((rows * rows).sum(axis=1))
    return rows / np.where(n > 0, n, 1)[:, None]


def pieces(batches: Iterator[pa.RecordBatch], rows: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Batches of a bounded number of rows, so that matrices over them are."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def vectors_of(batch: pa.RecordBatch, ids: int, column: int, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, unit vectors) of the rows of a batch with vectors of a dimension."""
    batch = batch.filter(pa.array(np.asarray(batch.column(column).value_lengths().fill_null(0)) == dimension))
    return np.asarray(batch.column(ids)), unit(np.asarray(batch.column(column).flatten(), dtype=float).reshape(-1, dimension))


class Best:
    """The ``k`` best of each of some queries so far: their ids and scores, best first; of equal scores the smaller id."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.queries, self.q, self.k = ids, queries, k
        self.ids, self.scores = np.full((len(ids), k), np.iinfo(np.int64).max), np.full((len(ids), k), -np.inf)

    def add(self, ids: np.ndarray, rows: np.ndarray, only: np.ndarray | None = None) -> None:
        """Rows seen by all queries, or by ``only`` some."""
        chosen = np.arange(len(self.queries)) if only is None else only
        for lo in range(0, len(chosen) if len(ids) else 0, ASKED):
            at = chosen[lo : lo + ASKED]
            s = np.round(self.q[at] @ rows.T, DIGITS)
            s[self.queries[at][:, None] == ids[None, :]] = -np.inf
            if s.shape[1] > self.k:  # the best by score, with all that tie with the last of them
                bar = np.maximum(-np.partition(-s, self.k - 1, axis=1)[:, self.k - 1], self.scores[at, -1])
            else:
                bar = self.scores[at, -1]
            for i in np.flatnonzero((s >= bar[:, None]).any(axis=1)):
                new = np.flatnonzero(s[i] >= bar[i])
                both, score = np.concatenate([self.ids[at[i]], ids[new]]), np.concatenate([self.scores[at[i]], s[i, new]])
                order = np.lexsort((both, -score))[: self.k]
                self.ids[at[i]], self.scores[at[i]] = both[order], score[order]

    def batch(self) -> pa.RecordBatch:
        flat = self.scores.ravel() > -np.inf
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.queries, self.k)[flat]), pa.array(self.ids.ravel()[flat]), pa.array(self.scores.ravel()[flat])], ["query_id", "id", "score"])


FOUND = "query_id bigint, id bigint, score double"


def blocks(queries: DataFrame, key: str, vec: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, unit vectors) of queries, SENT at a time by id; those of one id are in one block."""
    rows, last = queries.select(F.col(key).cast("long").alias("i"), F.col(vec).cast("array<double>").alias("v")).filter("i is not null and v is not null"), None
    while True:
        left = rows if last is None else rows.filter(F.col("i") > last)
        block = left.orderBy("i").limit(SENT).toArrow()
        full = block.num_rows == SENT
        if full:  # the last id may have more rows
            last = int(block["i"][-1].as_py())
            block = left.filter(F.col("i") <= last).toArrow()
        if block.num_rows:
            yield np.asarray(block["i"]), unit(np.array(block["v"].to_pylist(), float))
        if not full:
            return


def ranked(found: list[DataFrame], k: int, df: DataFrame) -> DataFrame:
    """(query_id, id, score, rank): the ``k`` best of what the tasks have found."""
    if not found:
        return df.sparkSession.createDataFrame([], FOUND + ", rank int")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def knn_join(df: DataFrame, queries: DataFrame, k: int, key: str, vec: str) -> DataFrame:
    """(query_id, id, score, rank): for each query row the ``k`` nearest other rows of ``df``.

    Up to SENT queries are broadcast for a pass over ``df`` and scored ASKED at a time; a task keeps k rows a query of its
    partition, so what is moved is tasks * queries * k rows, never pairs. More queries take more passes.
    """

    def search(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = sent.value
            best = Best(ids, q, k)
            for batch in pieces(batches):
                best.add(*vectors_of(batch, 0, 1, q.shape[1]))
            yield best.batch()

        return run

    rows = df.select(F.col(key).cast("long"), F.col(vec).cast("array<double>"))
    sent = (df.sparkSession.sparkContext.broadcast(x) for x in blocks(queries, key, vec))
    return ranked([rows.mapInArrow(search(x), FOUND) for x in sent], k, df)


def related(df: DataFrame, vec: str, source, k: int, key: str, boosts: dict[str, object] | None = None) -> DataFrame:
    """The ``k`` (1 to 50) nearest rows to the row with key ``source``, itself left out; with ``boosts`` by boosted score."""
    k = min(max(k, 1), 50)
    row = df.filter(F.col(key) == source).select(vec).first()
    if row is None or row[0] is None:
        return score(df.limit(0), vec, [0.0]).limit(0)
    others = df.filter(F.col(key) != source)
    return boosted(others, vec, row[0], k, key, boosts) if boosts else knn(others, vec, row[0], k, key)


def boosted(df: DataFrame, vec: str, query, k: int, key: str, boosts: dict[str, object], semantic: float = 0.7) -> DataFrame:
    """The ``k`` best by ``semantic`` times the similarity plus the rest times the share of boosts that the row meets,
    among the 2k most similar; without boosts the most similar."""
    hits = knn(df, vec, query, 2 * k if boosts else k, key)
    if not boosts:
        return hits
    met = sum(((F.col(c) == F.lit(v)).cast("double") for c, v in boosts.items()), F.lit(0.0)) / len(boosts)
    total = F.round(semantic * F.col("score") + (1 - semantic) * F.coalesce(met, F.lit(0.0)), DIGITS)
    return hits.withColumn("score", total).orderBy(F.desc("score"), key).limit(k)


#: Cells of a similarity join at most, steps that the angles of a cell are told apart in, and what is added to bounds of angles.
CELLS, STEPS, SLACK = 1024, 256, 1e-6
#: To how many other cells, and blocks of its own, a row goes at most, about; and rows that this is judged by.
COPIES, JUDGED = 32, 512


def _beyond(dots: np.ndarray, home: np.ndarray, p: np.ndarray, reach: float) -> np.ndarray:
    """Which other pivots' cells may hold rows similar to each row. A row of cell q is no nearer to p than to q, so it lies
    beyond the plane between them."""
    apart = np.sqrt(np.maximum(2 - 2 * np.clip(p @ p.T, -1, 1), 1e-30))
    return (dots[np.arange(len(dots)), home][:, None] - dots <= reach * apart[home]) & (np.arange(len(p))[None, :] > home[:, None])


def _pivots(rows: np.ndarray, most: int, reach: float) -> np.ndarray:
    """As many of the first rows as leave the rest with few cells to go to: where angles rule little out, cells are few."""
    most = min(most, len(rows))
    while most > 1:
        dots = rows[-JUDGED:] @ rows[:most].T
        if _beyond(dots, dots.argmax(axis=1), rows[:most], reach).sum(axis=1).mean() <= COPIES:
            break
        most //= 2
    return rows[:most]


def _dealt(df: DataFrame, key: str, vec: str, least: float, on: list[str], rows_a_block: int, more: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(tasks, cells) of a similarity join. A task has the rows (k, v, side, and columns ``more``) of two blocks, 0 and 1, that may
    hold similar pairs, or of one block, with itself."""
    more = more or []
    n = df.filter(F.col(vec).isNotNull()).count()
    rows_a_block = max(rows_a_block, -(-n // COPIES))
    kind = "float" if df.schema[vec].dataType.simpleString() == "array<float>" else "double"
    rows = df.filter(F.col(vec).isNotNull()).select(F.col(key).alias("k"), F.col(vec).cast(f"array<{kind}>").alias("v"), *on, *more)
    reach = np.sqrt(2 - 2 * max(least - 1e-9, -1)) + SLACK
    # the pivots: rows chosen by hash, one set a dimension; a dimension without one is one cell
    most = min(CELLS, max(1, n // rows_a_block))
    chosen = rows.select("v").orderBy(F.xxhash64("v")).limit(most + JUDGED).toArrow()["v"].to_pylist() if least > 0 and n else []
    pivots = {d: _pivots(unit(np.array([v for v in chosen if len(v) == d], float)), most, reach) for d in {len(v) for v in chosen if v}}
    sent = df.sparkSession.sparkContext.broadcast(pivots)
    near = np.arccos(np.clip(least - 1e-9, -1, 1)) + SLACK
    kinds = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (*on, *more)]
    schema = ", ".join([f"k {df.schema[key].dataType.simpleString()}", f"v array<{kind}>", *kinds, "cell int, angle double, others array<struct<cell:int,angle:double>>"])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in pieces(batches):
            sizes = np.asarray(whole.column(1).value_lengths())
            for d in np.unique(sizes[sizes > 0]):
                batch = whole.filter(pa.array(sizes == d))
                x, p = unit(np.asarray(batch.column(1).flatten(), dtype=float).reshape(-1, d)), sent.value.get(int(d))
                home, angle, others = np.zeros(len(x), np.int32), np.zeros(len(x)), [[]] * len(x)
                if p is not None:
                    dots = x @ p.T
                    home = dots.argmax(axis=1).astype(np.int32)
                    angles = np.arccos(np.clip(dots, -1, 1))
                    angle = angles[np.arange(len(x)), home]
                    may = _beyond(dots, home, p, reach)
                    others = [[{"cell": int(c), "angle": float(angles[i, c])} for c in np.flatnonzero(may[i])] for i in range(len(x))]
                kind = pa.list_(pa.struct([("cell", pa.int32()), ("angle", pa.float64())]))
                arrays = [batch.column(0), batch.column(1), *[batch.column(i) for i in range(2, batch.num_columns)], pa.array(home), pa.array(angle), pa.array(others, kind)]
                yield pa.RecordBatch.from_arrays(arrays, ["k", "v", *on, *more, "cell", "angle", "others"])

    held = rows.mapInArrow(assign, schema).withColumn("d", F.size("v"))
    own = [*on, "d", "cell"]
    # equal angles are told apart by a hash, so that copies fill as many blocks as they need
    held = held.withColumn("at", F.col("angle") + SLACK * F.pmod(F.xxhash64("k"), F.lit(1 << 20)) / (1 << 20))
    grid = F.percentile_approx("at", [i / STEPS for i in range(1, STEPS)], 100 * STEPS)
    cells = held.groupBy(*own).agg(F.count("*").alias("n"), grid.alias("grid"), F.min("at").alias("least"), F.max("at").alias("most"))
    blocks = F.least(F.lit(STEPS), F.ceil(F.col("n") / rows_a_block)).cast("int")
    cells = cells.withColumn("blocks", blocks).withColumn("parts", F.ceil(F.col("n") / F.lit(STEPS * rows_a_block)).cast("int"))
    bounds = F.transform(F.sequence(F.lit(1), F.greatest(F.col("blocks") - 1, F.lit(1))), lambda i: F.get("grid", F.floor(i * STEPS / F.col("blocks")).cast("int") - 1))
    cells = cells.select(*own, "n", "blocks", "parts", F.concat(F.array("least"), F.when(F.col("blocks") > 1, bounds).otherwise(F.array().cast("array<double>")), F.array("most")).alias("edges"))
    few = cells if on else F.broadcast(cells)

    span = lambda i: (F.get("edges", i) - SLACK, F.get("edges", i + 1) + SLACK)
    placed = held.join(few, own)
    # the block of a row: how many inner edges are below it; large cells have several parts of each
    step = F.least(F.size(F.filter(F.slice("edges", 2, F.size("edges")), lambda e: e < F.col("at"))), F.col("blocks") - 1)
    placed = placed.withColumn("step", step).withColumn("block", F.col("step") * F.col("parts") + F.pmod(F.xxhash64("k", F.lit(1)), F.col("parts")).cast("int"))
    here = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") * F.col("parts") - 1)))
    theirs = F.floor(F.col("other") / F.col("parts")).cast("int")
    close = (span(theirs)[0] - span(F.col("step"))[1] <= near) & (span(F.col("step"))[0] - span(theirs)[1] <= near)
    here = here.filter(close).select(*own, F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), F.lit(0).alias("salt"), "k", "v", *more, F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("side"))

    away = held.withColumn("o", F.explode("others")).select(*on, "d", F.col("o.cell").alias("cell"), F.col("o.angle").alias("seen"), "k", "v", *more).join(few, own)
    away = away.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    away = away.filter((span(F.col("other"))[0] - F.col("seen") <= near) & (F.col("seen") - span(F.col("other"))[1] <= near))
    away = away.withColumn("block", F.explode(F.sequence(F.col("other") * F.col("parts"), (F.col("other") + 1) * F.col("parts") - 1)))
    many = away.groupBy(*own, "block").agg(F.ceil(F.count("*") / rows_a_block).cast("int").alias("salts"))
    many = many if on else F.broadcast(many)
    from_far = away.join(many, [*own, "block"]).select(*own, F.col("block").alias("first"), F.lit(-1).alias("second"), F.pmod(F.xxhash64("k"), F.col("salts")).cast("int").alias("salt"), "k", "v", *more, F.lit(1).alias("side"))
    to_far = placed.select(*own, "block", "k", "v", *more).join(many, [*own, "block"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    to_far = to_far.select(*own, F.col("block").alias("first"), F.lit(-1).alias("second"), "salt", "k", "v", *more, F.lit(0).alias("side"))
    return here.unionByName(from_far).unionByName(to_far), cells


TASK = ["d", "cell", "first", "second", "salt"]


def similar_pairs(df: DataFrame, key: str, vec: str, least: float, block: list[str] | None = None, rows_a_block: int = ROWS, carry: str | None = None) -> DataFrame:
    """(a, b, score), a < b, of the rows at least so similar. With ``block`` columns only rows that agree on them are compared.
    A column to ``carry`` is added twice, as (ca, cb).

    Exact, with pruning by angles. Some rows are pivots, and a row lies in the cell of the nearest. It meets the rows of
    another cell only if it is near enough to the plane between the two, and within a cell only rows whose angle to the
    pivot is near enough to its own: cells are cut by that angle into blocks of some ``rows_a_block``, and a task multiplies
    two blocks as matrices. Pairs of blocks that can't hold a similar pair are never made. How much that saves depends on the
    threshold: below some 0.5 little is pruned. Then cells are fewer and blocks larger, so that a row is moved to a bounded
    number of them, while a task multiplies more. A null or empty vector has no pair; repeated rows have a pair each.
    """
    on = block or []
    df = df.withColumn("_carried", F.col(carry)) if carry else df
    key_at = ["k", "_carried"] if carry else ["k"]
    kinds = [df.schema[key].dataType.simpleString(), *([df.schema[carry].dataType.simpleString()] if carry else [])]
    tasks, _ = _dealt(df, key, vec, least, on, rows_a_block, key_at[1:])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        side, (keys, *more) = np.asarray(table["side"]), [table[c].combine_chunks() for c in key_at]
        own = bool(len(side)) and table["first"][0].as_py() == table["second"][0].as_py()
        x = unit(np.asarray(table["v"].combine_chunks().flatten(), dtype=float).reshape(len(side), -1))
        lo, hi = np.flatnonzero(side == 0), np.flatnonzero(side == (0 if own else 1))
        right = x[hi].T
        for at in range(0, len(lo), BLOCK // 4):
            some = lo[at : at + BLOCK // 4]
            dots = x[some] @ right
            i, j = np.nonzero(dots >= least - 10.0**-DIGITS)
            close = np.round(dots[i, j], DIGITS) >= least
            i, j = i[close], j[close]
            for k in range(0, len(i), BLOCK * 64):
                p, q = some[i[k : k + BLOCK * 64]], hi[j[k : k + BLOCK * 64]]
                a, b = keys.take(pa.array(p)), keys.take(pa.array(q))
                less = pc.less(a, b)
                columns = {"a": pc.if_else(less, a, b), "b": pc.if_else(less, b, a), "score": pa.array(np.round((x[p] * x[q]).sum(axis=1), DIGITS))}
                for c in more:
                    columns |= {"ca": pc.if_else(less, c.take(pa.array(p)), c.take(pa.array(q))), "cb": pc.if_else(less, c.take(pa.array(q)), c.take(pa.array(p)))}
                # a pair within a block is met from both its ends; of two blocks from one
                yield pa.RecordBatch.from_pydict(columns).filter(less if own else pc.not_equal(a, b))

    return tasks.groupBy(*on, *TASK).applyInArrow(pairs, ", ".join([f"a {kinds[0]}, b {kinds[0]}, score double", *[f"ca {c}, cb {c}" for c in kinds[1:]]]))


def pairs_compared(df: DataFrame, key: str, vec: str, least: float, block: list[str] | None = None, rows_a_block: int = ROWS) -> int:
    """How many pairs ``similar_pairs`` compares."""
    tasks, _ = _dealt(df, key, vec, least, block or [], rows_a_block)
    sides = tasks.groupBy(*(block or []), *TASK).agg(F.count_if(F.col("side") == 0).alias("x"), F.count_if(F.col("side") == 1).alias("y"))
    counted = F.when(F.col("first") == F.col("second"), F.col("x") * (F.col("x") - 1) / 2).otherwise(F.col("x") * F.col("y"))
    return int(sides.agg(F.sum(counted)).first()[0] or 0)
