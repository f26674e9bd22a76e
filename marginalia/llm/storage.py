"""Tables that cut lineage, in the folder that all executors share, joins on keys that may be hot, and a Bloom filter of
bounded size."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset one under the temporary folder, if the driver is the only
    machine, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(f"{tempfile.gettempdir()}/checkpoints/{uuid.uuid4().hex}")
        import shutil

        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


class Work:
    """The tables one run of an operator writes. ``drop`` and ``keep`` free those that nothing reads any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.held = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", set()

    def path(self, name: str) -> str:
        return f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` as a written table: later plans read it, so a lost executor costs no recomputation of what came before."""
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._work_path = path
        self.held.add(path)
        return out

    def _delete(self, paths: set[str]) -> None:
        for path in paths & self.held:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        self.held -= paths

    def drop(self, *tables: DataFrame) -> None:
        self._delete({t._work_path for t in tables})

    def keep(self, *tables: DataFrame) -> None:
        """Drops all other tables of this run: only these are read by what the operator returns."""
        self._delete(self.held - {t._work_path for t in tables})


#: A key is hot if more than this part of all rows have it, so there are fewer hot keys than this number.
MOST_HOT = 4096


def join_hot(rows: DataFrame, table: DataFrame, key: str | list[str], weight: str, total: int) -> DataFrame:
    """The inner join of written ``rows`` with a ``table`` of one row a key, in which ``weight`` says how many of the ``total``
    rows have the key. The few hot keys are broadcast, so that their rows stay where they are; no other key holds more
    than one in MOST_HOT rows. Rows without a key join nothing; the column ``weight`` is dropped."""
    on = [key] if isinstance(key, str) else key
    hot, more = F.col(weight) * MOST_HOT > F.lit(total), [c for c in table.columns if c not in (*on, weight)]
    near = F.broadcast(table.filter(hot).select(*on, *more, F.lit(True).alias("_hot")))
    marked = rows.join(near, on, "left")
    kept = [*on, *[c for c in rows.columns if c not in on]]
    rest = marked.filter("_hot is null").select(*kept).join(table.filter(~hot).select(*on, *more), on)
    return marked.filter("_hot").select(*kept, *more).unionByName(rest.select(*kept, *more))


MAX_BITS = 1 << 26


class Bloom:
    """A Bloom filter of ids that is broadcast. Its size has a fixed bound (MAX_BITS, 8 MB): with more ids than it can
    tell apart it lets more rows pass, and the exact join behind it does the rest."""

    HASHES = 3

    def __init__(self, ids: DataFrame, column: str, bits: int | None = None):
        spark, n = ids.sparkSession, ids.count()
        self.bits = bits or min(MAX_BITS, max(1 << 16, 1 << (16 * n).bit_length()))
        places = ids.select(F.explode(F.array(*self._places(column))).alias("p"))
        words = places.groupBy(F.shiftrightunsigned("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b"))
        got = words.toArrow()
        filled = np.zeros(self.bits // 64, np.int64)
        filled[np.asarray(got["w"])] = np.asarray(got["b"])
        self.words = spark.sparkContext.broadcast(filled)

    def _places(self, column: str):
        return [F.pmod(F.xxhash64(F.col(column), F.lit(k)), F.lit(self.bits).cast("long")) for k in range(self.HASHES)]

    def places(self, column: str):
        """The column that ``passing`` reads, for rows of a table with the id in ``column``."""
        return F.array(*self._places(column))

    @staticmethod
    def passing(words: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Which rows may be in the set; ``places`` has HASHES values a row."""
        p = places.reshape(-1, Bloom.HASHES)
        return ((words[p >> 6] >> (p & 63)) & 1).all(axis=1)
