"""Helpers shared by the training-data operators.

Nothing here keeps rows on the driver: tables that must outlive their lineage
are written below ``spark.checkpoint.dir``, which driver and executors share.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: A row set at most this long (a few dozen bytes a row) may be broadcast.
BROADCAST_ROWS = 500_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where none is set a local master gets a temporary folder; on a cluster that
    would be a folder which executors can't read, so there it is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="docsift-"))
    return context.getCheckpointDir()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docsift/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._stored_at = path
    return found


def dropped(df: DataFrame) -> None:
    """Delete a table of ``stored`` that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a stored table for broadcast if it has at most ``rows`` rows.

    Beyond that the join shuffles; Spark then splits the skewed partitions.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def lower_ascii(column):
    return F.translate(column, UPPER, LOWER)


class Cache:
    """Two generations of entries, about ``limit`` bytes in all: what is used stays, the rest goes.

    Keys and values are bytes, text or numbers. A cache belongs to one task and
    goes with it, so that a worker holds no memory for stages that come later.
    """

    #: Bytes of an entry besides its key's and its value's own.
    ENTRY = 170

    def __init__(self, limit: int = 32 << 20):
        self.limit, self.new, self.old, self.size = limit // 2, {}, {}, 0

    def _turn(self) -> None:
        if self.size > self.limit:
            self.old, self.new, self.size = self.new, {}, 0

    def _weigh(self, key, value) -> None:
        self.size += self.ENTRY + len(key) + (len(value) if isinstance(value, bytes) else 0)

    def get(self, key, learn):
        got = self.new.get(key)
        if got is None:
            got = self.old.get(key)
            if got is None:
                got = learn(key)
            self._turn()
            self.new[key] = got
            self._weigh(key, got)
        return got

    def fill(self, keys, learn) -> dict:
        """A dict that holds the keys; ``learn`` gives the values of a list of unknown keys."""
        self._turn()
        new, old, unknown = self.new, self.old, []
        for k in keys:
            if k not in new:
                got = old.get(k)
                if got is None:
                    unknown.append(k)
                else:
                    new[k] = got
                    self._weigh(k, got)
        if unknown:
            for k, got in zip(unknown, learn(unknown), strict=True):
                new[k] = got
                self._weigh(k, got)
        return new


def slices(texts: list, chars: int = 1_000_000):
    """Lists of neighbouring texts of about so many characters at most, one text at least."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t or "") > chars:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t or "")
    if part:
        yield part
