"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from markscope.session import checkpoint_dir

#: Lists of at most this many rows are broadcast after their rows were counted
#: (ids and hashes: a few tens of bytes a row); longer ones are joined by shuffle.
BROADCAST_ROWS = 1_000_000

_PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_SHIPPED = "_markscope_shipped"


#: Size of one Arrow batch, where the session sets none: bounds what a task holds of long texts.
BATCH_BYTES = 4 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that tasks can
    import it without it being installed there; bound the size of Arrow batches."""
    if spark.conf.get(_BATCH_KEY, None) is None:
        spark.conf.set(_BATCH_KEY, str(BATCH_BYTES))
    sc = spark.sparkContext
    if getattr(sc, _SHIPPED, False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="markscope-ship-"), "markscope_pkg.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for top, _, names in sorted(os.walk(_PACKAGE)):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(top, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(_PACKAGE)))
    sc.addPyFile(path)
    setattr(sc, _SHIPPED, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """A folder of this run under ``spark.checkpoint.dir``.

    ``save`` writes a table there and reads it back: that cuts lineage, is visible
    to every executor, and survives the loss of any of them. Behind a ``with`` block over
    it the folder is removed: for tables whose readers are all written within the block.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{checkpoint_dir(spark).rstrip('/')}/markscope-{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def save(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        path, schema = self.path(name), df.schema
        df.write.option("compression", codec).parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        root.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(root, True)


def keyed_filter(big: DataFrame, keys: DataFrame, on: list[str], how: str) -> DataFrame:
    """Semi or anti join of ``big`` with a written list of keys (null keys equal each
    other). The list is broadcast when its counted rows are at most BROADCAST_ROWS."""
    k = keys.select([F.col(c).alias(f"__key_{c}") for c in on]).distinct()
    if keys.count() <= BROADCAST_ROWS:
        k = F.broadcast(k)
    cond = None
    for c in on:
        one = big[c].eqNullSafe(k[f"__key_{c}"])
        cond = one if cond is None else cond & one
    return big.join(k, cond, how)


def least_hashes(rows: DataFrame, size: int) -> DataFrame:
    """The ``size`` distinct rows with the least hashes. Only rows under a bound fitted to the
    estimated number of distinct ones are sorted, so little more than ``size`` rows travel."""
    names = rows.columns
    hashed = rows.withColumn("__h", F.xxhash64(*names, F.lit("sample")))
    n = hashed.agg(F.approx_count_distinct("__h", 0.02)).first()[0]
    if n > 2 * size:
        hashed = hashed.where(F.col("__h") < int(-2 ** 63 + 2 ** 64 * 1.5 * size / n))
    return hashed.distinct().orderBy("__h", *names).limit(size).drop("__h")


def sampled_texts(rows: DataFrame, size: int, text: str, tags: list[str]) -> list[Row]:
    """At most ``size`` distinct rows (``text`` and ``tags``), the same for the same rows in any
    order. They are chosen by the text's hash; only chosen texts leave their place."""
    hashed = rows.select(text, *tags, F.xxhash64(text).alias("__th"))
    keys = least_hashes(hashed.select("__th", *tags), size).collect()
    if not keys:
        return []
    chosen = rows.sparkSession.createDataFrame(keys, hashed.select("__th", *tags).schema)
    on = hashed["__th"] == chosen["__th"]
    for c in tags:
        on = on & hashed[c].eqNullSafe(chosen[c])
    found = hashed.join(F.broadcast(chosen), on, "left_semi").dropDuplicates(["__th", *tags])
    return found.orderBy("__th", *tags).drop("__th").collect()
