"""Reversible line deduplication (op12): sharded cuckoo filters over exact reference counts.

A ``LineIndex`` is a folder of tables, written in generations (the last complete one counts):

* ``refs``: one row per document and key - the exact references;
* ``counts``: per key the number of documents that hold it and the smallest of them;
* ``filters``: per shard of the key space a chain of cuckoo filters with one fingerprint per
  live key.

``insert`` tells by the filters which keys of a batch are surely new; only the others are looked up
in the exact counts. ``delete`` takes documents away: their references go, the counts of the keys
they held are taken anew from the references that stay, and keys without any leave the filters.
So inserting and deleting the same documents restores the same decisions.

``clean`` drops a line when another document with a smaller doc_id holds its key. A key is the
line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased, at least ``min_chars`` code points
long; keys are compared by 128-bit hashes.

A key held by very many documents is no hot spot: counting aggregates before it shuffles, and the
keys with more references than a quarter of a mean shuffle partition - at most four times the number
of partitions - are joined by broadcast, so no task gets all references of one key.

Results by case: null or empty text is one empty line, which is never dropped (unless min_chars is
0); lines are read whole; repeated lines of the smallest document all stay; rows with one doc_id are
one document; rows with a null doc_id keep all lines and hold no keys; an empty table adds nothing;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markscope.llm.common import Scratch, ship
from markscope.llm.cuckoo import LOAD, SLOTS, Chain
from markscope.llm.slabs import slices

MIN_CHARS = 10
#: Keys per shard that a new index is laid out for.
SHARD_KEYS = 100_000
_BLANK = b" \t\n\x0b\x0c\r"
#: Keys handled at once for one shard.
_STEP = 200_000


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The 16-byte key of a line (UTF-8), or None if it is too short to count."""
    key = line.strip(_BLANK).lower()  # bytes.lower() folds A-Z only
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def line_refs(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """The distinct (doc_id, key) of ``docs`` (doc_id, text)."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            ids, keys = [], []
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                own = {line_key(x, min_chars) for x in (t or b"").split(b"\n")} - {None}
                ids += [d] * len(own)
                keys += sorted(own)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())],
                                             names=["doc_id", "key"])

    return (docs.where("doc_id IS NOT NULL").selectExpr("cast(doc_id as long) doc_id", "text")
            .mapInArrow(run, "doc_id long, key binary").distinct())


def _as_numbers(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)


def _counted(refs: DataFrame) -> DataFrame:
    return refs.groupBy("key").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))


class LineIndex:
    """The index in folder ``path`` (shared by all executors); opened if it is there."""

    def __init__(self, spark: SparkSession, path: str, min_chars: int = MIN_CHARS):
        self.spark, self.path, self.min_chars = spark, path.rstrip("/"), min_chars
        self.generation, self.shards, self.buckets, self.refs_paths = 0, 0, 0, []
        fs = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/log")
        if fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs):
            last = spark.read.parquet(f"{self.path}/log").orderBy(F.desc("generation")).first()
            self.generation, self.shards, self.buckets = last.generation, last.shards, last.buckets
            self.refs_paths, self.min_chars = list(last.refs_paths), last.min_chars

    # tables of the current generation

    def refs(self) -> DataFrame:
        if not self.refs_paths:
            return self.spark.createDataFrame([], "doc_id long, key binary")
        return self.spark.read.schema("doc_id long, key binary").parquet(*self.refs_paths)

    def counts(self) -> DataFrame:
        schema = "key binary, n_docs long, first_doc long"
        if not self.generation:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self._at("counts"))

    def filters(self) -> DataFrame:
        schema = "shard int, part int, blob binary"
        if not self.generation:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self._at("filters"))

    def _at(self, name: str, ahead: int = 0) -> str:
        return f"{self.path}/{name}-{self.generation + ahead:06d}"

    def _write(self, df: DataFrame, name: str) -> DataFrame:
        path, schema = self._at(name, 1), df.schema
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def _commit(self) -> None:
        """The next generation's tables are complete: the log names it, last of all."""
        self.generation += 1
        row = (self.generation, self.shards, self.buckets, self.min_chars, self.refs_paths)
        (self.spark.createDataFrame([row], "generation int, shards int, buckets int, min_chars int, "
                                           "refs_paths array<string>")
         .write.mode("append").parquet(f"{self.path}/log"))

    # the filters, shard by shard

    def _shard(self) -> F.Column:
        return F.pmod(F.xxhash64("key"), F.lit(self.shards)).cast("int")

    def _shardwise(self, keys: DataFrame, work, schema: str) -> DataFrame:
        """``work(shard, chain, steps of (keys, tags))`` for every shard that has rows. ``keys``: key
        and tag (int). The filters come first in each shard's sorted rows, then the keys."""
        ship(self.spark)
        buckets = self.buckets
        rows = (self.filters().selectExpr("shard", "0 kind", "part tag", "blob")
                .unionByName(keys.select(self._shard().alias("shard"), F.lit(1).alias("kind"), "tag",
                                         F.col("key").alias("blob"))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from itertools import groupby
            stream = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
            for shard, group in groupby(stream, key=lambda r: r[0]):
                blobs: list[bytes] = []

                def steps():
                    held, tags = [], []
                    for _, kind, tag, blob in group:
                        if not kind:
                            blobs.append(blob)
                            continue
                        held.append(blob)
                        tags.append(tag)
                        if len(held) >= _STEP:
                            yield held, tags
                            held, tags = [], []
                    yield held, tags

                yield from work(shard, lambda: Chain(buckets, blobs), steps())

        return (rows.repartition("shard").sortWithinPartitions("shard", "kind", "tag").mapInArrow(run, schema))

    def _maybe_known(self, keys: DataFrame) -> DataFrame:
        """The keys that their shard's filters may hold; all others are surely new."""

        def work(_shard, chain, steps):
            c = None
            for held, _ in steps:
                c = c or chain()
                if held:
                    found = c.contains(_as_numbers(held))
                    yield pa.RecordBatch.from_arrays([pa.array([k for k, f in zip(held, found) if f], pa.binary())],
                                                     names=["key"])

        return self._shardwise(keys.select("key", F.lit(1).alias("tag")), work, "key binary")

    def _updated_filters(self, changes: DataFrame) -> DataFrame:
        """The filters after ``changes`` (key, tag: -1 deletes, 1 inserts)."""

        def work(shard, chain, steps):
            c = None
            for held, tags in steps:
                c = c or chain()
                if held:
                    k, t = _as_numbers(held), np.array(tags)
                    c.delete(k[t < 0])
                    c.insert(k[t > 0])
            blobs = c.blobs()
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard] * len(blobs), pa.int32()), pa.array(range(len(blobs)), pa.int32()),
                 pa.array(blobs, pa.binary())], names=["shard", "part", "blob"])

        return self._shardwise(changes, work, "shard int, part int, blob binary")

    # updates

    def insert(self, docs: DataFrame) -> None:
        """Adds documents (doc_id, text). References that are there already are left as they are."""
        refs = line_refs(docs, self.min_chars)
        if self.generation:
            refs = refs.join(self.refs(), ["doc_id", "key"], "left_anti")
        refs = self._write(refs, "refs")
        batch = self._write(_counted(refs), "batch" if self.generation else "counts")
        if not self.generation:
            n = max(batch.count(), 1)
            self.shards = -(-n // SHARD_KEYS)
            self.buckets = 1 << int(np.ceil(np.log2(max(1.15 * n / self.shards / (SLOTS * LOAD), 16))))
            new = batch.select("key")
        else:
            known = self._maybe_known(batch)
            old = self.counts().join(known.distinct(), "key", "left_semi")  # exact: false positives fall out
            merged = self._write(batch.join(old.selectExpr("key", "n_docs n0", "first_doc f0"), "key", "left"), "merged")
            new = merged.where("n0 IS NULL").select("key")
            kept = self.counts().join(merged.where("n0 IS NOT NULL"), "key", "left_anti")
            self._write(kept.unionByName(merged.selectExpr(
                "key", "n_docs + coalesce(n0, 0) n_docs", "least(first_doc, f0) first_doc")), "counts")
        self._write(self._updated_filters(new.select("key", F.lit(1).alias("tag"))), "filters")
        self.refs_paths = [*self.refs_paths, self._at("refs", 1)]
        self._commit()

    def delete(self, ids: DataFrame) -> None:
        """Takes documents (doc_id) out again; unknown ids have no effect."""
        if not self.generation:
            return
        ids = ids.selectExpr("cast(doc_id as long) doc_id").where("doc_id IS NOT NULL").distinct()
        touched = self._write(self.refs().join(ids, "doc_id", "left_semi").select("key").distinct(), "touched")
        refs = self._write(self.refs().join(ids, "doc_id", "left_anti"), "refs")
        again = self._write(_counted(refs.join(touched, "key", "left_semi")), "again")
        dead = touched.join(again, "key", "left_anti")
        self._write(self.counts().join(touched, "key", "left_anti").unionByName(again), "counts")
        self._write(self._updated_filters(dead.select("key", F.lit(-1).alias("tag"))), "filters")
        self.refs_paths = [self._at("refs", 1)]
        self._commit()

    # decisions

    def drops(self) -> DataFrame:
        """doc_id, key: references of lines that go."""
        shared = self.counts().where("n_docs > 1")
        total = shared.agg(F.sum("n_docs")).first()[0] or 0
        width = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        bound = max(total // (4 * width), 1)
        # at most 4 * width keys can have more references than that
        hot = F.broadcast(shared.where(F.col("n_docs") > bound).selectExpr("key", "first_doc hot_first"))
        rows = self.refs().join(hot, "key", "left")
        cold = (rows.where("hot_first IS NULL").select("doc_id", "key")
                .join(shared.where(F.col("n_docs") <= bound).select("key", "first_doc"), "key"))
        return (rows.where("doc_id > hot_first").select("doc_id", "key")
                .unionAll(cold.where("doc_id > first_doc").select("doc_id", "key")))

    def clean(self, docs: DataFrame) -> DataFrame:
        """doc_id, text (kept lines joined by a line feed), n_lines, n_dropped per row of ``docs``."""
        ship(self.spark)
        min_chars = self.min_chars
        gone = self.drops().groupBy("doc_id").agg(F.collect_list("key").alias("gone"))
        rows = docs.selectExpr("cast(doc_id as long) doc_id", "text").withColumn(
            "__k", F.coalesce(F.col("doc_id"), F.xxhash64("text")))  # null ids match nothing, but spread
        gone = gone.select(F.col("doc_id").alias("__k"), F.col("doc_id").alias("__id"), "gone").hint("shuffle_hash")
        rows = rows.join(gone, (rows["__k"] == gone["__k"]) & (rows["doc_id"] == gone["__id"]), "left")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, "text"):
                texts, n_lines, n_dropped = [], [], []
                for t, out in zip(b.column("text").to_pylist(), b.column("gone").to_pylist()):
                    lines = (t or b"").split(b"\n")
                    kept = lines
                    if out:
                        out = set(out)
                        kept = [x for x in lines if line_key(x, min_chars) not in out]
                    texts.append(b"\n".join(kept))
                    n_lines.append(len(lines))
                    n_dropped.append(len(lines) - len(kept))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string()),
                     pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
                    names=["doc_id", "text", "n_lines", "n_dropped"])

        return (rows.select("doc_id", "text", "gone")
                .mapInArrow(run, "doc_id long, text string, n_lines long, n_dropped long"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, scratch: Scratch | None = None) -> DataFrame:
    """``clean`` of ``docs`` by an index of all of them."""
    scratch = scratch or Scratch(docs.sparkSession, "lines")
    index = LineIndex(docs.sparkSession, scratch.path("index"), min_chars)
    index.insert(docs)
    return index.clean(docs)


#: DuckDB SQL of the contract.
ORACLE = r"""
WITH lines AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS i
               FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents) s),
keyed AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
shared AS (SELECT k, min(doc_id) AS first_doc FROM keyed WHERE length(k) >= 10 GROUP BY k
           HAVING count(DISTINCT doc_id) > 1),
marked AS (SELECT doc_id, i, line, coalesce(doc_id > first_doc, false) AS dropped FROM keyed LEFT JOIN shared USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
