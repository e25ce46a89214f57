"""Token-id output (op1): frequency-ranked ids in a byte-aligned variable-length code
with separate control bytes, decoded by numpy table lookup.

File format (a Parquet table; one row is one block of whole documents):

    shard, block          place in the corpus: blocks in (shard, block) order hold the
                          documents in ascending doc_id order
    start                 ids of the shard before this block
    doc_ids, counts       the block's documents and their numbers of ids
    ranks                 the block's ids by falling frequency (uint32, little endian)
    control, data         per id its rank: two bits of length (1 to 4 bytes, four ids to a
                          control byte, low bits first), and the bytes (little endian)

A block ranks its ids by its own counts over all of its documents: no pass over the
corpus, no table that grows with it, and a lost task is redone alone. Documents reach
their shard by one range shuffle on doc_id.

Results by case: a null or empty text holds only the end id; a null doc_id comes first;
equal doc_ids stand next to each other, ordered by a hash of their text; equal rows give
equal rows; an empty table gives no block; other columns are ignored. A block closes
after ``block_ids`` ids; only a single document may be longer.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markscope.llm.common import ship
from markscope.llm.slabs import gathered, give_back
from markscope.llm.tokens import tokenizer

BLOCK_IDS = 2_000_000
#: Bytes of text encoded at once: distinct words are looked up once for each step.
STEP_BYTES = 8_000_000
SCHEMA = ("shard int, block int, start long, doc_ids array<bigint>, counts array<bigint>, "
          "ranks binary, control binary, data binary")

# the lengths of the four ids of each control byte
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit numbers."""
    r = np.zeros(-(-len(ranks) // 4) * 4, np.uint32)
    r[:len(ranks)] = ranks
    length = 1 + (r >= 1 << 8) + (r >= 1 << 16) + (r >= 1 << 24).astype(np.int64)
    code = (length - 1).reshape(-1, 4).astype(np.uint8)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    raw = r.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control.tobytes(), raw[np.arange(4) < length[:, None]].tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The first ``n`` numbers."""
    length = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)
    raw = np.zeros((len(length), 4), np.uint8)
    raw[np.arange(4) < length[:, None]] = np.frombuffer(data, np.uint8)
    return raw.view("<u4").reshape(-1)[:n]


def encode_block(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """ranks, control, data of a block's ids."""
    if not len(ids):
        return b"", b"", b""
    n = np.bincount(ids)
    used = np.flatnonzero(n)
    by_rank = used[np.lexsort((used, -n[used]))]
    rank = np.zeros(len(n), np.uint32)
    rank[by_rank] = np.arange(len(by_rank))
    return by_rank.astype("<u4").tobytes(), *encode_ranks(rank[ids])


def decode_block(ranks: bytes, control: bytes, data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(ranks, "<u4")[decode_ranks(control, data, n)]


def _writer(tokenizer_path: str, end_id: int, block_ids: int) -> Callable:
    schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("start", pa.int64()),
                        ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())),
                        ("ranks", pa.binary()), ("control", pa.binary()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(tokenizer_path)
        shard = TaskContext.get().partitionId()
        block, start, size = 0, 0, 0
        docs: list[int | None] = []
        counts: list[np.ndarray] = []
        parts: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            nonlocal block, start, size
            ids = np.concatenate(parts)
            row = [shard, block, start, list(docs), np.concatenate(counts).tolist(), *encode_block(ids)]
            block, start, size = block + 1, start + len(ids), 0
            docs.clear(), counts.clear(), parts.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

        for b in gathered(batches, "text", STEP_BYTES):
            texts, keys = b.column("text"), b.column("doc_id").to_pylist()
            sizes = np.array([len(t.as_buffer() or b"") if t.is_valid else 0 for t in texts], np.int64)
            cut = (np.cumsum(sizes) - sizes) // (4 * block_ids)  # about a block of ids a step
            for s in np.unique(cut):
                rows = np.flatnonzero(cut == s)
                flat, n = tok.encode(texts.slice(rows[0], len(rows)))
                ends = np.cumsum(n) + np.arange(1, len(n) + 1)
                ids = np.full(int(ends[-1]), end_id, np.uint32)
                inside = np.ones(len(ids), bool)
                inside[ends - 1] = False
                ids[inside] = flat
                docs += [keys[i] for i in rows]
                counts.append(n + 1)
                parts.append(ids)
                size += len(ids)
                if size >= block_ids:
                    yield close()
        if docs:
            yield close()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0,
                 block_ids: int = BLOCK_IDS) -> None:
    """Encode ``docs`` (doc_id, text) and write the blocks to ``path``."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("__h"))
    ordered = rows.repartitionByRange("doc_id", "__h").sortWithinPartitions("doc_id", "__h")
    (ordered.select("doc_id", "text").mapInArrow(_writer(tokenizer_path, end_id, block_ids), SCHEMA)
     .write.option("compression", "none").parquet(path))


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Documents of a written corpus: doc_id, start (ids of all documents before it),
    n_tokens, ids_crc32 (of the ids as little-endian uint32) and, if asked for, ids."""
    ship(spark)
    blocks = spark.read.schema(SCHEMA).parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                n = np.array(r["counts"], np.int64)
                ids = decode_block(r["ranks"], r["control"], r["data"], int(n.sum())).astype("<u4")
                ends = np.cumsum(n)
                cols = [pa.array([r["shard"]] * len(n), pa.int32()), pa.array(r["doc_ids"], pa.int64()),
                        pa.array(r["start"] + ends - n), pa.array(n),
                        pa.array([zlib.crc32(ids[a:b]) for a, b in zip(ends - n, ends)], pa.int64())]
                names = ["shard", "doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()),
                                                         pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)
        give_back()

    docs = blocks.mapInArrow(run, "shard int, doc_id long, start long, n_tokens long, ids_crc32 long"
                             + (", ids array<int>" if with_ids else ""))
    # one row per shard, that is per written partition
    sizes = blocks.groupBy(F.col("shard").alias("__shard")).agg(
        F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    bases = sizes.selectExpr("__shard", "sum(n) OVER (ORDER BY __shard) - n AS base")
    return (docs.join(F.broadcast(bases), F.col("shard") == F.col("__shard"))
            .withColumn("start", F.col("start") + F.col("base")).drop("__shard", "base", "shard"))
