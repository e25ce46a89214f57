"""Exact top-k search with vector approximations (op6).

Vectors become integers floor(256 x). A task reads its vectors in blocks. Each block is
approximated by cells (one byte a dimension over the block's range); one matrix product
of the cell numbers with the queries bounds every inner product from above and below.
Vectors whose upper bound reaches the query's k-th best certain score are read exactly,
in the order of their bounds, until the k-th result is certain. A task hands on its k
best of each query; the last step ranks them.

The queries (a stated set) go to the tasks in blocks of at most QUERY_BLOCK, so what is
broadcast is bounded; the vectors are read once for each block.

Results by case: vectors that are null, or hold a null or non-finite component, or lack a
vec_id take no part; a query meets vectors of its own length only; rows with the query's
vec_id are the query itself; several rows of one vec_id make one query (the smallest
vector); repeated candidates count by row; scores beyond a long are held at its ends; an
empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from markscope.llm.common import Scratch, ship

QUERY_BLOCK = 8192
VECTOR_BLOCK = 4096
CELLS = 256
#: Vectors with a larger integer are always read exactly.
HUGE = 2.0 ** 100
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def as_integers(vectors: np.ndarray) -> np.ndarray:
    """floor(256 x) as doubles (each is a whole number, or infinite beyond about 7e305)."""
    with np.errstate(over="ignore"):
        return np.floor(256.0 * np.asarray(vectors, np.float64))


def _whole(x: float) -> int:
    return math.floor(256.0 * x) if abs(x) < 2.0 ** 53 else int(x) * 256


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the integers of the rows of ``a`` and ``b``, as int64."""
    x, y = as_integers(a), as_integers(b)
    with np.errstate(over="ignore", invalid="ignore"):
        top = (np.abs(x).max(initial=0) * np.abs(y).max(initial=0)) * max(1, x.shape[1])
    if top < 2.0 ** 53:
        return np.einsum("ij,ij->i", x, y).astype(np.int64)
    return np.array([min(_HIGH, max(_LOW, sum(_whole(x) * _whole(y) for x, y in zip(r, s)))) for r, s in zip(a, b)], np.int64)


class Best:
    """The k best (score, vec_id) of each query so far, by falling score, rising id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.scores: list[list[tuple[int, int]]] = [[] for _ in ids]  # (-score, vec_id), sorted

    def certain(self, i: int) -> float:
        """A score that the k-th best of query i cannot fall below."""
        s = self.scores[i]
        return -s[-1][0] if len(s) == self.k else -np.inf

    def scan(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Take in a block of vectors of the queries' length."""
        whole = as_integers(vectors)
        # vectors with huge components are not bounded, and don't widen the others' cells
        huge = (np.abs(whole) > HUGE).any(axis=1)
        whole[huge] = 0
        low = whole.min(axis=0)
        step = (whole.max(axis=0) - low) / CELLS
        cell = np.zeros_like(whole)
        np.divide(whole - low, step, out=cell, where=step > 0)
        cell = np.minimum(np.floor(cell), CELLS - 1).astype(np.float32)
        # a vector is within half a cell of its cell's centre in every dimension
        for at in range(0, len(self.ids), 512):
            q = as_integers(self.vectors[at:at + 512])
            # huge queries may have bounds that are no numbers; they are not used
            with np.errstate(over="ignore", invalid="ignore"):
                weight = q * step
                # weights of at most 1 stay in the range of 32 bits
                scale = np.maximum(np.abs(weight).max(axis=1, initial=0), 1e-300)
                middle = ((cell @ (weight / scale[:, None]).T.astype(np.float32)).T.astype(np.float64) * scale[:, None]
                          + (q @ (low + step / 2))[:, None])
                # half a cell, and what rounding to 32 bits can add
                room = (np.abs(weight).sum(axis=1) * (0.5 + CELLS * vectors.shape[1] * 2.0 ** -22)
                        + np.abs(q) @ np.abs(low) * 2.0 ** -40 + 1)[:, None]
                sure = np.isfinite(middle) & np.isfinite(room) & ~huge
                # as scores are, bounds are held at the ends of a long
                upper = np.where(sure, np.clip(middle + room, _LOW, _HIGH), np.inf)
                lower = np.where(sure, np.clip(middle - room, _LOW, _HIGH), -np.inf)
            own = ids == self.ids[at:at + 512, None]  # rows of the query's vec_id are no results
            lower[own] = -np.inf
            # fewer others than k: all of them may be needed
            kth = -np.partition(-lower, self.k - 1, axis=1)[:, self.k - 1:self.k] if len(ids) >= self.k else -np.inf
            known = np.array([self.certain(at + j) for j in range(len(q))])[:, None]
            need = ~own & (upper >= np.maximum(kth, known))
            for j in np.flatnonzero(need.any(axis=1)):
                self._read(at + j, np.flatnonzero(need[j]), upper[j], ids, vectors)

    def _read(self, i: int, rows: np.ndarray, upper: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        rows = rows[ids[rows] != self.ids[i]]
        rows = rows[np.argsort(-upper[rows], kind="stable")]
        best = self.scores[i]
        for at in range(0, len(rows), 64):
            some = rows[at:at + 64]
            if len(best) == self.k and upper[some[0]] < -best[-1][0]:
                break  # no later vector can reach the k-th score
            q = np.broadcast_to(self.vectors[i], (len(some), vectors.shape[1]))
            got = exact_scores(vectors[some], q)
            best = sorted(best + [(-int(s), int(v)) for s, v in zip(got, ids[some])])[:self.k]
        self.scores[i] = best


def _usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
            .where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad))


def search(queries: DataFrame, vectors: DataFrame, k: int = 5, id_col: str = "vec_id",
           vector_col: str = "embedding", query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best inner products of each query
    with all vectors, ties to the smaller vec_id."""
    spark = vectors.sparkSession
    ship(spark)
    base = _usable(vectors, id_col, vector_col)
    asked = Scratch(spark, "topk").save(
        _usable(queries, id_col, vector_col).groupBy("id").agg(F.min("v").alias("v")), "queries")
    n_blocks = max(1, -(-asked.count() // query_block))
    out = None
    for n in range(n_blocks):
        # at most about query_block rows come to the driver at a time
        mine = asked.where(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == n).orderBy("id").collect()
        sent = spark.sparkContext.broadcast([(r["id"], list(r["v"])) for r in mine])

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            by_len: dict[int, list] = {}
            for i, v in sent.value:
                by_len.setdefault(len(v), []).append((i, v))
            best = {d: Best(np.array([i for i, _ in r], np.int64), np.array([v for _, v in r], np.float64).reshape(len(r), d), k)
                    for d, r in by_len.items()}
            for b in batches:
                flat, ids = b.column("v"), b.column("id").to_numpy()
                lens = flat.value_lengths().to_numpy()
                values = flat.flatten().to_numpy()
                starts = np.cumsum(lens) - lens
                for d in np.unique(lens):
                    if d not in best:
                        continue
                    rows = np.flatnonzero(lens == d)
                    for at in range(0, len(rows), VECTOR_BLOCK):
                        own = rows[at:at + VECTOR_BLOCK]
                        block = values[starts[own][:, None] + np.arange(d)]
                        best[d].scan(ids[own], block)
            rows = [(int(q), v, -s) for x in best.values() for q, got in zip(x.ids, x.scores) for s, v in got]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)],
                                                 names=["query_id", "vec_id", "score"])

        part = base.mapInArrow(run, "query_id long, vec_id long, score long")
        out = part if out is None else out.unionAll(part)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


#: DuckDB SQL of the contract (k = 5, queries by vec_id % 50).
ORACLE = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
           FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(range(1, len(a.q) + 1),
             lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
           FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
