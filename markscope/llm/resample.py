"""Importance resampling towards a target distribution (op13).

Features are runs of ``low`` to ``high`` consecutive words, hashed into buckets by the CRC-32 of
their UTF-8 bytes (words joined by one blank). Each document is written once in that normal form
and scanned once, storing the running CRC before and after every word. The CRC of any run then
comes from two of those prefixes: crc(B) = crc(AB) xor shift(crc(A), |B|), where the shift by n
bytes is a linear map over GF(2), applied through one table per binary digit of n. No run is ever
built as a string.

Two passes over the documents: bucket counts (a fixed-size array per task, summed by bucket), then
the weight of every document under the broadcast gains (one number per bucket). The draw orders
scores by range partitions, so no task sees all documents.

Results by case: null, empty and wordless texts have no features and weight 0, and are never
drawn; texts are read whole; equal rows get equal scores and consecutive ranks; a null doc_id is
hashed as the empty string and comes last among ties; an empty table on either side counts as no
features; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markscope.llm.common import Scratch, ship
from markscope.llm.slabs import ascii_alnum_words, slices, with_row_numbers

_POLYNOMIAL = np.uint32(0xEDB88320)


def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return (table[0][crc & 255] ^ table[1][(crc >> np.uint32(8)) & 255]
            ^ table[2][(crc >> np.uint32(16)) & 255] ^ table[3][crc >> np.uint32(24)])


def _shift_tables(bits: int) -> list[np.ndarray]:
    """For k < bits, the map that shifts a CRC over 2**k zero bytes, as four tables by byte."""
    x = np.arange(256, dtype=np.uint32)[None, :] << np.arange(0, 32, 8, dtype=np.uint32)[:, None]
    for _ in range(8):
        x = (x >> np.uint32(1)) ^ (x & np.uint32(1)) * _POLYNOMIAL
    tables = [x]
    while len(tables) < bits:
        tables.append(_apply(tables[-1], tables[-1]))
    return tables


_SHIFT = _shift_tables(40)


def shift(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each CRC moved over as many bytes as ``lengths`` says."""
    out = crc.copy()
    for k in range(int(lengths.max(initial=0)).bit_length()):
        at = np.flatnonzero((lengths >> k) & 1)
        out[at] = _apply(_SHIFT[k], out[at])
    return out


def running_crcs(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(CRC before each word, CRC behind it, the words' first and end byte) of the words' line."""
    before, behind, c = [], [], 0
    for w in words:
        before.append(c)
        c = zlib.crc32(w, c)
        behind.append(c)
        c = zlib.crc32(b" ", c)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]) if words else ends
    return np.array(before, np.uint32), np.array(behind, np.uint32), starts, ends


def run_crcs(words: list[bytes], low: int, high: int) -> np.ndarray:
    """CRC-32 of every run of ``low`` to ``high`` consecutive words, from prefixes alone."""
    before, behind, starts, ends = running_crcs(words)
    out = [np.zeros(0, np.uint32)]
    for k in range(low, min(high, len(words)) + 1):
        last = len(words) - k + 1
        out.append(behind[k - 1:] ^ shift(before[:last], ends[k - 1:] - starts[:last]))
    return np.concatenate(out)


def bucket_counts(texts: DataFrame, low: int, high: int, buckets: int) -> np.ndarray:
    """Features per bucket over all rows of ``texts`` (text)."""
    ship(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in slices(batches, "text"):
            for t in b.column("text").to_pylist():
                total += np.bincount(run_crcs(ascii_alnum_words(t), low, high) % buckets, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(total[at])], names=["bucket", "n"])

    rows = (texts.select("text").mapInArrow(run, "bucket long, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")).collect())  # at most one row per bucket
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln((t+1) * (S+B) / ((s+1) * (T+B)))) of every bucket."""
    b = len(source)
    s_all, t_all = int(source.sum()) + b, int(target.sum()) + b
    return np.array([math.floor(1000 * math.log(((t + 1) * s_all) / ((s + 1) * t_all)))
                     for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weights(docs: DataFrame, gains: np.ndarray, low: int, high: int) -> DataFrame:
    """doc_id, n_words, n_features, weight of every row of ``docs`` (doc_id, text)."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(gains)  # one number per bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for b in slices(batches, "text"):
            n_words, n_features, weight = [], [], []
            for t in b.column("text").to_pylist():
                words = ascii_alnum_words(t)
                crcs = run_crcs(words, low, high)
                n_words.append(len(words))
                n_features.append(len(crcs))
                weight.append(int(gain[crcs % len(gain)].sum()))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n_words, n_features, weight))],
                names=["doc_id", "n_words", "n_features", "weight"])

    return (docs.selectExpr("cast(doc_id as long) doc_id", "text")
            .mapInArrow(run, "doc_id long, n_words long, n_features long, weight long"))


def resample(docs: DataFrame, target: DataFrame, low: int = 1, high: int = 1, buckets: int = 10000,
             seed: int = 2024, min_words: int = 20, percent: int = 10, scratch: Scratch | None = None) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank. ``rank`` (from 1) is set for the
    ``percent`` of the documents of ``min_words`` words or more with the highest scores (Gumbel top-k)."""
    if not 1 <= low <= high or buckets < 1:
        raise ValueError("1 <= low <= high and buckets >= 1 are needed")
    scratch = scratch or Scratch(docs.sparkSession, "resample")
    gains = bucket_gains(bucket_counts(docs, low, high, buckets), bucket_counts(target, low, high, buckets))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")
    scored = (weights(docs, gains, low, high).withColumn("score", F.col("weight") + noise)
              .withColumn("fits", F.col("n_words") >= min_words))
    order = [F.col("fits").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight"),
             F.col("n_features")]
    ranked = with_row_numbers(scored, order, scratch, "resample")
    drawn = percent * ranked.where("fits").count() // 100
    return ranked.select("doc_id", "n_features", "weight", "score",
                         F.when(F.col("fits") & (F.col("row_number") <= drawn), F.col("row_number")).alias("rank"))


#: DuckDB SQL of the contract: the CRC folds the bytes of each distinct word through the usual table.
ORACLE = r"""
WITH crc_table AS (SELECT list(list_reduce(list_prepend(b, range(8)),
             lambda c, i: xor(c >> 1, (c & 1) * 3988292384)) ORDER BY b) AS t FROM range(256) r(b)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
per_doc AS (SELECT doc_id, word, count(*) AS n FROM d, unnest(w) u(word) GROUP BY ALL),
target AS (SELECT word, count(*) AS n FROM b, unnest(w) u(word) GROUP BY ALL),
vocabulary AS (SELECT word, hex(encode(word)) AS x FROM (SELECT word FROM per_doc UNION SELECT word FROM target) v),
hashed AS (SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(x) // 2),
             lambda i: (instr('0123456789ABCDEF', x[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', x[2 * i + 2]) - 1)),
             lambda c, v: xor(t[(xor(c, v) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket FROM vocabulary, crc_table),
s AS (SELECT bucket, sum(n) AS n FROM per_doc JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS n FROM target JOIN hashed USING (word) GROUP BY bucket),
totals AS (SELECT coalesce((SELECT sum(n) FROM s), 0) AS s_all, coalesce((SELECT sum(n) FROM t), 0) AS t_all),
gains AS (SELECT bucket, CAST(floor(1000 * ln(CAST((coalesce(t.n, 0) + 1) * (s_all + 10000) AS DOUBLE)
             / CAST((s.n + 1) * (t_all + 10000) AS DOUBLE))) AS BIGINT) AS gain
          FROM s LEFT JOIN t USING (bucket), totals),
summed AS (SELECT doc_id, sum(n) AS n, sum(n * gain) AS weight
           FROM per_doc JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY doc_id),
scored AS (SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
             len(w) >= 20 AS fits, CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST(
             ('0x' || sha256('2024:' || d.doc_id)[1:8]) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
           FROM d LEFT JOIN summed USING (doc_id)),
drawn AS (SELECT *, row_number() OVER (PARTITION BY fits ORDER BY score DESC, doc_id) AS r,
             10 * count(*) OVER (PARTITION BY fits) // 100 AS k FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN fits AND r <= k THEN r END AS rank FROM drawn
"""
