"""N-gram Jaccard join of documents (op2): grouped prefix join over word shingles.

1. Every text becomes its set of word shingles (64-bit hashes; two of the 2^64 values
   meeting by chance is the only inexactness). Texts with the same set are one class.
2. A set that can have a partner shares nearly all of its tokens. Over extended prefixes
   in hash order (``misses + l`` tokens, of which a linked pair shares ``l``), classes with
   too few shared tokens are set aside; this needs one count per token, no pairs. It is done
   again among the classes left: tokens shared by chance with a class set aside count no more,
   while both sets of a linked pair stay in every round.
3. The remaining classes, a small part of a corpus, are read again in full and go through
   the rarity-ordered grouped prefix join of ``setjoin``.

Results by case: null, empty and blank texts have empty sets and are linked with nothing;
fewer words than a shingle make one shingle; a null doc_id is kept and never names a
component that has another doc_id; equal rows are all kept; an empty table gives no row;
other columns are ignored; long texts are used whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markscope.llm.common import Scratch, keyed_filter, ship
from markscope.llm.setjoin import linked_components
from markscope.llm.shingles import shingle_sets
from markscope.llm.slabs import bounded


#: How often classes with too few shared tokens are set aside.
ROUNDS = 3


def _miss(n: int, t: Fraction) -> int:
    return n - -(-n * t.numerator // t.denominator)


def _extra(n: int, t: Fraction) -> int:
    """How many shared tokens the extended prefix of a set of n is made to hold."""
    return 1 + _miss(n, t) // 2


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0] + [len(r) for r in rows])
    flat = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64)))


def _signer(k: int, t: Fraction, full: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, "text"):
            sets = shingle_sets(b.column("text").to_pylist(), k)
            n = [len(s) for s in sets]
            fp = [hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets]
            toks = sets if full else [s[:_miss(len(s), t) + _extra(len(s), t)] for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("th"), pa.array(n, pa.int64()), pa.array(fp, pa.binary()),
                 pa.array([_extra(-(-x * t.numerator // t.denominator), t) if x else 0 for x in n], pa.int64()),
                 _lists(toks)], names=["doc_id", "th", "n", "fp", "need", "toks"])
    return run


SIGNED = "doc_id long, th long, n long, fp binary, need long, toks array<bigint>"


def ngram_components(docs: DataFrame, k: int = 3, threshold: Fraction = Fraction(9, 10),
                     scratch: Scratch | None = None) -> DataFrame:
    """One row per document (doc_id, text): doc_id, th (xxhash64 of the text), n_shingles,
    component (a long, equal for linked documents; null for empty sets), component_id (the
    smallest doc_id of the component)."""
    spark = docs.sparkSession
    ship(spark)
    scratch = scratch or Scratch(spark, "ngram")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    signed = scratch.save(rows.mapInArrow(_signer(k, threshold, False), SIGNED), "signatures")
    classes = scratch.save(
        signed.where("fp IS NOT NULL").groupBy("fp")
        .agg(F.min("doc_id").alias("low"), F.min(F.struct("doc_id", "th")).alias("rep"),
             F.first("n").alias("n"), F.first("need").alias("need"), F.first("toks").alias("toks"))
        .withColumn("cid", F.monotonically_increasing_id()), "classes")

    # classes that share enough of their extended prefix with others; then with others of these
    left = classes.select("cid", "need", "toks")
    for _ in range(ROUNDS):
        post = left.select("cid", "need", F.explode("toks").alias("t"))
        shared = post.groupBy("t").agg(F.count("*").alias("k")).where("k > 1").select("t")
        some = scratch.save(
            post.join(shared, "t", "left_semi").groupBy("cid", "need").agg(F.count("*").alias("k"))
            .where("k >= need").select("cid"), "may-link")
        left = keyed_filter(classes.select("cid", "need", "toks"), some, ["cid"], "left_semi")
    chosen = scratch.save(
        keyed_filter(classes.select("cid", "fp", "rep"), some, ["cid"], "left_semi")
        .select("cid", "fp", F.col("rep.doc_id").alias("doc_id"), F.col("rep.th").alias("th")), "chosen")
    again = keyed_filter(rows, chosen, ["doc_id", "th"], "left_semi")
    read = again.mapInArrow(_signer(k, threshold, True), SIGNED).dropDuplicates(["fp"])
    sets = scratch.save(read.join(chosen.select("fp", "cid"), "fp").select("cid", "n", "toks"), "sets")

    comp = linked_components(sets, threshold, scratch)
    label = classes.select("fp", "cid", "low").join(comp, F.col("cid") == F.col("id"), "left").select(
        "fp", "low", F.coalesce("comp", "cid").alias("component"))
    label = scratch.save(label, "labels-all")
    lowest = label.groupBy("component").agg(F.min("low").alias("component_id"))
    named = label.select("fp", "component").join(lowest, "component")
    return (signed.select("doc_id", "th", "n", "fp").join(named, "fp", "left")
            .select("doc_id", "th", F.col("n").alias("n_shingles"), "component",
                    F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")))


def keep_one_per_component(docs: DataFrame, k: int = 5, threshold: Fraction = Fraction(8, 10)) -> DataFrame:
    """``docs`` with one document (the smallest doc_id, then the smallest text hash) of
    each component; documents without words stay. Rows equal in doc_id (null equals null)
    and text are one document, of which one row stays. All columns are kept."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram-keep")
    with Scratch(spark, "ngram-steps") as steps:
        found = steps.save(ngram_components(docs, k, threshold, steps).where("component IS NOT NULL")
                           .groupBy("component", "doc_id", "th").agg(F.count("*").alias("n")), "documents")
        order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
        first = found.groupBy("component").agg(F.min(order).alias("first"), F.count("*").alias("size")).where("size > 1")
        gone = scratch.save(found.join(first, "component")
                            .where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th"))))
                            .selectExpr("doc_id __ms_id", "th __ms_th"), "removed")
        again = scratch.save(found.where("n > 1").selectExpr("doc_id __ms_id", "th __ms_th"), "repeated")
    tagged = docs.withColumn("__ms_id", F.col("doc_id").cast("long")).withColumn("__ms_th", F.xxhash64("text"))
    kept = keyed_filter(tagged, gone, ["__ms_id", "__ms_th"], "left_anti")
    # only rows that repeat are grouped with their texts
    once = keyed_filter(kept, again, ["__ms_id", "__ms_th"], "left_anti")
    first = keyed_filter(kept, again, ["__ms_id", "__ms_th"], "left_semi").dropDuplicates(["__ms_id", "__ms_th"])
    return once.unionByName(first).drop("__ms_id", "__ms_th")


#: DuckDB SQL of the contract (k = 3, 90 in 100).
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g
         FROM d, unnest(range(1, greatest(len(w) - 2, 1) + 1)) t(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
sized AS (SELECT * FROM sets JOIN sizes USING (doc_id)),
links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM sized a JOIN sized b USING (g)
          WHERE a.doc_id < b.doc_id AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n)
          GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached(id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.id, y FROM reached r JOIN both_ways ON x = r.other),
lowest AS (SELECT id, min(other) AS component_id FROM reached GROUP BY id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id
FROM d LEFT JOIN sizes USING (doc_id) JOIN lowest ON id = doc_id
"""
