"""Toxic spans and document scores by a linear-chain CRF (op8).

Labels stand on documents, so token labels are derived first: in toxic documents, the
words that carry a word or word beginning strongly associated with toxic documents,
counted over all labelled texts. A CRF (toxic / other) learns to tag them from word, n-gram and affix
features; forward-backward marginals give each word's probability, offending offsets are
the words at 0.5 or more, and a logistic curve over three sums of the marginals, fitted
on documents the tagger has not seen, gives the document's score.

The fit uses at most SAMPLE_DOCS different labelled texts (by a hash, each label on its
own: all toxic ones up to half, the others fill the rest; the documented bound), whole, on
the driver; two thirds train the tagger, one third the score. Scoring is one pass where the rows live.

Results by case: null, empty and wordless texts get the score of a text without toxic
words; long texts are scored whole; equal rows get equal scores; without labelled
documents of both kinds every score is 0; labels that are null take no part, and a
text with both labels counts once for each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markscope.llm import crf
from markscope.llm.common import BROADCAST_ROWS, Scratch, least_hashes, ship
from markscope.llm.slabs import bounded, give_back

#: Labelled documents that the model is fitted on, at most.
SAMPLE_DOCS = 3000
#: Beginnings of words (in bytes) that can be associated with toxic documents.
STEMS = (4, 5, 6, 7)
#: A word or beginning counts if its rate among the words of toxic documents is this many
#: times the rate in others (half an occurrence at least), and so many toxic ones have it.
RATIO, LEAST = 12.0, 4
#: Keys whose counts a task holds before it sends them on.
HELD_KEYS = 400_000


def _keys(word: bytes) -> list[int]:
    """The hashes of a word with its end mark and of its beginnings."""
    return [xxhash.xxh64_intdigest(k) >> 1 for k in (word + b"$", *(word[:n] for n in STEMS if len(word) >= n))]


def _summed(parts: list[np.ndarray]) -> np.ndarray:
    """Rows (key, whole, other, hits, docs) with one row per key: sums of the last three."""
    rows = np.concatenate(parts, axis=1)
    keys, at, place = np.unique(rows[0], return_index=True, return_inverse=True)
    return np.stack([keys, rows[1][at], *(np.bincount(place, rows[i], len(keys)).astype(np.int64) for i in (2, 3, 4))])


def _key_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, whole word or beginning, hits in other texts, hits in toxic ones, toxic texts) of
    batches of (text, toxic), summed over at most HELD_KEYS keys."""
    held: list[np.ndarray] = []

    def rows() -> pa.RecordBatch:
        total = _summed(held)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(c) for c in total], names=["key", "whole", "other", "hits", "docs"])

    for b in bounded(batches, "text"):
        vocabulary, texts = crf.coded(b.column("text").to_pylist())
        if not vocabulary:
            continue
        keys = [_keys(w) for w in vocabulary]
        size = np.fromiter(map(len, keys), np.int64, len(keys))
        flat = np.fromiter((k for own in keys for k in own), np.int64, int(size.sum()))
        at = np.cumsum(size) - size
        whole = np.zeros(len(flat), np.int64)
        whole[at] = 1  # a word's first key has the end mark
        number, place = np.unique(flat, return_inverse=True)
        seen = np.zeros((2, len(vocabulary)), np.int64)
        docs = np.zeros(len(number), np.int64)
        for w, y in zip(texts, b.column("toxic").to_pylist()):
            own, n = np.unique(w, return_counts=True)
            seen[y, own] += n
            if y and len(own):
                docs[np.unique(np.concatenate([place[at[i]:at[i] + size[i]] for i in own]))] += 1
        other, hits = (np.bincount(place, np.repeat(c, size), len(number)).astype(np.int64) for c in seen)
        marks = np.bincount(place, whole, len(number)).astype(bool).astype(np.int64)
        held.append(np.stack([number, marks, other, hits, docs]))
        if sum(h.shape[1] for h in held) > HELD_KEYS:
            held[:] = [_summed(held)]
            if held[0].shape[1] > HELD_KEYS // 2:
                yield rows()
    if held:
        yield rows()


def toxic_keys(rows: DataFrame) -> DataFrame:
    """key: the words (with an end mark) and beginnings associated with the toxic ones of
    ``rows`` (text, toxic 0 or 1), counted over all rows, as hashes."""
    counts = (rows.select("text", "toxic")
              .mapInArrow(_key_counts, "key long, whole long, other long, hits long, docs long")
              .groupBy("key", "whole").agg(*[F.sum(c).alias(c) for c in ("other", "hits", "docs")]))
    counts = Scratch(rows.sparkSession, "toxic-words").save(counts, "counts")
    # every word has one key with an end mark
    total = counts.where("whole = 1").agg(F.coalesce(F.sum("other"), F.lit(0)) + 1,
                                          F.coalesce(F.sum("hits"), F.lit(0)) + 1).first()
    return counts.where((F.col("docs") >= LEAST) & (F.col("hits") / F.lit(total[1]) >= F.lit(RATIO) * F.greatest(
        F.col("other"), F.lit(0.5)) / F.lit(total[0]))).select("key")


def _vocabulary_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in bounded(batches, "text"):
        own = {k for t in b.column("text").to_pylist() for w in set(crf.text_words(t)) for k in _keys(w)}
        yield pa.RecordBatch.from_arrays([pa.array(sorted(own), pa.int64())], names=["key"])


def _sums(lens: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Per text: largest marginal, log of the expected toxic words, their share."""
    t = p[:, 1:2] if p.shape[1] > 1 else np.zeros((len(p), 1))
    total = crf.by_text(lens, t)[:, 0]
    return np.stack([crf.by_text(lens, t, np.maximum)[:, 0], np.log1p(4 * total),
                     np.minimum(1, 20 * total / np.maximum(lens, 1))], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 800) -> np.ndarray:
    """Weights (and a last constant) of a logistic curve, by gradient descent."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= 2.0 * (x.T @ (p - y) / len(y) + 1e-4 * w)
    return w


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS) -> tuple[crf.Crf, np.ndarray] | None:
    """(tagger, score weights) from documents (doc_id, text) and labels (doc_id, toxic); None
    without both kinds. Labels meet hashes of the texts; only chosen texts leave their place."""
    spark = docs.sparkSession
    ship(spark)
    marks = labels.select("doc_id", (F.col("toxic") != 0).cast("int").alias("toxic")).where("toxic IS NOT NULL").distinct()
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    # one document of each labelled text, and how many rows it stands on
    first = Scratch(spark, "toxic-texts").save(
        hashed.select("doc_id", "th").join(marks, "doc_id").groupBy("th", "toxic", "doc_id").agg(F.count("*").alias("n"))
        .groupBy("th", "toxic").agg(F.min(F.struct("doc_id", "n")).alias("d")).select("th", "toxic", "d.*"), "texts")
    kinds = [least_hashes(first.where(F.col("toxic") == y).select("th", "toxic"), sample).collect() for y in (0, 1)]
    if not all(kinds):
        return None
    # as many toxic texts as there are, but half the sample if the others need it
    n_toxic = min(len(kinds[1]), max(sample // 2, sample - len(kinds[0])))
    keys = kinds[0][:sample - n_toxic] + kinds[1][:n_toxic]
    chosen = F.broadcast(spark.createDataFrame(keys, "th long, toxic int"))
    picked = hashed.select("text", "th").join(chosen, "th").dropDuplicates(["th", "toxic"])
    # by label, so that every part of the fit has its share of both
    rows = picked.orderBy("toxic", "th").select("text", "toxic").collect()
    toxic = np.array([r["toxic"] for r in rows], np.int64)
    vocabulary, texts = crf.coded([r["text"] for r in rows])
    if not vocabulary:
        return None
    # every third document is left for the score
    tag, rest = ([i for i in range(len(texts)) if bool(i % 3) == kind] for kind in (True, False))
    held, texts = [rows[i]["text"] for i in rest], [texts[i] for i in tag]
    del rows
    if first.count() <= BROADCAST_ROWS:
        first = F.broadcast(first)
    labelled = hashed.join(first, ["doc_id", "th"])
    each = labelled.where("n = 1").select("text", "toxic").unionByName(
        labelled.where("n > 1").dropDuplicates(["th", "toxic"]).select("text", "toxic"))
    own = picked.select("text").mapInArrow(_vocabulary_keys, "key long").distinct()
    good = {r["key"] for r in toxic_keys(each).join(own, "key", "left_semi").collect()}
    bad = np.array([not good.isdisjoint(_keys(w)) for w in vocabulary])
    gold = [bad[w] & bool(toxic[i]) for i, w in zip(tag, texts)]
    give_back()
    model = crf.train(vocabulary, texts, gold, 2)
    del vocabulary, texts, gold, good, bad
    parts = [_sums(lens, p) for lens, p in crf.marginals(model, held)]
    fitted = model, _logistic(np.concatenate(parts), toxic[rest])
    give_back()  # the driver has more stages before it
    return fitted


def _scored(sent, texts: list[str | None]) -> np.ndarray:
    if sent is None:
        return np.zeros(len(texts))
    model, w = sent
    x = np.concatenate([_sums(lens, p) for lens, p in crf.marginals(model, texts)] or [np.zeros((0, 3))])
    return 1 / (1 + np.exp(-np.clip(np.c_[x, np.ones(len(x))] @ w, -30, 30)))


def score_toxicity(docs: DataFrame, model, keep: list[str]) -> DataFrame:
    """``keep`` columns and score (0 to 1)."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)
    rows = docs.select(*keep, "text")
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, "text"):
            s = _scored(sent.value, b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(s)], names=[*keep, "score"])

    return rows.mapInArrow(run, ddl + ", score double")


def toxic_spans(docs: DataFrame, model, keep: list[str]) -> DataFrame:
    """``keep`` columns, word (number of the word among the text's words), surface and
    probability of every word that is toxic at 0.5 or more."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)
    rows = docs.select(*keep, "text")
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, "text"):
            texts = b.column("text").to_pylist()
            row, word, surface, prob, done = [], [], [], [], 0
            for lens, p in crf.marginals(sent.value[0], texts) if sent.value else ():
                ends = np.cumsum(lens)
                for i in np.flatnonzero(p[:, 1] >= 0.5):
                    t = int(np.searchsorted(ends, i, side="right"))
                    k = int(i - (ends[t] - lens[t]))
                    row.append(done + t)
                    word.append(k)
                    surface.append(crf.text_words(texts[done + t])[k].decode("utf-8", "replace"))
                    prob.append(float(p[i, 1]))
                done += len(lens)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c).take(at) for c in keep], pa.array(word, pa.int64()), pa.array(surface, pa.string()),
                 pa.array(prob, pa.float64())], names=[*keep, "word", "surface", "probability"])

    return rows.mapInArrow(run, ddl + ", word long, surface string, probability double")


def drop_toxic(docs: DataFrame, model, threshold: float = 0.5) -> DataFrame:
    """``docs`` (all columns) without the rows whose score reaches the threshold."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, "text"):
            yield b.filter(pa.array(_scored(sent.value, b.column("text").to_pylist()) < threshold))

    return docs.mapInArrow(run, docs.schema)
