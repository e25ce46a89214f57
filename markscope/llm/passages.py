"""Substring deduplication (op4): paragraphs and passages that repeat across documents.

Paragraphs (lines of at least ``min_words`` words) become sets of word shingles. MinHash
banding (BANDS x ROWS, tuned for recall: a pair at 0.8 meets with probability 0.9994) finds
colliding paragraphs; colliding ones are read again in full and verified by exact Jaccard
in the grouped prefix join, and components cluster them. The first paragraph of a cluster
(smallest doc_id) stays, the others go.

Repeated passages need not be whole paragraphs: they stand inside longer ones at any
offset, where paragraph sets do not meet. So passages of ``min_words`` or more equal words
are found as well: the least of each ANCHOR_RANGE consecutive hashes of ANCHOR_WORDS words is
an anchor, and any equal run of min_words words holds a common anchor; around anchors
that two documents share, every window of min_words words is compared, and windows that
stand in an earlier document go. Texts that equal an earlier one go whole.

No pairs are made: groupings by hash keep the first document of each, hot or not.

Results by case: null, empty and short texts are left as they are; repetition inside one
document is left alone; a null doc_id comes last; rows equal in doc_id and text are one
document; an empty table gives no row; other columns are ignored; letter case (A-Z) and
the kind of white space between words don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markscope.llm.common import Scratch, keyed_filter, ship
from markscope.llm.ngram_join import _lists
from markscope.llm.setjoin import linked_components
from markscope.llm.slabs import bounded
from markscope.llm.shingles import mixed, window_hashes, word_hashes

MIN_WORDS = 50
ANCHOR_WORDS = 30
BANDS, ROWS = 14, 4
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_PERM = np.random.default_rng(20).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def word_places(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word, and the byte behind it."""
    inside = np.concatenate(([False], ~_SPACE[np.frombuffer(raw, np.uint8)], [False]))
    edge = np.diff(inside.astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


class Text:
    """A text's words: hashes and the lines they stand in."""

    def __init__(self, text: str | None):
        raw = (text or "").encode("utf-8", "surrogatepass")
        self.hashes = word_hashes(raw.lower().split())
        self.n = len(self.hashes)
        self.lines: list[tuple[int, int]] = []  # first word, words
        if self.n >= MIN_WORDS:
            starts, _ = word_places(raw)
            line = np.searchsorted(np.flatnonzero(np.frombuffer(raw, np.uint8) == 10), starts)
            first = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
            self.lines = list(zip(first.tolist(), np.diff(np.r_[first, self.n]).tolist()))

    def paragraphs(self, min_words: int, k: int) -> list[tuple[int, int, np.ndarray]]:
        return [(a, n, np.unique(window_hashes(self.hashes[a:a + n], k))) for a, n in self.lines if n >= min_words]


def anchors(h: np.ndarray, min_words: int) -> np.ndarray:
    """Starts of the anchors among windows with hashes ``h``."""
    span = min_words - ANCHOR_WORDS + 1
    if len(h) < span:
        return np.zeros(0, np.int64)
    least = np.lib.stride_tricks.sliding_window_view(h, span).argmin(axis=1)
    return np.unique(least + np.arange(len(least)))


def bands(sets: list[np.ndarray]) -> np.ndarray:
    """One hash per band of the MinHash of each set (none is empty)."""
    key = np.zeros((len(sets), BANDS), np.uint64)
    if sets:
        flat = np.concatenate(sets)
        starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
        for i, p in enumerate(_PERM):  # an odd multiple permutes the hashes
            key[:, i // ROWS] = mixed(key[:, i // ROWS] ^ np.minimum.reduceat(flat * p, starts))
    return (key + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


_PARA = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32()), ("fp", pa.binary()), ("n", pa.int64()),
                            ("bands", pa.list_(pa.int64()))]))
_READ = ("doc_id long, th long, n_words long, hashes array<bigint>, places array<int>, "
         "paras array<struct<start: int, words: int, fp: binary, n: bigint, bands: array<bigint>>>")


def _places(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0] + [len(r) for r in rows])
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(np.int32)))


def _reader(min_words: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, "text"):
            n, hashes, places, found = [], [], [], []
            for t in b.column("text"):
                x = Text(t.as_py())
                n.append(x.n)
                if x.n < min_words:
                    hashes.append(np.zeros(0, np.uint64)), places.append(np.zeros(0, np.int64)), found.append([])
                    continue
                h = window_hashes(x.hashes, ANCHOR_WORDS)
                at = anchors(h, min_words)
                hashes.append(h[at])
                places.append(at)
                found.append(x.paragraphs(min_words, k))
            keys = iter(bands([s for f in found for _, _, s in f]).tolist())
            paras = [[{"start": a, "words": m, "fp": hashlib.md5(s.tobytes()).digest(), "n": len(s), "bands": next(keys)}
                      for a, m, s in f] for f in found]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("th"), pa.array(n, pa.int64()), _lists(hashes), _places(places),
                 pa.array(paras, _PARA)],
                names=["doc_id", "th", "n_words", "hashes", "places", "paras"])
    return run


def _windows(min_words: int):
    """Hashes and starts of all windows that hold one of the given anchors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = np.arange(min_words - ANCHOR_WORDS + 1)
        for b in bounded(batches, "text"):
            hashes, places = [], []
            for t, near in zip(b.column("text"), b.column("near")):
                h = window_hashes(Text(t.as_py()).hashes, min_words)
                at = np.unique(np.asarray(near.values.to_numpy(), np.int64)[:, None] - back)
                at = at[(at >= 0) & (at < len(h))]
                hashes.append(h[at])
                places.append(at)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("th"), _lists(hashes), _places(places)], names=["doc_id", "th", "hashes", "places"])
    return run


def _paragraph_sets(min_words: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, "text"):
            sets = [s for t in b.column("text") for _, _, s in Text(t.as_py()).paragraphs(min_words, k)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([hashlib.md5(s.tobytes()).digest() for s in sets], pa.binary()),
                 pa.array([len(s) for s in sets], pa.int64()), _lists(sets)], names=["fp", "n", "toks"])
    return run


def _key() -> Column:
    """Order of documents: the first keeps what repeats."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("th"))


def _elsewhere(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows whose group by ``by`` has its first row in an earlier document."""
    first = (rows.groupBy(*by).agg(F.min(_key()).alias("first"), F.max(_key()).alias("last"))
             .where("first <> last").drop("last"))
    return rows.join(first, by).where(_key() != F.col("first")).drop("first")


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, k: int = 5, threshold: Fraction = Fraction(8, 10),
                   scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, th, n_words of every distinct document; doc_id, th and spans: sorted,
    disjoint (start, length) in words of what repeats an earlier document)."""
    spark = docs.sparkSession
    ship(spark)
    scratch = scratch or Scratch(spark, "passages")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    keys = scratch.save(rows.select("doc_id", "th", F.length("text").alias("chars")), "keys").where("chars >= 2")
    # whole texts: the first of each stays
    copies = scratch.save(_elsewhere(keys.select("doc_id", "th", "chars").distinct(), ["th", "chars"])
                          .select("doc_id", "th"), "copies")
    read = scratch.save(rows.mapInArrow(_reader(min_words, k), _READ), "anchors")
    own = keyed_filter(read, copies, ["doc_id", "th"], "left_anti")

    # passages
    spot = own.select("doc_id", "th", F.explode(F.arrays_zip("hashes", "places")).alias("x")).select(
        "doc_id", "th", F.col("x.hashes").alias("h"), F.col("x.places").alias("place"))
    common = spot.groupBy("h").agg(F.min(_key()).alias("a"), F.max(_key()).alias("b")).where("a <> b").select("h")
    near = scratch.save(spot.join(common, "h", "left_semi").groupBy("doc_id", "th")
                        .agg(F.array_sort(F.collect_set("place")).alias("near")), "near")
    some = keyed_filter(rows, near.select("doc_id", "th"), ["doc_id", "th"], "left_semi").dropDuplicates(["doc_id", "th"])
    with_near = some.join(near.selectExpr("doc_id d", "th t", "near"),
                          F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")))
    windows = scratch.save(with_near.select("doc_id", "th", "text", "near").mapInArrow(
        _windows(min_words), "doc_id long, th long, hashes array<bigint>, places array<int>"), "windows")
    each = windows.select("doc_id", "th", F.explode(F.arrays_zip("hashes", "places")).alias("x")).select(
        "doc_id", "th", F.col("x.hashes").alias("h"), F.col("x.places").alias("start"))
    passages = _elsewhere(each, ["h"]).select("doc_id", "th", "start", F.lit(min_words).alias("words"))

    # paragraphs
    para = scratch.save(own.select("doc_id", "th", F.explode("paras").alias("p")).select("doc_id", "th", "p.*"), "paragraphs")
    kinds = scratch.save(para.groupBy("fp").agg(F.min(_key()).alias("rep"), F.first("bands").alias("bands"))
                         .withColumn("cid", F.monotonically_increasing_id()), "kinds")
    banded = kinds.select("cid", F.explode("bands").alias("h"))
    meet = banded.groupBy("h").agg(F.min("cid").alias("a"), F.max("cid").alias("b")).where("a <> b").select("h")
    cids = scratch.save(banded.join(meet, "h", "left_semi").select("cid").distinct(), "colliding")
    chosen = scratch.save(keyed_filter(kinds.select("cid", "fp", "rep"), cids, ["cid"], "left_semi")
                          .select("cid", "fp", "rep.doc_id", "rep.th"), "chosen")
    full = keyed_filter(rows, chosen, ["doc_id", "th"], "left_semi").mapInArrow(
        _paragraph_sets(min_words, k), "fp binary, n long, toks array<bigint>")
    sets = scratch.save(full.join(chosen.select("fp", "cid"), "fp").dropDuplicates(["cid"]).select("cid", "n", "toks"), "sets")
    comp = linked_components(sets, threshold, scratch)
    label = kinds.select("fp", "cid").join(comp, F.col("cid") == F.col("id"), "left").select(
        "fp", F.coalesce("comp", "cid").alias("comp"))
    paragraphs = _elsewhere(para.join(label, "fp").select("doc_id", "th", "start", "words", "comp"), ["comp"]).drop("comp")

    whole = keyed_filter(read, copies, ["doc_id", "th"], "left_semi").where(F.col("n_words") >= min_words).select(
        "doc_id", "th", F.lit(0).alias("start"), F.col("n_words").cast("int").alias("words"))
    spans = merged(passages.unionByName(paragraphs).unionByName(whole))
    return read.select("doc_id", "th", "n_words").distinct(), scratch.save(spans, "spans")


def merged(spans: DataFrame) -> DataFrame:
    """doc_id, th and their sorted, disjoint spans, from rows of (start, words)."""
    w = Window.partitionBy("doc_id", "th").orderBy("start", "words")
    end = F.col("start") + F.col("words")
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = (spans.withColumn("new", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int"))
               .withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
               .groupBy("doc_id", "th", "island").agg(F.min("start").alias("start"), F.max(end).alias("stop")))
    return islands.groupBy("doc_id", "th").agg(F.array_sort(F.collect_list(F.struct(
        "start", (F.col("stop") - F.col("start")).alias("words")))).alias("spans"))


def cut_text(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and the white space behind them."""
    raw = text.encode("utf-8", "surrogatepass")
    starts, _ = word_places(raw)
    out, at = [], 0
    for first, n in sorted(spans):
        if first >= len(starts):
            break
        out.append(raw[at:starts[first]])
        at = int(starts[first + n]) if first + n < len(starts) else len(raw)
    out.append(raw[at:])
    kept = b"".join(out)
    return (kept.rstrip() if at == len(raw) else kept).decode("utf-8", "surrogatepass")


def drop_repeats(docs: DataFrame, min_words: int = MIN_WORDS, k: int = 5,
                 threshold: Fraction = Fraction(8, 10)) -> DataFrame:
    """``docs`` (all columns) without repeated spans in their texts; a document whose words
    all repeat goes; n_chars follows the new text; other documents stay as they are."""
    spark = docs.sparkSession
    with Scratch(spark, "passages-steps") as steps:
        _, spans = repeated_spans(docs, min_words, k, threshold, steps)
        spans = Scratch(spark, "passages").save(
            spans.selectExpr("doc_id __ms_id", "th __ms_th", "spans __ms_spans"), "cuts")
    tagged = docs.withColumn("__ms_h", F.xxhash64("text"))
    both = tagged.join(spans, tagged["doc_id"].cast("long").eqNullSafe(F.col("__ms_id")) & (F.col("__ms_h") == F.col("__ms_th")),
                       "left").drop("__ms_id", "__ms_th", "__ms_h")
    text_at, chars_at = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = b.column("__ms_spans").to_pylist()
            cols = [b.column(i) for i in range(b.num_columns - 1)]
            keep = [True] * len(spans)
            if any(spans):
                texts = cols[text_at].to_pylist()
                size = [None] * len(spans) if chars_at is None else cols[chars_at].to_pylist()
                for i, s in enumerate(spans):
                    if s:
                        texts[i] = cut_text(texts[i], [(x["start"], x["words"]) for x in s])
                        size[i] = len(texts[i])
                        keep[i] = bool(texts[i].strip())
                cols[text_at] = pa.array(texts, pa.string())
                if chars_at is not None:
                    cols[chars_at] = pa.array(size, cols[chars_at].type)
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names[:-1]).filter(pa.array(keep))

    return both.mapInArrow(run, docs.schema)


def repeats_by_document(docs: DataFrame, min_words: int = MIN_WORDS, k: int = 5,
                        threshold: Fraction = Fraction(8, 10)) -> DataFrame:
    """One row per distinct document: doc_id, n_words, n_removed, spans (start, words)."""
    words, spans = repeated_spans(docs, min_words, k, threshold)
    s = spans.selectExpr("doc_id d", "th t", "spans")
    return (words.join(s, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left")
            .select("doc_id", "n_words",
                    F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["words"]),
                               F.lit(0).cast("long")).alias("n_removed"), "spans"))
