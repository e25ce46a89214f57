"""Phrase collocation mining (op11): Misra-Gries summaries per hash partition, then exact counts.

Texts become runs of words between separators; every n-gram inside a run is a 64-bit hash of its
words and its language. The hash space is dealt into partitions, whose number follows the size of
the corpus:

1. Each task counts its n-grams exactly in blocks of bounded size: a block's counts, split by
   partition, are summaries without any loss. They are sent to their partition as packed arrays
   of 32-bit remainders and counts (about five bytes an n-gram).
2. A partition first learns its mass from the blocks' headers, then merges the summaries with a
   capacity of more than mass / threshold counters: sums, less the largest count that does not fit.
   What is subtracted in all stays below the threshold, so an n-gram with ``threshold``
   occurrences survives; whatever has counter + subtracted < threshold goes.
3. The survivors become a bitmap of bounded size (``BITMAP_BITS`` at most, 32 MB), the only thing
   broadcast. The second pass counts exactly, by text, every n-gram whose bit is set. Other
   n-grams that share a bit only add rows, which the exact threshold then drops.

Hashes only choose what is counted: counts are kept by (language, phrase). (Within one
task's block of at most ``BLOCK`` phrases, two texts would have to share all 64 bits to be mixed up.)

Results by case: null and empty texts have no words; a null lang is ``und``; long texts are cut at
separators into slices of bounded size; repeated rows count each; ties rank by phrase; an empty
table has no rows; other columns are ignored. Scores are integers, computed in decimals of 38 digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from markscope.llm.common import Scratch, ship
from markscope.llm.shingles import mixed
from markscope.llm.slabs import SLICE_BYTES, slices

#: n-grams that a partition of the hash space holds on average.
PARTITION_MASS = 4_000_000
#: n-grams counted at once in the first pass, and entries of one packed row.
BLOCK, PACK = 2_000_000, 512
#: Phrases that a task of the second pass holds before it sends them on.
HELD = 200_000
#: Entries a partition gathers before it merges them into its summary.
MERGE = 1_000_000
#: Size limit of the broadcast bitmap (2**28 bits: 32 MB) and its bits per survivor below that.
BITMAP_BITS, BITS_EACH = 1 << 28, 16

_SEPARATORS = b".,;:!?\n\x0b\x0c\r"
# separators become line feeds, tabs blanks, A-Z lower case
_FOLD = bytes(10 if c in _SEPARATORS else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64))
_PLACE = mixed(np.arange(1000, 1064, dtype=np.uint64)) | np.uint64(1)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


class Slice:
    """Words of some texts: their bytes, places, run numbers and hashes."""

    def __init__(self, texts: list[bytes], salts: list[int]):
        self.raw = b"\n".join(texts)
        b = np.frombuffer(self.raw, np.uint8)
        inside = np.concatenate([[0], ((b != 32) & (b != 10)).view(np.int8), [0]])
        edge = np.diff(inside)
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.run = np.cumsum(b == 10)[self.starts] if len(b) else self.starts
        begins = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
        self.text = np.searchsorted(begins, self.starts, "right") - 1
        power, inverse = _powers(1 << max(len(b), SLICE_BYTES).bit_length())
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[b] * power[:len(b)], dtype=np.uint64)])
        self.words = mixed((sums[self.ends] - sums[self.starts]) * inverse[self.starts])
        self.salts = np.array(salts, np.uint64)[self.text] if len(self.text) else np.zeros(0, np.uint64)

    def keys(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, key) of every run of n words."""
        last = len(self.words) - n + 1
        if last <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.run[:last] == self.run[n - 1:])
        h = self.salts[at] * _PLACE[63] + np.uint64(n)
        for j in range(n):
            h = h + self.words[at + j] * _PLACE[j]
        return at, mixed(h)

    def phrase(self, at: int, n: int) -> str:
        got = self.raw[self.starts[at]:self.ends[at + n - 1]]
        return b" ".join(got.split()).decode("utf-8", "replace") if n > 1 else got.decode("utf-8", "replace")


def _bounded(text: bytes) -> Iterator[bytes]:
    """A folded text in parts of about a slice, cut at separators."""
    at = 0
    while len(text) - at > SLICE_BYTES:
        cut = text.rfind(b"\n", at, at + SLICE_BYTES)
        cut = cut if cut > at else text.find(b"\n", at + SLICE_BYTES)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def word_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Slice, list[str]]]:
    """(slice, languages of its texts) of rows (lang, text)."""
    salts: dict[str, int] = {}
    for b in slices(batches, "text"):
        texts: list[bytes] = []
        langs: list[str] = []
        held = 0
        for lang, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
            if lang not in salts:
                salts[lang] = xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"))
            for part in _bounded((t or b"").translate(_FOLD)):
                if texts and held + len(part) > SLICE_BYTES:
                    yield Slice(texts, [salts[x] for x in langs]), langs
                    texts, langs, held = [], [], 0
                texts.append(part)
                langs.append(lang)
                held += len(part)
        if texts:
            yield Slice(texts, [salts[x] for x in langs]), langs


def partition_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Partition of each key, ascending with the key; its other half tells keys of one apart."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def block_summaries(keys: np.ndarray, parts: int) -> pa.RecordBatch:
    """Exact counts of a block as rows: kind 0 tells a partition's mass, kind 1 holds packed
    remainders and counts."""
    uniq, n = np.unique(keys, return_counts=True)
    part = partition_of(uniq, parts)
    cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else part
    rows: list[tuple] = []
    low = (uniq & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    n32 = n.astype(np.uint32)
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(part)]):
        p = int(part[a])
        rows.append((p, 0, int(n[a:b].sum()), b"", b""))
        rows += [(p, 1, 0, low[i:min(i + PACK, b)].tobytes(), n32[i:min(i + PACK, b)].tobytes())
                 for i in range(a, b, PACK)]
    cols = list(zip(*rows)) if rows else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (
        pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["part", "kind", "mass", "low", "n"])


class MisraGries:
    """At most ``capacity`` counters; ``taken`` is what was subtracted from each true count at most."""

    def __init__(self, capacity: int):
        self.capacity, self.taken = capacity, 0
        self.keys, self.n = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def merge(self, keys: np.ndarray, n: np.ndarray) -> None:
        keys, n = np.concatenate([self.keys, keys]), np.concatenate([self.n, n])
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else order
        self.keys, self.n = keys[first], np.add.reduceat(n, first) if len(first) else n
        if len(first) > self.capacity:
            over = len(first) - self.capacity
            cut = int(np.partition(self.n, over - 1)[over - 1])  # the largest count that does not fit
            keep = self.n > cut
            self.keys, self.n = self.keys[keep], self.n[keep] - cut
            self.taken += cut

    def frequent(self, threshold: int) -> np.ndarray:
        """All keys that can have ``threshold`` occurrences."""
        return self.keys[self.n + self.taken >= threshold]


def merged_summaries(rows: DataFrame, threshold: int) -> DataFrame:
    """part, low: the survivors of every partition, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import groupby
        stream = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        for part, group in groupby(stream, key=lambda r: r[0]):
            mass, summary, low, n, held = 0, None, [], [], 0
            for _, kind, m, packed, counts in group:
                if not kind:
                    mass += m
                    continue
                # more than mass / threshold; twice that keeps fewer infrequent ones in the end
                summary = summary or MisraGries(2 * mass // threshold + 1)
                low.append(packed)
                n.append(counts)
                held += len(packed) // 4
                if held >= MERGE:
                    summary.merge(np.frombuffer(b"".join(low), np.uint32), np.frombuffer(b"".join(n), np.uint32).astype(np.int64))
                    low, n, held = [], [], 0
            if held:
                summary.merge(np.frombuffer(b"".join(low), np.uint32), np.frombuffer(b"".join(n), np.uint32).astype(np.int64))
            found = summary.frequent(threshold)
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([found.tobytes()], pa.binary())],
                                                 names=["part", "low"])

    return (rows.repartition("part").sortWithinPartitions("part", "kind")
            .mapInArrow(run, "part long, low binary"))


def survivors(docs: DataFrame, longest: int, threshold: int, parts: int) -> DataFrame:
    """First pass over ``docs`` (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        held = 0
        for s, _ in word_slices(batches):
            for k in range(1, longest + 1):
                keys.append(s.keys(k)[1])
                held += len(keys[-1])
            if held >= BLOCK:
                yield block_summaries(np.concatenate(keys), parts)
                keys, held = [], 0
        if held:
            yield block_summaries(np.concatenate(keys), parts)

    rows = docs.mapInArrow(run, "part long, kind int, mass long, low binary, n binary")
    return merged_summaries(rows, threshold)


def survivor_bitmap(found: DataFrame, parts: int) -> tuple[np.ndarray, int]:
    """(packed bitmap, bits per partition): each partition's survivors in its own segment."""
    total = (found.agg(F.sum(F.octet_length("low"))).first()[0] or 0) // 4
    each = 1 << max(BITS_EACH * total // parts, 8).bit_length()
    while each > 8 and each * parts > BITMAP_BITS:
        each //= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for low in b.column("low").to_pylist():
                bits = np.zeros(each, np.uint8)
                bits[np.frombuffer(low, np.uint32) & np.uint32(each - 1)] = 1
                out.append(np.packbits(bits).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("part"), pa.array(out, pa.binary())], names=["part", "bits"])

    bitmap = np.zeros(parts * each // 8, np.uint8)
    for r in found.mapInArrow(run, "part long, bits binary").toLocalIterator():  # BITMAP_BITS in all
        bitmap[r.part * each // 8:(r.part + 1) * each // 8] = np.frombuffer(r.bits, np.uint8)
    return bitmap, each


def exact_counts(docs: DataFrame, longest: int, threshold: int, bitmap: np.ndarray, each: int, parts: int) -> DataFrame:
    """Second pass: lang, words, phrase, n for phrases with at least ``threshold`` occurrences
    (words 0: all words of the language)."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        totals: dict[str, int] = {}
        held: dict[tuple[int, int], list] = {}

        def rows() -> pa.RecordBatch:
            out = [(lang, k[0], phrase, n) for k, (n, phrase, lang) in held.items()]
            out += [(lang, 0, "", n) for lang, n in totals.items()]
            held.clear(), totals.clear()
            cols = list(zip(*out)) if out else [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (
                pa.string(), pa.int32(), pa.string(), pa.int64()))], names=["lang", "words", "phrase", "n"])

        for s, langs in word_slices(batches):
            for i, n in enumerate(np.bincount(s.text, minlength=len(langs)).tolist()):
                totals[langs[i]] = totals.get(langs[i], 0) + n
            for k in range(1, longest + 1):
                at, keys = s.keys(k)
                place = partition_of(keys, parts) * each + (keys & np.uint64(each - 1)).astype(np.int64)
                hit = np.flatnonzero((bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1)
                uniq, first, n = np.unique(keys[hit], return_index=True, return_counts=True)
                where = at[hit][first]
                for key, i, m, t in zip(uniq.tolist(), where.tolist(), n.tolist(), s.text[where].tolist()):
                    entry = held.get((k, key))
                    if entry is None:
                        held[(k, key)] = [m, s.phrase(i, k), langs[t]]
                    else:
                        entry[0] += m
            if len(held) >= HELD:
                yield rows()
        yield rows()

    return (docs.mapInArrow(run, "lang string, words int, phrase string, n long")
            .groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"))
            .where((F.col("words") == 0) | (F.col("n") >= threshold)))


def phrase_counts(docs: DataFrame, longest: int, threshold: int, scratch: Scratch) -> DataFrame:
    """Exact counts of all phrases of 1 to ``longest`` words with at least ``threshold`` occurrences."""
    ship(docs.sparkSession)
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(1, size * longest // 6 // PARTITION_MASS)  # a word and its blank take some six bytes
    found = scratch.save(survivors(rows, longest, threshold, parts), "survivors")
    bitmap, each = survivor_bitmap(found, parts)
    return scratch.save(exact_counts(rows, longest, threshold, bitmap, each, parts), "phrase-counts")


def collocations(docs: DataFrame, longest: int = 3, threshold: int = 10, top: int = 2000, absorb: int = 50,
                 scratch: Scratch | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases of 2 to ``longest`` words
    by the score of their weakest cut, floor(1000000 * a * a / (l * r)). A phrase inside a longer
    candidate with at least ``absorb`` percent of its occurrences is left out."""
    if longest < 2 or threshold < 1:
        raise ValueError("longest >= 2 and threshold >= 1 are needed")
    scratch = scratch or Scratch(docs.sparkSession, "collocations")
    counts = phrase_counts(docs, longest, threshold, scratch)
    known = counts.where("words > 0").select("lang", "phrase", "n")
    wide = counts.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))

    def part(first, length):
        return F.array_join(F.slice("w", first, length), " ")

    k = F.col("k")
    cuts = wide.select("lang", "phrase", "words", "a", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), k).alias("left"),
                       part(k + 1, F.col("words") - k).alias("right"))
    cuts = (cuts.join(known.selectExpr("lang", "phrase left", "n l"), ["lang", "left"])
            .join(known.selectExpr("lang", "phrase right", "n r"), ["lang", "right"]))
    big = "cast(a as decimal(38,0)) * a * 1000000 div (cast(l as decimal(38,0)) * r)"
    scored = (cuts.groupBy("lang", "phrase", "a")
              .agg(F.min(F.struct(F.expr(big).alias("score"), "k", "l", "r")).alias("cut")))
    # contiguous shorter phrases of at least two words inside every candidate
    inner = wide.where("words > 2").select("a", "lang", "words", "w", F.explode(
        F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    inner = inner.select("a", "lang", "w", "size", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("at"))
    inner = (inner.select("lang", part(F.col("at"), F.col("size")).alias("phrase"), "a")
             .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
    kept = (scored.join(inner, ["lang", "phrase"], "left")
            .where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * absorb))
            .select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"))
    # the best of every language, first within slices of it, so that no task sorts a whole language
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = kept.withColumn("s", F.pmod(F.xxhash64("phrase"), F.lit(min(width, 64))))
    best = (share.withColumn("i", F.row_number().over(Window.partitionBy("lang", "s").orderBy(*order)))
            .where(F.col("i") <= top).drop("s", "i"))
    ranked = (best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
              .where(F.col("rank") <= top))
    totals = counts.where("words = 0").select("lang", "n")  # one row per language
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: DuckDB SQL of the contract.
ORACLE = r"""
WITH runs AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(p, '[^\x20\x09]+') AS w
              FROM documents, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) u(p)),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM runs GROUP BY lang),
grams AS (SELECT lang, 1 AS k, unnest(w) AS p FROM runs
          UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM runs
          UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1),
                           lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM runs),
counts AS MATERIALIZED (SELECT lang, k, p, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 10),
wide AS (SELECT lang, k, p, f AS a, string_split(p, ' ') AS w FROM counts WHERE k > 1),
places AS (SELECT lang, p, a, 1 AS j, w[1] AS x, array_to_string(w[2:], ' ') AS y FROM wide
           UNION ALL SELECT lang, p, a, 2, w[1] || ' ' || w[2], w[3] FROM wide WHERE k = 3),
cuts AS (SELECT c.lang, c.p, c.a, min({'score': (1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f), 'j': j,
                'l': l.f, 'r': r.f}) AS cut
         FROM places c JOIN counts l ON l.lang = c.lang AND l.p = c.x JOIN counts r ON r.lang = c.lang AND r.p = c.y
         GROUP BY ALL),
inner_phrases AS (SELECT lang, p, max(a) AS longer FROM (
           SELECT lang, w[1] || ' ' || w[2] AS p, a FROM wide WHERE k = 3
           UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM wide WHERE k = 3) i GROUP BY ALL),
kept AS (SELECT lang, p AS phrase, a, cut.l AS l, cut.r AS r, CAST(cut.score AS BIGINT) AS score
         FROM cuts LEFT JOIN inner_phrases USING (lang, p) WHERE longer IS NULL OR 100 * longer < 50 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
