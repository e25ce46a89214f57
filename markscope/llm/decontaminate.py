"""Benchmark decontamination (op9): prefix-filtered set join of word windows, in
DataFrame operations only.

The windows of the benchmark items are the sets; their words are ordered by rarity in the
documents (exact counts). A window that is contained whole needs a prefix of one word, its
rarest. Document words meet those prefix words; the prefix word's place in the window gives
the only start at which that window can stand (positional bound), which must lie within
the document (length bound); there the words are compared exactly.

Document words never shuffle: they are exploded where they are read and joined with the
benchmark's prefix words, which are broadcast once their written and counted rows are
few, and joined by shuffle otherwise. Work behind that join follows the hits.

Results by case: null, empty and wordless texts have no words and are not contaminated; an
item of fewer words than a window, but not none, is one window; items without item_id or
words take no part; rows of one item_id are one item; rows equal in doc_id and text get
equal results; an empty table on either side is no special case; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from markscope.llm.common import BROADCAST_ROWS, Scratch, keyed_filter

WINDOW = 13
_NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text, case kept."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _NOT_WORD), "")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def _small(df: DataFrame) -> DataFrame:
    """``df`` (a written table), broadcast if its counted rows are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def benchmark_windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """item_id, win (words joined by blanks), len."""
    w = items.where("item_id IS NOT NULL").select("item_id", words(ascii_lower(F.col("text"))).alias("w")).where(
        F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1)))
    one = w.select("item_id", "w", F.explode(starts).alias("i")).select(
        "item_id", F.slice("w", F.col("i"), size).alias("g"))
    return one.select("item_id", F.array_join("g", " ").alias("win"), F.size("g").alias("len")).distinct()


def find_hits(docs: DataFrame, items: DataFrame, scratch: Scratch, size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(hits: doc_id, th, start, len, win; the benchmark's windows). ``th`` is the
    xxhash64 of the text; a hit is an occurrence of a window."""
    wins = scratch.save(benchmark_windows(items, size), "windows")
    rows = docs.select(F.col("doc_id"), F.xxhash64("text").alias("th"), words(F.col("text")).alias("w"))

    # lower() also folds other letters: both sides of a join use it, so it only adds
    # candidates; the comparison below is exact
    parts = wins.select("win", "len").distinct().select(
        "win", "len", F.posexplode(F.split("win", " ")).alias("off", "word")).withColumn("key", F.lower("word"))
    parts = scratch.save(parts.select("win", "len", "off", "key"), "window-words")
    vocabulary = scratch.save(parts.select("key").distinct(), "vocabulary")
    spoken = rows.select(F.explode("w").alias("word")).select(F.lower("word").alias("key"))
    counts = scratch.save(spoken.join(_small(vocabulary), "key").groupBy("key").agg(F.count("*").alias("n")), "counts")

    # a window with a word that no document has cannot occur
    rare = (parts.join(counts, "key", "left").groupBy("win", "len")
            .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key", "off")).alias("p"))
            .where("p.n > 0").selectExpr("p.key key", "p.off off", "len").distinct())
    prefix = scratch.save(rare, "prefixes")
    # only places travel with the words; the windows that can stand there are cut from the words of
    # the documents that have any, within each document's row
    places = rows.select("doc_id", "th", F.size("w").alias("n"), F.posexplode("w").alias("pos", "word")).select(
        "doc_id", "th", "n", "pos", F.lower("word").alias("key"))
    starts = (places.join(_small(prefix), "key").withColumn("start", F.col("pos") - F.col("off"))
              .where((F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.col("n")))
              .groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "len")).alias("starts")))
    starts = scratch.save(starts, "starts")
    # always by shuffle: a broadcast below some size would make the work jump as a corpus grows
    at = starts.selectExpr("doc_id d", "th t", "starts").hint("merge")
    both = docs.select("doc_id", F.xxhash64("text").alias("th"), "text").join(
        at, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")))
    # a document's words are cut once, then its windows
    cut = F.transform(F.array(words(F.col("text"))), lambda w: F.transform("starts", lambda x: F.struct(
        x["start"].alias("start"), x["len"].alias("len"),
        ascii_lower(F.array_join(F.slice(w, x["start"] + 1, x["len"]), " ")).alias("win"))))[0]
    met = both.select("doc_id", "th", F.explode(cut).alias("x")).select("doc_id", "th", "x.*")
    known = scratch.save(wins.select("win", "len").distinct(), "distinct-windows")
    hits = scratch.save(met.join(_small(known), ["win", "len"]).distinct(), "hits")
    return hits, wins


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, times: int = 20,
                  scratch: Scratch | None = None) -> DataFrame:
    """One row per document: doc_id, th, n_words, n_hit, n_items, items_sha256,
    contaminated (n_hit > 0 and times * n_hit >= n_words)."""
    scratch = scratch or Scratch(docs.sparkSession, "decontaminate")
    hits, wins = find_hits(docs, items, scratch, size)
    # words inside the union of the occurrences: each adds what lies behind those before it
    before = (Window.partitionBy("doc_id", "th").orderBy("start", "len")
              .rowsBetween(Window.unboundedPreceding, -1))
    end = F.col("start") + F.col("len")
    covered = (hits.select("doc_id", "th", "start", "len").distinct()
               .withColumn("reach", F.coalesce(F.max(end).over(before), F.lit(0)))
               .groupBy("doc_id", "th").agg(
                   F.sum(F.greatest(F.lit(0), end - F.greatest("start", "reach"))).alias("n_hit")))
    of = (hits.select("doc_id", "th", "win").distinct().join(wins.select("win", "item_id"), "win")
          .groupBy("doc_id", "th").agg(F.collect_set(F.col("item_id").cast("string")).alias("ids")))
    found = covered.join(of, covered["doc_id"].eqNullSafe(of["doc_id"]) & (covered["th"] == of["th"])).select(
        covered["doc_id"].alias("__id"), covered["th"].alias("__th"), "n_hit", F.size("ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("ids"), ","), 256).alias("sha"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"),
                       F.size(words(F.col("text"))).cast("long").alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return (rows.join(found, rows["doc_id"].eqNullSafe(F.col("__id")) & (rows["th"] == F.col("__th")), "left")
            .select("doc_id", "th", "n_words", n_hit.alias("n_hit"),
                    F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
                    F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("items_sha256"),
                    ((n_hit > 0) & (n_hit * times >= F.col("n_words"))).alias("contaminated")))


def drop_contaminated(docs: DataFrame, items: DataFrame, size: int = WINDOW, times: int = 20) -> DataFrame:
    """``docs`` (all columns) without its contaminated rows."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    bad = scratch.save(contamination(docs, items, size, times, scratch).where("contaminated")
                       .selectExpr("doc_id __ms_id", "th __ms_th").distinct(), "contaminated")
    tagged = docs.withColumn("__ms_id", F.col("doc_id")).withColumn("__ms_th", F.xxhash64("text"))
    return keyed_filter(tagged, bad, ["__ms_id", "__ms_th"], "left_anti").drop("__ms_id", "__ms_th")


#: DuckDB SQL for the contract's columns.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 13) AS size, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g
        FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) t(i) WHERE len(w) > 0),
dg AS (SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS g
       FROM (SELECT doc_id, w, size FROM d, (SELECT DISTINCT size FROM win) s) x, unnest(range(1, len(w) - size + 2)) t(i)),
hit AS (SELECT DISTINCT doc_id, i, dg.size, dg.g FROM dg JOIN (SELECT DISTINCT g, size FROM win) k
        ON dg.g = k.g AND dg.size = k.size),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + size)) t(p) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(id, ',' ORDER BY id)) AS sha
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit JOIN win USING (g)) x GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(sha, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN items USING (doc_id)
"""
