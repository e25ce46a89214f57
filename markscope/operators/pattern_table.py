"""P4 / F9 with the patterns as a table of any size.

A table of at most TABLE_ROWS distinct patterns goes to the tasks: each line is searched where it
is, in its bytes (``functions.literals``). Only the text goes to Python and only matching
lines leave, in even partitions by their key columns.

A larger table is met by equi joins. Every pattern is indexed by one of its character n-grams (three
characters; shorter patterns by themselves): the one that stands least often in the lines, counted
for the patterns' n-grams alone. Lines are cut into windows of bounded length (overlapping by the
longest pattern) that meet the index by an equi join on their n-grams: it names the only place where
a pattern could stand around its n-gram, and the text there is compared at once. The occurrences of
a line are then chosen greedily from left to right (the one that ends first, the longest on ties), as
P4 does. So the work follows the n-grams of the lines and the candidates, not lines times patterns.
A line is known by its key columns and a hash of its text. With an index that can be broadcast only
occurrences are shuffled, and beside them the keys of the lines: no text, and no candidate that
fails. A larger index meets the n-grams without their windows, which its candidates look up.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markscope.functions.literals import Literals
from markscope.functions.positions import folded, let
from markscope.session import broadcast_if_small, carried

carried("markscope.functions.literals", __name__)

GRAM = 3
#: Characters of a window (at least the longest pattern's length): bounds the work for one place.
WINDOW = 128
#: A table of at most so many distinct patterns and bytes of them goes to the tasks.
TABLE_ROWS = 1_000_000
TABLE_BYTES = 16 << 20
#: Size of one Arrow batch of lines, where the session sets none.
BATCH_BYTES = 4 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _grams(text: Column, n: int) -> Column:
    """The n-grams of every place of a text, in order (an array; a place is its index).
    One regex pass; texts with characters of two UTF-16 units are cut by characters."""
    one_pass = F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{n}}}))"), 1)
    by_chars = let(_chars(text), lambda c: F.transform(
        F.sequence(F.lit(0), F.size(c) - n), lambda i: F.concat(*[F.element_at(c, i + 1 + j) for j in range(n)])))
    none = F.array().cast("array<string>")
    return F.when(F.length(text) < n, none).when(text.rlike(r"[\x{10000}-\x{10FFFF}]"), by_chars).otherwise(one_pass)


def _pieces(text: Column, step: int, width: int) -> Column:
    """The ``width`` characters (fewer at the end) from every ``step``-th character on; width >= step.
    One regex pass; texts with characters of two UTF-16 units are cut by characters."""
    one_pass = F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{1,{width}}})).{{1,{step}}}"), 1)
    by_chars = let(_chars(text), lambda c: F.transform(
        F.sequence(F.lit(0), F.floor((F.size(c) - 1) / step).cast("int")),
        lambda i: F.array_join(F.slice(c, i * step + 1, width), "")))
    return F.when(text.rlike(r"[\x{10000}-\x{10FFFF}]"), by_chars).otherwise(one_pass)


def _windows(lines: DataFrame, key: list[str], step: int, longest: int) -> DataFrame:
    """key, _window (its number; it begins at character ``step`` times that), _text, _byte (where
    it begins): an occurrence of a pattern lies whole in the window where it begins."""
    text = F.col("_text")
    begins = folded(_pieces(text, step, step), F.lit(0).cast("bigint"), lambda o, c: o + F.octet_length(c), lambda o, c: o)
    cut = let(begins, lambda b: F.transform(_pieces(text, step, step + longest - 1), lambda w, i: F.struct(
        w.alias("_text"), F.get(b, i).alias("_byte"))))
    whole = F.array(F.struct(text.alias("_text"), F.lit(0).cast("bigint").alias("_byte")))
    own = lines.select(*key, F.when(F.length(text) <= step, whole).otherwise(cut).alias("_w"))
    return own.select(*key, F.posexplode("_w").alias("_window", "_w")).select(*key, "_window", "_w.*")


def _window_grams(windows: DataFrame, keep: list[str], sizes: list[int]) -> DataFrame:
    """``keep`` columns, at (its place in the window), gram for n-grams of the given sizes."""
    out = None
    for n in sizes:
        own = (windows.where(F.length("_text") >= n)
               .select("*", F.explode(F.sequence(F.lit(0), F.length("_text") - n)).alias("at"))
               .select(*keep, "at", F.substring("_text", F.col("at") + 1, F.lit(n)).alias("gram")))
        out = own if out is None else out.unionByName(own)
    return out


def pattern_index(lines: DataFrame, patterns: DataFrame, sizes: list[int]) -> DataFrame:
    """pattern, n (characters), gram, off (its place in the pattern): one row per distinct pattern.
    ``lines`` has the text in ``_text``, ``patterns`` in ``pattern``; ``sizes`` as of ``_sizes``."""
    p = patterns.where("pattern <> ''").select("pattern").distinct().withColumn("n", F.length("pattern"))
    grams = None
    for n in sizes:
        own = p.where(F.least(F.col("n"), F.lit(GRAM)) == n).select(
            "pattern", "n", F.posexplode(_grams(F.col("pattern"), n)).alias("at", "gram"))
        grams = own if grams is None else grams.unionByName(own)
    wanted = broadcast_if_small(grams.select("gram").distinct())
    once = _window_grams(_windows(lines, [], WINDOW, GRAM), [], sizes).where(F.col("at") < WINDOW)
    seen = once.join(wanted, "gram").groupBy("gram").agg(F.count("*").alias("_k"))
    best = F.min(F.struct(F.coalesce("_k", F.lit(0)).alias("k"), "gram", "at"))
    return (grams.join(seen, "gram", "left").groupBy("pattern", "n").agg(best.alias("b"))
            .where("b.k > 0")  # an n-gram that no line has: the pattern occurs nowhere
            .select("pattern", "n", F.col("b.gram").alias("gram"), F.col("b.at").alias("off")))


def _sizes(patterns: DataFrame) -> tuple[list[int], int]:
    """The sizes of n-grams that the patterns need (at most GRAM numbers), and the longest pattern's length."""
    got = patterns.where("pattern <> ''").agg(
        F.collect_set(F.least(F.length("pattern"), F.lit(GRAM))).alias("s"), F.max(F.length("pattern")).alias("n")).first()
    return sorted(got.s) or [GRAM], got.n or 1


def _at_hand(table: DataFrame) -> pa.Array | None:
    """The distinct patterns, NULL and empty ones left out; None if they are too many for the tasks."""
    p = table.where("pattern <> ''").distinct()
    size = p.agg(F.count("*").alias("n"), F.sum(F.octet_length("pattern")).alias("b")).first()
    if size.n > TABLE_ROWS or (size.b or 0) > TABLE_BYTES:
        return None
    return p.select(F.col("pattern").cast("binary")).toArrow().column(0).combine_chunks()


def _searched(lines: DataFrame, text: Column, literals: pa.Array, key: list[str], pos_col: str) -> DataFrame:
    """The lines that hold a literal, with their matches, in even partitions by key."""
    spark = lines.sparkSession
    if spark.conf.get(_BATCH_KEY, None) is None:
        spark.conf.set(_BATCH_KEY, str(BATCH_BYTES))
    sent = spark.sparkContext.broadcast(literals)

    def positions(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ready = Literals(sent.value)
        for t in texts:
            yield ready.positions(t)

    # not deterministic: else the filter on its result would have it run twice
    search = F.arrow_udf(positions, "array<bigint>").asNondeterministic()
    known = lines.where(text.isNotNull())  # lines without a key are left out
    for k in key:
        known = known.where(F.col(k).isNotNull())
    hits = known.withColumn(pos_col, search(text)).where(F.size(pos_col) > 0)
    return hits.hint("rebalance", *key)


def _joined(lines: DataFrame, text: Column, table: DataFrame, key: list[str], pos_col: str) -> DataFrame:
    """The same for a table of any size, by joins on n-grams."""
    ln = lines.withColumn("_text", text).withColumn("_hash", F.xxhash64("_text"))
    sizes, longest = _sizes(table)
    own, step = [*key, "_hash"], max(WINDOW, longest)
    index = pattern_index(ln, table, sizes)
    few = broadcast_if_small(index)
    windows = _windows(ln, own, step, longest)
    if few is not index:  # broadcast: the window is at hand where its n-grams meet the index
        met = _window_grams(windows, [*own, "_window", "_text", "_byte"], sizes).join(few, "gram")
    else:
        met = _window_grams(windows, [*own, "_window"], sizes).join(index, "gram").join(
            windows.dropDuplicates([*own, "_window"]), [*own, "_window"])
    s = F.col("at") - F.col("off")
    met = met.where((s >= 0) & (s < step) & (F.substring("_text", s + 1, F.col("n")) == F.col("pattern")))
    found = met.select(*own, F.struct(
        (F.col("_window").cast("bigint") * step + s + F.col("n")).alias("e"), (-F.col("n")).alias("nn"),
        (F.col("_byte") + F.octet_length(F.substring("_text", F.lit(1), s))).alias("b")).alias("_o"))
    hits = found.groupBy(*own).agg(F.collect_set("_o").alias("_o"))
    chosen = folded(F.array_sort("_o"), F.lit(0).cast("bigint"),
                    lambda last, x: F.when(x["e"] + x["nn"] >= last, x["e"]).otherwise(last),
                    lambda last, x: F.when(x["e"] + x["nn"] >= last, x["b"]))
    return ln.join(hits.select(*own, chosen.alias(pos_col)), own).select(*lines.columns, pos_col)


def grep_pattern_table(lines: DataFrame, patterns: DataFrame, key: list[str], line_col: str = "line",
                       pattern_col: str = "pattern", ignore_case: bool = False, pos_col: str = "position") -> DataFrame:
    """Lines that hold a pattern, with the byte offsets of the matches chosen by P4 (into the lowered
    line when ignoring case). ``key`` names the columns that tell lines apart; patterns that are
    NULL or empty match nothing."""
    fold = F.lower if ignore_case else (lambda c: c)
    text = fold(F.col(line_col))
    table = patterns.select(fold(F.col(pattern_col)).alias("pattern"))
    literals = _at_hand(table)
    if literals is None:
        return _joined(lines, text, table, key, pos_col)
    return _searched(lines, text, literals, key, pos_col).select(*lines.columns, pos_col)
