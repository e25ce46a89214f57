"""Fuzzy nearest term.

``suggest`` takes a short list (a command's words) and unrolls it into one
expression: no join, no pairing of rows.  ``suggest_terms`` takes a vocabulary
of any size as a table: a term at distance d or less keeps one of d + 1 pieces of
it unchanged, moved by d characters at most, so words meet terms by an equi join
on (term length, piece number, piece) and only those pairs are measured.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markscope.functions.text import col

# The words a suggestion can name, in order (ties go to the
# earlier word), the largest distance suggested.
VOCABULARY = ["init", "reset", "grep", "help", "file", "pattern", "format", "json", "plain"]
MAX_DISTANCE = 3


def suggest(word: str | Column, vocabulary: list[str] | None = None,
            max_distance: int = MAX_DISTANCE) -> Column:
    """Closest term at Levenshtein distance 1..max_distance, the first term
    on ties; NULL when the word is itself a term or nothing is close."""
    vocab = list(VOCABULARY if vocabulary is None else vocabulary)
    w = col(word)
    cands = F.array(*[F.struct(F.levenshtein(w, F.lit(t)).alias("d"), F.lit(i).alias("i"), F.lit(t).alias("term"))
                      for i, t in enumerate(vocab)])
    exact = F.exists(cands, lambda c: c["d"] == 0)
    close = F.filter(cands, lambda c: (c["d"] >= 1) & (c["d"] <= max_distance))
    best = F.array_min(close)
    return F.when(exact, F.lit(None).cast("string")).otherwise(best["term"])


def _pieces(term: Column, n: int) -> Column:
    """(number, start from 0, length) of the ``n`` pieces of a text; the later ones take the rest."""
    size = F.length(term)
    each = F.floor(size / n).cast("int")
    plain = (F.lit(n) - size % n).cast("int")  # pieces without an additional character
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(
        i.alias("i"), (i * each + F.greatest(i - plain, F.lit(0))).alias("at"),
        (each + (i >= plain).cast("int")).alias("len")))


def suggest_terms(words: DataFrame, vocabulary: DataFrame, word_col: str = "word", term_col: str = "term",
                  order_col: str | None = None, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """``(word, suggestion)`` for every distinct word, as ``suggest`` with the vocabulary's terms
    in the order of ``order_col`` (else of the terms): NULL when the word is a term or none is close."""
    d = max_distance
    terms = vocabulary.select(F.col(term_col).alias("term"), F.col(order_col or term_col).alias("ord")) \
                      .where("term IS NOT NULL").groupBy("term").agg(F.min("ord").alias("ord"))
    w = words.select(F.col(word_col).alias("word")).distinct()
    known = terms.select(F.col("term").alias("word"))
    unknown = w.where("word IS NOT NULL").join(known, "word", "left_anti")
    t = terms.select("term", "ord", F.length("term").alias("n"), F.explode(_pieces(F.col("term"), d + 1)).alias("p"))
    t = t.select("term", "ord", "n", F.col("p.i").alias("i"), F.expr("substring(term, p.at + 1, p.len)").alias("piece"))
    # where a term of n characters would have its pieces, each within d characters of its place
    u = unknown.select("word", F.explode(F.sequence(F.greatest(F.length("word") - d, F.lit(0)), F.length("word") + d)).alias("n"))
    shape = F.expr("repeat('x', n)")
    u = u.select("word", "n", F.explode(_pieces(shape, d + 1)).alias("p"))
    u = u.select("word", "n", "p", F.explode(F.sequence(F.col("p.at") - d, F.col("p.at") + d)).alias("at"))
    u = u.where((F.col("at") >= 0) & (F.col("at") + F.col("p.len") <= F.length("word"))).select(
        "word", "n", F.col("p.i").alias("i"), F.expr("substring(word, at + 1, p.len)").alias("piece")).distinct()
    near = u.join(t, ["n", "i", "piece"]).select("word", "term", "ord").distinct()
    near = near.withColumn("d", F.levenshtein("word", "term", d)).where("d BETWEEN 1 AND " + str(d))
    best = near.groupBy("word").agg(F.min(F.struct("d", "ord", "term"))["term"].alias("suggestion"))
    return w.join(best, "word", "left")
