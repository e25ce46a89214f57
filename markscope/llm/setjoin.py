"""Grouped prefix join of token sets: which sets are linked by Jaccard similarity.

Sets are ordered by the rarity of their tokens (exact counts over the sets given). Two
sets that reach the threshold share a token in their prefixes (the first
``n - ceil(threshold n) + 1`` tokens). Sets of the same size and prefix form one group;
groups meet by prefix token, pass length and positional bounds, and only then are their
members compared.

Groups of near copies would make all pairs of their members. So the join has two rounds.
First every group is compared with the hub of each prefix token (the group with the
token at the smallest position) and every member with its group's first; what is linked
is contracted to components. Then only pairs across components are left, and they meet as
(token, group, component) entries by size range. No link between components is lost, and
no partner is capped.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markscope.llm.common import Scratch
from markscope.llm.components import components

#: Width of a size range (natural logarithm).
SIZE_STEP = 0.02


def misses(n: Column, t: Fraction) -> Column:
    """How many of its n tokens a set can lack in a partner."""
    return n - least_overlap(n, t)


def least_overlap(n: Column, t: Fraction) -> Column:
    """ceil(t n)."""
    return F.floor((n * t.numerator + t.denominator - 1) / t.denominator).cast("long")


def pair_overlap(a: Column, b: Column, t: Fraction) -> Column:
    """The least intersection of linked sets of sizes a and b."""
    s = t.numerator + t.denominator
    return F.floor(((a + b) * t.numerator + s - 1) / s).cast("long")


def _fits(n1: Column, p1: Column, n2: Column, p2: Column, t: Fraction) -> Column:
    """Length bound, and the positional bound for the first shared token."""
    return ((F.least(n1, n2) * t.denominator >= F.greatest(n1, n2) * t.numerator)
            & (F.least(n1 - p1, n2 - p2) >= pair_overlap(n1, n2, t)))


def verified(pairs: DataFrame, sets: DataFrame, t: Fraction) -> DataFrame:
    """The (a, b) of ``pairs`` whose sets reach the threshold, compared in full."""
    one = sets.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("toks").alias("ta"))
    two = sets.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("toks").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb"))
    return (pairs.join(one, "a").join(two, "b").withColumn("both", both)
            .where(F.col("both") * t.denominator >= (F.col("na") + F.col("nb") - F.col("both")) * t.numerator)
            .select("a", "b"))


def linked_components(sets: DataFrame, threshold: Fraction, scratch: Scratch) -> DataFrame:
    """``id, comp`` (see ``components``) of the linked sets among ``sets``
    (cid long, n long: size, toks array<bigint>: distinct tokens; no two sets equal)."""
    t = threshold
    n, pos = F.col("n"), F.col("pos")
    tokens = sets.select("cid", "n", F.explode("toks").alias("t"))
    shared = tokens.groupBy("t").agg(F.count("*").alias("df")).where("df > 1")
    # tokens of one set only come first; they need no entry, only their number counts
    ordered = (tokens.join(shared, "t").groupBy("cid", "n")
               .agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("o"))
               .withColumn("own", n - F.size("o"))
               .withColumn("take", misses(n, t) + 1 - F.col("own")).where("take > 0")
               .select("cid", "n", "own", F.slice("o", F.lit(1), F.col("take").cast("int")).alias("o")))
    ordered = scratch.save(ordered.withColumn("o", F.transform("o", lambda x: x["t"])), "prefixes")

    groups = ordered.groupBy("n", "own", "o").agg(F.min("cid").alias("gid"))
    # a set with tokens of its own in the prefix shares its prefix with no other
    member = scratch.save(
        ordered.where("own = 0").join(groups.where("own = 0").drop("own"), ["n", "o"]).select("cid", "gid")
        .unionAll(ordered.where("own > 0").selectExpr("cid", "cid gid")), "members")
    post = scratch.save(
        ordered.join(member.where("cid = gid").select("cid"), "cid", "left_semi")
        .select(F.col("cid").alias("gid"), "n", "own", F.posexplode("o").alias("i", "t"))
        .select("t", "gid", "n", (F.col("own") + F.col("i")).cast("long").alias("pos")), "postings")

    block = F.floor(F.log(n.cast("double")) / SIZE_STEP).cast("int")
    hubs = []
    for by in (["t"], ["t", "block"]):
        least = post.withColumn("block", block).groupBy(*by).agg(
            F.min(F.struct("pos", "n", "gid")).alias("h"), F.count("*").alias("k")).where("k > 1")
        hubs.append(post.withColumn("block", block).join(least, by)
                    .where((F.col("gid") != F.col("h.gid"))
                           & _fits(n, pos, F.col("h.n"), F.col("h.pos"), t))
                    .selectExpr("h.gid a", "gid b"))
    near = hubs[0].unionAll(hubs[1]).unionAll(member.where("cid <> gid").selectExpr("gid a", "cid b")).distinct()
    first = scratch.save(verified(near, sets, t), "near-links")
    comp = components(first, scratch, "near-cc")

    # entries of what is left: tokens that still join two components
    of = member.join(comp, member["cid"] == comp["id"], "left").select(
        "cid", "gid", F.coalesce("comp", "cid").alias("comp"))
    of = scratch.save(of, "labels")
    entry = post.join(of.select("gid", "comp").distinct(), "gid")
    open_t = entry.groupBy("t").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("t")
    entry = scratch.save(entry.join(open_t, "t", "left_semi"), "entries")
    low = least_overlap(n, t)
    s = t.numerator + t.denominator
    high = F.least(n, F.floor((n - pos) * s / t.numerator).cast("long") - n)
    probe = (entry.where(high >= low)
             .withColumn("block", F.explode(F.sequence(
                 F.floor(F.log(low.cast("double")) / SIZE_STEP).cast("int"),
                 F.floor(F.log(high.cast("double")) / SIZE_STEP).cast("int"))))
             .selectExpr("t", "block", "gid g1", "comp c1", "n n1", "pos p1"))
    index = entry.withColumn("block", block).selectExpr("t", "block", "gid g2", "comp c2", "n n2", "pos p2")
    c = F.col
    met = (probe.join(index, ["t", "block"])
           .where((c("c1") != c("c2"))
                  & ((c("n1") > c("n2")) | (c("n1") == c("n2"))
                     & ((c("g1") < c("g2")) | (c("g1") == c("g2")) & (c("c1") < c("c2"))))
                  & _fits(c("n1"), c("p1"), c("n2"), c("p2"), t))
           .select("g1", "c1", "g2", "c2").distinct())
    pairs = (met.join(of.selectExpr("gid g1", "comp c1", "cid a"), ["g1", "c1"])
             .join(of.selectExpr("gid g2", "comp c2", "cid b"), ["g2", "c2"]).select("a", "b"))
    second = verified(pairs, sets, t)
    return components(first.unionAll(second), scratch, "cc")
