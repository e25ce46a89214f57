"""Connected components of a table of links, as Spark joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markscope.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """``id, comp`` for every id (long) that occurs in ``links`` (a, b) and is not the
    smallest of its component; ``comp`` is the smallest id it is connected with.

    Alternates large-star and small-star steps: every node points its neighbours at the
    smallest id it knows, until each component is a star. A step is a grouping with
    partial minima and a join; the edges shrink from step to step and are written to the
    shared folder between steps. Links to itself and repeated links have no effect.
    """
    edges = scratch.save(links.where("a <> b").selectExpr("greatest(a, b) a", "least(a, b) b").distinct(),
                         f"{name}-links")
    mark = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if not state[0] or state == mark:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("comp"))
        mark = state
        both = edges.selectExpr("a u", "b v").unionAll(edges.selectExpr("b u", "a v"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.where("v > u").join(low, "u").selectExpr("v a", "m b").distinct())
        low2 = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = (large.join(low2, large["a"] == low2["u"]).where("b <> m").selectExpr("b a", "m b")
                 .unionAll(low2.selectExpr("u a", "m b")).distinct())
        edges = scratch.save(small, name)
