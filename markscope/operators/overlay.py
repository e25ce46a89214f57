"""Keyed overlay of config layers (base <- user <- workspace).

Per key the right layer wins field by field (a NULL field means "not set");
nested values (structs, arrays) are replaced whole; keys only on the left
keep their place, right-hand rows come after them in their own order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlay(left: DataFrame, right: DataFrame, key: str = "name", order_col: str = "ord") -> DataFrame:
    """Merge two layers.  Both carry ``key`` and ``order_col``; the result
    has ``ord_group`` (0 left-only, 1 from the right) and ``order_col``."""
    l_cols = [c for c in left.columns if c not in (key, order_col, "ord_group")]
    r_cols = [c for c in right.columns if c not in (key, order_col, "ord_group")]
    fields = l_cols + [c for c in r_cols if c not in l_cols]
    lt = left.select(key, *[F.col(c).alias(f"l_{c}") for c in l_cols + [order_col]])
    rt = right.select(key, F.lit(True).alias("_r"), *[F.col(c).alias(f"r_{c}") for c in r_cols + [order_col]])
    j = lt.join(rt, key, "full_outer")
    out = []
    for c in fields:
        if c in l_cols and c in r_cols:
            out.append(F.coalesce(F.col(f"r_{c}"), F.col(f"l_{c}")).alias(c))
        elif c in l_cols:
            out.append(F.col(f"l_{c}").alias(c))
        else:
            out.append(F.col(f"r_{c}").alias(c))
    from_right = F.col("_r").isNotNull()
    return j.select(key, *out, F.when(from_right, 1).otherwise(0).alias("ord_group"),
                    F.when(from_right, F.col(f"r_{order_col}")).otherwise(F.col(f"l_{order_col}")).alias(order_col))


def overlay_all(layers: list[DataFrame], key: str = "name", order_col: str = "ord") -> DataFrame:
    """Merge several layers (base, then user, then workspace...) in one grouping.

    Per key and field the last layer that sets it wins.  The result carries
    ``ord_path ARRAY<BIGINT>``; sorting by it gives the merged order: rows only in
    earlier layers keep their places, and each layer's rows come after them in that
    layer's own order.
    """
    fields = list(dict.fromkeys(c for df in layers for c in df.columns if c not in (key, order_col)))
    types = {c: df.schema[c].dataType for df in reversed(layers) for c in df.columns}
    rows = None
    for i, df in enumerate(layers):
        own = df.select(F.col(key), F.lit(i).alias("_layer"), F.col(order_col).cast("bigint").alias("_ord"),
                        *[(F.col(c) if c in df.columns else F.lit(None).cast(types[c])).alias(c) for c in fields])
        rows = own if rows is None else rows.unionByName(own)
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_layer"))).alias(c) for c in fields]
    out = rows.groupBy(key).agg(*last, F.max(F.struct("_layer", "_ord")).alias("_at"))
    zeros = F.array_repeat(F.lit(0).cast("bigint"), F.lit(len(layers) - 1) - F.col("_at._layer"))
    own = F.when(F.col("_at._layer") == 0, F.array(F.col("_at._ord"))) \
           .otherwise(F.array(F.lit(1).cast("bigint"), F.col("_at._ord")))
    return out.select(key, *fields, F.concat(zeros, own).alias("ord_path"))
