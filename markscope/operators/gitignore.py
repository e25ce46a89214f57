"""gitignore rules over path metadata.

Rules are the lines of ``.gitignore`` files, translated to regexes where they
are read; the optimizer chooses how to join them.
Every entry - each folder on a path, and the file itself - is tested only
against the rules of the folders above it (an equi-join on the folder); the
last matching rule decides, rules of a deeper folder coming after those of a
shallower one.  A file is ignored when it or any folder above it is, so a
negation cannot bring back a file under an ignored folder (as in git, and as
in a walk that prunes folders).  Folder decisions are made once per distinct
folder.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from markscope.functions.paths import ancestors, base_name, components, directory, gitignore_rule_regex
from markscope.operators.lines import explode_lines
from markscope.session import carried

RULES_SCHEMA = T.StructType([T.StructField("base_dir", T.StringType(), False),
                             T.StructField("ord", T.LongType(), False),
                             T.StructField("regex", T.StringType(), False),
                             T.StructField("negated", T.BooleanType(), False),
                             T.StructField("dir_only", T.BooleanType(), False)])

def rules_frame(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """``[(folder, rule text)]`` in file order -> rules DataFrame."""
    rows = []
    for i, (base, text) in enumerate(rules):
        tr = gitignore_rule_regex(text)
        if tr:
            rows.append((base.rstrip("/"), i, tr[0], tr[1], tr[2]))
    return spark.createDataFrame(rows, RULES_SCHEMA)


def rules_from_files(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """The rules of every ``.gitignore`` in a corpus of files. Rule texts are
    translated where they are; a rule's order counts within its folder."""
    gi = files.where(base_name(path_col) == ".gitignore") \
              .select(directory(path_col).alias("base_dir"), F.col(content_col).alias("text"))
    ln = explode_lines(gi, "text", keep=["base_dir"])

    def translate(batches):
        for pdf in batches:
            rows = [(b.rstrip("/"), n, *t) for b, n, t in
                    zip(pdf["base_dir"], pdf["line_no"], map(gitignore_rule_regex, pdf["line"])) if t]
            yield pd.DataFrame(rows, columns=RULES_SCHEMA.names)

    return ln.select("base_dir", "line_no", "line").mapInPandas(translate, RULES_SCHEMA)


carried("markscope.functions.paths", __name__)


def _ignored_entries(entries: DataFrame, rules: DataFrame, is_dir: bool) -> DataFrame:
    """Entries (``entry`` column) whose last matching rule ignores them."""
    bases = F.array_union(F.array(F.lit("")), ancestors("entry"))
    j = entries.select("entry", F.explode(bases).alias("base_dir")).join(rules, "base_dir")
    rel = F.when(F.col("base_dir") == "", F.col("entry")) \
           .otherwise(F.expr("substring(entry, length(base_dir) + 2)"))
    hits = j.where(F.regexp(rel, F.col("regex")) & (F.lit(is_dir) | ~F.col("dir_only")))
    depth = F.size(components("base_dir"))
    last = hits.groupBy("entry").agg(F.max_by("negated", F.struct(depth, F.col("ord"))).alias("negated"))
    return last.where(~F.col("negated")).select("entry")


def ignored_paths(paths: DataFrame, rules: DataFrame, path_col: str = "path") -> DataFrame:
    """Paths ignored by the rules: ``(path)``."""
    p = paths.select(F.col(path_col).alias("entry"))
    dirs = p.select(F.explode(ancestors("entry")).alias("entry")).distinct()
    bad_dirs = _ignored_entries(dirs, rules, True)
    under = p.select(F.col("entry").alias("_p"), F.explode(ancestors("entry")).alias("entry")) \
             .join(bad_dirs, "entry", "left_semi").select(F.col("_p").alias(path_col))
    own = _ignored_entries(p, rules, False).select(F.col("entry").alias(path_col))
    return own.unionByName(under).distinct()


def drop_gitignored(files: DataFrame, rules: DataFrame, path_col: str = "path") -> DataFrame:
    """keep the files no rule ignores (anti join on the path)."""
    ign = ignored_paths(files.select(path_col), rules, path_col)
    return files.join(ign, path_col, "left_anti")
