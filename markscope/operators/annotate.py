"""Annotation (T3-T6, W2-W4, X7, O3, S6): a TODO comment above each symbol.

The comment for a symbol is placed above its decorators (W2) and after any
doc comment; it is skipped when the line above already holds the same text
(W4), which makes a second run a no-op; consecutive duplicate comment lines
already in the source collapse to one (W3).  Source lines and comments are
merged by ``(line_no, 0 for comment / 1 for source)`` inside each file (O3)
and files are rebuilt by grouping on the path (S6).  All of it is keyed by
path, after the single shuffle of ``outline``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from markscope.functions.paths import base_name
from markscope.operators.gitignore import drop_gitignored, rules_from_files
from markscope.operators.lang import comment_prefix_of, detect_language
from markscope.operators.outline import comment_text, declarations, outline_lines, symbol_groups
from markscope.operators.select import drop_hidden, drop_ignored_extensions, drop_test_paths, select_glob
from markscope.sources.files import list_tree, read_listed, write_tree


def annotate_lines(files: DataFrame, path_col: str = "path", lang_col: str = "language",
                   content_col: str = "content") -> DataFrame:
    """``(path, language, ord, line, is_comment, has_eol)``: the annotated
    files as numbered lines."""
    l2 = declarations(outline_lines(files, path_col, lang_col, content_col))
    g = symbol_groups(l2, with_lines=True)
    is_comment = (F.col("tag") == 0) & F.col("ok") & F.col("role").isin("decl", "scope")
    row = "struct<line_no:bigint,sub:int,text:string>"
    rows = F.when(F.col("tag") == 2, F.array(F.struct(F.col("header").alias("line_no"), F.lit(1).alias("sub"),
                                                      F.col("text").alias("text")).cast(row))) \
            .when(is_comment, F.array(F.struct(F.col("start").alias("line_no"), F.lit(0).alias("sub"),
                                              comment_text(F.col("language"), F.col("level"), F.col("scope"))
                                              .alias("text")).cast(row))) \
            .otherwise(F.array().cast(f"array<{row}>"))
    u = g.select("path", "language", "has_eol", F.explode(rows).alias("r")).select(
        "path", "language", "has_eol", "r.line_no", "r.sub", "r.text")
    return merge_comments(u)


def merge_comments(u: DataFrame) -> DataFrame:
    """O3 + W3 + W4 over ``(path, language, has_eol, line_no, sub, text)``
    rows: source lines (sub 1) and comments (sub 0) of the same files."""
    w = Window.partitionBy("path").orderBy("line_no", "sub")
    u = u.withColumn("_prev", F.lag("text").over(w))
    prefix = comment_prefix_of(F.col("language"))
    dup_comment = F.coalesce((F.col("sub") == 1) & (F.col("text") == F.col("_prev")) &
                             (prefix != "") & F.ltrim(F.col("text")).startswith(prefix), F.lit(False))
    present = (F.col("sub") == 0) & F.coalesce(F.col("_prev") == F.col("text"), F.lit(False))
    kept = u.where(~dup_comment & ~present)
    return kept.select("path", "language", "has_eol",
                       F.row_number().over(w).cast("bigint").alias("ord"),
                       F.col("text").alias("line"), (F.col("sub") == 0).alias("is_comment"))


def collapse_comments(lines: DataFrame) -> DataFrame:
    """W3 alone: drop a comment line equal to the line right above it.
    Input ``(path, language, line_no, line)``."""
    w = Window.partitionBy("path").orderBy("line_no")
    prefix = comment_prefix_of(F.col("language"))
    prev = F.lag("line").over(w)
    dup = (F.col("line") == prev) & (prefix != "") & F.ltrim(F.col("line")).startswith(prefix)
    return lines.withColumn("_dup", F.coalesce(dup, F.lit(False))).where(~F.col("_dup")).drop("_dup")


def rebuild_files(lines: DataFrame) -> DataFrame:
    """``(path, content)``; a file that ended with a newline still does.
    Each group is one file, bounded by the source's size cap."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))),
                                    lambda x: x["line"]), "\n")
    return lines.groupBy("path").agg(
        F.concat(body, F.when(F.max("has_eol"), F.lit("\n")).otherwise(F.lit(""))).alias("content"))


def annotate_files(files: DataFrame, **kw) -> DataFrame:
    """T3 + S6: ``(path, content)`` of the annotated files."""
    return rebuild_files(annotate_lines(files, **kw))


def write_annotated(files: DataFrame, out_path: str) -> None:
    """Write the annotated corpus to a new location (never in place)."""
    annotate_files(files).write.mode("errorifexists").parquet(out_path)


def select_for_annotation(corpus: DataFrame, rules: DataFrame | None = None,
                          path_col: str = "path", root: str | None = None) -> DataFrame:
    """T5 selection: F1 ignored extensions, F2 hidden names, F3 gitignore,
    F4 ``test`` in the path under ``root``, F5 supported language."""
    f = drop_hidden(drop_ignored_extensions(corpus, path_col), path_col)
    if rules is not None:
        f = drop_gitignored(f, rules, path_col)
    rel = F.col(path_col) if root is None else F.expr(f"substring({path_col}, {len(root) + 2})")
    f = drop_test_paths(f, rel)
    f = detect_language(f, path_col)
    return f.where("supported").drop("ext", "comment_prefix", "indent_unit", "supported")


def annotate_corpus(corpus: DataFrame, rules: DataFrame | None = None, root: str | None = None) -> DataFrame:
    """T5: select the corpus like ``init`` does, then annotate every file."""
    return annotate_files(select_for_annotation(corpus, rules, root=root))


def annotate_tree(spark: SparkSession, root: str, out_root: str | None = None) -> DataFrame:
    """T5 on a file tree, contents last: the tree is listed, its ``.gitignore`` files are read, paths
    are selected, and only the files that stay are fetched and annotated. ``out_root``: also write
    them as files there (a new place)."""
    listing = list_tree(spark, root)
    ignore = read_listed(spark, root, listing.where((base_name("path") == ".gitignore") & F.col("error").isNull()))
    rules = rules_from_files(ignore.select("path", F.expr("make_valid_utf8(cast(content AS string))").alias("content")))
    chosen = select_for_annotation(listing.where("error IS NULL"), rules)
    files = detect_language(read_listed(spark, root, chosen)).where("error IS NULL AND is_valid_utf8(cast(content AS string))")
    done = annotate_files(files.select("path", "language", F.col("content").cast("string").alias("content")))
    if out_root is not None:
        write_tree(done, out_root)
    return done


def annotate_glob(corpus: DataFrame, glob: str) -> DataFrame:
    """Annotate the files matching a glob (``analyze -p``)."""
    f = detect_language(select_glob(corpus, glob)).where("supported")
    return annotate_files(f.drop("ext", "comment_prefix", "indent_unit", "supported"))
