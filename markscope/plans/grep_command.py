"""The ``grep`` command as one library call (a DataFrame per report).

Maps the reference command's options onto the operators: pattern choice
(``patterns``, ``ignore_case_patterns``, ``regex``), file choice (``file``),
output (``fmt`` json / plain / tree, ``list_files``, ``count``,
``hide_path``, ``colorize``).  An unknown format yields a one-row message
with the closest format name (J3) instead of a report.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markscope.operators import report as R
from markscope.operators.grep import DEFAULT_PATTERNS, SearchOptions, grep_documents
from markscope.operators.select import select_path
from markscope.operators.suggest import suggest

# The report formats a user can ask for.
FORMATS = ["plain", "json", "tree"]


def grep_command(files: DataFrame, patterns: list[str] | None = None,
                 ignore_case_patterns: list[str] | None = None, regex: bool = False,
                 file: str | None = None, fmt: str = "plain", hide_path: bool = False,
                 list_files: bool = False, count: bool = False, colorize: bool = False,
                 path_col: str = "path", text_col: str = "text") -> DataFrame:
    """Run a grep over ``files(path, text)`` and return the report.

    * plain: ``(section, directory, file, line, seq, text)`` rows; sort by
      ``(section = 9, directory, file, section, line, seq)`` to print;
      with ``count`` a single ``Total n lines found`` row.
    * json: ``(directory, name, json)`` per file.
    * tree: ``(directory, file, section, line, text)`` rows.
    """
    if fmt not in FORMATS:
        msg = F.concat(F.lit(f"Unknown format: '{fmt}'. Did you mean '"),
                       F.coalesce(suggest(F.lit(fmt)), F.lit("")), F.lit("'?"))
        return files.sparkSession.range(1).select(msg.alias("text"))
    if ignore_case_patterns is not None:
        pats, opts = list(ignore_case_patterns), SearchOptions(ignore_case=True, regex=regex)
    else:
        pats = list(patterns) if patterns is not None else list(DEFAULT_PATTERNS)
        opts = SearchOptions(ignore_case=regex, regex=regex)
    if file is not None:
        files = select_path(files, file, path_col)
    hits = grep_documents(files.select(F.col(path_col).alias("path"), F.col(text_col).alias("text")),
                          pats, opts, keep=["path"])
    if fmt == "json":
        return R.report_to_json(R.nested_report(hits))
    if fmt == "tree":
        return R.tree_report_rows(hits)
    if count:
        return R.count_total(hits).select(F.concat(F.lit("Total "), F.col("total").cast("string"),
                                                   F.lit(" lines found")).alias("text"))
    return R.plain_report_rows(hits, colorize_patterns=pats if colorize else None,
                               hide_path=hide_path, list_files=list_files)
