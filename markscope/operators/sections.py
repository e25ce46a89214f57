"""Tables of settings from section-structured text (a TOML-like subset).

A file holds sections, each one record: a header line ``[[kind]]`` starts a record, ``[kind]`` too;
``key = value`` lines below it are its fields. Values are strings in double or single quotes, whole
numbers, decimals, ``true`` / ``false``, lists of strings in brackets on one line, and inline tables
``{ a = "x", b = 2 }`` (one level, given as a map of texts). ``#`` starts a comment outside quotes.

The text is exploded to lines; a line's record is the running number of headers before it in
its file, so headers are carried forward by a window per file, and fields are gathered per record.
Lines that are none of these are returned by ``section_rejects``, not dropped silently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markscope.operators.lines import explode_lines

_HEADER = r"^\s*\[\[?\s*([\w.-]+)\s*\]\]?\s*(?:#.*)?$"
_FIELD = r"^\s*([\w.-]+|\"[^\"]*\")\s*=\s*(\S.*)$"
_STRING = r"^(?:\"((?:[^\"\\]|\\.)*+)\"|'([^']*)')\s*(?:#.*)?$"
_ITEM = r"\"((?:[^\"\\]|\\.)*+)\"|'([^']*)'"


def _unescaped(c: Column) -> Column:
    """Backslash sequences of a quoted text (quote, backslash, n, t)."""
    mark = "\x00"
    c = F.replace(c, F.lit("\\\\"), F.lit(mark))
    for short, real in (('\\"', '"'), ("\\n", "\n"), ("\\t", "\t")):
        c = F.replace(c, F.lit(short), F.lit(real))
    return F.replace(c, F.lit(mark), F.lit("\\"))


def _text(value: Column) -> Column:
    """A string value, NULL for other kinds."""
    return F.when(value.rlike(_STRING), F.when(value.startswith("'"), F.regexp_extract(value, _STRING, 2))
                  .otherwise(_unescaped(F.regexp_extract(value, _STRING, 1))))


def _list(value: Column) -> Column:
    """A list of strings, NULL for other kinds."""
    body = F.regexp_extract(value, r"^\[(.*)\]\s*(?:#.*)?$", 1)
    items = F.transform(F.regexp_extract_all(body, F.lit(_ITEM), 0), _text)
    return F.when(value.rlike(r"^\[(?:[^\]\"']|\"(?:[^\"\\]|\\.)*+\"|'[^']*')*+\]\s*(?:#.*)?$"), items)


def _table(value: Column) -> Column:
    """An inline table as a map of texts, NULL for other kinds."""
    body = F.regexp_extract(value, r"^\{(.*)\}\s*(?:#.*)?$", 1)
    pair = r"([\w.-]+)\s*=\s*(\"(?:[^\"\\]|\\.)*+\"|'[^']*'|[^,}\s]+)"
    pairs = F.transform(F.regexp_extract_all(body, F.lit(pair), 0), lambda x: F.struct(
        F.regexp_extract(x, pair, 1).alias("key"),
        _bare_or_text(F.regexp_extract(x, pair, 2)).alias("value")))
    return F.when(value.rlike(r"^\{.*\}\s*(?:#.*)?$"), F.map_from_entries(pairs))


def _bare_or_text(raw: Column) -> Column:
    return F.coalesce(_text(raw), raw)


def section_lines(files: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """``(path, line_no, record, kind, key, raw)`` of all lines that are not blank or comments;
    header lines have no key; ``record`` is 0 before the first header."""
    ln = explode_lines(files.select(F.col(path_col).alias("path"), F.col(text_col).alias("text")), "text", keep=["path"])
    ln = ln.where(~F.col("line").rlike(r"^\s*(?:#.*)?$"))
    kind = F.nullif(F.regexp_extract("line", _HEADER, 1), F.lit(""))
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    ln = ln.withColumn("own", kind)
    ln = ln.withColumn("record", F.count("own").over(w)).withColumn("kind", F.last("own", ignorenulls=True).over(w))
    field = F.col("own").isNull() & F.col("line").rlike(_FIELD)
    return ln.select("path", "line_no", "record", "kind",
                     F.when(field, F.translate(F.regexp_extract("line", _FIELD, 1), '"', "")).alias("key"),
                     F.when(field, F.rtrim(F.regexp_extract("line", _FIELD, 2))).alias("raw"), "line", "own")


def section_rejects(files: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """``(path, line_no, line)`` of lines that are neither header, field, comment nor blank, and of
    fields before the first header."""
    ln = section_lines(files, path_col, text_col)
    return ln.where("own IS NULL AND (key IS NULL OR record = 0)").select("path", "line_no", "line")


def load_sections(files: DataFrame, kind: str, fields: dict[str, str], path_col: str = "path",
                  text_col: str = "text") -> DataFrame:
    """One row per record of ``kind``: ``path``, ``ord`` (number of the record in its file) and the
    ``fields`` (name -> string, bigint, double, boolean, array<string> or map<string,string>); a field that
    is missing or of another kind is NULL, the last of several lines counts."""
    ln = section_lines(files, path_col, text_col).where(F.col("kind") == kind)
    raw = F.col("raw")
    bare = F.regexp_extract(raw, r"^([^\s#]+)\s*(?:#.*)?$", 1)
    typed = {"string": _text(raw), "bigint": F.expr("try_cast(nullif(bare, '') AS bigint)"),
             "double": F.expr("try_cast(nullif(bare, '') AS double)"),
             "boolean": F.when(bare.isin("true", "false"), bare == "true"),
             "array<string>": _list(raw), "map<string,string>": _table(raw)}
    ln = ln.withColumn("bare", F.translate(bare, "_", ""))
    cols = []
    for name, kind_of in fields.items():
        mine = F.col("key") == name
        cols.append(F.max_by(F.when(mine, typed[kind_of.replace(" ", "")]), F.when(mine, F.col("line_no"))).alias(name))
    return ln.groupBy("path", F.col("record").alias("ord")).agg(*cols)
