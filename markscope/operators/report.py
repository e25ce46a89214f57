"""Grep reports: nested report (A1), counts (A2-A4) and sinks.

A report row is one *file* with its matching lines.  The reference nests
files under one record per directory; here the directory is a column and the
sinks keep files of a directory together by sorting.  A record per
directory would put a whole directory (possibly a third of the corpus) into
one row, so it is not built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from markscope.functions.paths import directory, last_two, relative_display
from markscope.functions.text import highlight, trim_start

ITEM = T.StructType([T.StructField("line", T.LongType()),
                     T.StructField("content", T.StringType()),
                     T.StructField("position", T.ArrayType(T.LongType()))])
REPORT_SCHEMA = T.StructType([T.StructField("directory", T.StringType()),
                              T.StructField("name", T.StringType()),
                              T.StructField("items", T.ArrayType(ITEM))])


def with_location(matches: DataFrame, path_col: str = "path") -> DataFrame:
    """Add ``directory`` (X2) to grep results; the file name is the path."""
    return matches.withColumn("directory", directory(path_col))


def nested_report(matches: DataFrame, path_col: str = "path", line_no_col: str = "line_no",
                  line_col: str = "line", pos_col: str = "position") -> DataFrame:
    """A1: ``(directory, name, items[])`` with items ordered by line.

    One shuffle keyed by file; partial aggregation is not possible for
    ``collect_list`` but each group is one file, bounded by the source cap.
    """
    item = F.struct(F.col(line_no_col).cast("bigint").alias("line"), F.col(line_col).alias("content"),
                    F.col(pos_col).alias("position"))
    return (matches.groupBy(directory(path_col).alias("directory"), F.col(path_col).alias("name"))
            .agg(F.array_sort(F.collect_list(item)).alias("items")))


def count_total(matches: DataFrame) -> DataFrame:
    """A2: number of matching lines (not occurrences)."""
    return matches.agg(F.count(F.lit(1)).cast("bigint").alias("total"))


def count_per_file(matches: DataFrame, path_col: str = "path") -> DataFrame:
    """A3: matching lines per file (map-side partial counts, then one shuffle)."""
    return matches.groupBy(path_col).agg(F.count(F.lit(1)).cast("bigint").alias("n_lines"))


def files_with_matches(matches: DataFrame, path_col: str = "path") -> DataFrame:
    """A4: ``-l``: the files that have a match, with their directory."""
    return matches.select(directory(path_col).alias("directory"), F.col(path_col).alias("name")).distinct()


def report_to_json(report: DataFrame, pretty: bool = False) -> DataFrame:
    """One JSON document per file record."""
    opts = {"pretty": "true"} if pretty else {}
    return report.select("directory", "name",
                         F.to_json(F.struct("directory", "name", "items"), opts).alias("json"))


def report_from_json(js: DataFrame, json_col: str = "json") -> DataFrame:
    """S7 round trip: JSON text back to report records."""
    return js.select(F.from_json(json_col, REPORT_SCHEMA).alias("r")).select("r.*")


def write_report_json(report: DataFrame, out_path: str) -> None:
    """JSON-lines files, directory by directory."""
    (report_to_json(report).repartitionByRange("directory", "name")
     .sortWithinPartitions("directory", "name").select("json")
     .write.mode("errorifexists").text(out_path))


def _dir_headers(d: Column) -> Column:
    """Directory header lines: ``parent/last`` then ``last``."""
    two = last_two(d)
    hdr = F.when(F.size(two) == 2, F.array(F.concat(two[1], F.lit("/"), two[0]), two[0])) \
           .when(F.size(two) == 1, F.array(two[0])).otherwise(F.array(F.lit(".")))
    return hdr


def _per_line(matches: DataFrame, path_col: str, line_no_col: str, line_col: str,
              pos_col: str | None = None) -> DataFrame:
    """Matching lines, ``it`` (line, content, position), with ``first`` / ``last`` telling the ends of a
    file's lines and ``no`` their number in the file: each line looks at its neighbours in the file, nothing is collected. This is the
    single shuffle every report part reads, so the search itself runs once per report."""
    fields = [F.col(line_no_col).cast("bigint").alias("line"), F.col(line_col).alias("content")]
    if pos_col:
        fields.append(F.col(pos_col).alias("position"))
    lines = matches.select(directory(path_col).alias("directory"), F.col(path_col).alias("file"), F.struct(*fields).alias("it"))
    w = Window.partitionBy("directory", "file").orderBy("it.line")
    # the neighbours' whole items keep ``it`` referenced in all branches, so that column pruning
    # leaves their shuffles identical and Spark reuses one of them
    return (lines.withColumn("first", F.lag("it").over(w).isNull()).withColumn("last", F.lead("it").over(w).isNull())
            .withColumn("no", F.row_number().over(w).cast("bigint")))


def plain_report_rows(matches: DataFrame, path_col: str = "path", line_no_col: str = "line_no",
                      line_col: str = "line", colorize_patterns: list[str] | None = None,
                      hide_path: bool = False, list_files: bool = False) -> DataFrame:
    """The plain report as ordered text rows
    ``(directory, file, section, line, seq, text)``.

    Sections: 0 directory header, 1 file header, 2 matching line,
    3 blank after a file, 9 total.  Sorting by
    ``(section = 9, directory, file, section, line, seq)`` gives the report.
    """
    lines = _per_line(matches, path_col, line_no_col, line_col)
    empty = F.lit(None).cast("string")
    row = "struct<section:int,line:bigint,seq:int,text:string>"

    def one(section: int, line: Column, text: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), line.cast("bigint").alias("line"), F.lit(0).alias("seq"),
                        text.alias("text")).cast(row)

    zero, items = F.lit(0), []
    if not hide_path:
        items.append(F.when(F.col("first"), one(1, zero, last_two("file")[0])))
    if not list_files:
        content = F.col("it.content")
        if colorize_patterns:
            content = highlight(content, colorize_patterns)
        items.append(one(2, F.col("it.line"), F.concat(F.col("it.line").cast("string"), F.lit("    "), trim_start(content))))
        items.append(F.when(F.col("last"), one(3, zero, F.lit(""))))
    columns = ["directory", "file", "section", "line", "seq", "text"]
    parts = []
    if items:
        rows = F.filter(F.array(*items), lambda x: x.isNotNull())
        parts.append(lines.select("directory", "file", F.explode(rows).alias("r")).select(
            "directory", "file", "r.section", "r.line", "r.seq", "r.text"))
    if not hide_path:
        dirs = lines.where("first").select("directory").distinct()
        parts.append(dirs.select("directory", empty.alias("file"), F.lit(0).alias("section"),
                                 F.lit(0).cast("bigint").alias("line"),
                                 F.posexplode(_dir_headers(F.col("directory"))).alias("seq", "text")))
    # each file's last line has the number of its lines; a plain count would search again
    total = lines.where("last").agg(F.coalesce(F.sum("no"), F.lit(0)).alias("n")).select(
        empty.alias("directory"), empty.alias("file"), F.lit(9).alias("section"), F.lit(0).cast("bigint").alias("line"),
        F.posexplode(F.array(F.lit(""), F.concat(F.lit("Total "), F.col("n").cast("string"), F.lit(" lines found"))))
        .alias("seq", "text"))
    parts.append(total)
    out = parts[0].select(columns)
    for p in parts[1:]:
        out = out.unionByName(p.select(columns))
    return out.withColumn("seq", F.col("seq").cast("int"))


def write_plain_report(rows: DataFrame, out_path: str) -> None:
    """Range-partitioned global sort, then plain text files in order."""
    (rows.orderBy(F.col("section") == 9, "directory", "file", "section", "line", "seq")
     .select("text").write.mode("errorifexists").text(out_path))


def tree_report_rows(matches: DataFrame, path_col: str = "path", line_no_col: str = "line_no",
                     line_col: str = "line", pos_col: str = "position", indent: int = 4) -> DataFrame:
    """``dir`` header, then ``<indent>rel:line:pos0 - content`` per item."""
    lines = _per_line(matches, path_col, line_no_col, line_col, pos_col)
    items = lines.select("directory", "file", F.lit(1).alias("section"), F.col("it.line").alias("line"),
                      F.concat(F.lit(" " * indent), relative_display("directory", "file"), F.lit(":"),
                               F.col("it.line").cast("string"), F.lit(":"),
                               F.element_at("it.position", 1).cast("string"), F.lit(" - "),
                               trim_start("it.content")).alias("text"))
    dirs = lines.where("first").select("directory").distinct().select(
        "directory", F.lit(None).cast("string").alias("file"), F.lit(0).alias("section"),
        F.lit(0).cast("bigint").alias("line"), F.col("directory").alias("text"))
    return dirs.unionByName(items)
