"""Corpus selection: F1-F6, S4, S5."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markscope.functions.paths import components, glob_to_regex, has_hidden_component
from markscope.session import broadcast_if_small

# Extensions whose files and folders are skipped, as listed
# (duplicates kept).  "xlsx" is written with its dot so xlsx files are
# skipped too (a decision; see README).
IGNORED_EXTENSIONS = [
    ".tmp", ".bak", ".swp", ".old", ".new", ".orig", ".patch", ".diff",
    ".proj", ".sln", ".classpath", ".project",
    ".obj", ".exe", ".dll", ".class", ".o", ".e",
    ".toml", ".lock", ".json", ".md", ".yaml", ".yml", ".xml", ".ini",
    ".zip", ".tar", ".gz", ".rar", ".7z", ".tgz", ".xz", ".bz2",
    ".png", ".jpg", ".jpeg", ".bmp", ".svg", ".gif",
    ".wav", ".mp3", ".mp4", ".avi", ".mov", ".flv", ".ogg",
    ".doc", ".docx", ".pdf", ".ppt", ".pptx", ".xls", ".xlsx", ".odt",
    ".yml", ".xml", ".ini",
    ".log", ".dat",
    ".yarn", ".npm",
]


def _name_ext(c: Column) -> Column:
    return F.regexp_extract(c, r"^.+\.([^.]*)$", 1)


def has_ignored_extension(path: str | Column) -> Column:
    """some component (folder or file) has an ignored extension."""
    ign = sorted(set(IGNORED_EXTENSIONS))
    return F.exists(components(path),
                    lambda c: F.concat(F.lit("."), _name_ext(c)).isin(ign))


def drop_ignored_extensions(files: DataFrame, path_col: str = "path") -> DataFrame:
    return files.where(~has_ignored_extension(path_col))


def drop_hidden(files: DataFrame, path_col: str = "path") -> DataFrame:
    """drop anything under or named with a leading dot."""
    return files.where(~has_hidden_component(path_col))


def drop_test_paths(files: DataFrame, rel_path: str | Column = "path") -> DataFrame:
    """annotation skips paths containing ``test`` (relative path)."""
    c = F.col(rel_path) if isinstance(rel_path, str) else rel_path
    return files.where(~c.contains("test"))


def select_glob(files: DataFrame, glob: str, path_col: str = "path") -> DataFrame:
    """Keep paths matching a shell glob."""
    return files.where(F.col(path_col).rlike(glob_to_regex(glob)))


def select_path(files: DataFrame, path: str, path_col: str = "path") -> DataFrame:
    """One file; an equality the scan can push down."""
    return files.where(F.col(path_col) == path)


def select_names(df: DataFrame, names: DataFrame | list[str], name_col: str,
                 only: bool | None = None) -> DataFrame:
    """``only=True`` keeps rows named in ``names`` (left semi join),
    ``only=False`` keeps the others (left anti join), ``None`` keeps all.

    A name list is broadcast after a size check.
    """
    if only is None:
        return df
    if isinstance(names, list):
        names = df.sparkSession.createDataFrame([(n,) for n in names], f"{name_col} string")
    names = broadcast_if_small(names.select(name_col).distinct())
    return df.join(names, name_col, "left_semi" if only else "left_anti")
