"""Nearest ancestor folder that holds a marker (e.g. ``.git``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markscope.functions.paths import ancestors, base_name, directory


def marker_dirs(files: DataFrame, markers: list[str] | None = None, path_col: str = "path",
                hidden_names: bool = False) -> DataFrame:
    """Folders that directly hold a marker entry, a file or a folder.  A
    listing of files shows a folder by the paths under it (``a/.git/HEAD``
    makes ``a`` a root), or by name alone, as ``list_tree`` and ``read_tree``
    list markers that are hidden.  ``markers`` are exact names; ``hidden_names=True``
    treats any file with a dot-name as a marker."""
    if hidden_names:
        return files.where(base_name(path_col).startswith(".")).select(directory(path_col).alias("root")).distinct()
    entry = files.select(F.explode(F.concat(F.array(F.col(path_col)), ancestors(path_col))).alias("entry"))
    return entry.where(base_name("entry").isin(markers or [".git"])).select(directory("entry").alias("root")).distinct()


def project_roots(files: DataFrame, markers: DataFrame, path_col: str = "path") -> DataFrame:
    """Add ``root``: the deepest ancestor folder in ``markers`` (NULL if none).

    Ancestors are exploded (bounded by depth), semi-joined to the marker
    folders, and the longest one is kept per path.
    """
    anc = files.select(F.col(path_col).alias("_p"), F.explode(ancestors(path_col)).alias("root"))
    hit = anc.join(markers.select("root"), "root", "left_semi")
    best = hit.groupBy("_p").agg(F.max_by("root", F.length("root")).alias("root"))
    return files.join(best.withColumnRenamed("_p", path_col), path_col, "left")
