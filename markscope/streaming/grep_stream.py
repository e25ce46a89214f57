"""Incremental grep: new document files are searched as they arrive.

The batch operators are plain DataFrame transformations, so they apply to a
streaming DataFrame unchanged.  Marker counts per directory are a stateful
aggregation; its state is one row per directory.  Checkpoints go under the
session's shared checkpoint folder unless a location is given.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from markscope.functions.paths import directory
from markscope.operators.grep import SearchOptions, grep_documents
from markscope.session import checkpoint_dir


def stream_documents(spark: SparkSession, source_dir: str, schema: StructType,
                     max_files_per_trigger: int = 64) -> DataFrame:
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
            .parquet(source_dir))


def stream_grep(docs: DataFrame, patterns: list[str] | None = None,
                options: SearchOptions = SearchOptions(), text_col: str = "text",
                keep: list[str] | None = None) -> DataFrame:
    """Matching lines of each arriving document (append mode)."""
    return grep_documents(docs, patterns, options, text_col=text_col, keep=keep)


def stream_progress(matches: DataFrame, path_col: str = "path") -> DataFrame:
    """Running ``[TODO]`` / ``[DONE]`` counts per directory (update mode)."""
    is_todo = F.col("line").contains("[TODO]")
    return (matches.groupBy(directory(path_col).alias("directory"))
            .agg(F.sum(F.when(is_todo, 1).otherwise(0)).cast("bigint").alias("todo"),
                 F.sum(F.when(is_todo, 0).otherwise(1)).cast("bigint").alias("done")))


def start(df: DataFrame, name: str, mode: str = "append", sink: str = "memory",
          checkpoint: str | None = None, trigger_once: bool = False, **sink_options):
    """Start a query; the checkpoint defaults to ``<spark.checkpoint.dir>/streams/<name>``."""
    spark = df.sparkSession
    cp = checkpoint or os.path.join(checkpoint_dir(spark), "streams", name)
    w = df.writeStream.outputMode(mode).format(sink).option("checkpointLocation", cp)
    if sink == "memory":
        w = w.queryName(name)
    for k, v in sink_options.items():
        w = w.option(k, v)
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()
