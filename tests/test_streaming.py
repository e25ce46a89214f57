"""Incremental grep with Structured Streaming (memory sink)."""

import os

from markscope.session import checkpoint_dir
from markscope.sources import tables as TB
from markscope.streaming.grep_stream import start, stream_documents, stream_grep, stream_progress
from conftest import SF_SMALL


def test_stream_grep_matches_batch(spark):
    docs_dir = os.path.join(checkpoint_dir(spark), "stream-input")
    TB.marked_documents(spark, SF_SMALL).withColumnRenamed("content", "text").write.mode("overwrite").parquet(docs_dir)
    schema = spark.read.parquet(docs_dir).schema
    sdocs = stream_documents(spark, docs_dir, schema)
    q1 = start(stream_grep(sdocs, None, keep=["doc_id", "path"]), "grep_lines")
    q2 = start(stream_progress(stream_grep(sdocs, None, keep=["doc_id", "path"])), "grep_progress", mode="complete")
    q1.processAllAvailable()
    q2.processAllAvailable()
    n_stream = spark.sql("SELECT count(*) AS n FROM grep_lines").first().n
    q1.stop()
    q2.stop()
    from markscope.plans.queries import QUERIES
    assert n_stream == QUERIES["count_total"](spark, SF_SMALL).first().total
    prog = {r.directory: (r.todo, r.done) for r in spark.sql("SELECT * FROM grep_progress").collect()}
    batch = {r.directory: (r.todo, r.done) for r in QUERIES["todo_progress"](spark, SF_SMALL).collect()}
    assert prog == batch
