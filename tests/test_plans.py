"""Physical-plan properties that matter at scale."""

import json
import os
import re

from markscope.operators.annotate import annotate_files, write_annotated
from markscope.operators.grep import grep_documents
from markscope.operators.outline import symbols
from markscope.operators.report import nested_report, plain_report_rows, tree_report_rows, write_plain_report, write_report_json
from markscope.session import checkpoint_dir
from markscope.sources import tables as TB
from conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_grep_pushes_literal_to_scan(spark):
    docs = TB.table(spark, SF_SMALL, "documents").select("doc_id", "text")
    plan = _plan(grep_documents(docs, ["the"], keep=["doc_id"]))
    assert "StringContains(text,the)" in plan
    # only the two columns used are read
    assert re.search(r"ReadSchema: struct<doc_id:bigint,text:string>", plan)


def _files(spark):
    src = [("a.py", "python", "class A:\n    def f(self):\n        pass\n"),
           ("b.rs", "rust", "mod m {\n    fn g() {}\n}\n")]
    return spark.createDataFrame(src, "path string, language string, content string")


def _shuffles(plan):
    return [ln for ln in plan.split("\n") if "Exchange hashpartitioning" in ln or "Exchange rangepartitioning" in ln
            or "Exchange SinglePartition" in ln]


def test_outline_shuffles_once_by_path(spark):
    ex = _shuffles(_plan(symbols(_files(spark))))
    assert len(ex) == 1 and "hashpartitioning(path" in ex[0]


def test_annotate_shuffles_once_by_path(spark):
    # source lines travel with the outline's events: one read, one shuffle
    ex = _shuffles(_plan(annotate_files(_files(spark))))
    assert len(ex) == 1 and "hashpartitioning(path" in ex[0]


def test_sinks(spark):
    base = os.path.join(checkpoint_dir(spark), "sinks")
    docs = TB.marked_documents(spark, SF_SMALL).withColumnRenamed("content", "text")
    g = grep_documents(docs, None, keep=["path"])
    write_report_json(nested_report(g), base + "/json")
    recs = [json.loads(x.value) for x in spark.read.text(base + "/json").collect()]
    assert sum(len(r["items"]) for r in recs) == g.count()
    write_plain_report(plain_report_rows(g), base + "/plain")
    text = [x.value for x in spark.read.text(base + "/plain").collect()]
    assert text[-1] == f"Total {g.count()} lines found"
    write_annotated(_files(spark), base + "/annotated")
    out = {r.path: r.content for r in spark.read.parquet(base + "/annotated").collect()}
    assert out["a.py"].startswith("# [TODO] A\nclass A:")


def test_plain_report_searches_once(spark):
    docs = TB.marked_documents(spark, SF_SMALL).withColumnRenamed("content", "text")
    rows = plain_report_rows(grep_documents(docs, None, keep=["path"]))
    rows.collect()
    plan = _plan(rows)
    final = plan.split("\n   Union")[0] if "isFinalPlan=true" in plan else plan
    assert final.count("FileScan parquet") == 1 and final.count("ReusedExchange") >= 2


def test_reports_collect_nothing_per_file(spark):
    docs = TB.marked_documents(spark, SF_SMALL).withColumnRenamed("content", "text")
    g = grep_documents(docs, None, keep=["path"])
    for rows in (plain_report_rows(g), tree_report_rows(g)):
        assert "collect_list" not in _plan(rows)
