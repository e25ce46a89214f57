"""The grep operator: algorithm choice, options, reports."""

from pyspark.sql import functions as F

from markscope.operators import report as R
from markscope.operators.grep import SearchOptions, grep, grep_documents, pattern_tokens, tokenize_patterns
from markscope.operators.lines import explode_lines


def _docs(spark):
    text = "first line\n  [TODO] fix É\nnothing\n[DONE] ok [TODO]\n"
    return spark.createDataFrame([(1, "root/a/b.py", text), (2, "c.rs", "")], "doc_id long, path string, text string")


def test_lines_keep_numbering(spark):
    ln = explode_lines(_docs(spark), keep=["doc_id"]).orderBy("doc_id", "line_no").collect()
    assert [(r.doc_id, r.line_no) for r in ln] == [(1, 1), (1, 2), (1, 3), (1, 4)]  # no line for the final newline


def test_defaults_none_and_modes(spark):
    d = _docs(spark)
    g = grep_documents(d, None, keep=["doc_id", "path"]).orderBy("line_no").collect()
    assert [(r.line_no, r.position) for r in g] == [(2, [2]), (4, [0, 10])]
    assert grep_documents(d, [], keep=["doc_id"]).count() == 0
    ci = grep_documents(d, ["é"], SearchOptions(ignore_case=True), keep=["doc_id"]).collect()
    assert [(r.line_no, r.position) for r in ci] == [(2, [13])]
    rx = grep_documents(d, [r"\[[A-Z]+\]"], SearchOptions(regex=True), keep=["doc_id"]).orderBy("line_no").collect()
    assert [r.position for r in rx] == [[2], [0, 10]]


def test_reports(spark):
    g = grep_documents(_docs(spark), None, keep=["doc_id", "path"])
    assert R.count_total(g).first()["total"] == 2
    rep = R.nested_report(g).first()
    assert rep["directory"] == "root/a" and [i["line"] for i in rep["items"]] == [2, 4]
    back = R.report_from_json(R.report_to_json(R.nested_report(g))).first()
    assert back == rep
    plain = R.plain_report_rows(g).orderBy(F.col("section") == 9, "directory", "file", "section", "line", "seq")
    assert [r.text for r in plain.collect()] == ["root/a", "a", "b.py", "2    [TODO] fix É", "4    [DONE] ok [TODO]",
                                                   "", "", "Total 2 lines found"]


def test_tokens(spark):
    assert tokenize_patterns(" a  b ") == ["a", "b"]
    df = spark.createDataFrame([(1, "  x y\tz ")], "id long, arg string")
    assert [r.pattern for r in pattern_tokens(df, "arg").orderBy("token_no").collect()] == ["x", "y", "z"]


def test_grep_plain_lines(spark):
    ln = spark.createDataFrame([("a", 1, "abcabc")], "path string, line_no long, line string")
    assert grep(ln, ["bc"]).first().position == [1, 4]


def test_grep_command(spark):
    from markscope.plans.grep_command import grep_command
    d = _docs(spark)
    assert grep_command(d, fmt="jsn").first().text == "Unknown format: 'jsn'. Did you mean 'json'?"
    assert grep_command(d, count=True).first().text == "Total 2 lines found"
    assert grep_command(d, ignore_case_patterns=["FIRST"], count=True).first().text == "Total 1 lines found"
    assert grep_command(d, file="c.rs", count=True).first().text == "Total 0 lines found"
    js = grep_command(d, fmt="json").first()
    assert js.name == "root/a/b.py" and '"line":2' in js.json
    rows = grep_command(d, list_files=True).orderBy(F.col("section") == 9, "directory", "file", "section", "seq")
    assert [r.text for r in rows.collect()] == ["root/a", "a", "b.py", "", "Total 2 lines found"]
    col = grep_command(d, colorize=True).where("section = 2").orderBy("line").first().text
    assert col == "2    \x1b[31m[TODO]\x1b[0m fix É"


def test_regex_document_prefilter_is_exact(spark):
    d = spark.createDataFrame([(1, "p", "a ok\nb ok\nok c"), (2, "q", "none\n")], "doc_id long, path string, text string")
    got = grep_documents(d, ["ok$"], SearchOptions(regex=True), keep=["doc_id"]).orderBy("line_no").collect()
    assert [(r.doc_id, r.line_no, r.position) for r in got] == [(1, 1, [2]), (1, 2, [2])]
    # a look-ahead sees past the line end in a document: no document-level test then
    got = grep_documents(d, [r"ok(?!\s)"], SearchOptions(regex=True), keep=["doc_id"]).orderBy("line_no").collect()
    assert [r.line_no for r in got] == [1, 2]


def test_trim_start_unicode_white_space(spark):
    from markscope.functions.text import trim_start
    df = spark.createDataFrame([(" 　\t x y ",)], "t string")
    assert df.select(trim_start("t").alias("r")).first().r == "x y "


def test_pretty_json_round_trip(spark):
    g = grep_documents(_docs(spark), None, keep=["doc_id", "path"])
    rep = R.nested_report(g)
    js = R.report_to_json(rep, pretty=True)
    assert "\n" in js.first().json
    assert R.report_from_json(js).collect() == rep.collect()
