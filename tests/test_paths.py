import re

from pyspark.sql import functions as F

from conftest import one_col
from markscope.functions.paths import (directory, extension, glob_to_regex, gitignore_rule_regex, last_two,
                                       relative_display)
from markscope.operators.gitignore import drop_gitignored, rules_frame
from markscope.operators.lang import detect_language
from markscope.operators.select import drop_hidden, drop_ignored_extensions
from markscope.operators.suggest import suggest


def test_path_functions(spark):
    df = one_col(spark, ["a/b/c.tar.gz", ".bashrc", "x/.env", "foo.", "/r/a/b/c/d.py"], name="p")
    rows = df.select(extension("p").alias("e"), directory("p").alias("d"), last_two("p").alias("l"),
                     relative_display(directory("p"), "p").alias("r")).collect()
    assert [r.e for r in rows] == ["gz", "", "", "", "py"]
    assert [r.d for r in rows] == ["a/b", "", "x", "", "/r/a/b/c"]
    assert rows[0].l == ["c.tar.gz", "b"]
    assert rows[4].r == "../../d.py"


def test_glob_and_gitignore():
    assert re.match(glob_to_regex("src/**/*.py"), "src/a/b/c.py")
    assert not re.match(glob_to_regex("src/*.py"), "src/a/c.py")
    rx, neg, dir_only = gitignore_rule_regex("!keep.log")
    assert neg and not dir_only and re.match(rx, "a/keep.log")
    assert gitignore_rule_regex("/build/")[2]
    assert gitignore_rule_regex("# comment") is None


def test_selection(spark):
    df = one_col(spark, ["a/x.py", "a/.h/y.py", "b.old/z.py", "c/d.json", "c/e.xlsx", "logs/a.txt", "logs/keep.txt"],
                 name="path")
    kept = [r.path for r in drop_hidden(drop_ignored_extensions(df)).collect()]
    assert kept == ["a/x.py", "logs/a.txt", "logs/keep.txt"]
    rules = rules_frame(spark, [("", "logs/"), ("", "!keep.txt"), ("a", "*.py")])
    # a negation cannot bring back a file under an ignored folder
    assert sorted(r.path for r in drop_gitignored(df, rules).collect()) == ["b.old/z.py", "c/d.json", "c/e.xlsx"]
    lang = {r.path: (r.language, r.supported) for r in detect_language(df).collect()}
    assert lang["a/x.py"] == ("python", True) and lang["c/d.json"] == ("json", False)


def test_suggest(spark):
    df = one_col(spark, ["tree", "jsn", "json", "zzzzzzzz"], name="w")
    assert [r.s for r in df.select(suggest("w").alias("s")).collect()] == ["grep", "json", None, None]
