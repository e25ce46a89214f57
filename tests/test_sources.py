"""S1-S3 on a scratch tree (FIXTURES.md section 4)."""

import os
import tempfile

from pyspark.sql import functions as F

from markscope.operators.gitignore import drop_gitignored, rules_from_files
from markscope.operators.lines import decode_lossy, split_strict_utf8
from markscope.sources.files import read_tree


def _tree():
    root = tempfile.mkdtemp(prefix="markscope-tree-")
    files = {
        "pkg/__init__.py": b"class A:\n    pass\n",
        "pkg/crlf.py": b"x = 1\r\ny = 2",
        "pkg/bad.txt": bytes([0x78, 0xFF, 0xFE, 0xE2, 0x82, 0x79]),
        ".hidden/x.py": b"print(1)\n",
        "tests/_t.py": b"def test():\n    pass\n",
        "a.xlsx": b"xx",
        "logs/run.log": b"log\n",
        "build/out.py": b"x\n",
        "build/keep.py": b"y\n",
        ".gitignore": b"build/\n!keep.py\n*.txt\n",
    }
    for rel, data in files.items():
        full = os.path.join(root, rel)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "wb") as fh:
            fh.write(data)
    return root


def test_file_tree(spark):
    root = _tree()
    df = read_tree(spark, root)
    paths = sorted(r.path for r in df.select("path").collect())
    assert paths == [".gitignore", "build/keep.py", "build/out.py", "pkg/__init__.py", "pkg/bad.txt",
                     "pkg/crlf.py", "tests/_t.py"]
    text = df.select("path", decode_lossy("content").alias("t"))
    bad = text.where(F.col("path") == "pkg/bad.txt").first().t
    assert bad == b"x\xff\xfe\xe2\x82y".decode("utf-8", errors="replace")
    good, rejects = split_strict_utf8(df.where(F.col("error").isNull()))
    assert [r.path for r in rejects.collect()] == ["pkg/bad.txt"]
    crlf = good.where(F.col("path") == "pkg/crlf.py").first()
    assert crlf.content == "x = 1\r\ny = 2" and crlf.has_eol is False
    rules = rules_from_files(good)
    kept = sorted(r.path for r in drop_gitignored(good, rules).collect())
    # build/ is ignored, so "!keep.py" cannot bring build/keep.py back (git semantics)
    assert kept == [".gitignore", "pkg/__init__.py", "pkg/crlf.py", "tests/_t.py"]


def test_size_cap_reports(spark):
    root = _tree()
    df = read_tree(spark, root, maxFileBytes=8)
    big = {r.path: r.error for r in df.where("error IS NOT NULL").collect()}
    assert "pkg/__init__.py" in big and big["pkg/__init__.py"].startswith("larger than")


def test_path_filters_reach_the_listing(spark):
    root = _tree()
    df = read_tree(spark, root)
    one = df.where(F.col("path") == "pkg/crlf.py")
    assert [r.path for r in one.collect()] == ["pkg/crlf.py"]
    some = df.where(F.col("path").startswith("pkg/") & F.col("path").endswith(".py"))
    assert sorted(r.path for r in some.collect()) == ["pkg/__init__.py", "pkg/crlf.py"]
    mixed = df.where((F.col("path") == "pkg/crlf.py") | (F.col("size") > 100))
    assert [r.path for r in mixed.collect()] == ["pkg/crlf.py"]


def test_project_roots_of_nested_marker_folders(spark):
    from markscope.operators.project import marker_dirs, project_roots
    paths = ["a/.git/HEAD", "a/.git/refs/heads/main", "a/b/m.py", "a/b/c/.git/HEAD", "a/b/c/d/n.py", "x/y.py", "a/.gitignore"]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    got = {r.path: r.root for r in project_roots(files, marker_dirs(files)).collect()}
    assert got["a/b/m.py"] == "a" and got["a/b/c/d/n.py"] == "a/b/c" and got["x/y.py"] is None
    worktree = spark.createDataFrame([("w/.git",), ("w/s/k.py",)], "path string")
    assert {r.root for r in marker_dirs(worktree).collect()} == {"w"}


def _random_tree(seed):
    import random
    r = random.Random(seed)
    root = tempfile.mkdtemp(prefix="markscope-tree-")
    names = ["a", "b.py", "_c", ".git", ".gitignore", "d.log", "e.d", "node.yarn", "x y", "é.rs", ".hid"]

    def fill(folder, depth):
        os.makedirs(folder, exist_ok=True)
        for n in r.sample(names, r.randrange(len(names))):
            full = os.path.join(folder, n)
            if depth < 4 and r.random() < .5:
                fill(full, depth + 1)
            else:
                with open(full, "wb") as fh:
                    fh.write(os.urandom(r.randrange(50)))
    fill(os.path.join(root, "top"), 0)
    os.symlink(os.path.join(root, "top"), os.path.join(root, "link"))
    return root


def _walked(root):
    """Regular files by a plain walk with the same pruning, and the hidden markers."""
    from markscope.sources.files import _skip
    files, markers = {}, set()
    for d, dirs, names in os.walk(root):
        rel = os.path.relpath(d, root)
        at = lambda n: n if rel == "." else f"{rel}/{n}"
        markers |= {at(n) for n in dirs + names if n == ".git"}
        dirs[:] = [x for x in dirs if not _skip(x, True, True, True) and not os.path.islink(os.path.join(d, x))]
        files |= {at(n): os.path.getsize(os.path.join(d, n)) for n in names
                  if not _skip(n, True, True, False) and not os.path.islink(os.path.join(d, n))}
    return files, markers


def test_listing_equals_a_walk(spark):
    from markscope.sources.files import MARKER_ERROR, list_tree
    for seed in (1, 2, 3):
        root = _random_tree(seed)
        rows = list_tree(spark, root).collect()
        files, markers = _walked(root)
        assert {r.path: r.size for r in rows if r.error is None} == files
        assert {r.path for r in rows if r.error == MARKER_ERROR} == markers
        assert len(rows) == len(files) + len(markers)
    empty = tempfile.mkdtemp(prefix="markscope-tree-")
    assert list_tree(spark, empty).count() == 0 and read_tree(spark, empty).count() == 0
    assert [r.error for r in list_tree(spark, empty + "/none").collect()] == ["unreadable folder"]


def test_project_roots_on_the_default_listing(spark):
    from markscope.operators.project import marker_dirs, project_roots
    root = tempfile.mkdtemp(prefix="markscope-tree-")
    for p in ("a/.git/HEAD", "a/src/m.py", "a/sub/.git", "a/sub/x/n.py", "b/o.py"):
        os.makedirs(os.path.dirname(os.path.join(root, p)), exist_ok=True)
        with open(os.path.join(root, p), "w") as fh:
            fh.write("x = 1\n")
    files = read_tree(spark, root)
    got = {r.path: r.root for r in project_roots(files.where("error IS NULL"), marker_dirs(files)).collect()}
    assert got == {"a/src/m.py": "a", "a/sub/x/n.py": "a/sub", "b/o.py": None}


def test_annotate_tree_fetches_contents_last(spark):
    from markscope.operators.annotate import annotate_tree
    root, out = _tree(), tempfile.mkdtemp(prefix="markscope-out-")
    done = annotate_tree(spark, root, out)
    assert {r.path for r in done.collect()} == {"pkg/__init__.py", "pkg/crlf.py"}
    with open(os.path.join(out, "pkg/__init__.py")) as fh:
        assert fh.read() == "# [TODO] A\nclass A:\n    pass\n"
    plan = done._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].split("\n")
    # one shuffle: the listing was written before, contents meet the outline's alone
    shuffles = [ln for ln in plan if "Exchange hashpartitioning" in ln or "Exchange rangepartitioning" in ln]
    assert len(shuffles) == 1 and "hashpartitioning(path" in shuffles[0]


def test_tree_sink_round_trip_and_abort(spark):
    import pytest
    from markscope.sources.files import write_tree
    root = tempfile.mkdtemp(prefix="markscope-sink-")
    rows = [(f"d{i % 7}/é {i}.txt", f"line {i}\r\n" * (i % 5)) for i in range(200)]
    write_tree(spark.createDataFrame(rows, "path string, content string").repartition(6), root)
    back = {r.path: bytes(r.content).decode() for r in read_tree(spark, root).collect()}
    assert back == dict(rows) and sorted(os.listdir(root)) == [f"d{i}" for i in range(7)]
    before = {p: os.stat(os.path.join(root, p)).st_mtime_ns for p, _ in rows}
    rows[3] = (rows[3][0], "new")
    write_tree(spark.createDataFrame(rows, "path string, content string"), root)
    changed = [p for p, _ in rows if os.stat(os.path.join(root, p)).st_mtime_ns != before[p]]
    assert changed == [rows[3][0]]
    bad = spark.createDataFrame([(f"d0/n{i}", "x") for i in range(50)] + [("../out", "x")], "path string, content string")
    with pytest.raises(Exception):
        write_tree(bad.repartition(4), root)
    assert sorted(os.listdir(root)) == [f"d{i}" for i in range(7)]
    assert not any(n.startswith("n") for n in os.listdir(os.path.join(root, "d0")))


def test_workers_need_no_installed_package():
    """The sources and the lexer run from a script that only extends its own import path."""
    import subprocess
    import sys
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "2").getOrCreate())
from markscope.operators.annotate import annotate_tree
print("PATHS", sorted(r.path for r in annotate_tree(spark, {_tree()!r}).collect()))
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", code], cwd=tempfile.mkdtemp(), env=env, capture_output=True, text=True, timeout=300)
    assert "PATHS ['pkg/__init__.py', 'pkg/crlf.py']" in got.stdout, got.stderr[-2000:]
