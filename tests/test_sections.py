from markscope.operators.overlay import overlay_all
from markscope.operators.sections import load_sections, section_rejects

BASE = '''# languages
name = "lost"
[[language]]
name = "rust" # trailing
file-types = ["rs", "rs.in", 'x,y']
indent = { tab-width = 4, unit = "    " }
auto = true
size = 1_000

[[grammar]]
name = "rust"
[[language]]
name = 'py"t'
score = 2.5
file-types = []
what is this
size = 7
size = 8
text = "a \\\\ \\"q\\" # no comment \\n"
'''
USER = '[[language]]\nname = "rust"\nsize = 5\n[[language]]\nname = "go"\nfile-types = ["go"]\n'
FIELDS = {"name": "string", "file-types": "array<string>", "indent": "map<string,string>", "auto": "boolean",
          "size": "bigint", "score": "double", "text": "string"}


def test_records(spark):
    files = spark.createDataFrame([("base", BASE), ("user", USER), ("empty", None), ("none", "")], "path string, text string")
    rows = {(r.path, r["ord"]): r.asDict() for r in load_sections(files, "language", FIELDS).collect()}
    assert sorted(rows) == [("base", 1), ("base", 3), ("user", 1), ("user", 2)]
    rust, py = rows["base", 1], rows["base", 3]
    assert (rust["name"], rust["file-types"], rust["indent"], rust["auto"], rust["size"]) == (
        "rust", ["rs", "rs.in", "x,y"], {"tab-width": "4", "unit": "    "}, True, 1000)
    assert (py["name"], py["score"], py["file-types"], py["size"], py["text"]) == (
        'py"t', 2.5, [], 8, 'a \\ "q" # no comment \n')
    assert py["auto"] is None and rust["score"] is None
    assert [(r.path, r.line) for r in section_rejects(files).orderBy("line_no").collect()] == [
        ("base", 'name = "lost"'), ("base", "what is this")]


def test_layers(spark):
    files = spark.createDataFrame([("base", BASE), ("user", USER)], "path string, text string")
    rows = load_sections(files, "language", FIELDS)
    both = overlay_all([rows.where(f"path = '{p}'").drop("path") for p in ("base", "user")])
    got = [(r.name, r["file-types"], r.size) for r in both.orderBy("ord_path").collect()]
    assert got == [('py"t', [], 8), ("rust", ["rs", "rs.in", "x,y"], 5), ("go", ["go"], None)]


def test_many_layers_one_grouping(spark):
    layers = [spark.createDataFrame([("a", i, None if i % 2 else i, 0), (f"k{i}", i, i, 1)], "name string, x int, y int, ord long")
              for i in range(12)]
    out = overlay_all(layers)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    rows = [(r.name, r.x, r.y) for r in out.orderBy("ord_path").collect()]
    assert rows == [(f"k{i}", i, i) for i in range(11)] + [("a", 11, 10), ("k11", 11, 11)]
