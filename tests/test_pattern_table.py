import random

from pyspark.sql import functions as F

from markscope.operators.pattern_table import grep_pattern_table


def chosen(line, patterns):
    """Leftmost end first, longest on ties, then on behind the match."""
    occ = sorted((i + len(p), -len(p), i) for p in patterns for i in range(len(line) - len(p) + 1) if line.startswith(p, i))
    out, last = [], 0
    for e, _, s in occ:
        if s >= last:
            out.append(len(line[:s].encode()))
            last = e
    return out


def test_against_brute_force(spark):
    r = random.Random(8)
    text = lambda n: "".join(r.choice("abcé😀 ") for _ in range(n))
    patterns = list({text(r.choice([1, 2, 3, 4, 6])) for _ in range(60)}) + ["Abc", "zzz"]
    rows = [(i % 5, i, text(r.choice([0, 1, 2, 3, 40]))) for i in range(120)] + [(9, 1, None), (9, 2, "xABCx"), (9, 3, "abc" * 3000)]
    lines = spark.createDataFrame(rows, "doc int, no int, line string")
    for some, low in ((patterns, False), ([p for p in patterns if len(p) > 2], False), (patterns, True), (["zzz"], False), ([], False)):
        table = spark.createDataFrame([(p,) for p in some + some[:3]] + [(None,), ("",)], "pattern string")
        got = {(x.doc, x.no): x.position for x in grep_pattern_table(lines, table, ["doc", "no"], ignore_case=low).collect()}
        use = {p.lower() if low else p for p in some}
        want = {(d, n): chosen(t.lower() if low else t, use) for d, n, t in rows if t is not None}
        assert got == {k: v for k, v in want.items() if v}


def test_ten_thousand_patterns(spark):
    table = spark.range(10000).select(F.concat(F.lit("k"), F.col("id").cast("string"), F.lit("-")).alias("pattern"))
    lines = spark.range(2000).select("id", F.concat(F.lit("a k"), (F.col("id") * 7).cast("string"), F.lit("- b k3-")).alias("line"))
    out = grep_pattern_table(lines, table, ["id"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Contains(" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
    rows = {r.id: r.position for r in out.collect()}
    assert len(rows) == 2000
    for i, pos in rows.items():
        first = [2] if i * 7 < 10000 else []
        assert pos == first + [len(f"a k{i * 7}- b ")]


def test_windows_and_repeated_keys(spark, monkeypatch):
    """Matches across window edges, patterns longer than a window, keys that several lines have."""
    from markscope.operators import pattern_table
    r = random.Random(5)
    text = lambda n: "".join(r.choice("abé😀") for _ in range(n))
    rows = [(i // 3, 0, text(r.choice([3, 300, 511, 512, 513, 1400]))) for i in range(24)]
    rows += [(1, 0, rows[3][2]), (None, 0, "ab" * 10), (9, 0, "ab" * 700)]
    patterns = [text(n) for n in (1, 3, 5, 6)] + [rows[i][2][at:at + n] for i, at, n in ((24, 200, 40), (26, 250, 300))] + [
        t[250:280] for _, _, t in rows if len(t) > 280]
    lines = spark.createDataFrame(rows, "doc int, no int, line string")
    table = spark.createDataFrame([(p,) for p in patterns], "pattern string")
    want = sorted((d, n, t, pos) for d, n, t in rows if d is not None and (pos := chosen(t, set(patterns) - {""})))
    for rows_broadcast in (200_000, 0):  # the index broadcast, and joined by shuffle
        monkeypatch.setattr(pattern_table, "broadcast_if_small", lambda df: F.broadcast(df) if rows_broadcast else df)
        got = sorted(tuple(x) for x in grep_pattern_table(lines, table, ["doc", "no"]).collect())
        assert got == want


def test_no_text_is_shuffled(spark, capsys):
    """Only occurrences and the keys of the lines travel, neither their text nor candidates."""
    lines = spark.createDataFrame([(1, "a key1"), (2, "a key3")], "id long, line string")
    table = spark.createDataFrame([("key1",), ("key2",)], "pattern string")
    grep_pattern_table(lines, table, ["id"]).select("id", "position").explain("formatted")
    nodes = capsys.readouterr().out.split("\n\n")
    sent = [n for n in nodes if ") Exchange" in n and "id#" in n]
    assert sent and not any(c in n for n in sent for c in ("_text#", "line#", "_near#", "pattern#"))


def test_lines_are_searched_in_one_pass(spark, capsys):
    """No row for each place of a line, no join and no second reading: one search and one exchange."""
    lines = spark.createDataFrame([(1, "a key1"), (2, "a key3")], "id long, line string")
    table = spark.createDataFrame([("key1",), ("key2",)], "pattern string")
    out = grep_pattern_table(lines, table, ["id"])
    out.explain("formatted")
    plan = capsys.readouterr().out
    assert "Join" not in plan and "Generate" not in plan and "Aggregate" not in plan
    assert plan.count(") ArrowEvalPython") == 1 and plan.count(") Exchange") == 1
    assert [tuple(r) for r in out.collect()] == [(1, "a key1", [2])]


def test_tables_too_large_for_the_tasks(spark, monkeypatch):
    """The joins give the same lines as the search: by number of patterns and by their bytes, the
    index broadcast or not, keys repeated or NULL, both cases."""
    from markscope.operators import pattern_table
    r = random.Random(11)
    text = lambda n: "".join(r.choice("abBé😀") for _ in range(n))
    rows = [(i // 3, text(r.choice([0, 2, 30, 300]))) for i in range(30)] + [(None, "abab"), (7, None), (8, "abab"), (8, "abab")]
    lines = spark.createDataFrame(rows, "id int, line string")
    table = spark.createDataFrame([(text(r.choice([1, 3, 5])),) for _ in range(12)] + [("ab",), (None,), ("",)], "pattern string")
    for low in (False, True):
        want = sorted(tuple(x) for x in grep_pattern_table(lines, table, ["id"], ignore_case=low).collect())
        assert len(want) > 20 and all(x[0] is not None for x in want)
        for limit, few in (("TABLE_ROWS", True), ("TABLE_BYTES", False)):
            with monkeypatch.context() as m:
                m.setattr(pattern_table, limit, 1)
                m.setattr(pattern_table, "broadcast_if_small", lambda df: F.broadcast(df) if few else df)
                m.setattr(pattern_table, "_searched", None)
                got = sorted(tuple(x) for x in grep_pattern_table(lines, table, ["id"], ignore_case=low).collect())
            assert got == want


def test_any_columns_beside_the_key(spark):
    """Keys of several types, columns that Python never sees, no key at all."""
    lines = spark.sql("SELECT * FROM VALUES (1, 'x', map('a', 1), 'xaxa'), (1, NULL, map('b', 2), 'a'), (2, 'y', NULL, 'b') "
                      "AS t(n, s, m, line)").selectExpr("*", "named_struct('d', n) AS k", "make_ym_interval(n, 0) AS i")
    table = spark.createDataFrame([("a",)], "pattern string")
    out = grep_pattern_table(lines, table, ["n", "s", "k"])
    assert out.columns == [*lines.columns, "position"]
    assert [(r.n, r.m, r.position) for r in out.drop("i").collect()] == [(1, {"a": 1}, [1, 3])]
    assert grep_pattern_table(lines.select("line"), table, []).count() == 2
