"""Offset operators on short vectors (FIXTURES.md) and random properties."""

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from conftest import one_col
from markscope.functions.positions import (first_position, literal_positions, multi_positions,
                                           next_char_distance, overlapping_positions, regex_positions)

EMOJI = "🇰🇷🇯🇵한글!"  # 23 UTF-8 bytes


def _one(spark, col):
    return one_col(spark, ["x"]).select(col.alias("r")).first()["r"]


def test_vectors(spark):
    assert len(EMOJI.encode()) == 23
    df = spark.createDataFrame([("ABAAABCDABCDABABCD", "abababc", "aabaabaaba", "ababab", EMOJI * 5, "bbabab")],
                               "a string, b string, c string, d string, e string, f string")
    r = df.select(multi_positions("a", ["ABCD", "BCD"]).alias("m"),
                  first_position("b", "abc").alias("f1"),
                  overlapping_positions("c", "aaba").alias("o"),
                  first_position("d", "abc").alias("f2"),
                  literal_positions("e", EMOJI).alias("e"),
                  literal_positions("f", "abab").alias("bm"),
                  next_char_distance(F.lit("ABCBD"), 1, "B").alias("nd")).first()
    assert r["m"] == [4, 8, 14]
    assert r["f1"] == 4
    assert r["o"] == [0, 3, 6]
    assert r["f2"] is None
    assert r["e"] == [0, 23, 46, 69, 92]
    assert r["bm"] == [2]
    assert r["nd"] == 2


def test_multi_standard_semantics(spark):
    # earliest end wins, longest on ties, restart after the match
    df = one_col(spark, ["xaaaa", "abcd", "the then"])
    got = [r["p"] for r in df.select(multi_positions("t", ["aaa", "xa", "bc", "abcd", "th", "the", "he"]).alias("p"))
           .collect()]
    assert got == [[0, 2], [1], [0, 4]]


def test_regex_positions_bytes(spark):
    df = one_col(spark, ["é12 ab 345", "none", "a\x001 22", "7"])
    got = [r["p"] for r in df.select(regex_positions("t", "[0-9]+").alias("p")).collect()]
    # é is two bytes; a line holding a NUL takes the two-pass way
    assert got == [[2, 8], [], [2, 4], [0]]


def _model_nonoverlap(text, p):
    out, i, tb = [], 0, text.encode()
    pb = p.encode()
    while True:
        j = tb.find(pb, i)
        if j < 0 or not pb:
            return out
        out.append(j)
        i = j + len(pb)


def _model_overlap(text, p):
    tb, pb = text.encode(), p.encode()
    return [i for i in range(len(tb)) if pb and tb.startswith(pb, i)]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="abé ", max_size=12), min_size=1, max_size=6),
       st.text(alphabet="abé", min_size=1, max_size=3))
def test_literal_properties(spark, texts, pat):
    df = one_col(spark, texts)
    rows = df.select("t", literal_positions("t", pat).alias("n"), overlapping_positions("t", pat).alias("o")).collect()
    for r in rows:
        assert r["n"] == _model_nonoverlap(r["t"], pat)
        assert r["o"] == _model_overlap(r["t"], pat)
        for off in r["o"]:  # offsets slice back to the pattern
            assert r["t"].encode()[off:off + len(pat.encode())] == pat.encode()


def _model_standard(text, pats):
    """Scan left to right; at each end position report the longest pattern
    ending there that starts at or after the restart point (standard
    Aho-Corasick, non-overlapping)."""
    tb, out, restart = text.encode(), [], 0
    pbs = sorted({p.encode() for p in pats if p}, key=len, reverse=True)
    for end in range(1, len(tb) + 1):
        for pb in pbs:
            s = end - len(pb)
            if s >= restart and tb[s:end] == pb:
                out.append(s)
                restart = end
                break
    return out


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="abé", max_size=14), min_size=1, max_size=5),
       st.lists(st.text(alphabet="abé", min_size=1, max_size=3), min_size=2, max_size=4))
def test_multi_standard_properties(spark, texts, pats):
    df = one_col(spark, texts)
    rows = df.select("t", multi_positions("t", pats).alias("m")).collect()
    for r in rows:
        assert r["m"] == _model_standard(r["t"], pats), (r["t"], pats)


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet="abé \x00", max_size=16), min_size=1, max_size=5),
       st.sampled_from(["[ab]+", "a.b", "é+", "b(a|é)", "[^ ]+"]))
def test_regex_positions_properties(spark, texts, rx):
    import re
    df = one_col(spark, texts)
    for r in df.select("t", regex_positions("t", rx).alias("p")).collect():
        want = [len(r["t"][:m.start()].encode()) for m in re.finditer(rx, r["t"])]
        assert r["p"] == want, (r["t"], rx)


def test_offsets_of_one_long_line_take_time_in_proportion(spark):
    """200,000 matches in a line: folds in blocks do not copy the whole array for each match."""
    import time
    from markscope.functions.positions import literal_positions, multi_positions, overlapping_positions, regex_positions
    n = 200_000
    df = spark.createDataFrame([("é ab" * n,)], "line string").cache()
    df.count()
    ways = [(literal_positions("line", "ab"), 5, 3), (overlapping_positions("line", "ab"), 5, 3),
            (multi_positions("line", ["ab", "b"]), 5, 3), (regex_positions("line", "a[b]"), 5, 3)]
    for expr, step, first in ways:
        start = time.time()
        got = df.select(expr.alias("p")).first().p
        assert time.time() - start < 60
        assert len(got) == n and got[:2] == [first, first + step] and got[-1] == first + step * (n - 1)
