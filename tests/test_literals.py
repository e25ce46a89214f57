import random

import pyarrow as pa
import pytest

from markscope.functions import literals
from markscope.functions.literals import Literals
from test_pattern_table import chosen


def made(patterns):
    return Literals(pa.array([p.encode() for p in patterns], pa.binary()))


@pytest.mark.parametrize("places", [7, 1 << 17])
def test_against_brute_force(monkeypatch, places):
    """Literals of all sizes, over the edges of blocks and words, NUL and wide characters."""
    monkeypatch.setattr(literals, "PLACES", places)
    r = random.Random(places)
    for i in range(60):
        some = ("ab", "abcé😀 ", "ab\0")[i % 3]
        text = lambda n: "".join(r.choice(some) for _ in range(n))
        texts = [None if r.random() < .1 else text(r.choice([0, 1, 3, 20, 100])) for _ in range(20)]
        patterns = {text(r.choice([1, 2, 3, 4, 6, 8, 9, 12])) for _ in range(r.choice([1, 5, 30]))}
        patterns |= {t[5:5 + r.choice([9, 15, 40])] for t in texts if t and len(t) > 50}
        if i % 2:
            patterns = {p for p in patterns if len(p) > 2}
        array = pa.array(["ab", *texts], (pa.string(), pa.large_string())[i % 2])[1:]
        got = made(patterns).positions(array).to_pylist()
        assert got == [chosen(t, patterns) if t is not None else [] for t in texts]


def test_nothing_to_search():
    assert made([]).positions(pa.array(["a", None])).to_pylist() == [[], []]
    assert made(["a"]).positions(pa.array([], pa.string())).to_pylist() == []


def test_no_match_over_two_texts():
    found = made(["ab", "abcdefghij"]).positions(pa.array(["xa", "b", "abcde", "fghij", "abcdefghi"]))
    assert found.to_pylist() == [[], [], [0], [], [0]]
    assert made(["abcdefghij"]).positions(pa.array(["abcde", "fghij", "abcdefghi", "j"])).to_pylist() == [[]] * 4


def test_long_literals(monkeypatch):
    """Those that differ in few bytes, also where their hashes are the same."""
    base = "abcdefghij" * 60
    patterns = [base[:n] + c + base[n + 1:size] for n in (9, 40, 77, 300) for c in "XY" for size in (90, 140, 500) if n < size]
    texts = [f"é{base}{p}{base}" for p in patterns] + [base, patterns[0][:-1], patterns[3] * 2]
    want = [chosen(t, set(patterns)) for t in texts]
    assert made(patterns).positions(pa.array(texts)).to_pylist() == want
    monkeypatch.setattr(literals, "_mixed", lambda a, b: a)
    assert made(patterns).positions(pa.array(texts)).to_pylist() == want
