import random

import numpy as np

from markscope.llm.cuckoo import Chain
from markscope.llm.line_index import LineIndex, dedup_lines


def key_of(line, least=10):
    k = "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    return k if len(k) >= least else None


def brute(docs):
    holders = {}
    for d, t in docs:
        for x in (t or "").split("\n"):
            if d is not None and key_of(x):
                holders.setdefault(key_of(x), set()).add(d)
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or not key_of(x) or min(holders[key_of(x)]) == d]
        out.append((str(d), "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out)


def result(df):
    return sorted((str(r.doc_id), r.text, r.n_lines, r.n_dropped) for r in df.collect())


def make(seed, n=80):
    r = random.Random(seed)
    pool = [f"Line number {i} of the pool é" for i in range(60)] + ["short", "ÉÉÉÉÉÉÉÉÉ", "ÉÉÉÉÉÉÉÉÉÉ", "", " ", "the very common line"]
    docs = []
    for d in range(n):
        lines = [r.choice(["", " ", "\t\r"]) + (x.upper() if r.random() < .2 else x) + r.choice(["", "\x0b ", " "])
                 for x in r.choices(pool, k=r.choice([0, 1, 3, 12]))]
        docs.append((d * 3, "\n".join(lines + ["the very common line"] * (d % 3 == 0))))
    return docs + [(1000, None), (1001, ""), (1002, "\n\n"), (None, "the very common line"), (None, "the very common line"),
                   (1003, "own line repeated\nown line repeated"), (1003, "own line repeated\nshort"),
                   (1004, "own line repeated"), (1005, "z" * 300000 + "\n" + "the very common line\n" * 3000)]


def test_against_brute_force(spark, docs_of):
    docs = make(1)
    assert result(dedup_lines(docs_of(docs))) == brute(docs)
    assert dedup_lines(docs_of([])).count() == 0


def test_incremental_and_reversible(spark, docs_of, tmp_path):
    a = [x for x in make(2) if x[0] is not None]
    b = [(d + 1, t) for d, t in make(3, 60) if d is not None and d < 1000]
    index = LineIndex(spark, str(tmp_path / "index"))
    index.insert(docs_of(a))
    once = result(index.clean(docs_of(a)))
    assert once == brute(a)
    state = sorted(map(tuple, index.counts().collect()))
    index.insert(docs_of(b))
    assert result(index.clean(docs_of(a + b))) == brute(a + b)
    index = LineIndex(spark, str(tmp_path / "index"))  # opened anew
    index.insert(docs_of(b[:9]))  # nothing new in it
    assert result(index.clean(docs_of(a + b))) == brute(a + b)
    ids = {d for i, (d, _) in enumerate(a) if i % 4 == 0}
    gone = [x for x in a if x[0] in ids]
    index.delete(docs_of(gone))
    rest = [x for x in a + b if x not in gone]
    assert result(index.clean(docs_of(rest))) == brute(rest)
    index.insert(docs_of(gone))
    index.delete(docs_of(b + [(77777, None)]))
    assert result(index.clean(docs_of(a))) == once
    assert sorted(map(tuple, index.counts().collect())) == state
    fingerprints = sum(int((np.frombuffer(r.blob, np.uint16) != 0).sum()) for r in index.filters().collect())
    assert fingerprints == len(state)


def test_filter_chain():
    r = np.random.default_rng(1)
    keys = r.integers(0, 2 ** 63, (9000, 2)).astype(np.uint64)
    c = Chain(1024, [])
    c.insert(keys[:5000])
    c = Chain(1024, c.blobs())
    c.insert(keys[5000:])
    assert len(c.filters) == 3 and c.contains(keys).all()
    other = r.integers(0, 2 ** 63, (20000, 2)).astype(np.uint64)
    assert c.contains(other).mean() < 0.002
    c.delete(keys[:6000])
    assert c.contains(keys[6000:]).all() and c.contains(keys[:6000]).mean() < 0.002
    assert sum(map(len, c.filters)) == 3000
