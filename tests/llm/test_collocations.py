import random
import re
from collections import Counter

import numpy as np

from markscope.llm import collocations as C
from markscope.llm.collocations import MisraGries, Slice, collocations


def brute(rows, longest, threshold, top, absorb=50):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    wide = {g: a for g, a in f.items() if len(g[1]) > 1 and a >= threshold}
    dead = set()
    for (lang, w), a in wide.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                if 100 * a >= absorb * f[lang, w[i:i + k]]:
                    dead.add((lang, w[i:i + k]))
    out = []
    for lang in n:
        rows = []
        for (g, w), a in wide.items():
            if g == lang and (g, w) not in dead:
                s, _, l, r = min((10 ** 6 * a * a // (f[g, w[:k]] * f[g, w[k:]]), k, f[g, w[:k]], f[g, w[k:]])
                                 for k in range(1, len(w)))
                rows.append((" ".join(w), a, l, r, n[lang], s))
        rows.sort(key=lambda x: (-x[5], -x[1], x[0].encode()))
        out += [(lang, i, *x) for i, x in enumerate(rows[:top], 1)]
    return sorted(out)


def make(seed):
    r = random.Random(seed)
    vocab = ["De", "la", "é", "x-y", "I", "\x01", "'s", " "] + [f"w{i}" for i in range(40)]
    weights = [1 / (i + 1) for i in range(len(vocab))]
    rows = []
    for _ in range(120):
        words = r.choices(vocab, weights, k=r.choice([0, 1, 2, 30, 200]))
        rows.append((r.choice(["en", "en", "en", "fr", None, "und", ""]),
                     "".join(w + r.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ", "]) for w in words)))
    return rows + [("fr", None), (None, ""), ("en", " .;\t"), ("de", "a b c"), ("en", "long words here " * 30000),
                   ("en", "no end " * 100 + ". " + "same row\n" * 9), ("en", "no end " * 100 + ". " + "same row\n" * 9)]


def as_df(spark, rows):
    return spark.createDataFrame([(i, lang, t, 1, 2, "x") for i, (lang, t) in enumerate(rows)],
                                 "doc_id long, lang string, text string, rank int, n int, phrase string")


def test_against_brute_force(spark, monkeypatch):
    rows = make(1)
    for longest, threshold, top in ((3, 10, 2000), (4, 5, 25)):
        got = collocations(as_df(spark, rows), longest, threshold, top)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(map(tuple, got.collect())) == brute(rows, longest, threshold, top)
    # more than one partition, and texts cut into several slices
    real = C.survivors
    monkeypatch.setattr(C, "survivors", lambda d, k, t, parts: real(d, k, t, parts))
    monkeypatch.setattr(C, "PARTITION_MASS", 20_000)
    assert sorted(map(tuple, collocations(as_df(spark, rows), 3, 10, 50).collect())) == brute(rows, 3, 10, 50)


def test_empty(spark):
    assert collocations(as_df(spark, [])).count() == 0
    assert collocations(as_df(spark, [(None, None)])).count() == 0


def test_summary_keeps_every_frequent_key():
    r = np.random.default_rng(2)
    stream = np.concatenate([r.zipf(1.3, 40000) % 5000, r.integers(5000, 2 ** 32, 40000)]).astype(np.uint32)
    r.shuffle(stream)
    true = Counter(stream.tolist())
    for times in (1, 2):
        s = MisraGries(times * len(stream) // 10 + 1)
        for block in np.array_split(stream, 13):
            k, n = np.unique(block, return_counts=True)
            s.merge(k, n)
            assert len(s.keys) <= s.capacity
        assert s.taken < 10 and set(s.frequent(10).tolist()) >= {k for k, n in true.items() if n >= 10}
        assert all(n <= true[k] <= n + s.taken for k, n in zip(s.keys.tolist(), s.n.tolist()))


def test_keys_are_by_words_not_blanks():
    a, b = Slice([b"x  y\tz".translate(C._FOLD)], [7]), Slice([b"q.q x y z"], [7])
    assert a.keys(3)[1].tolist() == Slice([b"x y z"], [7]).keys(3)[1].tolist()
    assert set(a.keys(2)[1].tolist()) < set(Slice([b"q\nq x y z"], [7]).keys(2)[1].tolist())
    assert a.phrase(0, 3) == "x y z" and len(b.words) == 4
    assert a.keys(2)[1].tolist() != Slice([b"x y z"], [8]).keys(2)[1].tolist()
