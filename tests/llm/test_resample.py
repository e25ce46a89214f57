import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from markscope.llm.resample import resample, run_crcs, shift

W = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(t, low, high):
    w = W.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return [" ".join(w[i:i + k]).encode() for k in range(low, high + 1) for i in range(len(w) - k + 1)], len(w)


def brute(docs, target, low, high, buckets):
    def counts(texts):
        return Counter(zlib.crc32(f) % buckets for t in texts for f in features(t, low, high)[0])
    s, t = counts(x for _, x in docs), counts(target)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
            for b in range(buckets)]
    rows = []
    for d, x in docs:
        f, n = features(x, low, high)
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[zlib.crc32(g) % buckets] for g in f)
        rows.append((d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2 ** 32))), n))
    fit = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = Counter()
    for i, r in enumerate(fit[:10 * len(fit) // 100], 1):
        ranks[(r[:4], i)] += 1
    drawn = Counter(r for r, _ in ranks.elements())
    rest = Counter(r[:4] for r in rows) - drawn
    return sorted(map(str, [*ranks.elements(), *((r, None) for r in rest.elements())]))


def test_prefix_crcs_equal_zlib():
    r = random.Random(3)
    words = [bytes(r.randrange(97, 123) for _ in range(r.choice([1, 2, 7, 64, 5000]))) for _ in range(300)]
    got = run_crcs(words, 1, 4)
    want = [zlib.crc32(b" ".join(words[i:i + k])) for k in range(1, 5) for i in range(len(words) - k + 1)]
    assert got.tolist() == want
    assert run_crcs([], 1, 3).tolist() == [] and run_crcs([b"a"], 2, 3).tolist() == []
    assert shift(np.array([zlib.crc32(b"x")], np.uint32), np.array([100000])) ^ zlib.crc32(bytes(100000)) == \
        zlib.crc32(b"x" + bytes(100000))


def make(seed):
    r = random.Random(seed)
    vocab = ["The", "é", "Über", "x1"] + [f"w{i}" for i in range(60)]
    docs = [(i, r.choice([" ", ". ", "\n"]).join(r.choice(vocab) for _ in range(r.choice([0, 5, 19, 20, 21, 80]))))
            for i in range(150)]
    docs += [(200, None), (201, ""), (202, "..."), (None, "w1 " * 25), (203, "w2 w3 " * 30), (203, "w2 w3 " * 30),
             (204, "w4 é " * 40000)]
    target = [" ".join(r.choice(vocab[:20]) for _ in range(30)) for _ in range(20)] + [None, ""]
    return docs, target


def test_against_brute_force(spark, docs_of):
    docs, target = make(5)
    items = spark.createDataFrame([(t, 1, 2) for t in target], "text string, score int, rank int")
    for low, high, buckets in ((1, 1, 10000), (1, 3, 97)):
        got = resample(docs_of(docs), items, low, high, buckets)
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        rows = [((x.doc_id, x.n_features, x.weight, x.score), x.rank) for x in got.collect()]
        assert sorted(map(str, rows)) == brute(docs, target, low, high, buckets)


def test_empty(spark, docs_of):
    none = spark.createDataFrame([], "text string")
    assert resample(docs_of([]), none).count() == 0
    rows = resample(docs_of([(i, "a b") for i in range(20)]), none).collect()
    assert len(rows) == 20 and all(r.rank is None for r in rows)
