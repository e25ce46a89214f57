import math
import random
from fractions import Fraction

import numpy as np
import pytest

from markscope.llm.topk import Best, search


def brute(rows, queries, k=5):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in ok if queries(i)}):
        qv = [math.floor(256 * x) for x in min(v for i, v in rows if i == q and v is not None and all(
            x is not None and math.isfinite(x) for x in v))]
        got = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in ok if i != q and len(v) == len(qv))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(got)]
    return sorted(out)


def run(spark, rows, block=8192):
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<double>, id int, v double")
    got = search(df.where("vec_id % 50 = 0"), df, query_block=block).collect()
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got)


def test_against_brute_force(spark):
    r = random.Random(1)
    rows = [(i, [r.gauss(0, 0.3) for _ in range(8)]) for i in range(700)]
    rows += [(700 + i, rows[i][1]) for i in range(60)]  # ties
    rows += [(1000, None), (1001, [1.0, None] + [0.0] * 6), (1002, [float("nan")] * 8), (1050, [float("inf")] * 8),
             (1100, []), (1150, [0.5] * 3), (1151, [0.25] * 3), (None, [1.0] * 8), (50, [0.1] * 8), (1200, [1e9] * 8)]
    want = brute(rows, lambda i: i % 50 == 0)
    assert run(spark, rows) == want
    assert run(spark, rows, block=4) == want


def test_few_and_none(spark):
    rows = [(0, [1.0, 2.0]), (1, [0.5, 0.5]), (2, [0.0, 0.0])]
    assert run(spark, rows) == brute(rows, lambda i: i % 50 == 0)
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0])]) == []


def test_same_vectors_everywhere(spark):
    rows = [(i, [0.3, -0.2, 0.1]) for i in range(500)]
    assert run(spark, rows) == brute(rows, lambda i: i % 50 == 0)


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in df.collect()]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in search(df.where("vec_id % 50 = 0"), df).collect())
    assert got == brute(rows, lambda i: i % 50 == 0)


@pytest.mark.parametrize("copies", [1, 2, 5, 50])
def test_repeated_query_ids_with_large_own_scores(spark, copies):
    r = random.Random(copies)
    rows = [(i, [r.gauss(0, 0.3) for _ in range(16)]) for i in range(3000)]
    # the query's own rows have the largest scores of all
    rows += [(q, [4 * x for x in rows[q][1]]) for q in (0, 50, 100, 2950) for _ in range(copies)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)  # one block
    got = search(df.where("vec_id % 50 = 0"), df).collect()
    assert sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in got) == brute(rows, lambda i: i % 50 == 0)


def lost(copies, trials=40):
    """Results lost by one block of 4,096 vectors whose query id stands on ``copies`` rows."""
    out = 0
    for t in range(trials):
        r = np.random.default_rng(t)
        v = r.normal(0, 0.3, (4096, 64))
        whole = np.floor(256 * v)
        ids = np.arange(4096)
        ids[:copies], v[:copies], whole[:copies] = 0, v[0], whole[0]
        best = Best(np.array([0]), v[:1], 5)
        best.scan(ids, v)
        want = sorted((-int(x @ whole[0]), int(i)) for i, x in zip(ids, whole) if i)[:5]
        out += len(set(want) - set(best.scores[0]))
    return out


@pytest.mark.parametrize("copies", [1, 2, 5, 6, 50])
def test_no_result_of_a_block_is_lost_to_own_rows(copies):
    assert lost(copies) == 0


def brute_held(rows, k=5):
    """As brute, of finite components of any size, with scores held at the ends of a long."""
    whole = [(i, [math.floor(256 * Fraction(x)) for x in v]) for i, v in rows]
    out = []
    for q, qv in whole:
        if q % 50 == 0:
            scores = [(-min(2 ** 63 - 1, max(-2 ** 63, sum(a * b for a, b in zip(qv, v)))), i) for i, v in whole if i != q]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


@pytest.mark.parametrize("odd", [
    [3e38], [-3e38], [3e38, -3e38, 3e38], [1e36] * 7, [1e200, -1e200], [1.7e308, -1.7e308], [2.5e15, 1e16, 1e17] * 4])
def test_huge_components(spark, odd):
    r = random.Random(5)
    rows = [(i, [r.gauss(0, 0.3) for _ in range(8)]) for i in range(500)]
    rows[100][1][2] = 0.0
    # some vectors, a query among them, hold a huge component
    for i, x in enumerate(odd):
        rows[50 + 3 * i][1][2] = x
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)  # one block
    got = search(df.where("vec_id % 50 = 0"), df).collect()
    assert sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in got) == brute_held(rows)
