import random

from pyspark.sql import functions as F

from markscope.operators.suggest import suggest, suggest_terms


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_table_equals_brute_force(spark):
    r = random.Random(4)
    def word():
        return "".join(r.choice("abcé") for _ in range(r.choice([0, 1, 2, 3, 5, 8, 12])))
    terms = list(dict.fromkeys(word() for _ in range(150)))
    words = [word() for _ in range(150)] + terms[:5] + [t + "ab" for t in terms[:20]] + [None, "zzzzzzzzz"]
    v = spark.createDataFrame([(t, i) for i, t in enumerate(terms)] + [(None, 0)], "term string, ord int")
    w = spark.createDataFrame([(x,) for x in words], "word string")
    for d in (1, 3):
        got = {x.word: x.suggestion for x in suggest_terms(w, v, order_col="ord", max_distance=d).collect()}
        assert set(got) == set(words)
        for x in words:
            near = [(distance(x, t), i, t) for i, t in enumerate(terms)] if x is not None else []
            want = None if x is None or x in terms else min(((n, i, t) for n, i, t in near if 1 <= n <= d), default=(0, 0, None))[2]
            assert got[x] == want, (x, d)


def test_table_equals_expression(spark):
    words = spark.createDataFrame([(w,) for w in ("tree", "jsn", "json", "gre", "helpp", "xyzzyx")], "word string")
    vocab = ["init", "reset", "grep", "help", "file", "pattern", "format", "json", "plain"]
    v = spark.createDataFrame([(t, i) for i, t in enumerate(vocab)], "term string, ord int")
    one = {r.word: r.s for r in words.select("word", suggest("word").alias("s")).collect()}
    assert one == {r.word: r.suggestion for r in suggest_terms(words, v, order_col="ord").collect()}


def test_no_unrolled_vocabulary(spark):
    v = spark.range(20000).select(F.concat(F.lit("term"), F.col("id").cast("string")).alias("term"))
    w = spark.createDataFrame([("trm17",), ("term5",)], "word string")
    got = {r.word: r.suggestion for r in suggest_terms(w, v, max_distance=1).collect()}
    assert got == {"trm17": "term17", "term5": None}
