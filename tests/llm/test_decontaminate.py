import hashlib
import random
import re

from markscope.llm.decontaminate import contamination, drop_contaminated

W = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return W.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, size=13):
    wins = {}
    for i, t in items:
        w = words(t)
        if i is not None and w:
            for k in range(max(len(w) - size, 0) + 1):
                wins.setdefault(tuple(w[k:k + size]), set()).add(str(i))
    lens = {len(k) for k in wins}
    out = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for n in lens:
            for k in range(len(w) - n + 1):
                g = wins.get(tuple(w[k:k + n]))
                if g:
                    hit |= set(range(k, k + n))
                    ids |= g
        sha = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((str(d), len(w), len(hit), len(ids), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def make(seed):
    r = random.Random(seed)
    vocab = ["the", "of", "É", "é", "x1", "Zed", "über"] + [f"w{i}" for i in range(30)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([1, 2, 5, 12, 13, 14, 20, 40])))) for i in range(25)]
    items = [x for x in items if len(x[1].split()) > 3] + [(100, "the the the the the"), (101, "the " * 14),
             (102, None), (103, "..."), (None, "w1 w2 w3 w4 w5"), (104, items[7][1]), (7, "another text of item seven w3")]
    docs = []
    for d in range(60):
        w = [r.choice(vocab) for _ in range(r.choice([0, 3, 13, 60, 200]))]
        for _ in range(r.randrange(3)):
            part = words(r.choice(items)[1])
            a = r.randrange(len(part) + 1)
            w[len(w) // 2:len(w) // 2] = part[a // 2:]
        docs.append((d, r.choice([" ", "--", "\n"]).join(w).upper() if r.random() < .3 else " ".join(w)))
    docs += [(200, None), (201, ""), (202, "the " * 300), (None, items[3][1]), (203, items[3][1]), (203, items[3][1]),
             (203, "x"), (204, "w0 " * 30000 + items[5][1])]
    return docs, items


def test_against_brute_force(spark, docs_of):
    for seed in (1, 2):
        docs, items = make(seed)
        bench = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, doc_id int, n_words int")
        got = contamination(docs_of(docs), bench).collect()
        want = brute(docs, items)
        assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == want
    kept = drop_contaminated(docs_of(docs), bench)
    bad = {(d, n) for d, n, _, _, _, c in want if c}
    assert sorted((str(r.doc_id), len(words(r.text))) for r in kept.collect()) == sorted(
        (d, n) for d, n, *_ in want if (d, n) not in bad)
    assert kept.columns == docs_of(docs).columns


def test_empty(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination(docs_of([]), none).count() == 0
    assert [r.contaminated for r in contamination(docs_of([(1, "a b")]), none).collect()] == [False]
