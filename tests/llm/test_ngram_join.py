import random
from collections import defaultdict
from fractions import Fraction

import pytest

from markscope.llm.common import Scratch
from markscope.llm.components import components
from markscope.llm.ngram_join import keep_one_per_component, ngram_components


def sets_of(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, t):
    s = [sets_of(x, k) for _, x in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j]:
                both = len(s[i] & s[j])
                if both * t.denominator >= len(s[i] | s[j]) * t.numerator:
                    up[root(i)] = root(j)
    low = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        low[root(i)].append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [x for x in low[root(i)] if x is not None]
        out.append((str(d), len(s[i]), str(min(ids) if ids else None)))
    return sorted(out)


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["the", "of"] * 30
    line = " ".join(r.choice(vocab) for _ in range(12))
    rows, base = [], []
    for i in range(60):
        w = [r.choice(vocab) for _ in range(r.choice([1, 2, 3, 8, 20, 60, 150]))]
        text = " ".join(w)
        if r.random() < 0.4:
            text = line + "\n" + text
        base.append(text)
    rows = [(i, t) for i, t in enumerate(base)]
    for j in range(140):  # near copies with few or many changed words, of a few bases
        w = base[r.randrange(6)].split(" ")
        for _ in range(r.choice([0, 1, 1, 2, 4, 9])):
            w[r.randrange(len(w))] = r.choice(vocab)
        if r.random() < 0.2:
            w += [r.choice(vocab) for _ in range(r.randrange(12))]
        rows.append((100 + j, " ".join(w)))
    rows += [(400, None), (401, ""), (402, " \n\t "), (403, "One"), (404, "ONE"), (405, "One Two"), (406, "é É"),
             (407, "é é"), (None, base[0]), (None, "no id at all here"), (3, base[3]), (3, base[5]),
             (408, "very long " * 20000), (409, "very long " * 20001)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("k,t,seed", [(3, Fraction(9, 10), 1), (5, Fraction(4, 5), 2), (2, Fraction(1, 2), 3),
                                      (3, Fraction(9, 10), 4)])
def test_against_brute_force(spark, docs_of, k, t, seed):
    rows = corpus(seed)
    got = ngram_components(docs_of(rows), k, t).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows, k, t)


def test_keep_one(spark, docs_of):
    rows = corpus(7)
    docs = docs_of(rows)
    kept = keep_one_per_component(docs, 3, Fraction(9, 10))
    assert kept.columns == docs.columns
    # rows equal in doc_id and text are one document
    have = {(str(r.doc_id), str(r.text)) for r in kept.collect()}
    comp = defaultdict(set)
    empty = set()
    for (_, n, c), (i, x) in zip(sorted_by_row(rows), rows):
        (comp[c] if n else empty).add((str(i), str(x)))
    assert empty <= have
    assert sorted(len(have & members) for members in comp.values()) == [1] * len(comp)
    assert len(have) == len(empty) + len(comp)
    assert keep_one_per_component(docs_of([])).count() == 0


def sorted_by_row(rows):
    """(doc, n, a key of its component) in row order."""
    s = [sets_of(x, 3) for _, x in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and 10 * len(s[i] & s[j]) >= 9 * len(s[i] | s[j]):
                up[root(i)] = root(j)
    return [(d, len(s[i]), root(i)) for i, (d, _) in enumerate(rows)]


def test_empty(spark, docs_of):
    assert ngram_components(docs_of([])).count() == 0


def test_components_against_union_find(spark):
    r = random.Random(2)
    for n, m in ((30, 20), (200, 180), (50, 0)):
        links = [(r.randrange(n), r.randrange(n)) for _ in range(m)] + ([(i, i + 1) for i in range(60, 90)] if m > 50 else [])
        got = {x.id: x.comp for x in components(spark.createDataFrame(links, "a long, b long"),
                                                Scratch(spark, "t")).collect()}
        up = {x: x for e in links for x in e}

        def root(i):
            while up[i] != i:
                i = up[i]
            return i
        for a, b in links:
            x, y = sorted((root(a), root(b)))
            up[y] = x
        assert got == {i: root(i) for i in up if root(i) != i}


def test_keep_one_row_of_repeated_rows(spark, docs_of):
    rows = [(None, "a text without any id")] * 4 + [(1, "one two three four")] * 3 + [(2, "one two three four")] * 2 \
        + [(3, "stands alone in here")] + [(4, "")] * 2
    for docs in (docs_of(rows), docs_of(rows).repartition(5)):
        kept = keep_one_per_component(docs, 3, Fraction(9, 10))
        assert kept.columns == docs.columns
        assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(
            [(None, "a text without any id"), (1, "one two three four"), (3, "stands alone in here"), (4, ""), (4, "")], key=str)


def test_tokens_shared_with_classes_set_aside_do_not_count(spark, docs_of, monkeypatch):
    """A text whose shingles stand one each in unlike texts is not read again; linked ones are."""
    from markscope.llm import ngram_join
    words = [f"w{i}" for i in range(30)]
    rows = [(1, " ".join(words))]
    # every shingle of document 1 also stands in a text of its own words
    rows += [(10 + i, " ".join([f"a{i}x{j}" for j in range(40)] + words[i:i + 3])) for i in range(28)]
    rows += [(100, " ".join(f"c{j}" for j in range(60))), (101, " ".join([f"c{j}" for j in range(59)] + ["z"]))]
    seen = []
    real = ngram_join.linked_components
    monkeypatch.setattr(ngram_join, "linked_components", lambda sets, *a: seen.append(sets.count()) or real(sets, *a))
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_components(docs_of(rows)).collect()}
    assert got == {i: 100 if i == 101 else i for i, _ in rows}
    assert seen == [2]
