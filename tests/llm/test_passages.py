import random
import re

from markscope.llm.passages import cut_text, drop_repeats, repeats_by_document


def windows(text, n):
    w = (text or "").lower().split()
    return [tuple(w[i:i + n]) for i in range(len(w) - n + 1)]


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]

    def words(n):
        return [r.choice(vocab) for _ in range(n)]
    passage = [words(51), words(60), words(75)]
    rows = []
    for d in range(40):
        lines = [words(r.choice([5, 20, 80, 120])) for _ in range(r.randrange(1, 4))]
        if d % 3 == 0:
            line = lines[0]
            at = r.randrange(len(line) + 1)
            line[at:at] = passage[d % len(passage)]
        rows.append((d, "\n".join(" ".join(x) for x in lines)))
    near = rows[1][1] if len(rows[1][1].split()) > 120 else " ".join(words(150))
    w = near.replace("\n", " ").split()
    changed = list(w)
    changed[len(w) // 2] = "changed"
    rows += [(50, " ".join(w)), (51, " ".join(changed)), (52, rows[5][1]), (53, None), (54, ""), (55, "short text"),
             (56, "again and " * 400), (None, rows[6][1]), (57, "short text"), (7, rows[7][1])]
    return rows


def test_every_repeat_goes_and_nothing_else(spark, docs_of):
    rows = corpus(4)
    docs = docs_of(rows)
    out = drop_repeats(docs)
    assert out.columns == docs.columns
    got = [(r.doc_id, r.text) for r in out.collect()]
    kept = {}
    for d, t in got:
        kept.setdefault(d, t)
    seen = {}
    for d, t in kept.items():  # no window of 50 words stands in two documents any more
        for g in set(windows(t, 50)):
            assert g not in seen, (d, seen[g])
            seen[g] = d
    first = {}
    for d, t in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0)):
        for g in windows(t, 50):
            first.setdefault(g, d)
    near = {50, 51, 1}
    for d, t in rows:  # a document without a window of an earlier one is left alone
        if d not in near and all(first[g] == d for g in windows(t, 50)):
            assert (d, t) in got, d
    assert 52 not in kept and 51 not in kept  # a copy, and a paragraph with one word changed
    assert {53, 54, 55, 56, 57} <= set(kept)


def test_rows_and_empty(spark, docs_of):
    got = {r.doc_id: r for r in repeats_by_document(docs_of(corpus(4))).collect()}
    assert got[52].n_removed == got[52].n_words > 0 and got[55].n_removed == 0
    assert all(0 <= r.n_removed <= r.n_words for r in got.values())
    assert repeats_by_document(docs_of([])).count() == 0
    assert drop_repeats(docs_of([])).count() == 0


def test_cut_text():
    assert cut_text("a b c d", [(1, 2)]) == "a d"
    assert cut_text("a b\nc d\n", [(2, 2)]) == "a b"
    assert cut_text("é b  c", [(0, 1)]) == "b  c"
    assert re.sub(r"\s+", " ", cut_text("x " * 10, [(0, 4), (6, 2)])).split() == ["x"] * 4
