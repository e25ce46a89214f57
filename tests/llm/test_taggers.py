import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from markscope.llm import crf
from markscope.llm.common import least_hashes, sampled_texts
from markscope.llm.langid import fit as fit_langs
from markscope.llm.langid import tag_languages
from markscope.llm.queries import op7_langid, op8_toxicity
from markscope.llm.toxicity import drop_toxic, fit, score_toxicity, toxic_spans

from llm.conftest import SF

CASES = [(1, None), (2, ""), (3, " \n\t"), (4, "12 34 !"), (None, "the cat"), (5, "the cat"), (5, "the cat"),
         (6, "the cat sat on the mat " * 20000)]


def test_forward_backward_against_all_paths():
    r = np.random.default_rng(3)
    em, T = r.normal(size=(5, 3)), r.normal(size=(3, 3))
    want, moves, z = np.zeros((5, 3)), np.zeros((3, 3)), 0.0
    for path in itertools.product(range(3), repeat=5):
        p = np.exp(em[range(5), path].sum() + sum(T[a, b] for a, b in zip(path, path[1:])))
        z += p
        want[range(5), path] += p
        for a, b in zip(path, path[1:]):
            moves[a, b] += p
    got, got_moves, log_z = crf.forward_backward(em, T, np.ones(5, np.int64))
    assert np.allclose(got, want / z) and np.allclose(got_moves, moves / z) and np.isclose(log_z, np.log(z))


def test_forward_backward_holds_little():
    """The driver trains in one go: two arrays of the emissions' size, texts of any lengths side by side."""
    import tracemalloc
    r = np.random.default_rng(4)
    lens = np.array([700, 3, 1, 700, 250, 40] * 30)
    order, active = crf.time_major(lens)
    em, T = r.normal(size=(len(order), 2)), r.normal(size=(2, 2))
    tracemalloc.start()
    p, moves, log_z = crf.forward_backward(em[order], T, active)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3.5 * em.nbytes
    back = np.empty_like(p)
    back[order] = p
    each = [crf.forward_backward(x, T, np.ones(len(x), np.int64)) for x in np.split(em, np.cumsum(lens)[:-1])]
    assert np.allclose(back, np.concatenate([x[0] for x in each]))
    assert np.allclose(moves, sum(x[1] for x in each)) and np.isclose(log_z, sum(x[2] for x in each))


def test_training_does_not_depend_on_the_block_size(monkeypatch):
    texts = ["red green blue", "blau rot", "", "green rot red", "blau blau gelb"]
    words, coded = crf.coded(texts)
    gold = [np.array([int(words[i] in (b"blau", b"rot", b"gelb")) for i in t], np.int32) for t in coded]
    whole = crf.train(words, coded, gold, 2)
    monkeypatch.setattr(crf, "TRAIN_WORDS", 2)
    parts = crf.train(words, coded, gold, 2)
    assert np.allclose(whole.weights, parts.weights) and np.allclose(whole.transitions, parts.transitions)
    p = np.concatenate([p for _, p in crf.marginals(whole, texts)])
    assert (p.argmax(axis=1) == np.concatenate(gold)).all()


@pytest.mark.parametrize("size", [5, 40, 1000])
def test_sample_is_of_its_size_and_ignores_order_and_copies(spark, size):
    rows = spark.range(3000).selectExpr("if(id < 1000, 'same', concat('t', id)) text", "cast(id % 2 as int) y")
    got = sampled_texts(rows, size, "text", ["y"])
    assert len(set(got)) == len(got) == size
    assert got == sampled_texts(rows.repartition(7).orderBy(F.rand(1)), size, "text", ["y"])
    assert least_hashes(rows.where("false"), 5).count() == 0 == len(sampled_texts(rows.where("false"), 5, "text", ["y"]))


def test_languages_of_odd_rows(spark, docs_of):
    learn = spark.createDataFrame([("the cat sat on the mat", "en"), ("die katze lag im haus", "de"), (None, "en"),
                                   ("no label", None)], "text string, lang string")
    model, langs = fit_langs(learn)
    assert langs == ["de", "en"]
    got = tag_languages(docs_of(CASES), model, langs, ["doc_id"]).collect()
    assert len(got) == len(CASES)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1, 2, 3, 4))
    assert by[None].lang_pred == by[5].lang_pred == by[6].lang_pred == "en" and 0.5 < by[6].score <= 1
    assert by[6].n_lang_words == 120000
    mixed = tag_languages(docs_of([(1, "the cat sat die katze lag")]), model, langs, ["doc_id"]).first()
    assert mixed.n_switches == 1
    assert tag_languages(docs_of([]), model, langs, ["doc_id"]).count() == 0
    assert fit_langs(learn.where("false"))[1] == []
    none = tag_languages(docs_of(CASES), *fit_langs(learn.where("false")), ["doc_id"]).collect()
    assert {r.lang_pred for r in none} == {"und"}


def test_toxicity_of_odd_rows(spark, docs_of):
    # only one word tells the two kinds apart, and the odd rows' words are known
    texts = [(i, f"the cat sat on a mat with you {f'vile{chr(115) * (i % 3)}' if i % 2 else 'kind'} person number {i} go")
             for i in range(120)]
    docs = docs_of(texts)
    labels = spark.createDataFrame([(i, i % 2, 7) for i, _ in texts] + [(1, None, 7), (None, 1, 7)],
                                   "doc_id long, toxic int, text int")
    model = fit(docs, labels)
    got = score_toxicity(docs_of(CASES + [(7, "such a vile person"), (8, "x " * 50000 + "vile")]), model, ["doc_id"])
    rows = got.collect()
    assert len(rows) == len(CASES) + 2 and all(0 <= r.score <= 1 for r in rows)
    by = {r.doc_id: r.score for r in rows}
    assert by[1] == by[2] == by[3] == by[4] < 0.5 <= by[7]
    assert by[None] == by[5] < 0.5
    spans = toxic_spans(docs_of([(9, "such a Vile person"), (10, None)]), model, ["doc_id"]).collect()
    assert [(r.doc_id, r.word, r.surface) for r in spans] == [(9, 2, "vile")]
    kept = drop_toxic(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, _ in texts if i % 2 == 0}
    assert fit(docs, labels.where("toxic = 0")) is None and fit(docs_of([]), labels) is None
    assert {r.score for r in score_toxicity(docs_of(CASES), None, ["doc_id"]).collect()} == {0.0}
    assert score_toxicity(docs_of([]), model, ["doc_id"]).count() == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.col("lang").alias("truth"))
    got = op7_langid(spark, SF).join(docs, "doc_id").where("held_out AND truth IS NOT NULL").collect()
    assert np.mean([r.truth == r.lang_pred for r in got]) > 0.97
    scored = op8_toxicity(spark, SF)
    assert scored.count() == docs.count() and scored.where("predicted <> cast(score >= 0.5 as int)").count() == 0


def test_toxicity_fit_uses_rare_labels_and_all_sampled_texts(spark, docs_of, monkeypatch):
    texts = [(i, f"the cat sat on a mat with you {'vile' if i % 150 == 0 else 'kind'} person number {'x' * (i % 40)} "
                 f"{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyzabcd'[i // 100 % 10]} go") for i in range(3000)]
    texts = [(i, t + " " + "yz" * (i // 1000)) for i, t in texts]
    labels = spark.createDataFrame([(i, int(i % 150 == 0)) for i, _ in texts], "doc_id long, toxic int")
    used = []
    train = crf.train
    monkeypatch.setattr(crf, "train", lambda v, t, *a, **b: used.append((len(t), sum(map(np.any, a[0])))) or train(v, t, *a, **b))
    # 20 of 3,000 texts are toxic: all of them are in a sample of 120, two thirds in the training
    model = fit(docs_of(texts), labels, 120)
    assert used[0][0] == 80 and used[0][1] in (13, 14)
    by = {r.doc_id: r.score for r in score_toxicity(docs_of([(1, "such a vile person"), (2, "such a kind person")]), model,
                                                    ["doc_id"]).collect()}
    assert by[2] < 0.5 <= by[1]
    # a sample that holds all texts is trained on as a whole
    assert fit(docs_of(texts), labels) and used[1][0] == 2000
    # words are counted over all rows: each toxic word below stands in one sampled text at most
    some = [(i, f"word {'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]} {'foul' if i % 2 else 'fine'} here") for i in range(100)]
    fit(docs_of(some), spark.createDataFrame([(i, i % 2) for i, _ in some], "doc_id long, toxic int"), 6)
    assert used[2][0] == 4 and used[2][1] == 2


def test_rare_languages_are_learned(spark):
    """One text in a thousand is in a second language: it takes part in the fit."""
    from markscope.llm.langid import per_language
    rows = [(f"the river rose number {i}", "en") for i in range(3000)] + [(f"der fluss stieg {i}", "de") for i in range(3)]
    df = spark.createDataFrame(rows + rows[:50], "text string, lang string")
    got = per_language(df, 60)
    langs = [r["lang"] for r in got]
    assert langs.count("de") == 3 and langs.count("en") == 30 and len({r["text"] for r in got}) == len(got)
    assert per_language(df, 60) == got and per_language(df.where("false"), 60) == []
