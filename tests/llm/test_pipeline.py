import os
import zlib

import corpus_pipeline
from tokenizers import Tokenizer

from markscope.llm.decontaminate import contamination

from llm.conftest import SF, TOK


def shingles(text, k=5):
    w = (text or "").encode("utf-8").lower().split()
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_stages(spark, tmp_path):
    """Each stage over what its predecessor kept, held against the plain reading of its rule."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "near_duplicates", "repeated_passages", "decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert name == "packing" or docs.columns == columns
        kept[name] = docs

    def texts(name):
        return {r.doc_id: r.text for r in kept[name].select("doc_id", "text").collect()}

    # near duplicates: components by comparing all pairs, the smallest id of each stays
    before = texts("toxicity")
    sets = {d: shingles(t) for d, t in before.items()}
    low = {d: d for d in sets}

    def root(d):
        while low[d] != d:
            d = low[d]
        return d
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            both = len(sets[a] & sets[b])
            if both and 10 * both >= 8 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                low[y] = x
    assert set(texts("near_duplicates")) == {d for d in ids if root(d) == d}

    # repeated passages: no window of 50 words in two documents; others untouched
    before, after = texts("near_duplicates"), texts("repeated_passages")
    seen = {}
    for d, t in after.items():
        for g in shingles(t, 50) if len((t or "").split()) >= 50 else ():
            assert seen.setdefault(g, d) == d
    assert all(t is None or len(t) <= len(before[d] or "") for d, t in after.items())

    # contaminated documents go, all others stay
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    bad = {r.doc_id for r in contamination(kept["repeated_passages"], bench).where("contaminated").collect()}
    assert set(texts("decontamination")) == set(after) - bad

    # pieces hold every id of every document once
    tok = Tokenizer.from_file(f"{TOK}/word_bpe_49k.json")
    pieces = {}
    for r in kept["packing"].orderBy("doc_id", "start").collect():
        pieces.setdefault(r.doc_id, []).append(r)
    final = texts("decontamination")
    assert set(pieces) == set(final)
    for d, t in final.items():
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        at = 0
        for r in pieces[d]:
            own = ids[r.start:r.start + r.length]
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in own))
            at += r.length
        assert at == len(ids)


def test_tables_of_finished_steps_go(spark, docs_of):
    """What a stage leaves in the shared folder while later ones run: only what its result reads."""
    from markscope.session import checkpoint_dir
    top = checkpoint_dir(spark).removeprefix("file:")
    words = [f"w{i}" for i in range(400)]
    rows = [(d, " ".join(words[d * 3:d * 3 + 90 + d])) for d in range(30)]
    rows += [(100, rows[3][1]), (100, rows[3][1]), (101, rows[4][1] + " more"), (None, rows[5][1]), (102, None)]

    def left():
        return {(d.split("-", 1)[1].rsplit("-", 1)[0], t.split("-", 1)[1]) for d in set(os.listdir(top)) - before
                for t in os.listdir(f"{top}/{d}")}

    docs = docs_of(rows)
    for stage, tables in ((corpus_pipeline.near_duplicates, {("ngram-keep", "removed"), ("ngram-keep", "repeated")}),
                          (corpus_pipeline.repeated_passages, {("passages", "cuts")})):
        before = set(os.listdir(top))
        out = stage(spark, docs, SF)
        assert left() == tables
        got = sorted((r.doc_id or -1, r.text or "") for r in out.collect())
        assert got == sorted((r.doc_id or -1, r.text or "") for r in out.collect()) and 0 < len(got) < len(rows)
        assert left() == tables
