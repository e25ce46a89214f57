import random
import zlib

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from markscope.llm.packing import SquaresPacker, pack_documents
from markscope.llm.token_files import decode_ranks, encode_ranks, read_tokens, write_tokens
from markscope.llm.tokens import ChunkTokenizer

TOK = "/opt/tokenizers"
FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
ODD = ["", " ", "\n", "a  b  c\t\n x", "<|endoftext|> a<|endoftext|>b  <|endoftext|>", "\x1c!\x1c! it's I'LL 12 3½ é",
       "İSTANBUL ΑΣ ΟΔΟΣ", "　　x\r\n\r\ny  ", "\x00a\x00 b", "a  b ́c é", "word. Word,\nNext. a.\nb,\n\nc", "x" * 5000,
       "don't 'tis we'll\n'll", " lead", "trail ", "naïve ÀÉÎ ß ÿ Ÿ", "日本語 テキスト 한국어", "👍🏽 ok​zero"]


@pytest.mark.parametrize("name", FILES)
def test_chunks_equal_whole_text_encoding(name):
    import duckdb
    texts = [r[0] for r in duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet'").fetchall()]
    lib = Tokenizer.from_file(f"{TOK}/{name}")
    mine = ChunkTokenizer(f"{TOK}/{name}", cache_words=300)  # small: forgetting is exercised
    for group in (texts, ODD, ODD + texts[:20] + [None]):
        ids, n = mine.encode(group)
        want = [lib.encode(t or "", add_special_tokens=False).ids for t in group]
        assert n.tolist() == [len(w) for w in want]
        assert ids.tolist() == [i for w in want for i in w]


_libs = {n: (Tokenizer.from_file(f"{TOK}/{n}"), ChunkTokenizer(f"{TOK}/{n}")) for n in FILES}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("ab,. \n'\t\xa0　éÉß1!"), st.characters(codec="utf-8")),
                        max_size=30), max_size=4))
def test_chunks_equal_whole_text_property(texts):
    for lib, mine in _libs.values():
        ids, n = mine.encode(texts)
        assert ids.tolist() == [i for t in texts for i in lib.encode(t, add_special_tokens=False).ids]


@given(st.lists(st.integers(0, 2**32 - 1), max_size=60))
def test_code_round_trip(xs):
    a = np.array(xs, np.uint32)
    assert decode_ranks(*encode_ranks(a), len(a)).tolist() == xs


def _rows():
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(["the", "and", "tion", "Xy,", "end.\n"]) for _ in range(r.randrange(0, 300))))
            for i in range(120)]
    return rows + [(500, None), (501, ""), (None, "no id"), (7, rows[7][1]), (7, "other text"), (502, "long " * 20000)]


def _crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_round_trip(spark, docs_of, tmp_path):
    rows, lib = _rows(), Tokenizer.from_file(f"{TOK}/{FILES[0]}")
    write_tokens(docs_of(rows).repartition(5), str(tmp_path / "t"), f"{TOK}/{FILES[0]}", block_ids=2000)
    got = read_tokens(spark, str(tmp_path / "t")).toPandas().sort_values("start")
    assert len(got) == len(rows)
    keys = got["doc_id"].astype(object).where(got["doc_id"].notna(), None).tolist()
    assert keys[0] is None and [int(k) for k in keys[1:]] == sorted(int(k) for k in keys[1:])
    assert (got["start"].to_numpy() == np.concatenate(([0], np.cumsum(got["n_tokens"])[:-1]))).all()
    want = sorted((str(i), tuple(lib.encode(t or "", add_special_tokens=False).ids) + (0,)) for i, t in rows)
    have = sorted((str(None if pd.isna(r.doc_id) else int(r.doc_id)), tuple(r.ids)) for r in got.itertuples())
    assert have == want
    assert [_crc(r.ids) for r in got.itertuples()] == got["ids_crc32"].tolist()


def test_token_files_empty(spark, docs_of, tmp_path):
    write_tokens(docs_of([]), str(tmp_path / "t"), f"{TOK}/{FILES[0]}")
    assert read_tokens(spark, str(tmp_path / "t")).count() == 0


def test_packing_is_whole_and_tight(spark, docs_of):
    rows, lib = _rows(), Tokenizer.from_file(f"{TOK}/{FILES[1]}")
    got = pack_documents(docs_of(rows).repartition(3), f"{TOK}/{FILES[1]}", size=256).toPandas()
    assert (got["length"] == got["ids"].map(len)).all() and (got["length"] > 0).all()
    assert [_crc(x) for x in got["ids"]] == got["ids_crc32"].tolist()
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == np.concatenate(([0], np.cumsum(g["length"])[:-1])).tolist()
        total = int(g["length"].sum())
        assert total <= 256 and (total == 256 or total & (total - 1) == 0)
    want = sorted((str(i), len(e), _crc(e)) for i, t in rows
                  for e in [lib.encode(t or "", add_special_tokens=False).ids + [1]])
    # rows that share an id are told apart by what their pieces add up to
    have = []
    for key, g in got.groupby(got["doc_id"].astype(object).where(got["doc_id"].notna(), "None")):
        if key == 7:
            assert int(g["length"].sum()) == sum(n for i, n, _ in want if i == "7")
            continue
        ids = [x for p in g.sort_values("start")["ids"] for x in p]
        have.append((str(key if key == "None" else int(key)), len(ids), _crc(ids)))
        assert (g["doc_tokens"] == len(ids)).all()
    assert sorted(have) == [w for w in want if w[0] != "7"]
    assert pack_documents(docs_of([]), f"{TOK}/{FILES[1]}").count() == 0


def test_level_choice_minimises_the_sum_of_squares():
    r = random.Random(5)
    p = SquaresPacker(16)
    for _ in range(400):
        s = r.randrange(1, 16)
        n = p.count.copy()

        def squares(level):
            m = n.copy()
            if level:
                m[level] -= 1
            if level + s < 16:
                m[level + s] += 1
            return int((m[1:16] ** 2).sum())
        options = [0] + [h for h in range(1, 17 - s) if n[h]]
        assert squares(p.level_for(s)) == min(map(squares, options))
        list(p.place((0, 0, s, np.zeros(s, np.uint32))))


def test_small_batches_are_encoded_together():
    import pyarrow as pa
    from markscope.llm.slabs import gathered
    batches = [pa.RecordBatch.from_pydict({"text": [t, None]}) for t in ("a" * 30, "b" * 30, "c" * 100, "d")]
    out = list(gathered(iter(batches), "text", 60))
    assert [b.num_rows for b in out] == [4, 2, 2]
    assert pa.Table.from_batches(out).equals(pa.Table.from_batches(batches))
    assert not list(gathered(iter([]), "text", 60))


def test_known_words_skip_the_regex(monkeypatch):
    """Plain words seen before are looked up; pieces with NULs are never taken for kept ones."""
    from tokenizers import Tokenizer

    from markscope.llm import tokens
    texts = ["one two 12 three. Two", "one two 12 three. Two", " \x0012 \x00one \x00 . , .x", "one two"] * 2
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = f"{TOK}/{name}"
        tok, whole = tokens.ChunkTokenizer(path), Tokenizer.from_file(path)
        for t in texts:
            assert tok.encode([t])[0].tolist() == whole.encode(t, add_special_tokens=False).ids
        tried = []
        monkeypatch.setattr(tokens, "_PLAIN", lambda p: tried.append(p))
        tok.encode(["one two"])
        assert not tried
        monkeypatch.undo()


def test_words_are_taken_apart_without_a_regex(monkeypatch):
    """A word with other punctuation or a second word behind it is no new piece: neither the regex
    nor the whole pipeline of the library sees it."""
    from markscope.llm import tokens
    texts = ["One été, one. one!! Two## two.\nOne été?!\nté aÿ--", "(a b_c it's o' x'll d'été 'tis É.\nÀ été... ###\nb\n\nc",
             "one\n", "\n", " \n one", ". .\n, #\n##", "a,.\nb;: <|endoftext|> x<| endoftext|>", "K·l µm ªa ×b÷ ŉa İx"]
    for name in FILES:
        tok, whole = tokens.ChunkTokenizer(f"{TOK}/{name}"), Tokenizer.from_file(f"{TOK}/{name}")
        tried = []
        with monkeypatch.context() as m:
            m.setattr(tokens, "_PLAIN", lambda p: tried.append(p))
            ids, n = tok.encode(texts[:1])
        assert not tried and ids.tolist() == whole.encode(texts[0], add_special_tokens=False).ids
        assert not any(k.startswith("\0") for k in tok._index)
        for group in (texts, texts[::-1], *[[t] for t in texts]):
            want = [whole.encode(t, add_special_tokens=False).ids for t in group]
            ids, n = tok.encode(group)
            assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aBzéÿßÉ  \n.,!#-'_<|>1"), max_size=25), max_size=4))
def test_plain_pieces_equal_whole_text_encoding(texts):
    for lib, mine in _libs.values():
        ids, n = mine.encode(texts)
        assert ids.tolist() == [i for t in texts for i in lib.encode(t, add_special_tokens=False).ids]


def test_packing_gives_memory_back(monkeypatch):
    """A worker that has packed returns what it holds free: later stages use the same worker."""
    from types import SimpleNamespace

    import pyarrow as pa
    from markscope.llm import packing
    calls, kept = [], {}
    frame = SimpleNamespace(sparkSession=None, selectExpr=lambda *a: SimpleNamespace(
        mapInArrow=lambda run, ddl: kept.setdefault("run", run)))
    monkeypatch.setattr(packing, "ship", lambda s: None)
    monkeypatch.setattr(packing, "give_back", lambda: calls.append(1))
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    packing.pack_documents(frame, f"{TOK}/word_bpe_49k.json", with_ids=False)
    out = list(kept["run"](iter([pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["one two", None]})])))
    assert sum(b.num_rows for b in out) and calls == [1]
