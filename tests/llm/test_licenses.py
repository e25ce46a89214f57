import re

from markscope.llm.licenses import BASE_PHRASES, evaluate, scan_licenses, to_postfix

W = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = W.findall(t)
    at = sorted((i, label) for p, label in BASE_PHRASES.items() for i in range(len(words))
                if words[i:i + len(p.split())] == p.split())
    return (len(words), len(at), at[0][0] if at else None, at[-1][0] if at else None,
            ",".join(sorted({label for _, label in at})))


TEXTS = [None, "", "...", "Released under the MIT License.", "under the mit licenses", "cc by nc cc by nc CC-BY-NC 4.0",
         "Licensed under the Apache License, Version 2.0.", "xunder the mit license", "under\x00the/mit-license é",
         "under the mit license " * 3000, "É under THE mit LICENSE ünder the mit license", "cc by ncé", "\x1ccc\x1cby\x1cnc",
         "SPDX-License-Identifier: (GPL-2.0-only WITH Classpath-exception-2.0) OR MIT\nmore", "licença cc by nc"]


def test_base_places_match_brute_force(spark, docs_of):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, TEXTS[5])]
    got = scan_licenses(docs_of(rows)).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), *map(str, brute(t))) for i, t in rows)
    assert sorted((str(r.doc_id), str(r.n_words), str(r.n_base), str(r.first_word), str(r.last_word),
                   r.base_labels) for r in got) == want
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1
    assert scan_licenses(docs_of([])).count() == 0


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    text = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for r in scan_licenses(docs).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(text[r.doc_id])


def test_expressions():
    assert to_postfix("MIT OR Apache-2.0 AND GPL-3.0") == ["MIT", "Apache-2.0", "GPL-3.0", "and", "or"]
    assert to_postfix("(MIT OR Apache-2.0) AND GPL-3.0") == ["MIT", "Apache-2.0", "or", "GPL-3.0", "and"]
    assert to_postfix("GPL-2.0-only WITH Classpath-exception-2.0 OR MIT */") == [
        "GPL-2.0-only", "Classpath-exception-2.0", "with", "MIT", "or"]
    assert to_postfix("MIT license text follows") == ["MIT"]
    assert evaluate("MIT OR GPL-3.0-only") == ({"mit", "gpl-3"}, True)
    assert evaluate("MIT AND GPL-3.0-only") == ({"mit", "gpl-3"}, False)
    assert evaluate("GPL-2.0-only WITH Classpath-exception-2.0") == ({"gpl-2"}, False)
    for broken in ("", "(", ")", "AND", "MIT AND", "OR MIT", "((MIT)", "MIT)", "( AND )"):
        evaluate(broken)
