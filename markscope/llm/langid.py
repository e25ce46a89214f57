"""Language identification of code-switched text by a linear-chain CRF (op7).

Each word gets a language by forward-backward; a text's language is the one with the
largest share of its words' probability. The model is trained on the driver from at most
SAMPLE_DOCS labelled documents (by a hash of their text, shared out evenly over the languages; the
documented bound of the fit), whole texts; every document is then labelled in whole where it lives.

Results by case: null text or text without a letter is ``und`` with score 0; empty, very
long and repeated texts need no special case; without any labelled document everything is
``und``; ties go to the first language by name; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from markscope.llm import crf
from markscope.llm.common import ship

#: Documents that the model is fitted on, at most.
SAMPLE_DOCS = 600
_ASCII_LETTER = re.compile("[A-Za-z]")


def has_letter(text: str | None) -> bool:
    return bool(text) and (_ASCII_LETTER.search(text) is not None or any(c.isalpha() for c in text))


def per_language(rows: DataFrame, sample: int) -> list[Row]:
    """(text, lang) of at most ``sample`` distinct rows, the same number of each language where it has
    so many (with more languages than that, the most frequent ones). Texts are chosen by their
    hash; per language little more than its share of hashes is sorted."""
    hashed = rows.select("text", "lang", F.xxhash64("text").alias("__th"))
    sizes = (hashed.groupBy("lang").agg(F.approx_count_distinct("__th", 0.02).alias("n"))
             .orderBy(F.desc("n"), "lang").limit(sample).collect())
    if not sizes:
        return []
    share = max(1, sample // len(sizes))
    bounds = [(r["lang"], 2 ** 63 - 1 if r["n"] <= 2 * share else int(-2 ** 63 + 2 ** 64 * 1.5 * share / r["n"])) for r in sizes]
    limits = F.broadcast(rows.sparkSession.createDataFrame(bounds, "lang string, bound long"))  # at most ``sample`` rows
    near = hashed.select("lang", "__th").join(limits, "lang").where("__th <= bound").select("lang", "__th").distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("__th"))
    keys = near.withColumn("i", rank).where(F.col("i") <= share).select("lang", "__th").collect()
    chosen = F.broadcast(rows.sparkSession.createDataFrame(keys, "lang string, __th long"))
    found = hashed.join(chosen, ["lang", "__th"], "left_semi").dropDuplicates(["lang", "__th"])
    return found.orderBy("__th", "lang").select("text", "lang").collect()


def fit(labelled: DataFrame, sample: int = SAMPLE_DOCS) -> tuple[crf.Crf, list[str]]:
    """Model and its languages from labelled documents (text, lang)."""
    rows = per_language(labelled.where("text IS NOT NULL AND lang IS NOT NULL"), sample)
    langs = sorted({r["lang"] for r in rows})
    vocabulary, texts = crf.coded([r["text"] for r in rows])
    gold = [np.full(len(w), langs.index(r["lang"]), np.int32) for w, r in zip(texts, rows)]
    return crf.train(vocabulary, texts, gold, max(1, len(langs))), langs


def tag_languages(docs: DataFrame, model: crf.Crf, langs: list[str], keep: list[str]) -> DataFrame:
    """``keep`` columns, lang_pred, score (the language's share of the words' probability),
    n_lang_words, n_switches (neighbouring words whose likeliest languages differ)."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast((model, langs))
    rows = docs.select(*keep, "text")
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, langs = sent.value
        for b in batches:
            texts = b.column("text").to_pylist()
            pred, score, words, switches = [], [], [], []
            for lens, p in crf.marginals(model, texts):
                share = crf.by_text(lens, p) / np.maximum(lens, 1)[:, None]
                best = p.argmax(axis=1) if len(p) else np.zeros(0, np.int64)
                change = np.zeros((len(best), 1))
                change[1:, 0] = best[1:] != best[:-1]
                change[(np.cumsum(lens) - lens)[lens > 0], 0] = 0
                switches += crf.by_text(lens, change)[:, 0].astype(np.int64).tolist()
                words += lens.tolist()
                top = share.argmax(axis=1)
                for t, s, n in zip(top, share, lens):
                    ok = n and langs and has_letter(texts[len(pred)])
                    pred.append(langs[t] if ok else "und")
                    score.append(min(1.0, float(s[t])) if ok else 0.0)
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in keep], pa.array(pred, pa.string()), pa.array(score, pa.float64()),
                 pa.array(words, pa.int64()), pa.array(switches, pa.int64())],
                names=[*keep, "lang_pred", "score", "n_lang_words", "n_switches"])

    return rows.mapInArrow(run, ddl + ", lang_pred string, score double, n_lang_words long, n_switches long")
