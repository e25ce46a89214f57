"""Cleaning a corpus of documents: toxicity, near duplicates, repeated passages, benchmark
passages, then packing. ``run(spark, sf_dir)`` applies the stages to ``documents``; each
stage's result is written as Parquet and read again as the next one's documents.

Each stage function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
keep the columns of the documents.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession

from markscope.llm.common import Scratch, table
from markscope.llm.queries import learnable, tokenizer_path


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the tagger (fitted on ``labels``) scores 0.5 or more."""
    from markscope.llm.toxicity import drop_toxic, fit
    return drop_toxic(docs, fit(learnable(docs), table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: Jaccard 0.8 or more over five-word shingles."""
    from markscope.llm.ngram_join import keep_one_per_component
    return keep_one_per_component(docs, k=5, threshold=Fraction(8, 10))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages and paragraphs of 50 words or more that an earlier document has."""
    from markscope.llm.passages import drop_repeats
    return drop_repeats(docs, min_words=50, k=5, threshold=Fraction(8, 10))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents contaminated by ``benchmark``."""
    from markscope.llm.decontaminate import drop_contaminated
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 2048 tokens: one row per piece."""
    from markscope.llm.packing import pack_documents
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"), end_id=1, size=2048, with_ids=False)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages),
          ("decontamination", decontamination), ("packing", packing)]

#: The first stage is a fitted model; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
