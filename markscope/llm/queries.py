"""Registered queries of this subpackage: opN_<name> over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from markscope.llm.collocations import ORACLE as COLLOCATIONS_SQL
from markscope.llm.common import Scratch, table
from markscope.llm.decontaminate import ORACLE as DECONTAMINATE_SQL
from markscope.llm.line_index import ORACLE as LINES_SQL
from markscope.llm.ngram_join import ORACLE as NGRAM_SQL
from markscope.llm.resample import ORACLE as RESAMPLE_SQL
from markscope.llm.topk import ORACLE as TOPK_SQL


def tokenizer_path(name: str) -> str:
    """The file of a public tokenizer (the same path on all executors)."""
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    from markscope.llm.token_files import read_tokens, write_tokens
    path = Scratch(spark, "op1").path("tokens")
    write_tokens(table(spark, sf_dir, "documents"), path,
                 tokenizer or tokenizer_path("byte_bpe_50k.json"), end_id=0)
    return read_tokens(spark, path, with_ids=False)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from markscope.llm.ngram_join import ngram_components
    return (ngram_components(table(spark, sf_dir, "documents"), k=3, threshold=Fraction(9, 10))
            .select("doc_id", "n_shingles", "component_id"))


def op3_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    from markscope.llm.packing import pack_documents
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer or tokenizer_path("word_bpe_49k.json"),
                          end_id=1, size=2048, with_ids=False)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from markscope.llm.passages import repeats_by_document
    return repeats_by_document(table(spark, sf_dir, "documents"), min_words=50, k=5, threshold=Fraction(8, 10))


def op5_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from markscope.llm.html_extract import extract, fit
    pages = table(spark, sf_dir, "pages")
    return extract(pages, fit(pages), ["page_id", "url"])


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from markscope.llm.topk import search
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors.where("vec_id % 50 = 0"), vectors, k=5)


def _remainder(by: int) -> Column:
    """crc32(doc_id as text) mod ``by``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % by


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from markscope.llm.langid import fit, tag_languages
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(_remainder(3) == 1, F.lit(False))
    model, langs = fit(docs.where(~held))
    rows = docs.select("doc_id", held.alias("held_out"), "text")
    return tag_languages(rows, model, langs, ["doc_id", "held_out"])


def learnable(docs: DataFrame) -> DataFrame:
    """doc_id, text of the documents whose labels may be learned from."""
    return docs.where(_remainder(5) != 0).select("doc_id", "text")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from markscope.llm.toxicity import fit, score_toxicity
    docs = table(spark, sf_dir, "documents")
    model = fit(learnable(docs), table(spark, sf_dir, "labels"))
    held = F.coalesce(_remainder(5) == 0, F.lit(False))
    rows = docs.select("doc_id", held.alias("held_out"), "text")
    return score_toxicity(rows, model, ["doc_id", "held_out"]).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from markscope.llm.decontaminate import contamination
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("th")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from markscope.llm.licenses import scan_licenses
    return scan_licenses(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from markscope.llm.collocations import collocations
    return collocations(table(spark, sf_dir, "documents"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from markscope.llm.line_index import dedup_lines
    return dedup_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from markscope.llm.resample import resample
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files,
    "op2_ngram_join": op2_ngram_join,
    "op3_packing": op3_packing,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_extract": op5_extract,
    "op6_topk": op6_topk,
    "op7_langid": op7_langid,
    "op8_toxicity": op8_toxicity,
    "op9_decontaminate": op9_decontaminate,
    "op10_licenses": op10_licenses,
    "op11_collocations": op11_collocations,
    "op12_line_dedup": op12_line_dedup,
    "op13_resample": op13_resample,
}

ORACLE_SQL: dict[str, str] = {
    "op2_ngram_join": NGRAM_SQL,
    "op6_topk": TOPK_SQL,
    "op9_decontaminate": DECONTAMINATE_SQL,
    "op11_collocations": COLLOCATIONS_SQL,
    "op12_line_dedup": LINES_SQL,
    "op13_resample": RESAMPLE_SQL,
}
