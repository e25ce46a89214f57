"""Pattern search over lines (F7-F15) with match offsets.

The algorithm is chosen by the pattern list, like the reference:
regex -> ``rlike``; none -> no match; one literal -> ``contains``;
several literals -> any-match, with Aho-Corasick-style offsets.
The cheap predicate always runs first, so only matching lines pay for
their offsets.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markscope.functions.positions import (
    literal_positions,
    multi_positions,
    overlapping_positions,
    regex_positions,
)
from markscope.functions.text import col
from markscope.operators.lines import explode_lines

# The patterns searched when none are given.
DEFAULT_PATTERNS = ["[TODO]", "[DONE]"]

def _empty() -> Column:
    return F.array().cast("array<bigint>")




@dataclass(frozen=True)
class SearchOptions:
    ignore_case: bool = False
    regex: bool = False
    overlapping: bool = False  # single literal only (P2)


def tokenize_patterns(arg: str | None) -> list[str]:
    """a pattern argument is split on white space into patterns."""
    return arg.split() if arg else []


def pattern_tokens(df: DataFrame, arg_col: str, out_col: str = "pattern") -> DataFrame:
    """F15 as a DataFrame: one row per white-space separated token."""
    toks = F.filter(F.split(F.trim(F.col(arg_col)), r"\s+"), lambda t: t != "")
    rest = [c for c in df.columns if c != arg_col]
    return df.select(*rest, F.posexplode(toks).alias("token_no", out_col)) \
             .withColumn("token_no", F.col("token_no").cast("bigint"))


def _combined_regex(patterns: list[str]) -> str:
    pats = [p for p in patterns if p]
    return pats[0] if len(pats) == 1 else "|".join(f"(?:{p})" for p in pats)


def _prepared(line: Column, options: SearchOptions, patterns: list[str]):
    if options.ignore_case and not options.regex:
        return F.lower(line), [p.lower() for p in patterns]
    return line, list(patterns)


def match_predicate(line: str | Column, patterns: list[str],
                    options: SearchOptions = SearchOptions()) -> Column:
    """True when the line matches (any pattern)."""
    line = col(line)
    pats = [p for p in patterns if p]
    if not pats:
        return F.lit(False)
    if options.regex:
        rx = ("(?iu)" if options.ignore_case else "") + _combined_regex(pats)
        return line.rlike(rx)
    text, pats = _prepared(line, options, pats)
    pred = text.contains(pats[0])
    for p in pats[1:]:
        pred = pred | text.contains(p)
    return pred


def match_positions(line: str | Column, patterns: list[str],
                    options: SearchOptions = SearchOptions()) -> Column:
    """Byte offsets of the matches (into the lowered line when ignoring case)."""
    line = col(line)
    pats = [p for p in patterns if p]
    if not pats:
        return _empty()
    if options.regex:
        return regex_positions(line, _combined_regex(pats), options.ignore_case)
    text, pats = _prepared(line, options, pats)
    if len(pats) == 1:
        if options.overlapping:
            return overlapping_positions(text, pats[0])
        return literal_positions(text, pats[0])
    return multi_positions(text, pats)


def grep(lines: DataFrame, patterns: list[str] | None = None,
         options: SearchOptions = SearchOptions(), line_col: str = "line",
         pos_col: str = "position") -> DataFrame:
    """Matching lines with a ``position`` array.

    ``patterns=None`` searches the defaults ``[TODO]``/``[DONE]`` (F13);
    an empty list matches nothing (F14).
    """
    pats = DEFAULT_PATTERNS if patterns is None else list(patterns)
    hit = lines.where(match_predicate(line_col, pats, options))
    return hit.withColumn(pos_col, match_positions(line_col, pats, options))


def grep_documents(docs: DataFrame, patterns: list[str] | None = None,
                   options: SearchOptions = SearchOptions(), text_col: str = "text",
                   keep: list[str] | None = None) -> DataFrame:
    """Grep straight from a document table.

    For literal patterns a document that does not contain any pattern cannot
    hold a matching line, so documents are filtered before they are split
    into lines (the filter reaches the parquet scan as ``StringContains``).
    A regex is tested on lines only: what it matches in a whole document and
    in a line can differ.
    """
    pats = DEFAULT_PATTERNS if patterns is None else list(patterns)
    if not options.regex:
        docs = docs.where(match_predicate(text_col, pats, options))
    lines = explode_lines(docs, text_col=text_col, keep=keep)
    return grep(lines, pats, options)
