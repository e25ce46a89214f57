"""Text helpers: regex quoting, display trim, highlighting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ANSI colour used to highlight a match, and the reset code.
HIGHLIGHT_ON = "\x1b[31m"
HIGHLIGHT_OFF = "\x1b[0m"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def java_quote(s: str) -> str:
    """Quote a literal for a Java regex, like ``Pattern.quote``."""
    return "\\Q" + s.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def literal_alternation(patterns: list[str]) -> str:
    """One Java regex that matches any of the literals."""
    return "|".join(java_quote(p) for p in patterns if p)


def trim_start(line: str | Column) -> Column:
    """Left trim of Unicode white space (the White_Space property), as used
    by the plain and tree reports (X8)."""
    return F.regexp_replace(col(line), r"(?U)^\s+", "")


def highlight(line: str | Column, patterns: list[str], ignore_case: bool = True) -> Column:
    """Wrap every match of any literal in ANSI red.

    Patterns are quoted (the reference joined them unquoted with a space;
    see README "decisions").
    """
    alt = literal_alternation(patterns)
    if not alt:
        return col(line)
    flags = "(?iu)" if ignore_case else ""
    return F.regexp_replace(col(line), f"{flags}({alt})",
                            F.lit(HIGHLIGHT_ON + "$1" + HIGHLIGHT_OFF))
