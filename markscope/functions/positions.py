"""Match-offset operators (P1-P7): string -> array of UTF-8 byte offsets.

All offsets are byte offsets into the (possibly lower-cased) line, like the
reference.  Everything is built from ``split`` / ``regexp_extract_all`` and
left folds (``aggregate``) in blocks, so it runs inside the JVM, in time in
proportion to the matches of a line.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from markscope.functions.text import col, java_quote

def _empty() -> Column:
    return F.array().cast("array<bigint>")


def _nbytes(s: str) -> int:
    return len(s.encode("utf-8"))


#: Items folded in one go. Adding to an array copies it, so long arrays are folded in blocks
#: whose results are joined at the end: the work stays in proportion to the number of items.
BLOCK = 128


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def folded(items: Column, start: Column, step, emit) -> Column:
    """The non-NULL ``emit(state, item)`` of a left fold over an array, as array<bigint>."""

    def fold(state: Column, part: Column) -> Column:
        def add(acc, x):
            e = emit(acc["s"], x)
            return F.struct(step(acc["s"], x).alias("s"),
                            F.when(e.isNull(), acc["a"]).otherwise(F.concat(acc["a"], F.array(e))).alias("a"))
        return F.aggregate(part, F.struct(state.alias("s"), _empty().alias("a")), add)

    def in_blocks(all_items: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), ((F.size(all_items) - 1) / BLOCK).cast("int")),
                             lambda i: F.slice(all_items, i * BLOCK + 1, BLOCK))
        lists = F.array().cast("array<array<bigint>>")
        return F.aggregate(blocks, F.struct(start.alias("s"), lists.alias("l")),
                           lambda acc, part: let(fold(acc["s"], part), lambda r: F.struct(
                               r["s"].alias("s"), F.concat(acc["l"], F.array(r["a"])).alias("l"))),
                           lambda acc: F.flatten(acc["l"]))

    return let(items, lambda all_items: F.when(F.size(all_items) <= BLOCK, fold(start, all_items)["a"])
               .otherwise(in_blocks(all_items)))


def _part_ends(parts: Column, gap: int) -> Column:
    """Byte offset where each part but the last ends, parts being separated by ``gap`` bytes."""
    return let(folded(parts, F.lit(0).cast("bigint"),
                      lambda o, x: o + F.octet_length(x) + F.lit(gap),
                      lambda o, x: o + F.octet_length(x)),
               lambda ends: F.slice(ends, 1, F.size(ends) - 1))


def literal_positions(line: str | Column, pattern: str) -> Column:
    """Non-overlapping occurrences, left to right, jumping by the pattern."""
    if not pattern:
        return _empty()
    return _part_ends(F.split(col(line), java_quote(pattern), -1), _nbytes(pattern))


def overlapping_positions(line: str | Column, pattern: str) -> Column:
    """Every occurrence, advancing by one character.

    A split on a zero-width look-ahead cuts the line in front of each
    occurrence; Java never cuts at offset 0, so that case is added back.
    """
    if not pattern:
        return _empty()
    line = col(line)
    starts = _part_ends(F.split(line, f"(?={java_quote(pattern)})", -1), 0)
    return F.when(line.startswith(pattern),
                  F.concat(F.array(F.lit(0).cast("bigint")), starts)).otherwise(starts)


def first_position(line: str | Column, pattern: str) -> Column:
    """Byte offset of the first occurrence, NULL when there is none."""
    line = col(line)
    if not pattern:
        return F.lit(None).cast("bigint")
    idx = F.instr(line, pattern)
    return F.when(idx > 0, F.octet_length(F.substring(line, F.lit(1), idx - 1)).cast("bigint"))


def multi_positions(line: str | Column, patterns: list[str]) -> Column:
    """Multi-literal offsets with standard Aho-Corasick semantics.

    Non-overlapping, left to right: the occurrence that ends first wins, the
    longest one on ties, and the scan restarts where the match ended.  We list
    all occurrences of all patterns, sort by (end, -length) and fold greedily.
    """
    pats = sorted({p for p in patterns if p})
    if not pats:
        return _empty()
    if len(pats) == 1:
        return literal_positions(line, pats[0])
    if substring_free(pats):
        # No pattern occurs inside another, so the occurrence that ends
        # first is also the one that starts first: a left-to-right regex
        # scan over the alternation gives the same matches in one pass.
        # a look-ahead on the first characters lets most positions fail fast
        first = "".join(sorted({p[0] for p in pats}))
        cls = "".join("\\" + ch if ch in "\\[]^-&" else ch for ch in first)
        return regex_positions(line, f"(?=[{cls}])(?:" + "|".join(java_quote(p) for p in pats) + ")")
    line = col(line)
    occ = []
    def occurrence(n):
        # one-argument lambda: PySpark reads the arity from the signature
        return lambda s: F.struct((s + n).alias("e"), F.lit(-n).alias("nn"), s.alias("s"))

    for p in pats:
        occ.append(F.transform(overlapping_positions(line, p), occurrence(_nbytes(p))))
    ordered = F.array_sort(F.concat(*occ))
    return folded(ordered, F.lit(0).cast("bigint"),
                  lambda last, x: F.when(x["s"] >= last, x["e"]).otherwise(last),
                  lambda last, x: F.when(x["s"] >= last, x["s"]))


def substring_free(patterns: list[str]) -> bool:
    """True when no pattern is a substring of another one."""
    ps = sorted(set(patterns), key=len)
    return not any(a in b for i, a in enumerate(ps) for b in ps[i + 1:])


def regex_positions(line: str | Column, regex: str, ignore_case: bool = False) -> Column:
    """P5: start offsets of successive regex matches (Java regex dialect).

    One left-to-right search marks every match; the byte lengths of the
    pieces between marks add up to the offsets.  Patterns that can match the
    empty string are not supported (Java and Rust disagree on them).
    """
    line = col(line)
    rx = ("(?iu)" if ignore_case else "") + regex
    # One regex pass: put a NUL in front of every match and cut there (a
    # one-character split takes Java's non-regex path); the cut points are
    # the offsets.  A line that already holds a NUL takes the two-pass way.
    marked = F.split(F.regexp_replace(line, rx, F.lit(_MARK + "$0")), _MARK, -1)
    return F.when(F.instr(line, _MARK) > 0, _regex_positions_two_pass(line, rx)) \
            .otherwise(_part_ends(marked, 0))


_MARK = "\u0000"


def _regex_positions_two_pass(line: Column, rx: str) -> Column:
    parts = F.split(line, rx, -1)
    matches = F.regexp_extract_all(line, F.lit(rx), 0)
    pairs = F.zip_with(parts, matches, lambda p, m: F.struct(p.alias("p"), m.alias("m")))
    zero = F.lit(0)
    return folded(pairs, F.lit(0).cast("bigint"),
                  lambda o, z: o + F.octet_length(z["p"]) + F.coalesce(F.octet_length(z["m"]), zero),
                  lambda o, z: F.when(z["m"].isNotNull(), o + F.octet_length(z["p"])))


def next_char_distance(chars: str | Column, start: str | Column | int, c: str) -> Column:
    """Distance from index ``start`` to the next ``c`` after it, 0 if none
    (character indexes, 0-based)."""
    start = F.lit(start) if isinstance(start, int) else col(start)
    p = F.position(F.lit(c), col(chars), start + 2)
    return F.when(p > 0, p - 1 - start).otherwise(F.lit(0))
