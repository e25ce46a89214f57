"""Licence scan (op10).

An Aho-Corasick automaton runs over the normalised words of a text and finds
notice phrases and identifier tags; the expression after a tag is evaluated by a
shunting-yard parser (``AND`` / ``OR`` / ``WITH`` / parentheses). Every row is
handled where it lives: no shuffle, no state between rows.

Results by case: null or empty text has no words, no places and empty label
lists; long texts are read whole; equal rows give equal rows; other columns of
the input are ignored. A broken expression yields the labels of its known parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from markscope.llm.common import ship

#: Fixed values of the contract: phrase -> label.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Phrases that this operator adds (words as they stand after normalisation).
MORE_PHRASES = {
    "gnu general public license version 3": "gpl-3",
    "gnu general public license version 2": "gpl-2",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "permission to use copy modify and or distribute this software": "isc",
    "eclipse public license": "epl",
    "creative commons attribution sharealike": "cc-by-sa",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0": "cc0",
    "all rights reserved": "all-rights-reserved",
}

TAG = "spdx license identifier"

#: Identifiers known to the expression parser: (pattern, label).
IDENTIFIERS = [
    (r"mit(-0)?", "mit"), (r"apache-2(\.0)?(-only|-or-later|\+)?", "apache-2"),
    (r"cc-by-nc(-[\d.]+)?", "cc-by-nc"), (r"cc-by-sa(-[\d.]+)?", "cc-by-sa"),
    (r"cc-by-nd(-[\d.]+)?", "cc-by-nd"), (r"cc-by(-[\d.]+)?", "cc-by"), (r"cc0(-[\d.]+)?", "cc0"),
    (r"gpl-3(\.0)?(-only|-or-later|\+)?", "gpl-3"), (r"gpl-2(\.0)?(-only|-or-later|\+)?", "gpl-2"),
    (r"lgpl-[\d.]+(-only|-or-later|\+)?", "lgpl"), (r"agpl-[\d.]+(-only|-or-later|\+)?", "agpl"),
    (r"mpl-[\d.]+", "mpl"), (r"bsd-\d-clause(-[a-z]+)?", "bsd"), (r"isc", "isc"),
    (r"epl-[\d.]+", "epl"), (r"unlicense", "unlicense"),
]
_KNOWN = [(re.compile(p + r"\Z"), label) for p, label in IDENTIFIERS]
#: Labels whose terms allow commercial reuse without opening one's own source.
PERMISSIVE = {"mit", "apache-2", "bsd", "isc", "cc0", "cc-by", "unlicense"}

# bytes outside 0-9, A-Z, a-z and >= 0x80 become blanks; A-Z become lower case
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
                for c in range(256))
_TAG_AT = re.compile(r"SPDX-License-Identifier\s*:[ \t]*([^\r\n]*)", re.I)
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9.+:_-]+")
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}

RESULT = ("doc_id long, n_words long, n_base long, first_word long, last_word long, "
          "base_labels string, labels string, score double, expression string, permissive boolean")


def identifier_label(name: str) -> str | None:
    low = name.lower()
    return next((label for p, label in _KNOWN if p.match(low)), None)


def to_postfix(expression: str) -> list[str]:
    """Shunting-yard: infix licence expression to postfix; stray parentheses and
    operators are skipped. Ends at the first word that cannot continue it."""
    out: list[str] = []
    ops: list[str] = []
    operand = False  # the last token read was an operand (or a closed group)
    for tok in _TOKEN.findall(expression):
        low = tok.lower()
        if low in _PRECEDENCE:
            if not operand:
                continue
            while ops and ops[-1] != "(" and _PRECEDENCE[ops[-1]] >= _PRECEDENCE[low]:
                out.append(ops.pop())
            ops.append(low)
            operand = False
        elif tok == "(":
            if operand:
                break
            ops.append(tok)
        elif tok == ")":
            if not operand or "(" not in ops:
                continue
            while ops[-1] != "(":
                out.append(ops.pop())
            ops.pop()
        else:
            if operand:
                break
            out.append(tok)
            operand = True
    if not operand and ops and ops[-1] != "(":
        ops.pop()  # an operator without a right side
    out.extend(o for o in reversed(ops) if o != "(")
    return out


def evaluate(expression: str) -> tuple[set[str], bool | None]:
    """Labels named by an expression, and whether it can be met by permissive
    licences alone (``or``: one side suffices; ``and``: both; ``with``: its left
    side decides). Nothing known: (empty set, None)."""
    labels: set[str] = set()
    stack: list[bool | None] = []
    for tok in to_postfix(expression):
        if tok in _PRECEDENCE:
            if len(stack) < 2:
                continue
            b, a = stack.pop(), stack.pop()
            if tok == "with":
                stack.append(a)
            elif tok == "or":
                stack.append(True if a or b else None if a is None or b is None else False)
            else:
                stack.append(False if a is False or b is False else None if a is None or b is None else True)
        else:
            label = identifier_label(tok)
            if label:
                labels.add(label)
            stack.append(None if label is None else label in PERMISSIVE)
    return labels, stack[-1] if stack else None


def automaton(base: dict[str, str] = BASE_PHRASES, more: dict[str, str] = MORE_PHRASES) -> ahocorasick.Automaton:
    """Automaton over blank-framed word sequences; values (words, label or None, is base)."""
    a = ahocorasick.Automaton()
    for p, label in {**more, **base}.items():
        a.add_word(f" {p} ", (p, label, p in base))
    a.add_word(f" {TAG} ", (TAG, None, False))
    a.make_automaton()
    return a


def scan_text(text: str | None, auto: ahocorasick.Automaton) -> tuple:
    """(n_words, n_base, first, last, base labels, all labels, score, expression, permissive)."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_NORMAL)
    words = raw.split()
    n = len(words)
    if not n:
        return 0, 0, None, None, "", "", 0.0, None, None
    line = " " + b" ".join(words).decode("utf-8", "surrogatepass") + " "
    starts: list[int] = []
    base: set[str] = set()
    labels: set[str] = set()
    tagged = False
    at, seen = 0, 0  # blanks before ``at`` are counted in ``seen``
    for end, (phrase, label, is_base) in auto.iter(line):
        if is_base:
            start = end - len(phrase) - 1  # the blank before the phrase
            if start >= at:
                seen += line.count(" ", at, start)
                at = start
                starts.append(seen)
            else:
                starts.append(line.count(" ", 0, start))
            base.add(label)
        if label:
            labels.add(label)
        else:
            tagged = True
    expression, permissive = None, None
    if tagged and text:
        found = _TAG_AT.findall(text)
        for e in found:
            got, ok = evaluate(e)
            labels |= got
            permissive = ok if permissive is None else permissive and bool(ok)
        expression = " ; ".join(e.strip() for e in found) or None
    if permissive is None and labels:
        permissive = labels <= PERMISSIVE
    # 1 when a tag or a base notice stands, 0.8 for another notice, 0 for none
    score = 1.0 if base or expression else 0.8 if labels else 0.0
    return (n, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
            ",".join(sorted(labels)), score, expression, permissive)


def scan_licenses(docs: DataFrame, base: dict[str, str] = BASE_PHRASES,
                  more: dict[str, str] = MORE_PHRASES) -> DataFrame:
    """One row per document (doc_id, text): counts, places, labels, expression."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton(base, more)
        schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()),
                            ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()),
                            ("labels", pa.string()), ("score", pa.float64()), ("expression", pa.string()),
                            ("permissive", pa.bool_())])
        for b in batches:
            rows = [scan_text(t.as_py(), auto) for t in b.column("text")]
            cols = list(zip(*rows)) if rows else [()] * 9
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *[pa.array(c, f.type) for c, f in zip(cols, list(schema)[1:])]], schema=schema)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, RESULT)
