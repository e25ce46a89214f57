"""Path functions (X1-X4) and glob / gitignore translation.

Paths are '/'-separated strings.  Only the translators run on the driver,
and only over rule text (a few rows), never over data.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from markscope.functions.text import col


def base_name(path: str | Column) -> Column:
    return F.regexp_extract(col(path), r"([^/]*)/*$", 1)


def extension(path: str | Column) -> Column:
    """Text after the last dot of the file name; '' when there is none.
    A leading dot does not start an extension (``.bashrc`` has none)."""
    return F.regexp_extract(base_name(path), r"^.+\.([^.]*)$", 1)


def directory(path: str | Column) -> Column:
    """Parent directory ('' for a bare file name, '/' under the root)."""
    p = col(path)
    d = F.regexp_extract(p, r"^(.*)/[^/]*$", 1)
    return F.when((d == "") & p.startswith("/"), F.lit("/")).otherwise(d)


def components(path: str | Column) -> Column:
    """Non-empty '/'-separated components."""
    return F.filter(F.split(col(path), "/"), lambda c: c != "")


def last_two(path: str | Column) -> Column:
    """The last component, then the one before it (at most two)."""
    return F.slice(F.reverse(components(path)), 1, 2)


def relative_display(dir_col: str | Column, path: str | Column) -> Column:
    """Path under its directory, behind one ``..`` per directory
    component beyond the third."""
    d, p = col(dir_col), col(path)
    under = F.when(p.startswith(F.concat(d, F.lit("/"))),
                   F.substring(p, F.length(d) + 2, 1 << 30)
                   ).otherwise(p)
    # a leading '/' counts as a component (the root), as in a path library
    n_comp = F.size(components(d)) + F.when(d.startswith("/"), 1).otherwise(0)
    n = F.greatest(n_comp - 3, F.lit(0))
    return F.concat(F.repeat(F.lit("../"), n), under)


def has_hidden_component(path: str | Column) -> Column:
    """some component starts with a dot."""
    return F.exists(components(path), lambda c: c.startswith("."))


def ancestors(path: str | Column) -> Column:
    """Every proper ancestor directory of a path, outermost first
    (``a/b/c.py`` -> ``[a, a/b]``)."""
    comps = components(path)
    prefixes = F.transform(F.sequence(F.lit(1), F.size(comps)),
                           lambda k: F.when(k < F.size(comps),
                                            F.array_join(F.slice(comps, F.lit(1), k), "/")))
    return F.filter(prefixes, lambda x: x.isNotNull())


# --- glob (S4) -------------------------------------------------------------

def glob_to_regex(glob: str) -> str:
    """Translate a shell glob into an anchored Java/RE2 regex.

    ``**/`` any directories, ``**`` anything, ``*`` within one component,
    ``?`` one character, ``[..]`` / ``[!..]`` classes; the rest is literal.
    """
    out, i, n = [], 0, len(glob)
    while i < n:
        c = glob[i]
        if glob.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif glob.startswith("**", i):
            out.append(".*")
            i += 2
        elif c == "*":
            out.append("[^/]*")
            i += 1
        elif c == "?":
            out.append("[^/]")
            i += 1
        elif c == "[":
            j = glob.find("]", i + 2)
            if j == -1:
                out.append(re.escape(c))
                i += 1
            else:
                body = glob[i + 1:j]
                if body.startswith("!"):
                    body = "^" + body[1:]
                out.append("[" + body.replace("\\", "\\\\") + "]")
                i = j + 1
        else:
            out.append(re.escape(c))
            i += 1
    return "^" + "".join(out) + "$"


# --- gitignore (F3) ----------------------------------------------------------

def gitignore_rule_regex(rule: str) -> tuple[str, bool, bool] | None:
    """One ``.gitignore`` line -> (regex over an entry's path relative to the
    ignore file's folder, negated, folders only); None for blanks and comments."""
    r = rule.rstrip("\r").rstrip(" ")
    if not r or r.startswith("#"):
        return None
    negated = r.startswith("!")
    if negated:
        r = r[1:]
    if r.startswith("\\"):
        r = r[1:]
    dir_only = r.endswith("/")
    r = r.rstrip("/")
    if not r:
        return None
    anchored = "/" in r
    r = r.lstrip("/")
    body = glob_to_regex(r)[1:-1]
    prefix = "^" if anchored else "^(?:.*/)?"
    return prefix + body + "$", negated, dir_only
