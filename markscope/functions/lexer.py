"""Blanking strings and comments where a token depends on what came before it.

``blanked`` replaces every string, comment and literal with its own syntax by blanks (line breaks
stay), for the forms that one regular expression per token cannot tell apart: it keeps the previous
token (is a slash a division or the start of a pattern?), the open templates and interpolations,
the number of hashes of a raw string, the words of the here-documents that the line's end
starts, and the bracket depth at each open ``#if``. Every text is gone through once, in time in
proportion to its length; anything left open at the end is blanked to the end.

It works on one file's text and is called by ``operators.outline`` for files that hold such forms.
"""

from __future__ import annotations

import re

_RUN = re.compile(r"[^\n]+")


def _blank(s: str) -> str:
    return _RUN.sub(" ", s)


# --- JavaScript, TypeScript ---------------------------------------------------

_JS = re.compile(r"""\s+|//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|"(?:[^"\\\n]|\\[\s\S])*+"?|'(?:[^'\\\n]|\\[\s\S])*+'?"""
                 r"""|[\w$]+|\+\+|--|=>|[\s\S]""")
_JS_PATTERN = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/\w*")
_JS_TEXT = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*+\\?")
# words after which an operand follows, and words before the brackets of a control statement
_JS_BEFORE = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "instanceof",
              "await", "yield", "default", "extends"}
_JS_CONTROL = {"if", "while", "for", "with"}


def _script(text: str) -> str:
    out: list[str] = []
    open_: list[tuple[str, bool]] = []  # bracket and whether an operand may follow its end
    templates = pos = 0
    operand, last, bad_line = True, "", -1

    def template(at: int) -> int:
        """Blanks a template's text from ``at``; returns where code goes on."""
        nonlocal operand, templates
        end = _JS_TEXT.match(text, at).end()
        if text.startswith("${", end):
            open_.append(("`", False))
            templates += 1
            operand = True
            end += 2
        else:
            end += 1
            operand = False
        out.append(_blank(text[at:end]))
        return end

    while pos < len(text):
        m = _JS.match(text, pos)
        tok, start, pos = m[0], pos, m.end()
        c = tok[0]
        if c.isspace():
            out.append(tok)
            continue
        if tok[:2] in ("//", "/*") and len(tok) > 1:
            out.append(_blank(tok))
            continue
        if c == "`":
            out.append(" ")
            pos = template(pos)
            last = "`"
            continue
        if c in "\"'":
            out.append(_blank(tok))
            operand, last = False, "'"
            continue
        if tok == "/" and operand and start > bad_line:
            found = _JS_PATTERN.match(text, start)
            if found:
                out.append(" ")
                pos = found.end()
                operand, last = False, "/re/"
                continue
            bad_line = text.find("\n", start) % (len(text) + 1)  # not tried again on this line
        if tok == "}" and open_ and open_[-1][0] == "`":
            open_.pop()
            templates -= 1
            out.append(" ")
            pos = template(pos)
            last = "`"
            continue
        out.append(" " if templates else tok)
        if c in "([{":
            if c == "(":
                after = last in _JS_CONTROL
            else:  # the end of a block may be followed by a statement, that of an object by an operator
                after = c == "{" and (last in ("", ")", ";", "{", "}", "=>", "else", "do", "try", "finally")
                                      or (last[:1].isidentifier() and last not in _JS_BEFORE))
            open_.append((c, after))
            operand = True
        elif c in ")]}":
            operand = open_.pop()[1] if open_ else c == "}"
        elif c.isalnum() or c in "_$":
            operand = tok in _JS_BEFORE and last != "."
        elif tok not in ("++", "--"):
            operand = True
        last = tok
    return "".join(out)


# --- Rust -----------------------------------------------------------------------

_RS = re.compile(r"""//[^\n]*|/\*|(?<!\w)(?:br|cr|r)(\#*)"|"(?:[^"\\]|\\[\s\S])*+"?|'(?:\\[^'\n]{1,10}|\\'|[^'\\\n])'""")
_RS_COMMENT = re.compile(r"/\*|\*/")


def _rust(text: str) -> str:
    out: list[str] = []
    pos = 0
    while m := _RS.search(text, pos):
        out.append(text[pos:m.start()])
        pos = m.end()
        if m[0] == "/*":  # comments nest
            depth = 1
            while depth and (inner := _RS_COMMENT.search(text, pos)):
                depth += 1 if inner[0] == "/*" else -1
                pos = inner.end()
            pos = pos if not depth else len(text)
        elif m[1] is not None:
            end = text.find('"' + m[1], pos)
            pos = end + 1 + len(m[1]) if end >= 0 else len(text)
        out.append(_blank(text[m.start():pos]))
    return "".join(out) + text[pos:]


# --- C, C++ -----------------------------------------------------------------------

_CPP = re.compile(r"""//(?:[^\\\n]|\\[\s\S])*+|/\*[\s\S]*?(?:\*/|\Z)|(?<!\w)(?:u8|[uUL])?R"([^()\\\s]{0,16})\("""
                  r"""|"(?:[^"\\\n]|\\[\s\S])*+"?|(?<![\w.])\d(?:[.']?\w)*+|'(?:[^'\\\n]|\\[\s\S])*+'?"""
                  r"""|^[ \t]*\#[ \t]*(\w*)(?:[^\\\n/]|\\[\s\S]|/(?!\*))*+""", re.M)
_PAIRS = ("{}", "()", "[]")


def _balance(have: list[int], want: list[int]) -> str:
    """Brackets that lead from one depth to another."""
    return "".join(p[0] * (w - h) if w > h else p[1] * (h - w) for p, h, w in zip(_PAIRS, have, want))


def _cpp(text: str) -> str:
    """Directives are blanked too. Each branch of a conditional starts at the depth of its ``#if``;
    after the ``#endif`` the depth of the branch that changed it most holds (the first of such)."""
    out: list[str] = []
    depth = [0, 0, 0]
    ifs: list[list] = []  # depth at the #if, largest change of an ended branch
    pos = 0

    def code(part: str) -> None:
        out.append(part)
        for i, (a, b) in enumerate(_PAIRS):
            depth[i] += part.count(a) - part.count(b)

    while m := _CPP.search(text, pos):
        code(text[pos:m.start()])
        pos = m.end()
        if m[1] is not None:
            end = text.find(f'){m[1]}"', pos)
            pos = end + 2 + len(m[1]) if end >= 0 else len(text)
        tok, word = m[0], m[2]
        if word is None and tok[0].isdigit():
            out.append(tok)
            continue
        out.append(_blank(text[m.start():pos]))
        if word in ("if", "ifdef", "ifndef"):
            ifs.append([depth[:], None])
        elif ifs and word in ("else", "elif", "elifdef", "elifndef", "endif"):
            start, most = ifs[-1]
            change = [d - s for d, s in zip(depth, start)]
            if most is None or sum(map(abs, change)) > sum(map(abs, most)):
                most = change
            target = start if word != "endif" else [s + c for s, c in zip(start, most)]
            out.append(_balance(depth, target))
            depth[:] = target
            if word == "endif":
                ifs.pop()
            else:
                ifs[-1][1] = most
    return "".join(out) + text[pos:]


# --- Ruby ---------------------------------------------------------------------------

_RB = re.compile(r"[ \t\r\f\v]+|\n|\#[^\n]*|[^\W\d]\w*[?!]?(?!=)|[^\W\d]\w*|\d[\w.]*|<<|=>|[\s\S]")
_RB_BEFORE = {"if", "unless", "while", "until", "and", "or", "not", "return", "when", "case", "then", "else", "elsif", "do",
              "in", "yield", "begin", "ensure", "rescue", "puts"}
_RB_HEREDOC = re.compile(r"<<([~-]?)([\"'`]?)([^\W\d]\w*)\2")
_RB_PERCENT = re.compile(r"%([qQwWiIrxs]?)([^\w\s])")
_RB_PATTERN = re.compile(r"/(?:[^/\\\n]|\\.)*+/|/[ \t]*\n")
_RB_CHAR = re.compile(r"\?(?:\\.|[^\s\\])(?!\w)")
_RB_BLOCK = re.compile(r"=begin\b[\s\S]*?(?:^=end[^\n]*|\Z)", re.M)
_RB_END = re.compile(r"__END__[ \t\r]*(?:\n|\Z)")
_CLOSERS = {"(": ")", "[": "]", "{": "}", "<": ">"}


def _inside(close: str, opener: str, interpolated: bool) -> re.Pattern:
    return re.compile("|".join([r"\\[\s\S]", *([r"\#\{"] if interpolated else []), *([re.escape(opener)] if opener else []),
                                re.escape(close)]))  # ``re`` keeps compiled patterns


def _ruby(text: str) -> str:
    out: list[str] = []
    frames: list[list] = []  # [kind, ...]: open strings ("s", regex, opener, close, depth), interpolations ("c", braces)
    here: list[tuple[str, bool]] = []  # words of here-documents that start at the line's end
    ends: dict[tuple[str, bool], list[int]] = {}
    pos, operand, name, last, space = 0, True, False, "", False

    def terminators(word: str, indented: bool) -> re.Pattern:
        return re.compile(rf"^{'[ \t]*' if indented else ''}{re.escape(word)}[ \t]*\r?$", re.M)

    def ends_after(word: str, indented: bool, at: int) -> bool:
        """Is there a line that ends the here-document? (Its last place is looked up once per word.)"""
        if (word, indented) not in ends:
            ends[word, indented] = [x.start() for x in terminators(word, indented).finditer(text)][-1:] or [-1]
        return ends[word, indented][0] > at

    def string(opener: str, close: str, interpolated: bool) -> None:
        frames.append(["s", _inside(close, opener, interpolated), opener, close, 1])

    while pos < len(text):
        if frames and frames[-1][0] == "s":
            f = frames[-1]
            m = f[1].search(text, pos)
            end = m.end() if m else len(text)
            out.append(_blank(text[pos:end]))
            pos = end
            if m and m[0] == "#{":
                frames.append(["c", 0])
                operand = True
            elif m and m[0][0] != "\\":
                f[4] += 1 if m[0] == f[2] and f[2] else -1
                if not f[4]:
                    frames.pop()
                    operand, name, last = False, False, '"'
            space = False
            continue
        m = _RB.match(text, pos)
        tok, start, pos = m[0], pos, m.end()
        c, ahead = tok[0], text[pos:pos + 1]
        at_line = start == 0 or text[start - 1] == "\n"
        if at_line and c == "=" and (block := _RB_BLOCK.match(text, start)):
            out.append(_blank(block[0]))
            pos = block.end()
            continue
        if at_line and tok == "__END__" and _RB_END.match(text, start):
            out.append(_blank(text[start:]))
            break
        if tok == "\n":
            out.append(tok)
            for word, indented in here:
                body = terminators(word, indented).search(text, pos)
                end = body.end() if body else len(text)
                out.append(_blank(text[pos:end]))
                pos = end
            here, operand, space, last = [], True, True, "\n"
            continue
        if c in " \t\r\f\v":
            out.append(tok)
            space = True
            continue
        if c == "#":
            out.append(" ")
            continue
        # a name followed by a blank and an operator that touches the next token takes an argument
        argument = operand or (name and space and ahead not in (" ", "=", "\n", "\t", ""))
        was, space = space, False
        if last == "def" and c in "/%`<":
            out.append(tok)  # the name of an operator method
            operand, last = False, tok
            continue
        literal = None
        if c in "\"`":
            literal = ("", c, True)
        elif c == "'":
            literal = ("", c, False)
        elif c == "%" and argument and (p := _RB_PERCENT.match(text, start)):
            literal = (p[2] if p[2] in _CLOSERS else "", _CLOSERS.get(p[2], p[2]), p[1] not in ("q", "w", "i", "s"))
            pos = p.end()
        elif c == "/" and argument and _RB_PATTERN.match(text, start) and text.find("/", pos) > 0:
            literal = ("", "/", True)
        elif c == "?" and operand and (p := _RB_CHAR.match(text, start)):
            out.append(" ")
            pos = p.end()
            operand, name, last = False, False, "?"
            continue
        elif tok == "<<" and (p := _RB_HEREDOC.match(text, start)) and last != "class":
            marked = bool(p[1] or p[2])
            if (operand or marked or (name and was and p[3][0].isupper())) and ends_after(p[3], bool(p[1]), start):
                here.append((p[3], bool(p[1])))
                out.append(" ")
                pos = p.end()
                operand, name, last = False, False, '"'
                continue
        if literal:
            out.append(" ")
            string(*literal)
            continue
        if frames and c == "{":
            frames[-1][1] += 1
        elif frames and c == "}":
            if not frames[-1][1]:
                frames.pop()
                out.append(" ")
                continue
            frames[-1][1] -= 1
        out.append(" " if frames else tok)
        word = c.isidentifier()
        name = word and tok not in _RB_BEFORE
        operand = (word and tok in _RB_BEFORE and last != ".") or not (word or c.isdigit() or c in ")]}")
        last = tok
    return "".join(out)


_BY_LANGUAGE = {"javascript": _script, "typescript": _script, "rust": _rust, "cpp": _cpp, "ruby": _ruby}


def blanked(text: str, language: str) -> str:
    """``text`` with strings, comments and (C, C++) directives blanked; other languages as they are."""
    return _BY_LANGUAGE.get(language, lambda t: t)(text)
