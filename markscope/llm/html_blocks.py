"""HTML pages as sequences of leaf blocks (helper of the extraction, op5)."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

#: Elements that do not break a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter q ruby s "
                   "samp small span strike strong sub sup time tt u var wbr".split())
#: Elements whose content is no text of the page.
HIDDEN = frozenset("script style noscript template head title textarea select option svg iframe object".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

#: Elements that can stand in head; any other one ends it, as the end tag is optional.
IN_HEAD = frozenset("head base basefont bgsound link meta noframes noscript script style template title".split())

#: Elements whose content is not read as markup.
RAW = frozenset("script style noscript template textarea iframe svg".split())
#: Elements with optional end tags: what each one ends, and what it does not look beyond.
_CELLS, _PARTS = frozenset(("td", "th")), frozenset(("thead", "tbody", "tfoot"))
IMPLIED = {"li": (frozenset(("li",)), frozenset(("ul", "ol", "menu"))),
           **dict.fromkeys(("dt", "dd"), (frozenset(("dt", "dd")), frozenset(("dl",)))),
           **dict.fromkeys(_CELLS, (_CELLS, frozenset(("tr", "table")))), "tr": (frozenset(("tr",)), frozenset(("table",))),
           **dict.fromkeys(_PARTS, (_PARTS, frozenset(("table",)))),
           "option": (frozenset(("option",)), frozenset(("select", "optgroup", "datalist")))}

_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_STOP = re.compile("""[>"']""")
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME = re.compile(r"[a-z0-9]+")


@dataclass
class Block:
    text: str  # references decoded, white space single
    path: tuple[str, ...]  # tags and class / id / role words, outermost first
    linked: int  # characters inside links


class _Tags:
    """The markup of a page, piece by piece: (start, end, end tag?, name, attributes, literal text).

    A tag ends at the first ``>`` outside quotes. A search that finds none remembers where it has
    been: a later one that comes to such a place ends there too, so all searches together
    go over the page a few times at most."""

    def __init__(self, page: str):
        self.page, self.dead = page, set()
        self.last = {q: page.rfind(q) for q in "\"'>"}

    def end_of_tag(self, at: int) -> int:
        """Where the tag whose attributes start at ``at`` ends, -1 if it does not."""
        page, seen = self.page, []
        while at <= self.last[">"] and (m := _STOP.search(page, at)):
            if m.start() in self.dead:
                break
            seen.append(m.start())
            at = m.end()
            if m[0] == ">":
                return at
            if m.start() < self.last[m[0]]:  # a quote that is never closed is like any other character
                at = page.index(m[0], at) + 1
        self.dead.update(seen)
        return -1

    def __iter__(self):
        page, at = self.page, self.page.find("<")
        while at >= 0:
            start, end, literal, tag = at, -1, None, None
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4) + 3
                end = end if end > 2 else len(page)
            elif page.startswith("<![CDATA[", at):
                close = page.find("]]>", at)
                literal, end = (page[at + 9:], len(page)) if close < 0 else (page[at + 9:close], close + 3)
            elif page[at + 1:at + 2] in ("!", "?"):
                end = page.find(">", at) + 1 if at < self.last[">"] else -1
            elif tag := _TAG.match(page, at):
                end = self.end_of_tag(tag.end())
            if end <= 0:
                at = page.find("<", at + 1)  # the sign itself
                continue
            if tag is None:
                yield start, end, False, None, "", literal
            else:
                name, attributes = tag[2].lower(), page[tag.end():end - 1]
                if name in RAW and not tag[1]:
                    raw = _RAW_END[name].search(page, end)
                    yield start, raw.end() if raw else len(page), False, None, "", None
                    end = raw.end() if raw else len(page)
                else:
                    yield start, end, bool(tag[1]), name, attributes, None
            at = page.find("<", end)


def page_blocks(page: str | None) -> list[Block]:
    """The page's blocks in order; runs of text between tags that break a block."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    text: list[str] = []
    state = [0, 0, 0]  # depth of hidden elements, open links, linked characters

    def close() -> None:
        if text:
            t = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if t:
                out.append(Block(t, tuple(n for _, names in stack for n in names), min(state[2], len(t))))
        state[2] = 0

    def add(raw: str) -> None:
        if raw and not state[0]:
            text.append(raw)
            if state[1]:
                state[2] += len(raw)

    open_tags: Counter[str] = Counter()

    def pop() -> str:
        tag = stack.pop()[0]
        open_tags[tag] -= 1
        state[0] -= tag in HIDDEN
        state[1] -= tag == "a"
        return tag

    def end_implied(ends: frozenset[str], stops: frozenset[str]) -> None:
        if any(open_tags[t] for t in ends):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ends:
                    while len(stack) > i:
                        pop()
                    return
                if stack[i][0] in stops:
                    return

    page = page or ""
    at = 0
    for start, end, closing, tag, attributes, literal in _Tags(page):
        add(page[at:start])
        at = end
        if literal is not None:
            add(html.escape(literal))
            continue
        if tag is None:
            continue
        if tag not in INLINE:
            close()
        if closing:
            if open_tags[tag]:
                while pop() != tag:
                    pass
            continue
        if tag not in IN_HEAD and open_tags["head"] and not (open_tags["title"] or open_tags["template"]
                                                             or open_tags["noscript"]):
            while pop() != "head":
                pass
        if tag in IMPLIED:
            end_implied(*IMPLIED[tag])
        if tag == "p" and open_tags["p"]:
            # a paragraph ends the one before it, unless a container stands between
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    while len(stack) > i:
                        pop()
                    break
                if stack[i][0] not in INLINE:
                    break
        if tag in VOID:
            continue
        names = [tag]
        for _, a, b, c in _ATTR.findall(attributes):
            names += ["." + w for w in _NAME.findall((a or b or c).lower())]
        stack.append((tag, tuple(names)))
        open_tags[tag] += 1
        state[0] += tag in HIDDEN
        state[1] += tag == "a"
    add(page[at:])
    close()
    return out
