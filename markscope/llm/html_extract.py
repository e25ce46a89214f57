"""Main-text extraction by a recurrent block labeller (op5).

A page becomes the sequence of its leaf blocks. A bidirectional LSTM in numpy reads, for
each block, a tag-path vector (hashed tag, class, id and role words of its ancestors), a
hashed-word vector and a few measures, and labels every block as main text or not with
the whole page as context. The blocks labelled as main text are the page's text.

No labels are given, so the model is trained on the driver from at most SAMPLE_PAGES pages
(by a hash; the documented bound) with the labels that their markup suggests, and on
variations of them: articles moved into other containers, and foreign blocks set into
comments, notices, side bars, forms and the like, so that it learns the names and the
places instead of one template. Every page is then labelled in whole where it lives.

Results by case: null, empty or textless pages give an empty text; a page of one block is
labelled like any other; long pages are read whole; equal rows give equal rows; an empty
table gives no row; other columns are ignored.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from markscope.llm.common import sampled_texts, ship
from markscope.llm.crf import time_major
from markscope.llm.html_blocks import Block, page_blocks

#: Pages that the model is fitted on, at most.
SAMPLE_PAGES = 200
PATH_DIM, WORD_DIM, HIDDEN = 64, 16, 16
STEP_PAGES = 500

#: Names of containers that hold no main text; used for training labels only.
ASIDE = frozenset("nav header footer aside form menu button dialog .nav .menu .header .footer .sidebar .side .ad .ads "
                  ".advert .banner .promo .sponsor .cookie .consent .notice .comment .comments .reply .share .social "
                  ".related .breadcrumb .newsletter .subscribe .login .search .popup .widget .navigation .copyright".split())
MAIN = frozenset("article main .article .content .post .entry .story .main .body".split())
_WORD = re.compile(r"\w+")

_FRAMES = [("nav",), ("footer",), ("aside",), ("aside", ".sidebar"), ("div", ".sidebar"), ("div", ".ad"),
           ("div", ".advert"), ("div", ".cookie", ".notice"), ("div", ".banner"), ("section", ".comments"),
           ("div", ".comments", "div", ".comment"), ("ul", ".comments", "li", ".comment"), ("form",),
           ("form", ".newsletter"), ("header",), ("div", ".header"), ("div", ".footer"), ("div", ".related"),
           ("div", ".share"), ("div", ".promo"), ("ul", ".menu", "li"), ("div", ".breadcrumb"), ("div", ".notice")]
_HOMES = [("article",), ("main",), ("main", "article"), ("div", ".content"), ("div", ".post"), ("div", ".entry", ".content"),
          ("div", ".article", ".body"), ("section", ".story"), ("div", ".main"), ("article", ".post")]


def _bucket(name: str, n: int) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % n


def features(blocks: list[Block]) -> np.ndarray:
    """One row per block: path, words, measures."""
    x = np.zeros((len(blocks), PATH_DIM + WORD_DIM + 6))
    for i, b in enumerate(blocks):
        for name in b.path:
            h = _bucket(name, 4 * PATH_DIM)
            x[i, h % PATH_DIM] += 1 if h < 2 * PATH_DIM else -1
        words = _WORD.findall(b.text)
        for w in words:
            h = _bucket(w.lower(), 2 * WORD_DIM)
            x[i, PATH_DIM + h % WORD_DIM] += (1 if h < WORD_DIM else -1) / (len(words) + 1)
        x[i, -6:] = (np.log1p(len(b.text)) / 6, np.log1p(len(words)) / 5, b.linked / len(b.text),
                     sum(b.text.count(c) for c in ".,;!?") / (len(words) + 1), i / len(blocks), b.text[-1] in ".!?")
    return np.clip(x, -3, 3)


def suggested(b: Block, has_main: bool) -> int:
    """The label that a block's own markup suggests."""
    names = set(b.path)
    return int(not names & ASIDE and (not has_main or bool(names & MAIN)))


class Labeller:
    """Bidirectional LSTM with a logistic output; parameters in one dictionary."""

    def __init__(self, seed: int = 0):
        r = np.random.default_rng(seed)
        d = PATH_DIM + WORD_DIM + 6
        self.p = {"out": r.normal(0, 0.3, 2 * HIDDEN + d), "b": np.zeros(1)}
        for k in "fb":
            self.p["w" + k] = r.normal(0, 0.2, (d + HIDDEN, 4 * HIDDEN))
            self.p["c" + k] = np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)

    @staticmethod
    def _steps(lens: np.ndarray, back: bool) -> tuple[np.ndarray, np.ndarray]:
        """Rows in the order of the steps (of the reversed pages if ``back``), texts per step."""
        order, active = time_major(lens)
        if back:
            ends = np.repeat(np.cumsum(lens), lens)
            starts = ends - np.repeat(lens, lens)
            order = (starts + ends - 1 - np.arange(len(ends)))[order]
        return order, active

    def _run(self, k: str, x: np.ndarray, active: np.ndarray):
        w, c0 = self.p["w" + k], self.p["c" + k]
        d = x.shape[1]
        pre = x @ w[:d] + c0
        at = np.concatenate(([0], np.cumsum(active)))
        gates, cell, hid = np.empty_like(pre), np.empty((len(x), HIDDEN)), np.empty((len(x), HIDDEN))
        for t, n in enumerate(active):
            lo, hi = at[t], at[t + 1]
            z = pre[lo:hi]
            if t:
                z = z + hid[at[t - 1]:at[t - 1] + n] @ w[d:]
            g = np.empty_like(z)
            g[:, :3 * HIDDEN] = 1 / (1 + np.exp(-z[:, :3 * HIDDEN]))  # in, forget, out
            g[:, 3 * HIDDEN:] = np.tanh(z[:, 3 * HIDDEN:])
            c = g[:, :HIDDEN] * g[:, 3 * HIDDEN:]
            if t:
                c += g[:, HIDDEN:2 * HIDDEN] * cell[at[t - 1]:at[t - 1] + n]
            gates[lo:hi], cell[lo:hi], hid[lo:hi] = g, c, g[:, 2 * HIDDEN:3 * HIDDEN] * np.tanh(c)
        return gates, cell, hid, at

    def _back(self, k: str, x: np.ndarray, active: np.ndarray, saved, dh: np.ndarray):
        """Gradients of the direction's parameters, given those of its hidden states."""
        gates, cell, hid, at = saved
        w, d, H = self.p["w" + k], x.shape[1], HIDDEN
        dz_all = np.empty_like(gates)
        dw_h = np.zeros((H, 4 * H))
        dh, dc_all = dh.copy(), np.zeros_like(cell)
        for t in range(len(active) - 1, -1, -1):
            lo, hi, n = at[t], at[t + 1], active[t]
            g, tc = gates[lo:hi], np.tanh(cell[lo:hi])
            dc = dc_all[lo:hi] + dh[lo:hi] * g[:, 2 * H:3 * H] * (1 - tc * tc)
            dz = np.empty_like(g)
            dz[:, :H] = dc * g[:, 3 * H:] * g[:, :H] * (1 - g[:, :H])
            dz[:, 2 * H:3 * H] = dh[lo:hi] * tc * g[:, 2 * H:3 * H] * (1 - g[:, 2 * H:3 * H])
            dz[:, 3 * H:] = dc * g[:, :H] * (1 - g[:, 3 * H:] ** 2)
            if t:
                b = at[t - 1]
                dz[:, H:2 * H] = dc * cell[b:b + n] * g[:, H:2 * H] * (1 - g[:, H:2 * H])
                dc_all[b:b + n] = dc * g[:, H:2 * H]
                dh[b:b + n] += dz @ w[d:].T
                dw_h += hid[b:b + n].T @ dz
            else:
                dz[:, H:2 * H] = 0
            dz_all[lo:hi] = dz
        return np.concatenate([x.T @ dz_all, dw_h]), dz_all.sum(axis=0)

    def _forward(self, x: np.ndarray, lens: np.ndarray):
        keep, h = {}, np.empty((len(x), 2 * HIDDEN))
        for i, k in enumerate("fb"):
            order, active = self._steps(lens, k == "b")
            saved = self._run(k, x[order], active)
            h[order, i * HIDDEN:(i + 1) * HIDDEN] = saved[2]
            keep[k] = (order, active, saved)
        full = np.c_[h, x]
        return 1 / (1 + np.exp(-np.clip(full @ self.p["out"] + self.p["b"], -30, 30))), full, keep

    def label(self, x: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Probability of main text for each block; pages stand one after another."""
        return self._forward(x, lens)[0] if len(x) else np.zeros(0)

    def fit(self, x: np.ndarray, lens: np.ndarray, y: np.ndarray, steps: int = 120, rate: float = 0.03) -> None:
        """Adam over all pages at once."""
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        for s in range(1, steps + 1):
            p, full, keep = self._forward(x, lens)
            e = (p - y) / len(y)
            g = {"out": full.T @ e + 1e-4 * self.p["out"], "b": np.array([e.sum()])}
            dh = e[:, None] * self.p["out"][:2 * HIDDEN]
            for i, k in enumerate("fb"):
                order, active, saved = keep[k]
                g["w" + k], g["c" + k] = self._back(k, x[order], active, saved, dh[order, i * HIDDEN:(i + 1) * HIDDEN])
            for k, gk in g.items():
                m[k] = 0.9 * m[k] + 0.1 * gk
                v2[k] = 0.99 * v2[k] + 0.01 * gk * gk
                self.p[k] -= rate * (m[k] / (1 - 0.9 ** s)) / (np.sqrt(v2[k] / (1 - 0.99 ** s)) + 1e-8)


def varied(blocks: list[Block], labels: list[int], others: list[str], r: random.Random) -> tuple[list[Block], list[int]]:
    """A variation of a page: its main text in another container, foreign blocks around and in it."""
    home = r.choice(_HOMES)
    out: list[tuple[Block, int]] = []
    for b, y in zip(blocks, labels):
        if y:
            tail = b.path[-1:] if b.path and b.path[-1] not in MAIN else ("p",)
            b = Block(b.text, ("html", "body", *home, *tail), b.linked)
        out.append((b, y))
    for _ in range(r.randrange(1, 5)):
        frame, inside = r.choice(_FRAMES), r.random() < 0.4
        text = r.choice(others)
        linked = len(text) if frame[0] in ("nav", "ul") and r.random() < 0.7 else 0
        path = ("html", "body", *(home if inside else ()), *frame, *r.choice([(), ("p",), ("div",)]))
        at = r.choice([0, len(out)]) if not inside or r.random() < 0.5 else r.randrange(len(out) + 1)
        out[at:at] = [(Block(text, path, linked), 0)] * r.choice([1, 1, 2, 3])
    return [b for b, _ in out], [y for _, y in out]


def fit(pages: DataFrame, sample: int = SAMPLE_PAGES, seed: int = 7) -> Labeller:
    """A labeller from at most ``sample`` pages (html)."""
    rows = sampled_texts(pages.where("html IS NOT NULL"), sample, "html", [])
    seen = [b for b in (page_blocks(r["html"]) for r in rows) if b]
    model = Labeller()
    if not seen:
        return model
    r = random.Random(seed)
    others = [b.text for s in seen for b in s]
    data: list[tuple[list[Block], list[int]]] = []
    for s in seen:
        has_main = any(set(b.path) & MAIN for b in s)
        y = [suggested(b, has_main) for b in s]
        data += [(s, y), varied(s, y, others, r), varied(s, y, others, r)]
    lens = np.array([len(s) for s, _ in data], np.int64)
    model.fit(np.concatenate([features(s) for s, _ in data]), lens, np.concatenate([y for _, y in data]).astype(float))
    return model


def extract(pages: DataFrame, model: Labeller, keep: list[str]) -> DataFrame:
    """``keep`` columns, text (main text, blocks joined by a blank), n_chars, n_blocks, n_main."""
    spark = pages.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)
    rows = pages.select(*keep, "html")
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for whole in batches:
            for at in range(0, len(whole), STEP_PAGES):
                b = whole.slice(at, STEP_PAGES)
                blocks = [page_blocks(h) for h in b.column("html").to_pylist()]
                lens = np.array([len(x) for x in blocks], np.int64)
                full = lens[lens > 0]
                p = model.label(np.concatenate([features(x) for x in blocks if x]) if len(full) else np.zeros((0, 1)), full)
                ends = np.cumsum(lens)
                picked = [[x.text for x, s in zip(bl, p[e - n:e]) if s >= 0.5] for bl, n, e in zip(blocks, lens, ends)]
                text = [" ".join(t) for t in picked]
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(c) for c in keep], pa.array(text, pa.string()),
                     pa.array([len(t) for t in text], pa.int64()), pa.array(lens),
                     pa.array([len(t) for t in picked], pa.int64())],
                    names=[*keep, "text", "n_chars", "n_blocks", "n_main"])

    return rows.mapInArrow(run, ddl + ", text string, n_chars long, n_blocks long, n_main long")
