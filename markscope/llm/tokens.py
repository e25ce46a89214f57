"""Tokenising whole texts with a public tokenizer file, a batch at a time.

Texts are cut in front of blanks; no pre-token of the supported files reaches
back across such a cut (their patterns have no look-behind, and a run of white
space is only ever joined to what follows it), so the ids of a text are the ids
of its pieces in turn. Pieces repeat a lot: a batch's distinct pieces are found
by dictionary coding and encoded once each by the ``tokenizers`` library. A piece
that is one plain word (with punctuation behind it, perhaps with a second word on a
new line) goes to the library's model as those pre-tokens, each distinct one once:
Arrow takes pieces apart, except those with accented capitals, which Python has to
lower. Any other piece goes through the library whole. ``tests/llm/test_tokens.py`` holds all of this against
encoding whole texts.
"""

from __future__ import annotations

import json
import os
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# the white space of the tokenizers' own patterns (Unicode White_Space)
_WS = "\t-\r \x85\xa0  -     　"
_CHUNK = re.compile(f"[{_WS}]*[^{_WS}]+|[{_WS}]+")
# a blank that continues a run of white space: no cut in front of it
_BLANK_AFTER_WS = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "
_LETTERS = "[A-Za-zÀ-ÖØ-öø-ÿ]+"
_PLAIN = re.compile(rf"( ?)({_LETTERS})([.,]?)(?:\n({_LETTERS})([.,]?))?").fullmatch
# for Arrow: no capitals but ASCII ones, any run of ASCII punctuation (an apostrophe can start a pre-token)
_SMALL = "[A-Za-zß-öø-ÿ]+"
_MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")
_MARK = r"[!-&(-/:-@\[-`{-~]*"
_PLAIN_SMALL = rf"\A ?{_SMALL}{_MARK}(?:\n{_SMALL}{_MARK})?\z"
_NO_MARKS = " " + "".join(chr(c) for c in range(256) if re.match(_SMALL, chr(c)))

#: Words kept per worker (about 250 bytes each); later ones live for one step.
CACHE_WORDS = 300_000
#: Bytes handled at once; bounds the arrays of one step (a longer text is a step of its own).
SLICE_BYTES = 8_000_000


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Positions starts[i] .. starts[i] + lens[i] - 1 of all i, one after another."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lens), lens) + np.arange(total, dtype=np.int64)


def byte_characters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for
    the code points from 256 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class ChunkTokenizer:
    """Encodes texts with the tokenizer file at ``path``."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self._tok = Tokenizer.from_file(path)
        self._model = self._tok.model
        self.vocab_size = self._tok.get_vocab_size(with_added_tokens=True)
        pre = config.get("pre_tokenizer") or {}
        steps = [n["type"] for n in (config.get("normalizer") or {}).get("normalizers", [])]
        # how plain words become pre-tokens: "byte": blank kept; "word": blank dropped, lower case
        self._kind = ("byte" if pre.get("type") == "ByteLevel" and not steps and not pre.get("add_prefix_space")
                      else "word" if steps == ["NFC", "Replace", "Lowercase"] else None)
        self._chars = {b: c for b, c in byte_characters().items()}
        self._max = cache_words
        self._index: dict[str, int] = {}
        self._starts = np.zeros(1024, np.int64)
        self._lens = np.zeros(1024, np.int64)
        self._ids = np.zeros(4096, np.uint32)
        self._n_ids = 0

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        if n <= len(a):
            return a
        b = np.zeros(max(n, 2 * len(a)), a.dtype)
        b[:len(a)] = a
        return b

    def _add(self, keys: list[str], ids: list[list[int]]) -> None:
        at = len(self._index)
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((x for i in ids for x in i), np.uint32, int(lens.sum()))
        self._starts = self._room(self._starts, at + len(ids))
        self._lens = self._room(self._lens, at + len(ids))
        self._ids = self._room(self._ids, self._n_ids + len(flat))
        self._lens[at:at + len(ids)] = lens
        self._starts[at:at + len(ids)] = self._n_ids + np.cumsum(lens) - lens
        self._ids[self._n_ids:self._n_ids + len(flat)] = flat
        self._n_ids += len(flat)
        self._index.update(zip(keys, range(at, at + len(keys))))

    def _forget(self) -> None:
        """Back to the first words kept."""
        keep = self._max
        if len(self._index) > keep:
            for c in list(self._index)[keep:]:
                del self._index[c]
            self._n_ids = int(self._starts[keep - 1] + self._lens[keep - 1]) if keep else 0

    def _pretoken(self, word: str) -> list[int]:
        """Ids of one plain pre-token, by the library's model."""
        if word.isascii() and word != "\n":
            s = "Ġ" + word[1:] if word[0] == " " else word
        else:
            s = "".join([self._chars[b] for b in word.encode()])
        return [t.id for t in self._model.tokenize(s)]

    def _numbers(self, parts: list[str]) -> np.ndarray:
        """Numbers of parts among the kept ones; new parts are encoded ("\\0" marks a whole piece)."""
        get = self._index.get
        idx = np.fromiter(map(get, parts, repeat(-1)), np.int64, len(parts))
        missing = np.flatnonzero(idx < 0)
        if len(missing):
            new = list(dict.fromkeys([parts[i] for i in missing]))
            whole = [p for p in new if p[0] == "\0"]
            words = [p for p in new if p[0] != "\0"]
            if words:
                self._add(words, [self._pretoken(w) for w in words])
            if whole:
                self._add(whole, [e.ids for e in self._tok.encode_batch_fast(
                    [w[1:] for w in whole], add_special_tokens=False)])
            idx[missing] = [get(parts[i]) for i in missing]
        return idx

    def _plain_parts(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the parts of pieces like ``_PLAIN_SMALL`` in turn, and how many parts each has."""
        lower = self._kind == "word"
        if lower:
            pieces = pc.ascii_lower(pc.ascii_ltrim(pieces, " "))
        split = pc.split_pattern(pieces, "\n")
        lines, offsets = split.flatten(), split.offsets.to_numpy()
        first = offsets[:-1] - offsets[0]
        words = pc.ascii_rtrim(lines, _MARKS)
        stopped = pc.not_equal(pc.binary_length(lines), pc.binary_length(words)).to_numpy(zero_copy_only=False)
        broken = np.full(len(lines), not lower)  # a line break in front, unless it is a piece's first line
        broken[first] = False
        size = 1 + broken + stopped
        at = np.cumsum(size) - size
        out = np.empty(int(size.sum()), np.int64)
        out[at + broken] = self._coded_numbers(words)
        if stopped.any():
            stops = pc.utf8_ltrim(lines.filter(pa.array(stopped)), _NO_MARKS)
            out[(at + broken + 1)[stopped]] = self._coded_numbers(stops)
        if broken.any():
            out[at[broken]] = self._numbers(["\n"])[0]
        return out, np.add.reduceat(size, first)

    def _coded_numbers(self, parts: pa.Array) -> np.ndarray:
        coded = parts.dictionary_encode()
        return self._numbers(coded.dictionary.to_pylist())[coded.indices.to_numpy()]

    def _other_parts(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for any other pieces."""
        lower, get = self._kind == "word", self._index.get
        # pieces seen before: no regex for them (a NUL would look like a mark)
        if lower:
            known = np.fromiter((-1 if "\0" in p[:2] else get(p[1:] if p[:1] == " " and p[1:] not in ".," else p, -1) for p in pieces), np.int64, len(pieces))
        else:
            known = np.fromiter((-1 if p[:1] == "\0" else get(p, -1) for p in pieces), np.int64, len(pieces))
        other = np.flatnonzero(known < 0)
        parts: list[str] = []  # parts of all pieces not seen before in turn: "\0" marks a whole piece
        n_parts = np.ones(len(pieces), np.int64)
        for i in other.tolist():
            p = pieces[i]
            m = _PLAIN(p) if self._kind else None
            if m is None:
                parts.append("\0" + p)
                continue
            blank, one, stop, two, stop2 = m.groups()
            n = len(parts)
            parts.append(one.lower() if lower else blank + one)
            if stop:
                parts.append(stop)
            if two:
                if not lower:
                    parts.append("\n")
                parts.append(two.lower() if lower else two)
                if stop2:
                    parts.append(stop2)
            n_parts[i] = len(parts) - n
        idx = self._numbers(parts)
        if len(other) < len(pieces):  # all parts in the order of the pieces
            seen, first = idx, np.cumsum(n_parts) - n_parts
            idx = np.empty(int(n_parts.sum()), np.int64)
            idx[first[known >= 0]] = known[known >= 0]
            idx[ragged(first[other], n_parts[other])] = seen
        return idx, n_parts

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Starts and lengths, in a flat id array of their own, of (distinct) pieces."""
        plain = (pc.match_substring_regex(pieces, _PLAIN_SMALL).to_numpy(zero_copy_only=False) if self._kind
                 else np.zeros(len(pieces), bool))
        found = []  # (pieces, their parts, parts of each)
        for kind, take in ((plain, self._plain_parts), (~plain, lambda some: self._other_parts(some.to_pylist()))):
            own = np.flatnonzero(kind)
            if len(own):
                found.append((own, *take(pieces.take(pa.array(own)))))
        n_parts = np.zeros(len(pieces), np.int64)
        for own, _, n in found:
            n_parts[own] = n
        ends = np.cumsum(n_parts)
        idx = np.empty(int(n_parts.sum()), np.int64)
        for own, parts, n in found:
            idx[ragged(ends[own] - n, n)] = parts
        lens = self._lens[idx]
        self._flat = self._ids[ragged(self._starts[idx], lens)]
        at = np.concatenate(([0], np.cumsum(lens)))
        starts = at[ends - n_parts]
        return starts, at[ends] - starts

    def _join(self, code: np.ndarray, pieces: pa.Array, n_pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts given as numbers of distinct pieces."""
        starts, lens = self._pieces(pieces)
        lens_of = lens[code]
        flat = self._flat[ragged(starts[code], lens_of)]
        at = np.concatenate(([0], np.cumsum(lens_of)))
        ends = np.cumsum(n_pieces)
        return flat, at[ends] - at[ends - n_pieces]

    def _encode_any(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces by regular expression: for texts with a blank after white space."""
        chunks: list[str] = []
        n_chunks = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            c = _CHUNK.findall(t)
            n_chunks[i] = len(c)
            chunks += c
        code = {c: i for i, c in enumerate(dict.fromkeys(chunks))}
        return self._join(np.fromiter(map(code.__getitem__, chunks), np.int64, len(chunks)), pa.array(list(code), pa.string()),
                          n_chunks)

    def _encode_plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Texts whose blanks all follow something else: cut in front of each blank."""
        split = pc.split_pattern(texts, " ")
        offsets = split.offsets.to_numpy()
        coded = split.flatten().dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        words = coded.dictionary
        heads = offsets[:-1] - offsets[0]
        first, back = np.unique(code[heads], return_inverse=True)
        code[heads] = len(words) + back  # a text's first piece has no blank in front
        pieces = pa.concat_arrays([pc.binary_join_element_wise("", words, " "), words.take(pa.array(first))])
        return self._join(code, pieces, np.diff(offsets).astype(np.int64))

    def encode(self, texts: list[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32) one text after another, and the number of ids per text."""
        arr = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        arr = pc.fill_null(arr, "")
        sizes = pc.binary_length(arr).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(sizes) - sizes) // SLICE_BYTES
        odd = pc.match_substring_regex(arr, _BLANK_AFTER_WS).to_numpy(zero_copy_only=False)
        out = []
        for p in np.unique(part):
            rows = np.flatnonzero(part == p)
            flats, counts, order = [], [], []
            for kind in (False, True):
                own = rows[odd[rows] == kind]
                if len(own):
                    some = arr.take(pa.array(own))
                    f, c = self._encode_any(some.to_pylist()) if kind else self._encode_plain(some)
                    flats.append(f)
                    counts.append(c)
                    order.append(own)
            self._forget()
            if len(flats) == 1:
                out.append((flats[0], counts[0]))
            else:  # back to the order of the rows
                n, where = np.concatenate(counts), np.argsort(np.concatenate(order))
                starts = np.cumsum(n) - n
                out.append((np.concatenate(flats)[ragged(starts[where], n[where])], n[where]))
        if not out:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        return np.concatenate([p[0] for p in out]), np.concatenate([p[1] for p in out])


_workers: dict[str, ChunkTokenizer] = {}


def tokenizer(path: str) -> ChunkTokenizer:
    """The worker process's tokenizer for ``path`` (kept between tasks)."""
    if path not in _workers:
        _workers[path] = ChunkTokenizer(path)
    return _workers[path]
