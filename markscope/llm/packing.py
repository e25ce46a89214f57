"""Sum-of-squares online packing (op3).

Each task packs its own input partition as it reads it: whole windows are cut off a
long document, and its rest goes to the fill level that minimises the sum of squared
counts of partly filled windows, which are tracked in an array by level. When the
partition ends, the windows that are still open are emptied into full windows, and the
last few ids into windows of a power of two. No shuffle, no state between tasks; a
task keeps only its open windows (a few ids arrays per level).

Results by case: a null or empty text holds only the end id; ties go to the fullest
level; equal rows are packed separately; an empty table gives no piece; other columns
are ignored; a document of any length is cut into whole windows and one rest.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from markscope.llm.common import ship
from markscope.llm.slabs import give_back
from markscope.llm.tokens import tokenizer

WINDOW = 2048
#: Documents tokenised at once hold about this many bytes of text.
STEP_BYTES = 4_000_000

Piece = tuple[object, int, int, np.ndarray]  # doc_id, start, doc_tokens, ids


class SquaresPacker:
    """Windows of ``size`` ids, filled online; emits (window number, its pieces)."""

    def __init__(self, size: int = WINDOW):
        self.size = size
        self.count = np.zeros(size + 1, np.int64)  # open windows by level
        self.open: list[list[list[Piece]]] = [[] for _ in range(size + 1)]
        self.made = 0

    def _done(self, pieces: list[Piece]) -> tuple[int, list[Piece]]:
        self.made += 1
        return self.made - 1, pieces

    def level_for(self, s: int) -> int:
        """The level (0: a new window) whose use for ``s`` ids adds least to the sum of squares."""
        n, size = self.count, self.size
        # new window: one more at level s
        best, level = (2 * int(n[s]) + 1 if s < size else 0), 0
        top = size - s  # a window at this level becomes full
        if top >= 1:
            delta = 2 * (n[1 + s:size + 1] - n[1:top + 1]) + 2
            delta[-1] = 1 - 2 * n[top]
            delta[n[1:top + 1] == 0] = np.iinfo(np.int64).max
            i = top - 1 - int(np.argmin(delta[::-1]))
            if delta[i] <= best:
                level = i + 1
        return level

    def place(self, piece: Piece) -> Iterator[tuple[int, list[Piece]]]:
        s = len(piece[3])
        level = self.level_for(s)
        if level:
            pieces = self.open[level].pop()
            self.count[level] -= 1
        else:
            pieces = []
        pieces.append(piece)
        if level + s == self.size:
            yield self._done(pieces)
        else:
            self.open[level + s].append(pieces)
            self.count[level + s] += 1

    def add(self, doc_id: object, ids: np.ndarray) -> Iterator[tuple[int, list[Piece]]]:
        total = len(ids)
        whole = total - total % self.size
        for at in range(0, whole, self.size):
            yield self._done([(doc_id, at, total, ids[at:at + self.size])])
        if whole < total:
            yield from self.place((doc_id, whole, total, ids[whole:]))

    def finish(self) -> Iterator[tuple[int, list[Piece]]]:
        """Close the open windows: those at a power of two as they are, the pieces of the
        others cut into full windows and a last row of powers of two."""
        rest: list[Piece] = []
        for level in range(1, self.size):
            for pieces in self.open[level]:
                if level & (level - 1) == 0:
                    yield self._done(pieces)
                else:
                    rest += pieces
            self.open[level] = []
        self.count[:] = 0
        left = sum(len(p[3]) for p in rest)
        sizes = [self.size] * (left // self.size)
        left %= self.size
        sizes += [1 << k for k in range(self.size.bit_length() - 1, -1, -1) if left >> k & 1]
        rest.reverse()
        for want in sizes:
            window: list[Piece] = []
            while want:
                d, at, total, ids = rest.pop()
                if len(ids) > want:
                    rest.append((d, at + want, total, ids[want:]))
                    ids = ids[:want]
                window.append((d, at, total, ids))
                want -= len(ids)
            yield self._done(window)


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, size: int = WINDOW,
                   with_ids: bool = True) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text): doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset and, if asked for, ids."""
    ship(docs.sparkSession)
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
              ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
    ddl = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    if with_ids:
        fields.append(("ids", pa.list_(pa.int32())))
        ddl += ", ids array<int>"
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, packer = tokenizer(tokenizer_path), SquaresPacker(size)
        base = TaskContext.get().partitionId() << 40  # windows are numbered within the task
        rows: list[tuple] = []

        def emit(windows: Iterator[tuple[int, list[Piece]]]) -> None:
            for number, pieces in windows:
                offset = 0
                for d, at, total, ids in pieces:
                    row = (d, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, base + number, offset)
                    rows.append((*row, ids.astype(np.int32)) if with_ids else row)
                    offset += len(ids)

        def flush() -> pa.RecordBatch:
            cols = [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)]
            rows.clear()
            return pa.RecordBatch.from_arrays(cols, schema=schema)

        for b in batches:
            texts, keys = b.column("text"), b.column("doc_id").to_pylist()
            sizes = np.array([len(t.as_buffer() or b"") if t.is_valid else 0 for t in texts], np.int64)
            cut = (np.cumsum(sizes) - sizes) // STEP_BYTES
            for s in np.unique(cut):
                own = np.flatnonzero(cut == s)
                flat, n = tok.encode(texts.slice(own[0], len(own)))
                ends = np.cumsum(n)
                for i, a, z in zip(own, ends - n, ends):
                    emit(packer.add(keys[i], np.append(flat[a:z], np.uint32(end_id))))
                if rows:
                    yield flush()
        emit(packer.finish())
        if rows:
            yield flush()
        give_back()  # this worker may serve other stages

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, ddl)
