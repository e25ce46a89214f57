"""Arrow batches of texts in slices of bounded bytes, and running ranks of sorted tables."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markscope.llm.common import Scratch

#: Bytes of text handled at once by one task.
SLICE_BYTES = 1 << 20

# bytes outside 0-9, A-Z, a-z and >= 0x80 become blanks; A-Z become lower case
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
               for c in range(256))


def ascii_alnum_words(raw: bytes | None) -> list[bytes]:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a UTF-8 text, A-Z lower-cased."""
    return (raw or b"").translate(_WORDS).split()


def bounded(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in batches of about ``limit`` bytes of ``text`` (one row at least).
    After the last one, memory that the task's worker holds free goes back to the system."""
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(text)), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                yield b.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < b.num_rows:
            yield b.slice(start)
    b = None
    give_back()


def gathered(batches: Iterator[pa.RecordBatch], text: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in order, small batches joined until they hold ``limit`` bytes of
    ``text``: for work with a cost per distinct word of a step. Ends like ``bounded``."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.column(text).nbytes
        if size >= limit:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)
    b = held = None
    give_back()


def give_back() -> None:
    """Workers are kept for later tasks: what they hold free would add up over the stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """``bounded`` rows, the text as binary."""
    for b in bounded(batches, text, limit):
        at = b.schema.get_field_index(text)
        yield b.set_column(at, text, b.column(at).cast(pa.large_binary()))


def with_row_numbers(df: DataFrame, order: list[Column], scratch: Scratch, name: str) -> DataFrame:
    """``df`` with ``row_number`` (long, from 1) in the order given, without gathering rows in one
    task: a range partitioning, sorted per partition; each partition then adds the number of rows
    in those before it. Only one number per partition passes through the driver."""
    rows = scratch.save(df, f"{name}-rows")
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # monotonically_increasing_id: partition in the upper bits, row within it in the lower 33
    placed = scratch.save(rows.repartitionByRange(width, *order).sortWithinPartitions(*order)
                          .withColumn("__at", F.monotonically_increasing_id()), f"{name}-sorted")
    part = F.shiftright("__at", 33)
    sizes = placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()
    before, total = {}, 0
    for p, n in sorted((r.p, r.n) for r in sizes):
        before[p], total = total, total + n
    shifts = df.sparkSession.createDataFrame([(p, b) for p, b in before.items()], "__p long, __before long")
    return (placed.join(F.broadcast(shifts), part == F.col("__p"))  # one row per shuffle partition
            .withColumn("row_number", F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1)
            .drop("__at", "__p", "__before"))
