"""S1 and S6 on a file tree: distributed listing, contents fetched after selection, files written back.

``list_tree`` expands a frontier of folders on the executors, one level per job, and never holds
the files on the driver: ``(path, size, error)`` with paths relative to the root. ``read_listed``
reads the contents of the rows of such a listing, after whatever was selected from it, through the
``filetree`` data source: the listing is written as a table, each of its parts becomes one input
partition, and tasks read their part and the files it names. ``read_tree`` does both.

Unlike the built-in ``binaryFile`` / ``text`` sources, names that start with ``_`` or ``.`` are not
lost: ``__init__.py`` is kept. The walk prunes hidden entries (but ``.gitignore`` files are kept so
their rules can be applied) and folders or files with an ignored extension. Marker entries such as
``.git`` are listed by name (``error`` says so) but not entered. Links are skipped. A file or
folder that cannot be read, or a file larger than ``maxFileBytes`` where that is set (no limit by
default), is returned with NULL content and a reason in ``error`` - nothing is dropped silently.

``write_tree`` writes ``(path, content)`` rows as files below a root. Each task stages its files in
a folder of its own; only when all tasks are done are they moved into place. A file whose content is
already there is not written again. A failed job leaves the tree as it was.

Roots are paths that all executors share or URIs that ``pyarrow.fs`` opens (hdfs://, s3://, ...).
"""

from __future__ import annotations

import hashlib
import os
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition,
                                    StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage)

from markscope.operators.select import IGNORED_EXTENSIONS
from markscope.session import carried, scratch_path

SCHEMA = "path string, size bigint, content binary, error string"
LISTING = "path string, size bigint, error string"
MARKERS = (".git",)
MARKER_ERROR = "marker entry, not read"
#: Bytes of files that one partition reads, and of contents in one batch of rows.
PARTITION_BYTES, BATCH_BYTES = 128 << 20, 16 << 20
_IGNORED = set(IGNORED_EXTENSIONS)
_FILE_COST = 4096  # counted for each file, so that tiny ones do not pile up


def _ext(name: str) -> str:
    base = name.rsplit("/", 1)[-1]
    i = base.rfind(".")
    return base[i + 1:] if i > 0 else ""


def _skip(name: str, skip_hidden: bool, skip_ext: bool, is_dir: bool) -> bool:
    if skip_hidden and name.startswith(".") and not (not is_dir and name == ".gitignore"):
        return True
    if skip_ext and ("." + _ext(name)) in _IGNORED and "." in name[1:]:
        return True
    return False


def _open(root: str) -> tuple[fs.FileSystem, str]:
    if "://" in root:
        return fs.FileSystem.from_uri(root)
    return fs.LocalFileSystem(), os.path.abspath(root.removeprefix("file:"))


def _children(store: fs.FileSystem, folder: str) -> Iterator[tuple[str, bool, int]]:
    """(name, is a folder, size) of the entries of a folder; links and other kinds are left out."""
    if isinstance(store, fs.LocalFileSystem):
        with os.scandir(folder) as entries:
            for e in entries:
                if e.is_dir(follow_symlinks=False):
                    yield e.name, True, 0
                elif e.is_file(follow_symlinks=False):
                    yield e.name, False, e.stat(follow_symlinks=False).st_size
        return
    for info in store.get_file_info(fs.FileSelector(folder)):
        if info.type in (fs.FileType.Directory, fs.FileType.File):
            yield info.base_name, info.type == fs.FileType.Directory, info.size or 0


def _lister(root: str, skip_hidden: bool, skip_ext: bool, markers: tuple[str, ...]):
    """Rows (path, size, is_dir, error) for the entries of the folders given."""

    def entries(folder: str) -> Iterator[tuple]:
        store, base = _open(root)
        try:
            for name, is_dir, size in _children(store, f"{base}/{folder}" if folder else base):
                path = f"{folder}/{name}" if folder else name
                if not _skip(name, skip_hidden, skip_ext, is_dir):
                    yield path, None if is_dir else size, is_dir, None
                elif name in markers:
                    yield path, None, False, MARKER_ERROR
        except OSError:
            yield folder or ".", None, False, "unreadable folder"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("size", pa.int64()), ("is_dir", pa.bool_()), ("error", pa.string())])
        rows: list[tuple] = []
        for b in batches:
            for folder in b.column("folder").to_pylist():
                for row in entries(folder):
                    rows.append(row)
                    if len(rows) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def list_tree(spark: SparkSession, root: str, skip_hidden: bool = True, skip_ext: bool = True,
              markers: tuple[str, ...] = MARKERS) -> DataFrame:
    """``(path, size, error)`` of every regular file under ``root`` that the walk reaches. One job
    per level of folders; each level is a written table, read by the next."""
    base, levels = scratch_path(spark, "listing"), []
    frontier = spark.createDataFrame([("",)], "folder string")
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    while True:
        path = f"{base}/{len(levels):04d}"
        # folders of one parent are spread, so a wide level uses all executors
        (frontier.repartition(width, "folder")
         .mapInArrow(_lister(root, skip_hidden, skip_ext, tuple(markers)), "path string, size bigint, is_dir boolean, error string")
         .write.parquet(path))
        levels.append(path)
        level = spark.read.schema("path string, size bigint, is_dir boolean, error string").parquet(path)
        frontier = level.where("is_dir").select(F.col("path").alias("folder"))
        if frontier.isEmpty():
            break
    every = spark.read.schema("path string, size bigint, is_dir boolean, error string").parquet(*levels)
    return every.where("NOT is_dir").select("path", "size", "error")


class _Part(InputPartition):
    """One part of a written listing."""

    def __init__(self, index: int, file: str | None):
        super().__init__(index)
        self.file = file


class FileTreeReader(DataSourceReader):
    def __init__(self, options):
        if "listing" not in options:
            raise ValueError("the filetree source reads a listing: use read_tree or read_listed")
        self.root, self.listing = options["path"], options["listing"]
        cap = options.get("maxFileBytes")  # opt-in; without it every file is read whole
        self.max_file = int(cap) if cap else None
        self.path_tests = []  # pushed-down predicates on the relative path

    def pushFilters(self, filters):
        """Path predicates (=, IN, starts/ends with, contains) are tested on the listing, so
        files they exclude are never opened; others stay with Spark."""
        for f in filters:
            attr = getattr(f, "attribute", None)
            if attr != ("path",):
                yield f
            elif isinstance(f, EqualTo):
                self.path_tests.append(("eq", f.value))
            elif isinstance(f, In):
                self.path_tests.append(("in", tuple(f.value)))
            elif isinstance(f, StringStartsWith):
                self.path_tests.append(("prefix", f.value))
            elif isinstance(f, StringEndsWith):
                self.path_tests.append(("suffix", f.value))
            elif isinstance(f, StringContains):
                self.path_tests.append(("contains", f.value))
            else:
                yield f

    def _keep(self, rel: str) -> bool:
        for op, v in self.path_tests:
            if (op == "eq" and rel != v) or (op == "in" and rel not in v) or \
               (op == "prefix" and not rel.startswith(v)) or (op == "suffix" and not rel.endswith(v)) or \
               (op == "contains" and v not in rel):
                return False
        return True

    def partitions(self):
        store, base = _open(self.listing)
        parts = sorted(i.path for i in store.get_file_info(fs.FileSelector(base)) if i.base_name.endswith(".parquet"))
        return [_Part(i, p) for i, p in enumerate(parts)] or [_Part(0, None)]

    def _row(self, store: fs.FileSystem, base: str, path: str, size: int | None, error: str | None) -> tuple:
        if error is not None:
            return path, size, None, error
        if self.max_file is not None and (size or 0) > self.max_file:
            return path, size, None, f"larger than {self.max_file} bytes"
        try:
            with store.open_input_stream(f"{base}/{path}", compression=None) as stream:
                data = stream.read()
        except OSError as e:
            return path, size, None, f"unreadable: {e.strerror or e}"
        return path, len(data), data, None

    def read(self, partition):
        if partition.file is None:
            return
        (store, base), (lists, _) = _open(self.root), _open(self.listing)
        schema = pa.schema([("path", pa.string()), ("size", pa.int64()), ("content", pa.binary()), ("error", pa.string())])
        rows, held = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        with lists.open_input_file(partition.file) as listing:
            for b in pq.ParquetFile(listing).iter_batches(columns=["path", "size", "error"]):
                for path, size, error in zip(*(c.to_pylist() for c in b.columns)):
                    if self._keep(path):
                        rows.append(self._row(store, base, path, size, error))
                        held += _FILE_COST + len(rows[-1][2] or b"")
                        if held >= BATCH_BYTES:
                            yield batch()
                            rows, held = [], 0
        if rows:
            yield batch()


@dataclass
class _Staged(WriterCommitMessage):
    folder: str | None
    written: int
    unchanged: int


class FileTreeWriter(DataSourceWriter):
    """Files below ``path``; see the module's text."""

    def __init__(self, options):
        self.root = options["path"]
        self.staging = f".markscope-staging-{uuid.uuid4().hex}"

    @staticmethod
    def _same(store: fs.FileSystem, path: str, data: bytes) -> bool:
        info = store.get_file_info(path)
        if info.type != fs.FileType.File or info.size != len(data):
            return False
        with store.open_input_stream(path, compression=None) as old:
            return hashlib.sha256(old.read()).digest() == hashlib.sha256(data).digest()

    def write(self, iterator):
        store, base = _open(self.root)
        own = f"{base}/{self.staging}/{uuid.uuid4().hex}"  # attempts of one task never meet
        written = unchanged = 0
        for row in iterator:
            path, data = row["path"], row["content"]
            clean = posixpath.normpath(path) if path else ""
            if not clean or clean != path or clean.startswith(("/", "..")):
                raise ValueError(f"not a path below the root: {path!r}")
            data = data.encode("utf-8", "surrogatepass") if isinstance(data, str) else bytes(data or b"")
            if self._same(store, f"{base}/{path}", data):
                unchanged += 1
                continue
            store.create_dir(posixpath.dirname(f"{own}/{path}"), recursive=True)
            with store.open_output_stream(f"{own}/{path}", compression=None) as out:
                out.write(data)
            written += 1
        return _Staged(own if written else None, written, unchanged)

    def commit(self, messages):
        """Moves the staged files of the tasks that count into place, one by one."""
        store, base = _open(self.root)
        for m in messages:
            if m is None or m.folder is None:
                continue
            folders = [m.folder]
            while folders:
                for info in store.get_file_info(fs.FileSelector(folders.pop())):
                    if info.type == fs.FileType.Directory:
                        folders.append(info.path)
                        continue
                    target = f"{base}/{info.path[len(m.folder) + 1:]}"
                    store.create_dir(posixpath.dirname(target), recursive=True)
                    store.move(info.path, target)
        self._clear(store, base)

    def abort(self, messages):
        self._clear(*_open(self.root))

    def _clear(self, store: fs.FileSystem, base: str) -> None:
        if store.get_file_info(f"{base}/{self.staging}").type == fs.FileType.Directory:
            store.delete_dir(f"{base}/{self.staging}")


class FileTreeSource(DataSource):
    @classmethod
    def name(cls):
        return "filetree"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return FileTreeReader(self.options)

    def writer(self, schema, overwrite):
        return FileTreeWriter(self.options)


carried(__name__)


def register(spark) -> None:
    # the reader tests pushed-down path predicates before it opens a file
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FileTreeSource)


def read_listed(spark: SparkSession, root: str, listing: DataFrame, partition_bytes: int = PARTITION_BYTES,
                max_file_bytes: int | None = None) -> DataFrame:
    """``(path, size, content, error)`` for the rows of ``listing`` (path, size, error). The listing
    is written in parts of about ``partition_bytes`` of files; contents never pass a shuffle here."""
    register(spark)
    path = scratch_path(spark, "listed")
    rows = listing.select("path", "size", "error")
    total = rows.agg(F.sum(F.coalesce("size", F.lit(0)) + _FILE_COST)).first()[0] or 0
    rows.repartition(max(1, -(-int(total) // partition_bytes)), "path").write.parquet(path)
    r = spark.read.format("filetree").option("path", root).option("listing", path)
    if max_file_bytes is not None:
        r = r.option("maxFileBytes", str(max_file_bytes))
    return r.load()


def read_tree(spark, root: str, **options):
    """Scan a folder into ``(path, size, content, error)``. Options: ``skipHidden``,
    ``skipIgnoredExtensions``, ``partitionBytes``, ``maxFileBytes``."""
    def flag(name):
        return str(options.get(name, "true")).lower() == "true"

    cap = options.get("maxFileBytes")
    listing = list_tree(spark, root, flag("skipHidden"), flag("skipIgnoredExtensions"))
    return read_listed(spark, root, listing, int(options.get("partitionBytes", PARTITION_BYTES)), int(cap) if cap else None)


def write_tree(files: DataFrame, root: str) -> None:
    """Write ``(path, content)`` as files below ``root``; files with equal content stay untouched."""
    register(files.sparkSession)
    files.select("path", "content").write.format("filetree").option("path", root).mode("append").save()
