"""Trees of repositories as a partitioned data source: ``format("code_tree")``.

Reading lists the tree once, when the scan is planned, and deals the sorted paths into ranges of
about ``partitionBytes`` (sizes come with the listing, contents don't); each range is a task. Names
with a dot or an underscore in front are names like any other. With ``archives`` the files are tar or
zip archives, one repository each, and are streamed member by member. What can't be read is a row as
well, with ``error`` and without content: a file, a member that is protected or damaged, an archive
that breaks off; all that was readable before it stays.

Writing puts each row (repo_id, path, content) at ``root/<repo_id>/<path>``. A task writes a file under
a name of its own and moves it into place, so that a repeated or speculative task leaves the same tree
and a lost one no half file. ``_SUCCESS`` is written when all tasks have committed, and holds the number
of files.

Any file system that Arrow knows will do: local or mounted folders, hdfs, s3, gs.
"""

from __future__ import annotations

import lzma
import re
import tarfile
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage,
)

ARCHIVE = re.compile(r"(?i)\.(tar|tar\.gz|tgz|tar\.bz2|tar\.xz|zip)$")
SCHEMA = "repo_id string, path string, content string, error string"
ARROW = pa.schema([(c, pa.string()) for c in ("repo_id", "path", "content", "error")])
PARTITION_BYTES, BATCH_BYTES, DONE = 32 << 20, 4 << 20, "_SUCCESS"
BYTES_PER_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
UNREADABLE = (OSError, RuntimeError, NotImplementedError, EOFError, ValueError, KeyError, tarfile.TarError,
              zipfile.BadZipFile, zlib.error, lzma.LZMAError)


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark writes it, and the path in it."""
    path = re.sub(r"^file:/+", "/", path)
    if path.startswith("/"):
        return fs.LocalFileSystem(), path.rstrip("/")
    system, inner = fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", path))
    return system, inner.rstrip("/")


@dataclass
class Range(InputPartition):
    """Paths of one task."""
    paths: list[str]


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.archives = options.get("archives", "false").lower() == "true"
        self.bytes = int(options.get("partitionbytes", PARTITION_BYTES))

    def partitions(self) -> list[Range]:
        system, root = located(self.root)
        found = sorted((i.path, i.size or 0) for i in system.get_file_info(fs.FileSelector(root, recursive=True))
                       if i.type == fs.FileType.File and i.path != f"{root}/{DONE}"
                       and (not self.archives or ARCHIVE.search(i.path)))
        ranges, held = [Range([])], 0
        for path, size in found:
            if held and held + size > self.bytes:
                ranges.append(Range([]))
                held = 0
            ranges[-1].paths.append(path)
            held += size + 4096
        return ranges

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        system, root = located(self.root)
        rows, held = [], 0
        for path in partition.paths:
            inner = path[len(root) + 1:]
            for row in (self._members(system, path) if self.archives else self._file(system, path, inner)):
                rows.append(row)
                held += len(row[2] or "")
                if held > BATCH_BYTES:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)

    def _file(self, system: fs.FileSystem, path: str, inner: str) -> Iterator[tuple]:
        repo, _, name = inner.partition("/")
        if not name:
            return  # beside the repositories
        try:
            with system.open_input_stream(path, compression=None) as f:
                yield repo, name, _text(f.read()), None
        except UNREADABLE as e:
            yield repo, name, None, _reason(e)

    def _members(self, system: fs.FileSystem, path: str) -> Iterator[tuple]:
        base = path.rsplit("/", 1)[-1]
        repo = ARCHIVE.sub("", base)
        try:
            with system.open_input_file(path) as f:
                for name, read in (_zip if base.lower().endswith(".zip") else _tar)(f):
                    name = name.removeprefix("./")
                    try:
                        yield repo, name, _text(read()), None
                    except UNREADABLE as e:
                        yield repo, name, None, _reason(e)
        except UNREADABLE as e:
            yield repo, base, None, _reason(e)


def _zip(f) -> Iterator[tuple]:
    with zipfile.ZipFile(f) as z:
        for m in z.infolist():
            if not m.is_dir():
                yield m.filename, lambda m=m: z.read(m)


def _tar(f) -> Iterator[tuple]:
    with tarfile.open(fileobj=f, mode="r|*") as t:
        for m in t:
            if m.isfile():
                yield m.name, lambda m=m: t.extractfile(m).read()
        # the module takes an archive that breaks off between members for a whole one, which ends in a blank block
        if t.fileobj.tell() - t.offset < tarfile.BLOCKSIZE:
            raise tarfile.ReadError("unexpected end of archive")


def _text(data: bytes) -> str:
    return data.decode("utf-8", "ignore")


def _reason(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"[:500]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], schema=ARROW)


@dataclass
class Written(WriterCommitMessage):
    files: int


class TreeWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]

    def write(self, rows: Iterator) -> Written:
        system, root = located(self.root)
        files, made = 0, set()
        for row in rows:
            path = f"{root}/{row.repo_id}/{row.path}"
            folder = path.rsplit("/", 1)[0]
            if folder not in made:
                system.create_dir(folder, recursive=True)
                made.add(folder)
            own = f"{folder}/.{uuid.uuid4().hex}.part"
            data = row.content if isinstance(row.content, (bytes, bytearray)) else (row.content or "").encode()
            with system.open_output_stream(own, compression=None) as f:
                f.write(data)
            system.move(own, path)
            files += 1
        return Written(files)

    def commit(self, messages: list) -> None:
        system, root = located(self.root)
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/{DONE}") as f:
            f.write(str(sum(m.files for m in messages if m)).encode())

    def abort(self, messages: list) -> None:
        """Files that are in place stay, without the mark of a finished tree."""


class CodeTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "code_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)

    def writer(self, schema, overwrite: bool) -> TreeWriter:
        return TreeWriter(self.options)


def read_tree(spark: SparkSession, root: str, archives: bool = False, **options: int) -> DataFrame:
    """(repo_id, path, content, error) of all files below ``root/<repo_id>/``, or of the members of all
    archives below ``root``."""
    spark.dataSource.register(CodeTree)
    reader = spark.read.format("code_tree").option("archives", str(archives).lower())
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(root)


def write_tree(rows: DataFrame, root: str) -> None:
    """Rows (repo_id, path, content), content a string or binary, as files.

    Spark hands a writer batches of so many rows; while this job runs they are bounded by bytes as well,
    so that a worker holds some megabytes of texts however long these are, and however many tasks follow."""
    spark = rows.sparkSession
    spark.dataSource.register(CodeTree)
    before = spark.conf.get(BYTES_PER_BATCH)
    spark.conf.set(BYTES_PER_BATCH, str(BATCH_BYTES))
    try:
        rows.select("repo_id", "path", "content").write.format("code_tree").mode("append").save(root)
    finally:
        spark.conf.set(BYTES_PER_BATCH, before)
