"""The content directory: a file per distinct content, named by its digest, written by tasks.

``write`` goes over the contents once. A task writes each under a name of its own and then renames it to its digest in a staging folder, so that
a file with a digest's name is always whole: a task that is run again, or another that has the same content, finds it there and writes
nothing. Names (content id, extension) are far smaller than contents; they alone are shuffled to choose the extension, that of the first row. Then
the staged files are renamed into place. Whatever is in place already stays: its name says that it holds the same.

Files lie in folders by the first digits of their digest (two, so 256 folders; three or four for over 10^8 files).
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import text
from tesserae.operators.scratch import settled
from tesserae.sources.locations import Opener, open_at

#: What a content's file is called, and the bytes of contents after which a batch that is read ends.
NAMED, BATCH_BYTES = re.compile(r"[0-9a-f]{64}(\.[^/]*)?"), 16 << 20


def _size(store: fs.FileSystem, path: str) -> int | None:
    """The size of a file; null if there is none."""
    found = store.get_file_info(path)
    return found.size if found.type == fs.FileType.File else None


class _Folders:
    """Folders that are made when they are first needed."""

    def __init__(self, store: fs.FileSystem, top: str) -> None:
        self.store, self.top, self.made = store, top, set()

    def of(self, name: str, fan: int) -> str:
        folder = f"{self.top}/{name[:fan]}"
        if folder not in self.made:
            self.store.create_dir(folder, recursive=True)
            self.made.add(folder)
        return folder


def _publish(store: fs.FileSystem, written: str, name: str, size: int) -> None:
    """Renames ``written`` to ``name``, unless that is there with the size that it must have. Who is second finds it there."""
    if _size(store, name) == size:
        return
    try:
        store.move(written, name)
    except OSError:
        if _size(store, name) != size:
            raise


def _drop(store: fs.FileSystem, path: str) -> bool:
    """Whether a file was deleted; false if it wasn't there."""
    try:
        store.delete_file(path)
    except FileNotFoundError:
        return False
    return True


def _stage(folder: str, fan: int, open_with: Opener) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = open_with(folder)
        folders = _Folders(store, top)
        for batch in batches:
            ids, sizes = [], []
            for value in batch.column(2):
                data = value.as_buffer()
                name = hashlib.sha256(data).hexdigest()
                place = folders.of(name, fan)
                if _size(store, f"{place}/{name}") != data.size:
                    own = f"{place}/.{uuid.uuid4().hex}"
                    with store.open_output_stream(own, compression=None) as out:
                        out.write(data)
                    _publish(store, own, f"{place}/{name}", data.size)
                    _drop(store, own)
                ids.append(name)
                sizes.append(data.size)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.string()), pa.array(sizes, pa.int64())], names=["key", "ext", "content_id", "size"])

    return run


def _place(staged: str, folder: str, fan: int, open_with: Opener) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (store, top), (_, before) = open_with(folder), open_with(staged)
        folders = _Folders(store, top)
        for batch in batches:
            for name, file, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                _publish(store, f"{before}/{name[:fan]}/{name}", f"{folders.of(name, fan)}/{file}", size)
            yield batch

    return run


def write(rows: DataFrame, folder: str, content: str = "content", name: str = "name", key: str = "key", fan: int = 2, open_with: Opener = open_at) -> DataFrame:
    """(content_id, file, size) per distinct content of ``rows``, whose file is in ``folder`` when this returns.

    A content that several rows have gets the extension of the row with the smallest ``key`` (null keys last, then the smaller extension).
    Null contents have no file; empty ones have an empty file. Extensions are lower case; characters but letters, digits, ``_``, ``+``
    and ``-`` are left out of them, so that no name leads out of the folder.
    """
    spark, staged = rows.sparkSession, f"{folder.rstrip('/')}/_staged-{uuid.uuid4().hex}"
    ext = F.coalesce(F.regexp_replace(text.extension(F.col(name)), r"[^.\p{L}\p{N}_+-]", ""), F.lit(""))
    given = rows.where(F.col(content).isNotNull()).select(F.col(key).alias("key"), ext.alias("ext"), F.col(content).cast("binary").alias("content"))
    each = given.mapInArrow(_stage(staged, fan, open_with), f"key {dict(given.dtypes)['key']}, ext string, content_id string, size bigint")
    first = F.min(F.struct(F.col("key").isNull(), "key", "ext"))["ext"]
    named = settled(each.groupBy("content_id").agg(first.alias("ext"), F.min("size").alias("size")))
    files = named.select("content_id", F.concat("content_id", "ext").alias("file"), "size")
    out = settled(files.mapInArrow(_place(staged, folder, fan, open_with), "content_id string, file string, size bigint"))
    _delete_folder(spark, staged)
    return out


def _delete_folder(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def stored(spark: SparkSession, folder: str, fan: int = 2, open_with: Opener = open_at) -> DataFrame:
    """(content_id, file, size) of the files in ``folder``. Tasks list its folders, so the driver never holds the list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = open_with(folder)
        for batch in batches:
            for part in batch.column(0).to_pylist():
                inside = store.get_file_info(fs.FileSelector(f"{top}/{part:0{fan}x}", allow_not_found=True))
                found = [(f.base_name, f.size) for f in inside if f.type == fs.FileType.File and NAMED.fullmatch(f.base_name)]
                names = [n for n, _ in found]
                yield pa.RecordBatch.from_arrays([pa.array([n[:64] for n in names], pa.string()), pa.array(names, pa.string()), pa.array([s for _, s in found], pa.int64())], names=["content_id", "file", "size"])

    return spark.range(16**fan).mapInArrow(run, "content_id string, file string, size bigint")


def read(files: DataFrame, folder: str, fan: int = 2, open_with: Opener = open_at) -> DataFrame:
    """``files`` (as ``write`` and ``stored`` give them) with ``content``, null where the file is gone. Batches end by bytes, so a task holds
    ``BATCH_BYTES`` and one content more at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = open_with(folder)
        for batch in batches:
            begin, held, got = 0, 0, []
            for at, name in enumerate(batch.column(1).to_pylist()):
                got.append(_content(store, f"{top}/{name[:fan]}/{name}"))
                held += len(got[-1] or b"")
                if held >= BATCH_BYTES or at == batch.num_rows - 1:
                    part = batch.slice(begin, at + 1 - begin)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.binary())], names=["content_id", "file", "size", "content"])
                    begin, held, got = at + 1, 0, []

    return files.select("content_id", "file", "size").mapInArrow(run, "content_id string, file string, size bigint, content binary")


def _content(store: fs.FileSystem, path: str) -> bytes | None:
    try:
        with store.open_input_file(path) as file:
            return file.read()
    except FileNotFoundError:
        return None


def remove(files: DataFrame, folder: str, fan: int = 2, open_with: Opener = open_at) -> DataFrame:
    """(file, removed) per row of ``files`` (as ``stored`` gives them, such as those that ``store.orphans`` leaves); false for a file that was gone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = open_with(folder)
        for batch in batches:
            names = batch.column(0).to_pylist()
            gone = [bool(NAMED.fullmatch(x or "")) and _drop(store, f"{top}/{x[:fan]}/{x}") for x in names]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(gone, pa.bool_())], names=["file", "removed"])

    return settled(files.select("file").mapInArrow(run, "file string, removed boolean"))
