"""Listings and reads whose file names never pass through the driver.

Spark's file readers gather the status of every file on the driver before a job starts. Here directories are rows: a task
lists the directories it is given, and those it finds are the rows of the next round, so there are as many jobs as levels and
the driver holds none of the names. What one task holds at a time is the listing of one directory.

Paths are opened with Arrow's file systems (local or mounted, object stores, HDFS), by the name in the URI. For stores that only
a Hadoop client reaches there are :func:`corpusloom.sources.listing.list_files` and
:func:`corpusloom.sources.documents.read_text_files`.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.session import materialize
from corpusloom.sources.listing import folder_order, parent_folder

#: Characters that a read task gathers before it hands a batch on; a longer file is a batch by itself.
BATCH_CHARS = 8 << 20
#: Files of a listing that one read task takes.
FILES_A_TASK = 20_000
#: Name of a missing value in a path, and the characters that are escaped in one, as in Spark's partitioned folders.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
_ESCAPED = {c: f"%{c:02X}" for c in (*range(1, 32), *b"\"#%'*/:=?\\\x7f{[]^")}

_FOUND = "relative string, directory boolean, bytes long"


def holds(directory: str, prefixes: Sequence[str], after: str | None) -> bool:
    """Whether names below ``directory`` can start with one of the prefixes and come after the token."""
    below = directory + "/" if directory else ""
    if after is not None and below < after and not after.startswith(below):
        return False
    return not prefixes or any(below.startswith(p) or p.startswith(below) for p in prefixes)


def wanted(name: str, prefixes: Sequence[str], after: str | None, pattern: str) -> bool:
    if after is not None and name <= after:
        return False
    return (not prefixes or name.startswith(tuple(prefixes))) and fnmatch.fnmatchcase(name.rsplit("/", 1)[-1], pattern)


def hidden(name: str) -> bool:
    """Names that Spark's readers leave out."""
    return name.startswith(".") or name.startswith("_") and "=" not in name


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system of a path or URI, and the path inside it. Names are taken as they are, without URI escapes."""
    scheme, mark, rest = path.partition("://")
    if not mark:
        return fs.LocalFileSystem(), opened_name(path)
    return fs.FileSystem.from_uri(f"{scheme}://{rest.partition('/')[0]}/")[0], opened_name(path)


def opened_name(path: str) -> str:
    """Path inside its file system: bucket names are part of it in object stores, hosts are not."""
    scheme, mark, rest = path.partition("://")
    if not mark:
        return path.removeprefix("file:")
    return "/" + rest.partition("/")[2] if scheme in ("file", "hdfs", "viewfs") else rest


def _lister(root: str, prefixes: Sequence[str], after: str | None, pattern: str) -> Callable:
    schema = pa.schema([("relative", pa.string()), ("directory", pa.bool_()), ("bytes", pa.int64())])

    def list_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = opened(root.rstrip("/"))
        for batch in batches:
            for directory in batch.column("relative").to_pylist():
                found = store.get_file_info(fs.FileSelector(f"{base}/{directory}" if directory else base or "/"))
                rows = []
                for entry in found:
                    if hidden(entry.base_name):
                        continue
                    name = f"{directory}/{entry.base_name}" if directory else entry.base_name
                    if entry.type == fs.FileType.Directory:
                        if holds(name, prefixes, after):
                            rows.append((name, True, 0))
                    elif wanted(name, prefixes, after, pattern):
                        rows.append((name, False, entry.size))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return list_batches


def list_pages(spark: SparkSession, root: str, folders: Sequence[str] = (), pattern: str = "*", prefixes: Sequence[str] = (),
               after: str | None = None, folder_of: Callable[[Column], Column] = parent_folder) -> DataFrame:
    """``(path, folder, folder_ord, bytes)`` of the files under ``root``, and ``relative``: the path below ``root``.

    ``prefixes``: only names below ``root`` that start with one of these; a name that fits several is listed once.
    ``after``: only names greater than this one (by UTF-8 bytes), such as :func:`last_page` of an earlier listing.
    Directories that cannot hold such names are not opened. Names that begin with ``_`` or ``.`` are left out, as Spark's readers
    do. A root without files gives no rows; one that does not exist raises an error.

    The listing is a written table, so that later steps see the same files even where new ones arrive.
    """
    task = _lister(root, tuple(prefixes), after, pattern)
    cores = spark.sparkContext.defaultParallelism
    level = spark.createDataFrame([("",)], "relative string")
    files = None
    while True:
        found = materialize(level.mapInArrow(task, _FOUND), "listing")
        here = found.where("not directory")
        files = here if files is None else files.unionByName(here)
        below = found.where("directory").select("relative")
        n = below.count()
        if n == 0:
            break
        level = below.repartition(min(n, max(cores, n // 1000 + 1)), "relative")
    path = F.concat(F.lit(root.rstrip("/") + "/"), "relative")
    folder = folder_of(path)
    return files.select(path.alias("path"), folder.alias("folder"), folder_order(folder, folders).alias("folder_ord"), "bytes", "relative")


def last_page(files: DataFrame) -> str | None:
    """Greatest name of a listing, for ``after`` in the next; None if it has no files.

    Names that sort before it and are added later are not found that way: it fits stores where new files come in new folders
    or with rising names. Otherwise list everything and let the ledger leave out what is done.
    """
    return files.agg(F.max("relative")).first()[0]


def _writer(root: str, by: Sequence[str], text: str) -> Callable:
    def write_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = opened(root.rstrip("/"))
        task, n, made = TaskContext.get().partitionId(), 0, set()
        for batch in batches:
            keys = zip(*(batch.column(name).to_pylist() for name in by), strict=True)
            for values, body in zip(keys, batch.column(text).cast(pa.binary()), strict=True):
                parts = [f"{name}={NO_VALUE if v in (None, '') else str(v).translate(_ESCAPED)}" for name, v in zip(by, values, strict=True)]
                directory = "/".join([base, *parts[:-1]])
                if directory not in made:
                    store.create_dir(directory, recursive=True)
                    made.add(directory)
                with store.open_output_stream(f"{directory}/{parts[-1]}.{task}-{n}.txt") as file:
                    if body.is_valid:
                        file.write(body.as_buffer())
                    file.write(b"\n")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["files"])

    return write_batches


def write_text_files(rows: DataFrame, root: str, by: Sequence[str], text: str = "text") -> int:
    """One text file a row, written by the task that holds it; the number of files.

    A file is named by the columns ``by``: ``root/folder=a/doc_id=7.<task>-<n>.txt``. All but the last are directories, so there
    are few of these; rows that repeat the names have files of their own. A text ends in a line break, a null one is empty.
    Spark's own writer opens a directory for each value and moves every file in the driver when the job ends.
    """
    written = rows.select(*by, text).mapInArrow(_writer(root, tuple(by), text), "files long")
    return written.agg(F.coalesce(F.sum("files"), F.lit(0)).alias("n")).first()["n"]


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stores: dict[str, fs.FileSystem] = {}

    def read(path: str) -> str | None:
        host = "/".join(path.split("/", 3)[:3]) if "://" in path else ""
        store, name = (stores[host], opened_name(path)) if host in stores else opened(path)
        stores[host] = store
        try:
            with store.open_input_stream(name) as file:
                return file.read().decode("utf-8", "replace")
        except FileNotFoundError:
            return None

    def batch_of(files: pa.RecordBatch, at: list[int], texts: list[str]) -> pa.RecordBatch:
        rows = files.take(pa.array(at, pa.int64()))
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(texts, pa.string())], [*rows.schema.names, "text"])

    for files in batches:
        at, texts, held = [], [], 0
        for i, path in enumerate(files.column("path").to_pylist()):
            text = read(path)
            if text is None:
                continue
            if at and held + len(text) > BATCH_CHARS:
                yield batch_of(files, at, texts)
                at, texts, held = [], [], 0
            at.append(i)
            texts.append(text)
            held += len(text)
        if at:
            yield batch_of(files, at, texts)


def read_pages(files: DataFrame) -> DataFrame:
    """``(doc_id, file_name, folder, folder_ord, text)`` of listed files, ready for the corpus build.

    Files are dealt out by name, so that a large folder is read by many tasks. Bytes that are not UTF-8 become U+FFFD. A file that is
    gone by now gives no row, and so stays unfinished. ``doc_id`` is a hash of the path, as in ``read_text_files``.
    """
    listed = files.select("path", "folder", "folder_ord")
    parts = max(files.sparkSession.sparkContext.defaultParallelism, files.count() // FILES_A_TASK + 1)
    rows = listed.repartition(parts, "path").mapInArrow(_read_batches, T.StructType([*listed.schema.fields, T.StructField("text", T.StringType())]))
    return rows.select(F.xxhash64("path").alias("doc_id"), F.col("path").alias("file_name"), "folder", "folder_ord", "text")
