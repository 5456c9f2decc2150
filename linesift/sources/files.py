"""Files as a source: listing (no bytes read), then loading of the surviving files only.

A tree in any store that ``pyarrow.fs`` opens is walked from a frontier of directories: the driver lists its upper levels,
up to a fixed number of entries; then jobs list the directories that are left, each task a bounded number of entries, and
hand on what lies deeper.  So a wide or deep subtree is dealt anew after each job.  Hidden names are listed like any
other, excluded directories are not entered, links to directories not followed.  A directory that can't be opened gives an
error row; a task that doesn't see the root at all fails.  Other stores are listed by Spark's ``binaryFile`` source
(``path, length, modificationTime`` only), which leaves out names starting with ``.`` or ``_``.

Pruning runs on the list.  The survivors' bytes are read by path inside the tasks (``pyarrow.fs``: local, HDFS, S3,
GCS), so excluded files are never opened.  Paths are made relative to the root (scheme and root removed) so directory
exclusions see only the directories below the root.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linesift.functions.regex import glob_to_java
from linesift.operators.prune import with_path_parts

CONTENT_SCHEMA = "path string, file_path string, content binary, error string"
MAX_FILE_BYTES = 1 << 30  # one file is one row: guard far below the 2 GiB row limit
LOAD_TASK_BYTES = 64 << 20  # file bytes one loading task reads


def _root_pattern(root: str) -> str:
    r = re.sub(r"^file:(//)?", "", root.rstrip("/"))
    return "^(?:file:)?(?://)?" + re.escape(r) + "/"


def list_files(spark: SparkSession, root: str, glob: str | None = None, exclude_dirs: Iterable[str] = ()) -> DataFrame:
    """Recursive listing: ``path`` (URI), ``file_path`` (relative), ``base_name, ext, dirs, length, modificationTime``.

    Directories named in ``exclude_dirs`` are not entered (in stores that only Spark lists: prune the listing).
    """
    return list_tree(spark, root, glob, exclude_dirs)[0]


def list_tree(spark: SparkSession, root: str, glob: str | None = None, exclude_dirs: Iterable[str] = ()) -> tuple[DataFrame, DataFrame]:
    """The listing of :func:`list_files`, and ``file_path, stage, message`` of directories that could not be opened."""
    local = re.sub(r"^file:(//)?", "", root)
    if ":" not in local.split("/")[0]:
        root = os.path.abspath(local)
        found = _tree(spark, f"file:{root}", frozenset(exclude_dirs))
    elif _opens(root):
        found = _tree(spark, root.rstrip("/"), frozenset(exclude_dirs))
    else:
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        found = listed, spark.createDataFrame([], "path string, message string")
    rel = F.regexp_replace(F.col("path"), _root_pattern(root), "")
    files = with_path_parts(found[0].select("path", "length", "modificationTime").withColumn("file_path", rel))
    errors = found[1].select(rel.alias("file_path"), F.lit("list").alias("stage"), "message")
    return (files.where(F.col("base_name").rlike(glob_to_java(glob))) if glob else files), errors


FILE_SCHEMA = "path string, length long, changed long"  # changed: microseconds
ENTRY_SCHEMA = f"kind string, {FILE_SCHEMA}, message string"  # kind: file, directory (still to be listed) or error
ENTRY_ROWS = 10_000  # listing rows per output record batch
DRIVER_ENTRIES = 10_000  # entries the driver lists at most, to have directories to deal out
TASK_ENTRIES = 100_000  # entries a task lists before it hands on the directories that are left
Entry = tuple[str, str, int | None, int | None, str | None]


def _opens(root: str) -> bool:
    """Whether ``pyarrow.fs`` knows the root's store."""
    try:
        return _open(root)[0] is not None
    except Exception:  # noqa: BLE001 - a scheme that only Spark's readers know
        return False


def _entries(directory: str, skip: frozenset[str]) -> Iterator[Entry]:
    """Files and directories of a directory (a URI); of links to directories, pipes and devices nothing."""
    try:
        yield from (_local_entries if directory.startswith("file:") else _store_entries)(directory, skip)
    except OSError as e:
        yield "error", directory, None, None, f"Error listing directory: {e}"


def _local_entries(directory: str, skip: frozenset[str]) -> Iterator[Entry]:
    with os.scandir(re.sub("^file:/+", "/", directory)) as found:
        for entry in found:
            path = f"file:{entry.path}"
            try:
                if entry.is_dir(follow_symlinks=False):
                    if entry.name not in skip:
                        yield "directory", path, None, None, None
                elif entry.is_file():
                    info = entry.stat()
                    yield "file", path, info.st_size, info.st_mtime_ns // 1000, None
                elif entry.is_symlink() and not os.path.exists(entry.path):
                    yield "file", path, 0, None, None  # leads nowhere: an error when it is read
            except OSError:
                yield "file", path, 0, None, None


def _store_entries(directory: str, skip: frozenset[str]) -> Iterator[Entry]:
    from pyarrow import fs

    filesystem, place = _open(directory)
    for info in filesystem.get_file_info(fs.FileSelector(place)):
        path = f"{directory.rstrip('/')}/{info.base_name}"
        if info.type == fs.FileType.Directory:
            if info.base_name not in skip:
                yield "directory", path, None, None, None
        elif info.type == fs.FileType.File:
            yield "file", path, info.size, (info.mtime_ns or 0) // 1000, None


def _rows(found: list[Entry]):
    import pyarrow as pa

    cols = list(zip(*found)) if found else [()] * 5
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["kind", "path", "length", "changed", "message"])


def _walk(batches: Iterator, skip: frozenset[str], root: str, most: int = TASK_ENTRIES) -> Iterator:
    """What lies in the given directories and below, up to ``most`` entries; directories left after that as such."""
    from pyarrow import fs

    filesystem, place = _open(root)
    if filesystem.get_file_info(place).type == fs.FileType.NotFound:
        raise FileNotFoundError(f"this executor does not see {root}")
    left = most
    for batch in batches:
        waiting, found = batch.column(0).to_pylist(), []
        while waiting:
            directory = waiting.pop()
            if left <= 0:
                found.append(("directory", directory, None, None, None))
            else:
                for entry in _entries(directory, skip):
                    left -= 1
                    if entry[0] == "directory":
                        waiting.append(entry[1])
                    else:
                        found.append(entry)
                        if len(found) >= ENTRY_ROWS:
                            yield _rows(found)
                            found = []
            if len(found) >= ENTRY_ROWS:
                yield _rows(found)
                found = []
        if found:
            yield _rows(found)


def _tree(spark: SparkSession, root: str, skip: frozenset[str], limit: int = DRIVER_ENTRIES, most: int = TASK_ENTRIES) -> tuple[DataFrame, DataFrame]:
    """``path, length, modificationTime`` of all files below ``root`` (a URI), and ``path, message`` of directories not opened.

    The driver lists while it has read at most ``limit`` entries.  Each job after that is written before the next begins,
    and only the number of directories left comes back from it.
    """
    import pyarrow as pa
    from pyarrow import fs

    from linesift.session import written

    filesystem, place = _open(root)
    info = filesystem.get_file_info(place)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(f"no such file or directory: {root}")
    single = info.type == fs.FileType.File
    found: list[Entry] = [("file", root, info.size, (info.mtime_ns or 0) // 1000, None)] if single else []
    waiting, left = [] if single else [root], limit
    while waiting:
        entries = list(islice(_entries(waiting[0], skip), left + 1))
        if len(entries) > left:
            break
        left -= len(entries)
        found += [e for e in entries if e[0] != "directory"]
        waiting = waiting[1:] + [e[1] for e in entries if e[0] == "directory"]
    out = spark.createDataFrame(pa.Table.from_batches([_rows(found)]), ENTRY_SCHEMA)
    if waiting:
        frontier, n = spark.createDataFrame(pa.table({"path": pa.array(waiting, pa.string())}), "path string"), len(waiting)
        while n:
            spread = frontier.repartition(min(n, 4 * spark.sparkContext.defaultParallelism))
            level = written(spread.mapInArrow(lambda it: _walk(it, skip, root, most), ENTRY_SCHEMA), "listing")
            out = out.unionByName(level.where("kind <> 'directory'"))
            frontier = level.where("kind = 'directory'").select("path")
            n = frontier.count()
    files = out.where("kind = 'file'").select("path", "length", F.timestamp_micros("changed").alias("modificationTime"))
    return files, out.where("kind = 'error'").select("path", "message")


def _walked(spark: SparkSession, root: str, skip: frozenset[str], limit: int = DRIVER_ENTRIES) -> DataFrame:
    """The files of a local tree."""
    return _tree(spark, f"file:{root}", skip, limit)[0]


def _open(path: str):
    """File system and plain path of a listed path, which is not URL-encoded: ``#``, ``?``, ``%`` and blanks are part of names."""
    from pyarrow import fs

    scheme, colon, rest = path.partition("://")
    if path.startswith("file:") or not colon:
        return fs.LocalFileSystem(), re.sub("^file:/+", "/", path)
    place, _, name = rest.partition("/")
    filesystem, base = fs.FileSystem.from_uri(f"{scheme}://{place}/")
    return filesystem, f"{base.rstrip('/')}/{name}"


def _read_one(uri: str, rel: str, max_bytes: int) -> tuple:
    try:
        filesystem, p = _open(uri)
        info = filesystem.get_file_info(p)
        if info.size is not None and info.size > max_bytes:
            return (uri, rel, None, f"file larger than {max_bytes} bytes")
        with filesystem.open_input_stream(p) as f:
            return (uri, rel, f.read(), None)
    except Exception as e:  # noqa: BLE001 - reported as a row, the scan goes on
        return (uri, rel, None, f"Error accessing file {rel}: {e}")


OUTPUT_BATCH_BYTES = 64 << 20  # file bytes per output record batch


def _read_batches(it: Iterator, max_bytes: int) -> Iterator:
    """Listing batches -> content batches; a batch is emitted whenever 64 MiB of file bytes were read.

    Input batches are listing rows (tiny), so their count says nothing about the
    bytes behind them; the output is bounded by bytes instead.
    """
    import pyarrow as pa

    schema = pa.schema([("path", pa.string()), ("file_path", pa.string()), ("content", pa.binary()), ("error", pa.string())])

    def emit(rows):
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, schema)], schema=schema)

    for batch in it:
        rows, size = [], 0
        for u, r in zip(batch.column("path").to_pylist(), batch.column("file_path").to_pylist()):
            row = _read_one(u, r, max_bytes)
            rows.append(row)
            size += len(row[2] or b"")
            if size >= OUTPUT_BATCH_BYTES:
                yield emit(rows)
                rows, size = [], 0
        if rows:
            yield emit(rows)


def _check_one(uri: str, rel: str, max_bytes: int) -> str | None:
    try:
        filesystem, p = _open(uri)
        info = filesystem.get_file_info(p)
        if info.size is not None and info.size > max_bytes:
            return f"file larger than {max_bytes} bytes"
        with filesystem.open_input_stream(p):  # opened, not read: permissions and existence
            return None
    except Exception as e:  # noqa: BLE001
        return f"Error accessing file {rel}: {e}"


def _check_batches(it: Iterator, max_bytes: int) -> Iterator:
    import pyarrow as pa

    schema = pa.schema([("file_path", pa.string()), ("message", pa.string())])
    for batch in it:
        rows = []
        for u, r in zip(batch.column("path").to_pylist(), batch.column("file_path").to_pylist()):
            msg = _check_one(u, r, max_bytes)
            if msg is not None:
                rows.append((r, msg))
        cols = list(zip(*rows)) if rows else [[], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, schema)], schema=schema)


def read_errors(files: DataFrame, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """``file_path, stage, message`` for listed files that cannot be read, from metadata only (no bytes read)."""
    checked = files.select("path", "file_path").mapInArrow(
        lambda it: _check_batches(it, max_bytes), "file_path string, message string"
    )
    return checked.select("file_path", F.lit("read").alias("stage"), "message")


def files_from(paths: DataFrame, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """``path`` (URI or absolute path) [+ ``file_path``] -> ``path, file_path, content, error``."""
    cols = paths.columns
    src = paths.select("path", F.col("file_path") if "file_path" in cols else F.col("path").alias("file_path"))
    return src.mapInArrow(lambda it: _read_batches(it, max_bytes), CONTENT_SCHEMA)


def sized_for_loading(files: DataFrame, task_bytes: int = LOAD_TASK_BYTES, stats: tuple[int, int] | None = None) -> DataFrame:
    """Partition a listing by the bytes its files hold, about ``task_bytes`` per task.

    The listing's own partitions follow Spark's split rules for tiny rows (many
    partitions of a few paths each).  One small aggregate over ``length`` gives
    the total (or ``stats`` passes it in); the listing is then coalesced (no
    shuffle) or spread round-robin (only listing rows move), never below the
    number of task slots.
    """
    try:
        slots = files.sparkSession.sparkContext.defaultParallelism
        current = files.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - no local context: keep the listing as it is
        return files
    if stats is None:
        row = files.agg(F.sum("length").alias("b"), F.count(F.lit(1)).alias("n")).collect()[0]
        stats = (int(row["b"] or 0), int(row["n"] or 0))
    total, count = stats
    if count == 0:
        return files
    want = max(slots, min(count, -(-total // task_bytes)))
    if want < current:
        return files.coalesce(want)
    if want > current:
        return files.repartition(want)
    return files


def load_contents(files: DataFrame, max_bytes: int = MAX_FILE_BYTES, stats: tuple[int, int] | None = None) -> DataFrame:
    """Bytes of the listed (already pruned) files, read where the rows are, about 64 MiB per task.

    ``stats`` = (total bytes, file count) when the caller already has them (saves one aggregation).
    """
    cols = ["path", "file_path"] + (["length"] if "length" in files.columns else [])
    listing = files.select(*cols)
    if "length" in listing.columns:
        listing = sized_for_loading(listing, stats=stats)
    return files_from(listing.select("path", "file_path"), max_bytes)
