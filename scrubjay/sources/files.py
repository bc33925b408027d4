"""File inventories, contents and atomic writes: local paths as such, addresses with a scheme through their own store."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator
from itertools import islice
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, StructField, StructType

from ..functions.paths import MANIFEST_SUFFIX, SUFFIXES
from ..operators.scrub import MOST_BYTES
from ..session import scratch, small_batches, stored
from . import stores

INVENTORY = "base string, path string, dir string, name string, stem string, suffix string, ord long, error string"


def rooted(paths: list[str], recursive: bool) -> Iterator[tuple[str, str, str | None]]:
    """(root, file, error): files as named, whatever their suffix; folders by suffix, sorted; what isn't there as an error."""
    for address in paths:
        if stores.is_address(address):
            yield from stores.rooted(address, recursive)
            continue
        given = Path(address)
        if given.is_dir():
            inside = (f for f in below(str(given), recursive) if split(f)[3].lower() in SUFFIXES)
            for child in sorted(inside, key=lambda f: f.split("/")):
                yield str(given), child, None
        elif given.is_file():
            yield str(given.parent), str(given), None
        else:
            yield str(given.parent), str(given), stores.ABSENT


def below(folder: str, recursive: bool) -> Iterator[str]:
    """The files in a folder; recursive: in its subfolders as well, but not through symbolic links, and folders that can't be listed are left out."""
    prefix = "" if folder == "." else folder.rstrip("/") + "/"
    try:
        with os.scandir(folder) as entries:
            inside = []
            for entry in entries:
                if entry.is_file(follow_symlinks=False) or (entry.is_symlink() and os.path.isfile(entry.path)):
                    yield prefix + entry.name
                elif recursive and entry.is_dir(follow_symlinks=False):
                    inside.append(prefix + entry.name)
    except OSError:
        if not recursive:
            raise
        return
    for child in inside:
        yield from below(child, True)


def split(path: str) -> tuple[str, str, str, str]:
    """(folder, name, stem, suffix) of a path or an address in its normal spelling."""
    folder, slash, name = path.rpartition("/")
    dot = name.rfind(".")
    stem, suffix = (name[:dot], name[dot:]) if 0 < dot < len(name) - 1 else (name, "")
    return folder or slash or ".", name, stem, suffix


def named(path: str) -> tuple[str, str, str, str]:
    """(folder, name, stem, suffix) of a path or an address."""
    return split(path if stores.is_address(path) else str(Path(path)))


#: So many names become rows at once.
NAMES_A_BATCH = 65536


def inventory(spark: SparkSession, paths: list[str], recursive: bool = False) -> DataFrame:
    """One row a file in visit order. Names are listed on the driver, once, and stored in batches; no content is read."""
    found = enumerate(rooted(paths, recursive))
    folder, schema = scratch(spark, "names"), StructType.fromDDL(INVENTORY)
    kinds = to_arrow_schema(schema)
    spark.createDataFrame([], schema).write.parquet(f"{folder}/listed")
    while rows := [(root, f, *named(f), k, error) for k, (root, f, error) in islice(found, NAMES_A_BATCH)]:
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.types, strict=True)]
        spark.createDataFrame(pa.Table.from_arrays(columns, schema=kinds), schema).write.mode("append").parquet(f"{folder}/listed")
    return spark.read.schema(schema).parquet(f"{folder}/listed")


def beside(folder: str) -> list[str]:
    """The files in a folder, sorted; none where there is no such folder."""
    if stores.is_address(folder):
        return stores.names(folder)
    return sorted(below(folder, False)) if Path(folder).is_dir() else []


def siblings(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Every name in the folders of the files: what manifests and their assets are looked for among. Each folder is listed once, and the names stored."""
    folders = files.select("dir").distinct().repartition(spark.sparkContext.defaultParallelism, "dir")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = iter(beside(folder))
                while part := list(islice(found, NAMES_A_BATCH)):
                    _, names, stems, suffixes = zip(*map(split, part), strict=True)
                    yield pa.RecordBatch.from_pydict({"path": part, "dir": [folder] * len(part), "name": names, "stem": stems, "suffix": suffixes})

    return stored(folders.mapInArrow(run, "path string, dir string, name string, stem string, suffix string"), f"{scratch(spark, 'beside')}/names")


def real_paths(files: DataFrame) -> DataFrame:
    """path and `real`: where it leads through symbolic links, from the task that looks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([stores.real(p) if stores.is_address(p) else str(Path(p).resolve()) for p in batch.column(0).to_pylist()], pa.string())], names=["path", "real"])

    return files.select("path").mapInArrow(run, "path string, real string")


def read(path: str, most: int | None = None) -> bytes:
    """The bytes of a file; one of more than `most` is an OSError."""
    size = 0 if most is None else stores.size(path) if stores.is_address(path) else os.path.getsize(path)
    if most is not None and size > most:
        raise OSError(f"{path} has {size} bytes")
    return stores.read(path) if stores.is_address(path) else Path(path).read_bytes()


#: Names are dealt by number, for Spark weighs what it deals and a name tells nothing of what a task will read. A task costs as much as
#: some hundred small files, so few files make small tasks only until each core has CORE_TASKS of them.
FILES_A_TASK, MOST_FILES_A_TASK, CORE_TASKS = 32, 8192, 8


def dealt(files: DataFrame, total: int) -> DataFrame:
    """files in tasks of FILES_A_TASK to MOST_FILES_A_TASK of `total` files."""
    cores = files.sparkSession.sparkContext.defaultParallelism
    tasks = min(-(-total // FILES_A_TASK), max(CORE_TASKS * cores, -(-total // MOST_FILES_A_TASK)))
    return files.repartition(max(1, tasks), "path")


#: Contents go on in batches of about so many bytes, a file at least.
CONTENT_BYTES, CONTENT_FILES = 1 << 20, 1024


def with_content(files: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """files and their content, read where the task runs.

    Null is the content of a file that can't be read or has more than `most` bytes, and of a detached manifest, which isn't read.
    """
    paths, suffixes = files.columns.index("path"), files.columns.index("suffix")
    schema = StructType([*files.schema, StructField("content", BinaryType())])

    def content(path: str, suffix: str | None) -> bytes | None:
        try:
            return None if (suffix or "").lower() == MANIFEST_SUFFIX else read(path, most)
        except OSError:
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def joined(batch: pa.RecordBatch, to: int, read: list[bytes | None]) -> pa.RecordBatch:
            rows = batch.slice(to - len(read), len(read))
            return pa.RecordBatch.from_arrays([*rows.columns, pa.array(read, pa.binary())], names=[*rows.schema.names, "content"])

        for batch in batches:
            held, size = [], 0
            for i, (path, suffix) in enumerate(zip(batch.column(paths).to_pylist(), batch.column(suffixes).to_pylist(), strict=True)):
                data = content(path, suffix)
                if held and (size + len(data or b"") > CONTENT_BYTES or len(held) == CONTENT_FILES):
                    yield joined(batch, i, held)
                    held, size = [], 0
                held.append(data)
                size += len(data or b"")
            if held:
                yield joined(batch, batch.num_rows, held)

    small_batches(files.sparkSession)
    return files.mapInArrow(run, schema)


def atomic_write(destination: str, data: bytes, mode_from: str | None = None) -> None:
    """Write beside the destination, then rename over it; nothing is left behind on failure."""
    if stores.is_address(destination):
        return stores.write(destination, data, mode_from)
    target = Path(destination)
    create = lambda: tempfile.mkstemp(prefix=f".{target.name}.", suffix=".tmp", dir=target.parent)
    try:
        handle, part = create()
    except FileNotFoundError:
        target.parent.mkdir(parents=True, exist_ok=True)
        handle, part = create()
    try:
        with open(handle, "wb") as out:
            out.write(data)
            out.flush()
            os.fsync(out.fileno())
        if mode_from and os.path.exists(mode_from):
            shutil.copymode(mode_from, part)
        os.replace(part, target)
    except BaseException:
        Path(part).unlink(missing_ok=True)
        raise


def write_rows(rows: DataFrame) -> DataFrame:
    """Writes (path, destination, data) and gives (path, written). Writing the same bytes again, in a retry, is harmless."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, destination, data in zip(*(batch.column(k).to_pylist() for k in range(2)), batch.column(2), strict=True):
                atomic_write(destination, data.as_py(), path)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["path", "written"])

    small_batches(rows.sparkSession)
    return rows.select("path", "destination", "data").mapInArrow(run, "path string, written string")
