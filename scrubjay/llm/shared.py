"""Shared storage, Arrow helpers and text primitives of the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import removed, scratch, small_batches, stored  # noqa: F401  (the operators take them from here)

#: Java form of one word; white space is U+0020 and U+0009 to U+000D only.
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"
SPACE_PATTERN = "[\\x20\\x09-\\x0D]"


def file_system(uri: str):
    """(pyarrow file system, path) of a folder or file under the shared root, usable from a Python worker."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def publish(uri: str, data: bytes) -> None:
    """Write one file whole: under a temporary name first, then renamed, so readers never see half of it."""
    system, path = file_system(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.part-{uuid.uuid4().hex}"
    with system.open_output_stream(part, compression=None) as out:
        out.write(data)
    system.move(part, path)


def released() -> None:
    """Give memory that is free in this worker back to the system: workers stay between tasks and share a machine."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def slices(batches: Iterator[pa.RecordBatch], column: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about `limit` bytes of the given column, one row at least."""
    for batch in batches:
        released()
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            base = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to
    released()


#: How numbers of F.monotonically_increasing_id tell the task that drew them: all bits above these.
WITHIN_TASK = 33


def numbered(df: DataFrame, path: str) -> DataFrame:
    """df stored with a column `number`, drawn while the table is written and only read from then on: unique, and by file."""
    return stored(df.withColumn("number", F.monotonically_increasing_id()), path)


def beside(rows: DataFrame, marks: DataFrame, folder: str, then: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None, schema: str | None = None) -> DataFrame:
    """Rows of a `numbered` table that marks has by `number`, with the columns of marks; rows are not shuffled.

    Marks, each number once at most, are dealt and written by the task that drew the numbers: a file's rows lie together, and so
    do their marks, which a task reads when it meets the file's numbers. It holds one file's marks at a time. then, whose result has the
    schema given, goes on with what was found in the same worker.
    """
    part = F.shiftright("number", WITHIN_TASK)
    marks.withColumn("part", part).repartition("part").write.mode("overwrite").partitionBy("part").parquet(folder)
    names = [c for c in marks.columns if c != "number"]
    found_schema = StructType([*rows.schema.fields, *(marks.schema[c] for c in names)])
    at = rows.columns.index("number")

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, batch.num_rows * (4 << 20) // max(1, batch.nbytes))
            for at_row in range(0, batch.num_rows, step):
                yield batch.slice(at_row, step)
            del batch
            released()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs, parquet

        system, root = file_system(folder)
        held: tuple[int, pa.Table | None] = (-1, None)

        def marks_of(task: int) -> pa.Table | None:
            found = system.get_file_info(fs.FileSelector(f"{root}/part={task}", allow_not_found=True))
            tables = []
            for name in sorted(f.path for f in found if f.path.endswith(".parquet")):
                with system.open_input_file(name) as file:
                    tables.append(parquet.ParquetFile(file).read())
            return pa.concat_tables(tables).sort_by("number").combine_chunks() if tables else None

        for batch in small(batches):
            numbers = batch.column(at).to_numpy()
            tasks = numbers >> WITHIN_TASK
            starts = np.flatnonzero(np.concatenate([[True], tasks[1:] != tasks[:-1]])) if len(numbers) else []
            for s, e in zip(starts, [*starts[1:], len(numbers)], strict=True):
                if held[0] != tasks[s]:
                    held = (int(tasks[s]), marks_of(int(tasks[s])))
                if held[1] is None:
                    continue
                known = held[1].column("number").to_numpy()
                place = np.minimum(np.searchsorted(known, numbers[s:e]), len(known) - 1)
                hit = known[place] == numbers[s:e]
                if hit.any():
                    own = batch.slice(s, e - s).filter(pa.array(hit))
                    more = held[1].take(pa.array(place[hit])).combine_chunks().to_batches()[0]
                    yield pa.RecordBatch.from_arrays([*own.columns, *(more.column(c) for c in names)], names=found_schema.names)

    return rows.mapInArrow((lambda batches: then(run(batches))) if then else run, schema or found_schema)


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of each text (null: none) as dictionary codes: row offsets, codes in text order, distinct words.

    Words are runs of anything but U+0020 and U+0009 to U+000D.
    """
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(texts)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values
    offsets, flat = offsets - offsets[0], flat.slice(offsets[0], offsets[-1] - offsets[0])
    if len(flat):
        full = pc.greater(pc.binary_length(flat), 0)
        if not pc.all(full).as_py():
            keep = full.to_numpy(zero_copy_only=False)
            offsets = np.concatenate([[0], np.cumsum(keep)])[offsets].astype(np.int64)
            flat = flat.filter(full)
    coded = flat.dictionary_encode()
    return offsets, coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def binary_array(pieces: list[bytes]) -> pa.Array:
    return pa.array(pieces, type=pa.binary())


def string_parts(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string array without nulls; offsets count from the start of bytes."""
    _, offsets, data = strings.buffers()
    at = np.frombuffer(offsets, np.int32)[strings.offset : strings.offset + len(strings) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.array([], np.uint8)
    return at.astype(np.int64), raw
