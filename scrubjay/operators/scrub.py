"""Format kernels over rows of bytes, in Arrow batches of a few megabytes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..kernels.base import Policy
from ..kernels.formats import Unsupported, facts_of, scrub
from ..session import small_batches
from . import sniff

REMOVALS = "array<struct<where:string,what:string,detail:string,applied:boolean>>"
SCRUBBED = f"data binary, removals {REMOVALS}, preserved array<string>, changed boolean, error string"
REMOVAL_TYPE = pa.list_(pa.struct([("where", pa.string()), ("what", pa.string()), ("detail", pa.string()), ("applied", pa.bool_())]))
#: A worker holds so much at once, with what is found in it; of small files, the findings take more room than the bytes.
BATCH_BYTES, BATCH_ROWS = 1 << 20, 256
#: Larger files are reported, not read: a row's bytes, old and new, must fit in a worker, and 2 GiB is what a row can hold at all.
MOST_BYTES = 512 << 20
UNREAD = f"not read: missing, not permitted, or of more than {MOST_BYTES >> 20} MiB"


def small(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Slices of about BATCH_BYTES of one column and at most BATCH_ROWS, a row at least."""
    for batch in batches:
        start, held = 0, 0
        for i, value in enumerate(batch.column(column)):
            size = value.as_buffer().size if value.is_valid else 0
            if i > start and (held + size > BATCH_BYTES or i - start == BATCH_ROWS):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if batch.num_rows > start:
            yield batch.slice(start)


def with_format(files: DataFrame) -> DataFrame:
    return files.withColumn("format", sniff.format_of(F.col("content"), F.col("suffix")))


def scrubbed_bytes(data: bytes | None, kind: str | None, suffix: str, policy: Policy) -> tuple:
    """(data, removals, preserved, changed, error); data is null unless it changed."""
    if data is None:
        return None, [], [], False, UNREAD
    try:
        out = scrub(data, kind, suffix or "", policy)
    except Unsupported as exc:
        return None, [], [], False, str(exc)
    except Exception as exc:
        return None, [], [], False, f"{type(exc).__name__}: {exc}"
    return out.data if out.changed else None, [r._asdict() for r in out.removals], out.preserved, out.changed, None


def scrub_rows(files: DataFrame, policy: Policy = Policy(), along: str | None = None) -> DataFrame:
    """path, format, data, removals, preserved, changed, error of rows (path, suffix, content).

    along names a column that comes along, so what is known of a file needs no join with its contents.
    """
    more = [along] if along else []
    rows = with_format(files.select("path", "suffix", "content", *more)).select("path", "suffix", "format", "content", *more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small(batches, 3):
            found = [scrubbed_bytes(d, k, s, policy) for s, k, d in zip(*(part.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
            data, removals, preserved, changed, errors = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([*part.columns[4:], part.column(0), part.column(2), pa.array(data, pa.binary()), pa.array(removals, REMOVAL_TYPE), pa.array(preserved, pa.list_(pa.string())), pa.array(changed, pa.bool_()), pa.array(errors, pa.string())], names=[*more, "path", "format", "data", "removals", "preserved", "changed", "error"])

    small_batches(files.sparkSession)
    schema = StructType([f for f in rows.schema if f.name in more])
    return rows.mapInArrow(run, StructType([*schema, *StructType.fromDDL(f"path string, format string, {SCRUBBED}")]))


def scrubbed(files: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """path and content of rows (path, suffix, content) as they are after scrubbing; what did not change or could not be scrubbed is as it was."""
    rows = scrub_rows(files.withColumn("old", F.col("content")), policy, "old")
    return rows.select("path", F.coalesce("data", "old").alias("content"))


def facts(files: DataFrame) -> DataFrame:
    """path, embedded, remote_url, unrecognized, signer of rows (path, suffix, content)."""
    from ..functions.provenance import SIGNER

    rows = with_format(files.select("path", "suffix", "content")).select("path", "format", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small(batches, 2):
            found = [facts_of(d or b"", k) for k, d in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([f.embedded for f in found], pa.bool_()), pa.array([f.remote_url for f in found], pa.string()), pa.array([f.unrecognized for f in found], pa.string())], names=["path", "embedded", "remote_url", "unrecognized"])

    small_batches(files.sparkSession)
    # Without an SDK that reads manifests, who signed is not known.
    return rows.mapInArrow(run, "path string, embedded boolean, remote_url string, unrecognized string").withColumn("signer", F.lit(None).cast(SIGNER))
