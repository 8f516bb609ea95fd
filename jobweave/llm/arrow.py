"""Arrow batches inside tasks: bounded slices of text columns, whole key groups of sorted rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one numpy pass takes; a longer text is a pass of its own.
SLICE_BYTES = 1 << 18
#: Rows of texts that come to a task at once.
BATCH_ROWS = 1000
#: Rows of a group that one task compares with each other; larger groups are dealt out by pairs of blocks.
BLOCK = 512


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it while the table already has such a column (any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch to ``BATCH_ROWS`` rows, so that a worker never holds thousands of texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(ends):
        ends = np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column of at most ``limit`` bytes each, or of one row."""
    _, ends = text_bytes(column)
    at, n = 0, len(ends) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def binary_rows(column: pa.Array, dtype: str) -> list[np.ndarray]:
    """One typed array for each value of a binary column."""
    raw, ends = text_bytes(column)
    return [np.frombuffer(raw[a:b].tobytes(), dtype) for a, b in zip(ends[:-1], ends[1:])]


def add_columns(
    df: DataFrame, text: str, fields: list[tuple[str, str]], fn: Callable[[pa.Array], list], limit: int = SLICE_BYTES
) -> DataFrame:
    """``df`` with columns that ``fn`` computes from slices of the column ``text``, in one pass without a shuffle.

    ``fn`` takes a string array and gives one sequence for each of ``fields`` (name, SQL type).
    """
    small_batches(df.sparkSession)
    names = [n for n, _ in fields]
    added = df.limit(0).select(*[F.lit(None).cast(t).alias(n) for n, t in fields]).schema
    schema = T.StructType([*df.schema.fields, *[T.StructField(f.name, f.dataType, True) for f in added]])
    at = df.columns.index(text)
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = [to_arrow_schema(added).field(n).type for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(at), limit):
                part = batch.slice(a, b - a)
                got = fn(part.column(at))
                new = [x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(got, kinds)]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, *names])

    return df.mapInArrow(run, schema)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 4096) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by ``keys`` as tables of whole groups, with the n + 1 borders of the groups.

    Groups are small (``deal_blocks`` sees to it), so what is held is bounded by ``rows`` and one group.
    """
    held: list[pa.RecordBatch] = []
    n = 0

    def borders(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        new[:1] = True
        for k in keys:
            col = table.column(k).combine_chunks()
            codes = col.dictionary_encode()
            if isinstance(codes, pa.ChunkedArray):
                codes = codes.combine_chunks()
            ids = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            new[1:] |= ids[1:] != ids[:-1]
        return np.append(np.flatnonzero(new), table.num_rows)

    def flush(last: bool) -> Iterator[tuple[pa.Table, np.ndarray]]:
        nonlocal held, n
        table = pa.Table.from_batches(held).combine_chunks()
        at = borders(table)
        if not last:
            at = at[:-1]
        if len(at) > 1 or last:
            yield table.slice(0, int(at[-1])), at
            rest = table.slice(int(at[-1]))
            held = rest.to_batches()
            n = rest.num_rows

    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            part = batch.slice(a, rows)
            held.append(part)
            n += part.num_rows
            if n >= rows:
                yield from flush(False)
    if n:
        yield from flush(True)
