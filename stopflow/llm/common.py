"""What the operators of this subpackage share: the shared working folder and blocks of text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..sources.working import forget, materialised

__all__ = ["BLOCK_BYTES", "blocks", "buffers", "forget", "free_name", "saved", "table"]
#: Bytes of text that a kernel works on at once; one longer document makes a block of its own.
BLOCK_BYTES = 2 << 20


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes a frame to the shared folder and reads it back; see working.materialised()."""
    return materialised(df, name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column, and where each row starts; a null row has no bytes."""
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        wide = np.int32
    else:
        column, wide = column.cast(pa.large_binary()), np.int64
    if column.null_count:
        column = pc.fill_null(column, b"" if "binary" in str(column.type) else "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a text column into row ranges of about `limit` bytes: first row, end row, bytes, row borders."""
    data, at = buffers(column)
    first, rows = 0, len(column)
    while first < rows:
        last = int(np.searchsorted(at, at[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last, data[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
