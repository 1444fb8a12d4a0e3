"""What the two vector searches share: valid rows, and blocks of queries against blocks of rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def valid(vectors: DataFrame, nonzero: bool = False) -> DataFrame:
    """(vec_id, embedding as doubles) of rows without nulls or non-finite components; with nonzero, no zero vectors."""
    x = F.col("embedding")
    fit = F.forall(x, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))
    some = F.exists(x, lambda c: c != 0) if nonzero else F.lit(True)
    rows = vectors.filter(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0)).filter(fit & some)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<double>").alias("embedding"))


def queries(rows: DataFrame, every: int) -> DataFrame:
    """(query_id, embedding) of the ids that `every` divides; an id that is repeated asks once."""
    asked = rows.filter(F.col("vec_id") % every == 0)
    return asked.groupBy(F.col("vec_id").alias("query_id")).agg(F.min("embedding").alias("embedding"))


def salt(parts: Column | int, *of: str) -> Column:
    """A part for each row by a hash of it, so that rows of one id are spread as well."""
    return F.pmod(F.xxhash64(*of), parts if isinstance(parts, Column) else F.lit(parts)).cast("int")


def by_length(rows: DataFrame, search: Callable[[DataFrame, dict], DataFrame | None], **about: Column) -> DataFrame | None:
    """search() over the rows of each length, with the aggregates `about` and n of them; lengths never meet.

    The driver gets a row for each length that occurs.
    """
    width = F.size("embedding")
    found = rows.groupBy(width.alias("width")).agg(F.count("*").alias("n"), *(v.alias(k) for k, v in about.items())).orderBy("width").collect()
    parts = [search(rows.filter(width == r["width"]), r.asDict()) for r in found]
    parts = [p for p in parts if p is not None]
    return reduce(DataFrame.unionByName, parts) if parts else None


def parts_of(rows: int, each: int, spark: SparkSession) -> int:
    """Into how many parts rows are dealt: of `each` rows about, and enough for all cores."""
    return max(1, min(rows, max(-(-rows // each), 2 * spark.sparkContext.defaultParallelism)))


def first_of_each(group: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores of each group, ties to the smaller id; groups in order."""
    order = np.lexsort((ids, ~scores if scores.dtype.kind == "i" else -scores, group))
    group = group[order]
    begin = np.searchsorted(group, group)
    return order[np.arange(len(order)) - begin < k]


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A list column of equal lengths as a matrix of doubles."""
    column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))
