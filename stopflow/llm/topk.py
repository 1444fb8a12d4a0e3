"""Exact top-k inner products by no-random-access aggregation over sorted lists.

Vectors become integers floor(256 * x). The stated queries meet all rows in blocks: rows are dealt into parts that
are sorted once, and each part meets blocks of BLOCK_QUERIES queries. A part has one list of its rows for each
dimension, sorted by value; a query reads each from the end that suits the sign of its component, a slice at a time.
What was read gives every row a partial score; the last value read bounds what an unread component can add, and the
far end of the list how little. Reading stops when no row that was never seen can pass the k-th best lower bound and
few rows have an upper bound at or above it; the exact scores of those decide. Bounds are matrix products over many
queries, taken at the depths PARTS, and from the second block on only from the depth before the one where the
first block's queries began to stop. The best of each part are merged.

Defined cases: rows with a null id, a null or empty vector, null or non-finite components take no part; vectors of
different lengths have no inner product, so each length is searched among its own rows; rows that share an id are
candidates each, but never for a query of that id, and a repeated query is answered once, by the vector that sorts
first, or the best over its lengths; ties go to the smaller vec_id; with fewer candidates all are returned; components of any finite size are
taken exactly, and a score beyond the range of a long is given as the nearest end of that range; an empty table gives
an empty result; other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, table
from .vectors import by_length, first_of_each, matrix, parts_of, queries, salt, valid

SCALE, EVERY, K = 256, 50, 5
#: Rows of a part and queries of a block, and queries whose bounds are taken at once.
BLOCK_ROWS, BLOCK_QUERIES, AT_ONCE = 32_768, 4096, 256
#: Depths to which the lists are read in turn; scores are resolved once at most the share FEW of the rows is left.
PARTS, FEW = (0.25, 0.5, 0.7, 0.85, 1.0), 0.05
#: Products are taken in longs where their sums stay below this, else in integers of any size.
LONG = 1 << 62
ENDS = 2.0**63


def integers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), in longs, or as integers of any size where longs do not hold them."""
    whole = np.floor(SCALE * x.astype(np.float64))
    if np.abs(whole).max(initial=0.0) < LONG:
        return whole.astype(np.int64)
    return np.array([[int(c) for c in row] for row in whole], object).reshape(whole.shape)


def scores(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact integer inner products of each row with its query, kept within the range of a long."""
    most = float(np.abs(rows).max(initial=0)) * float(np.abs(query).max(initial=0)) * max(rows.shape[1], 1)
    if most < LONG:
        return (rows.astype(np.int64) * query.astype(np.int64)).sum(axis=1)
    exact = (rows.astype(object) * query.astype(object)).sum(axis=1)
    return np.array([min(max(s, -(1 << 63)), (1 << 63) - 1) for s in exact], np.int64)


class Lists:
    """The rows of a part as sorted lists, one for each dimension."""

    def __init__(self, rows: np.ndarray):
        self.n = len(rows)
        self.x = rows.astype(np.float64)
        order = np.argsort(self.x, axis=0, kind="stable")
        self.values = np.take_along_axis(self.x, order, axis=0)
        self.rank = np.empty(order.shape, np.int32)
        np.put_along_axis(self.rank, order, np.arange(self.n, dtype=np.int32)[:, None], axis=0)
        self.start = 0

    def candidates(self, asked: np.ndarray, k: np.ndarray) -> list[np.ndarray]:
        """For each query, the places of all rows that can be among its k best.

        All queries read to the same depth; what they have read of a row is then known by its ranks, so the bounds
        of all rows for all queries are two matrix products. Sums are rounded, so a bar is lowered by more than that.
        """
        n, x, values, rank = self.n, self.x, self.values, self.rank
        weight = np.concatenate((np.maximum(asked, 0), np.minimum(asked, 0)), axis=1).astype(np.float64).T
        slack = 2.0**-40 * (np.abs(weight).T @ np.tile(np.abs(x).max(axis=0, initial=0.0), 2) + 1.0)
        out: list[np.ndarray] = [np.arange(n)] * len(asked)
        active = np.flatnonzero(k < n)
        for turn, part in enumerate(PARTS):
            if turn < self.start or not len(active):
                continue
            read = max(1, int(n * part))
            seen = np.concatenate((rank >= n - read, rank < read), axis=1)
            known = np.concatenate((x, x), axis=1)
            next_ = np.concatenate((values[n - read], values[read - 1]))  # the last values read bound all unread ones
            far = np.concatenate((values[0], values[-1]))  # the other ends
            lower = weight[:, active].T @ np.where(seen, known, far).T
            bar = np.array([np.partition(row, n - m)[n - m] for row, m in zip(lower, k[active], strict=True)])
            bar = np.where(bar <= -ENDS, -np.inf, np.minimum(bar, ENDS)) - slack[active]  # scores at the ends of a long are ties
            ready = np.flatnonzero((next_ @ weight[:, active] < bar) | (read == n))  # no unseen row can qualify
            upper = weight[:, active[ready]].T @ np.where(seen, known, next_).T
            done = np.zeros(len(active), bool)
            for place, row in zip(ready.tolist(), upper, strict=True):
                left = np.flatnonzero(row >= bar[place])
                if len(left) <= max(FEW * n, 4 * k[active[place]]) or read == n:
                    out[active[place]], done[place] = left, True
            if done.any() and not self.start:
                self.start = max(turn - 1, 0)
            active = active[~done]
        return out


def _block(rows: pa.Table, asked: pa.Table, k: int) -> pa.Table:
    """The k best of a part's rows for each query of a block."""
    ids, wanted = (t.column(c).to_numpy() for t, c in ((rows, "vec_id"), (asked, "query_id")))
    out: list[np.ndarray] = [np.zeros((0, 3), np.int64)]
    if len(ids) and len(wanted):
        x, q = integers(matrix(rows.column("embedding"))), integers(matrix(asked.column("embedding")))
        lists, (known, often) = Lists(x), np.unique(ids, return_counts=True)
        spot = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
        own = k + np.where(known[spot] == wanted, often[spot], 0)
        for a in range(0, len(wanted), AT_ONCE):
            for one, query, left in zip(wanted[a:].tolist(), q[a:], lists.candidates(q[a : a + AT_ONCE], own[a : a + AT_ONCE]), strict=False):
                left = left[ids[left] != one]
                score = scores(x[left], query)
                best = first_of_each(np.zeros(len(left), np.int64), score, ids[left], k)
                out.append(np.stack((np.full(len(best), one), ids[left[best]], score[best]), axis=1))
    columns = np.concatenate(out).T
    return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("query_id", "vec_id", "score"), columns, strict=True)})


def search(rows: DataFrame, every: int = EVERY, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score for the queries among valid rows (vec_id, embedding)."""
    spark = rows.sparkSession

    def of_length(rows: DataFrame, about: dict) -> DataFrame:
        asked = saved(queries(rows, every), "queries")
        row_parts, query_parts = parts_of(about["n"], BLOCK_ROWS, spark), -(-asked.count() // BLOCK_QUERIES)
        every_row, every_query = (F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1))) for n in (row_parts, query_parts))
        left = rows.select("vec_id", "embedding", salt(row_parts, "vec_id", "embedding").alias("r"), every_query.alias("q"))
        right = asked.select("query_id", "embedding", salt(max(query_parts, 1), "query_id").alias("q"), every_row.alias("r"))
        block = lambda rows, asked: _block(rows, asked, k)
        return left.groupBy("q", "r").cogroup(right.groupBy("q", "r")).applyInArrow(block, "query_id long, vec_id long, score long")

    found = by_length(rows, of_length)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    ranked = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", ranked).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(valid(table(spark, sf_dir, "embeddings")))
