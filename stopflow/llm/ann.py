"""Approximate nearest neighbours by inner product: inverted lists with adaptive dimension scans.

Inner products become distances: with vectors scaled to norms of at most 1, a vector x gets one more component
sqrt(1 - |x|^2), a query a zero there, so the nearest extended vector has the largest product. A random rotation then
spreads each vector's length over all dimensions. Lists are k-means cells, about sqrt(rows) of them but MOST_LISTS at
most, fitted on a bounded sample of SAMPLE_EACH rows a list; every row is in the list of its nearest centre. A query
probes its nearest lists, as many as sample rows need to find the share RECALL of their nearest within the sample,
which is no easier than among all rows. Within the lists it scans column blocks of WIDTH rotated dimensions: after each
block a row is abandoned when its partial distance, scaled to all dimensions, exceeds the query's bound, its k-th best
distance to the sample, by more than the test's margin (Gao, Long, "High-dimensional approximate nearest neighbor
search: with reliable and efficient distance comparison operations", SIGMOD 2023). The rows left are scored exactly on
the original vectors.

Neighbouring lists form groups of about GROUP_ROWS rows, and a group larger than that is cut into parts by hash. A row
goes to one part; a query goes once to each part that holds a list it probes, so queries and not rows are copied.

Defined cases: rows with a null id, a null, empty or zero vector, null or non-finite components take no part; vectors
of different lengths have no inner product, so each length has an index of its own; rows that share an id are
candidates each, but never for a query of that id, and a repeated query is answered once, by the vector that sorts
first, or the best over its lengths; ties go to the smaller vec_id; a query probes on until its lists hold enough rows,
so with few candidates all are returned; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, table
from .vectors import by_length, first_of_each, matrix, parts_of, queries, salt, valid

EVERY, K = 20, 20
#: Most lists, sample rows for each, and the share of the sample's nearest that probing has to find.
MOST_LISTS, SAMPLE_EACH, RECALL = 1024, 32, 0.97
#: Sample rows that set the number of probes.
TRIALS = 512
#: Width of a column block, and the margin of the test in units of 1 / sqrt(dimensions read).
WIDTH, MARGIN = 16, 2.1
#: Pairs are taken one by one once this share of a block is left.
SPARSE = 0.05
#: Rows of a group of lists and queries of a block, about, and pairs and rows whose distances are taken at once.
GROUP_ROWS, BLOCK_QUERIES, PAIRS, AT_ONCE = 32_768, 16_384, 1 << 21, 1024


class Index:
    """Rotation, centres and probes, fitted on a sample of vectors; `reach` is the largest norm of any row."""

    def __init__(self, sample: np.ndarray, reach: float, lists: int, k: int = K, seed: int = 1):
        random = np.random.default_rng(seed)
        width = sample.shape[1] + 1
        self.reach = reach
        self.rotation = np.linalg.qr(random.normal(size=(width, width)))[0]
        x = self.extended(sample)
        self.sample = x
        self.centres = x[random.choice(len(x), min(lists, len(x)), replace=False)]
        for _ in range(10):
            near = self.nearest(x)
            for c in np.unique(near):
                self.centres[c] = x[near == c].mean(axis=0)
        self.centres = self.centres[_in_line(self.centres)]
        self.sample_list = self.nearest(x)
        self.probes = self._probes(sample[:TRIALS], k)

    def _probes(self, asked: np.ndarray, k: int) -> int:
        """How many lists the asked rows of the sample probe to find the share RECALL of their k nearest in it."""
        q = self.extended(asked, query=True)
        far = self._to_sample(q)
        far[np.arange(len(q)), np.arange(len(q))] = np.inf
        best = np.argsort(far, axis=1, kind="stable")[:, : min(k, len(self.sample) - 1)]
        if not best.size:
            return len(self.centres)
        place = np.empty((len(q), len(self.centres)), np.int64)
        np.put_along_axis(place, np.argsort(self.distances(q), axis=1, kind="stable"), np.arange(len(self.centres))[None, :], axis=1)
        needed = np.take_along_axis(place, self.sample_list[best], axis=1)
        return int(np.quantile(needed, RECALL)) + 1

    def extended(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        x = x / self.reach
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(1.0 - (x * x).sum(axis=1), 0.0))
        return np.concatenate((x, more[:, None]), axis=1) @ self.rotation

    def distances(self, x: np.ndarray) -> np.ndarray:
        return (self.centres**2).sum(axis=1) - 2.0 * x @ self.centres.T

    def nearest(self, x: np.ndarray) -> np.ndarray:
        parts = [self.distances(x[a : a + AT_ONCE]).argmin(axis=1) for a in range(0, len(x), AT_ONCE)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def _to_sample(self, q: np.ndarray) -> np.ndarray:
        return (q**2).sum(axis=1)[:, None] + (self.sample**2).sum(axis=1) - 2.0 * q @ self.sample.T

    def bounds(self, q: np.ndarray, probed: np.ndarray, k: int) -> np.ndarray:
        """For each extended query, the k-th smallest distance to the sample rows of its probed lists.

        It is no less than the k-th smallest to all rows of these lists; infinite where the sample has too few.
        """
        if len(self.sample) < k:
            return np.full(len(q), np.inf)
        out = np.empty(len(q))
        for a in range(0, len(q), AT_ONCE // 4):
            far = self._to_sample(q[a : a + AT_ONCE // 4])
            far[~probed[a : a + AT_ONCE // 4][:, self.sample_list]] = np.inf
            out[a : a + AT_ONCE // 4] = np.partition(far, k - 1, axis=1)[:, k - 1]
        return out

    def scan(self, x: np.ndarray, q: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, row) that no test abandons, among extended rows x and queries q with their bounds.

        All pairs of a block are taken at once until few are left, then those alone.
        """
        width, slack = x.shape[1], 1e-9
        partial, at, row = np.zeros((len(q), len(x))), None, None
        for start in range(0, width, WIDTH):
            stop = min(start + WIDTH, width)
            u, v = q[:, start:stop], x[:, start:stop]
            margin = (1 + MARGIN / stop**0.5) ** 2 * stop / width if stop < width else 1.0
            if at is None:
                partial += (u**2).sum(axis=1)[:, None] + (v**2).sum(axis=1) - 2.0 * u @ v.T
                kept = partial <= (bound * margin + slack)[:, None]
                if stop == width or kept.mean() < SPARSE:
                    at, row = np.nonzero(kept)
                    partial = partial[at, row]
            else:
                partial = partial + ((u[at] - v[row]) ** 2).sum(axis=1)
                kept = partial <= bound[at] * margin + slack
                at, row, partial = at[kept], row[kept], partial[kept]
        return at, row


def _in_line(centres: np.ndarray) -> np.ndarray:
    """An order of the centres in which neighbours are near: halves along the widest dimension, again and again."""
    done, open_ = [], [np.arange(len(centres))]
    while open_:
        some = open_.pop()
        if len(some) < 3:
            done.append(some)
            continue
        axis = int(np.ptp(centres[some], axis=0).argmax())
        some = some[np.argsort(centres[some, axis], kind="stable")]
        open_ += [some[len(some) // 2 :], some[: len(some) // 2]]
    return np.concatenate(done)


def _scan_part(index: Index, k: int, rows: pa.Table, asked: pa.Table) -> pa.Table:
    """For each query the k best of a part's rows among the lists it probes."""
    best: tuple = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    who = asked.column("query_id").to_numpy()
    if rows.num_rows and asked.num_rows:
        ids, list_ = rows.column("vec_id").to_numpy(), rows.column("list").to_numpy()
        x, q, bound = matrix(rows.column("embedding")), matrix(asked.column("embedding")), asked.column("bound").to_numpy()
        ex, eq = index.extended(x), index.extended(q, query=True)
        lists = asked.column("lists").combine_chunks()
        probed = lists.flatten().to_numpy()
        asker = np.repeat(np.arange(len(who)), np.diff(lists.offsets.to_numpy()))
        row_order, probe_order = np.argsort(list_, kind="stable"), np.argsort(probed, kind="stable")
        for one in np.unique(list_):
            here = row_order[slice(*np.searchsorted(list_[row_order], (one, one + 1)))]
            askers = asker[probe_order[slice(*np.searchsorted(probed[probe_order], (one, one + 1)))]]
            step = max(1, PAIRS // len(here))
            found = [best]
            for a in range(0, len(askers), step):
                some = askers[a : a + step]
                at, row = index.scan(ex[here], eq[some], bound[some])
                at, row = some[at], here[row]
                other = ids[row] != who[at]
                at, row = at[other], row[other]
                score = np.empty(len(at))
                for b in range(0, len(at), 65536):
                    score[b : b + 65536] = (x[row[b : b + 65536]] * q[at[b : b + 65536]]).sum(axis=1)
                found.append((at, ids[row], score))
            at, other_id, score = (np.concatenate(c) for c in zip(*found, strict=True))
            kept = first_of_each(at, score, other_id, k)
            best = at[kept], other_id[kept], score[kept]
    return pa.table({"query_id": pa.array(who[best[0]], pa.int64()), "vec_id": pa.array(best[1], pa.int64()), "score": pa.array(best[2], pa.float64())})


def _search_length(rows: DataFrame, about: dict, every: int, k: int) -> DataFrame | None:
    """(query_id, vec_id, score): the k best of each part for the queries among rows of one length."""
    spark, n = rows.sparkSession, about["n"]
    wanted = max(1, min(MOST_LISTS, round(n**0.5)))
    size = SAMPLE_EACH * wanted
    share = int(min(1.0, 1.5 * size / n + 1e-3) * (1 << 20))
    drawn = rows.withColumn("place", F.xxhash64("vec_id", "embedding")).filter(F.pmod("place", F.lit(1 << 20)) < share)
    sample = drawn.orderBy("place", "vec_id").limit(size).select("embedding").toArrow()
    if not sample.num_rows:
        return None
    index = Index(matrix(sample.column("embedding")), about["reach"], wanted, k)
    lists = len(index.centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = index.nearest(index.extended(matrix(pa.chunked_array([batch.column("embedding")]))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32))], ["vec_id", "embedding", "list"])

    listed = saved(rows.mapInArrow(assign, "vec_id long, embedding array<double>, list int"), "lists")
    sizes = np.zeros(lists, np.int64)
    for r in listed.groupBy("list").count().collect():  # a row for each list
        sizes[r["list"]] = r["count"]
    # Runs of neighbouring lists with about equal rows.
    groups = min(lists, parts_of(n, GROUP_ROWS, spark))
    group = np.minimum((np.cumsum(sizes) - sizes) * groups // n, groups - 1)
    parts = np.maximum(1, -(-np.bincount(group, sizes, groups).astype(np.int64) // (2 * GROUP_ROWS)))
    enough = 4 * k + 1

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = index.extended(matrix(pa.chunked_array([batch.column("embedding")])), query=True)
            near = np.argsort(index.distances(q), axis=1, kind="stable")
            filled = np.cumsum(sizes[near], axis=1) - sizes[near] < enough
            filled[:, : index.probes] = True
            at, place = np.nonzero(filled)
            probed = np.zeros((len(q), lists), bool)
            probed[at, near[at, place]] = True
            bound = index.bounds(q, probed, k + 1)
            at, list_ = np.nonzero(probed)  # in order of query, then list, so of group as well
            fresh = np.flatnonzero(np.diff(at * groups + group[list_], prepend=-1))
            ends = np.append(fresh, len(at)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    *(c.take(pa.array(at[fresh])) for c in batch.columns),
                    pa.array(group[list_[fresh]].astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(list_.astype(np.int32))),
                    pa.array(bound[at[fresh]]),
                ],
                ["query_id", "embedding", "group", "lists", "bound"],
            )

    schema = "query_id long, embedding array<double>, group int, lists array<int>, bound double"
    asked = saved(queries(listed.drop("list"), every).mapInArrow(probe, schema), "probes")
    most = asked.groupBy("group").count().agg(F.max("count")).first()[0] or 1
    blocks = -(-most // BLOCK_QUERIES)
    group_of, parts_by = (F.array(*map(F.lit, x.tolist())) for x in (group, parts))
    every_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    dealt = listed.withColumn("group", F.get(group_of, "list"))
    left = dealt.select("*", salt(F.get(parts_by, "group"), "vec_id", "embedding").alias("r"), every_block.alias("q"))
    every_part = F.explode(F.sequence(F.lit(0), F.get(parts_by, "group") - 1))
    right = asked.select("*", salt(blocks, "query_id").alias("q"), every_part.alias("r"))
    keys = ["group", "r", "q"]
    scan = lambda rows, asked: _scan_part(index, k, rows, asked)
    return left.groupBy(keys).cogroup(right.groupBy(keys)).applyInArrow(scan, "query_id long, vec_id long, score double")


def search(rows: DataFrame, every: int = EVERY, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score for the queries among valid rows (vec_id, embedding), none of which is zero."""
    top = F.array_max(F.transform("embedding", F.abs))
    norm = F.aggregate(F.transform("embedding", lambda c: c / top), F.lit(0.0), lambda a, c: a + c * c, lambda a: F.sqrt(a) * top)
    found = by_length(rows, lambda some, about: _search_length(some, about, every, k), reach=F.max(norm))
    if found is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    ranked = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", ranked).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_approximate_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(valid(table(spark, sf_dir, "embeddings"), nonzero=True))
