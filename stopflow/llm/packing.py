"""Best-fit-decreasing packing of token pieces into sequences of bounded length.

Pieces of one length are alike, so the packing is planned on their counts alone: lengths are at most the
capacity, and a segment tree over remaining capacities finds the tightest open bin in logarithmic time.
Bins with the same filling are kept as ranges of sequence numbers, so a step of the plan places a whole run
of equal pieces where best-fit decreasing would put them one by one. The plan has a few thousand steps
whatever the number of documents; every piece then looks up its own place by its rank among its length.

Defined cases: a null or empty text is the closing id alone; texts of any length are cut into pieces, the
first of which may be shorter; an added token of the vocabulary written out in a text is that token; repeated
rows are packed each; a null doc_id is packed like any other; of bins with equal room any one is taken; an empty
table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import blocks, saved, table

CAPACITY = 2048
CLOSING = 0
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: About this many pieces are ranked together, in at most MOST_SHARDS shards.
SHARD_ROWS, MOST_SHARDS = 2048, 4096
#: Rows of a partition of the result, where the shuffles would leave more partitions with fewer.
PART_ROWS = 4096


class Capacities:
    """Counts of open bins by remaining capacity 0..size, in a segment tree."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, bins: int) -> None:
        node = room + self.leaves
        while node:
            self.count[node] += bins
            node >>= 1

    def tightest(self, need: int) -> int | None:
        """The least remaining capacity of an open bin that is at least `need`."""
        node = need + self.leaves
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        return node - self.leaves


def plan(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Best-fit decreasing for counts[length] pieces of each length.

    Returns rows (length, first rank, first sequence, pieces a sequence, offset), sorted, and the number of
    sequences: the piece of rank first + j lies in sequence + j // pieces, at offset + j % pieces * length.
    """
    tree = Capacities(capacity)
    ranges: dict[int, list[tuple[int, int]]] = {}
    rows, opened = [], 0

    def put(room: int, first: int, bins: int) -> None:
        if bins:
            ranges.setdefault(room, []).append((first, bins))
            tree.add(room, bins)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, bins = capacity, -(-left // (capacity // length))
                first, opened = opened, opened + bins
            else:
                first, bins = ranges[room].pop()
                tree.add(room, -bins)
            each = room // length
            placed = min(left, bins * each)
            rows.append((length, rank, first, each, capacity - room))
            full, rest = divmod(placed, each)
            put(room - each * length, first, full)
            if rest:
                put(room - rest * length, first + full, 1)
            used = full + bool(rest)
            put(room, first + used, bins - used)
            left, rank = left - placed, rank + placed
    return np.array(sorted(rows), np.int64).reshape(-1, 5), opened


@lru_cache(maxsize=2)
def encoding(path: str) -> tiktoken.Encoding:
    """The vocabulary of a byte-level BPE file of the tokenizers library, with its merges as ranks, and its added tokens."""
    with open(path, encoding="utf-8") as file:
        read = json.load(file)
    model, added = read["model"], {t["content"]: t["id"] for t in read["added_tokens"]}
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in read["added_tokens"]):
        raise ValueError(f"{path}: added tokens that take white space or whole words only are not supported")
    spoken = [*range(33, 127), *range(161, 173), *range(174, 256)]
    silent = [b for b in range(256) if b not in spoken]
    byte = {chr(b): b for b in spoken} | {chr(256 + k): b for k, b in enumerate(silent)}
    ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if all(c in byte for c in t)}
    ranks = {token: i for token, i in ranks.items() if i not in added.values()}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document's ids and closing id."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = partial(encoding(path).encode, allowed_special="all")
        for batch in batches:
            for first, last, data, at in blocks(batch.column("text")):
                raw, borders = data.tobytes(), at.tolist()
                which, rows, kept = [], [], []
                for k in range(last - first):
                    ids = encode(raw[borders[k] : borders[k + 1]].decode("utf-8", "replace"))
                    ids.append(CLOSING)
                    packed = np.array(ids, "<u4").tobytes()
                    begin, n = 0, (len(ids) - 1) % capacity + 1
                    for piece in range(-(-len(ids) // capacity)):
                        part = packed[4 * begin : 4 * (begin + n)]
                        which.append(first + k)
                        rows.append((piece, begin, n, zlib.crc32(part)))
                        kept.append(part)
                        begin, n = begin + n, capacity
                numbers = np.array(rows, np.int64).reshape(-1, 4)
                columns = [batch.column("doc_id").take(pa.array(which, pa.int64()))]
                columns += [pa.array(numbers[:, 0], pa.int32()), *(pa.array(numbers[:, c]) for c in (1, 2, 3))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    ids = np.frombuffer(b"".join(kept), "<u4").astype(np.int32)
                    ends = np.concatenate(([0], np.cumsum(numbers[:, 2]))).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(ids)))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, schema)


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """Every piece with its sequence_id and its offset there."""
    cut = saved(pieces(docs, capacity, path, with_ids).withColumn("row", F.monotonically_increasing_id()), "pieces")
    by_length = cut.groupBy("length").agg(F.count("*").alias("n")).collect()  # a row for each length up to capacity
    total = sum(r.n for r in by_length)
    shards = min(MOST_SHARDS, max(1, total // SHARD_ROWS))
    key = F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard")
    counted = cut.groupBy(key, "length").agg(F.count("*").alias("n"))
    steps, _ = plan({r.length: r.n for r in by_length}, capacity)
    if not len(steps):
        steps = np.zeros((1, 5), np.int64)
    scale = max(int(steps[:, 1].max()), total) + 1
    begins, ranges = steps[:, 0] * scale + steps[:, 1], steps

    @F.arrow_udf("struct<sequence_id: long, offset: long>")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        n, r = length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False)
        found = ranges[np.searchsorted(begins, n * scale + r, side="right") - 1]
        bins, turn = np.divmod(r - found[:, 1], found[:, 3])
        return pa.StructArray.from_arrays(
            [pa.array(found[:, 2] + bins), pa.array(found[:, 4] + turn * n)], ["sequence_id", "offset"]
        )

    before = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    earlier = counted.select("shard", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    local = Window.partitionBy("shard", "length").orderBy("row")
    ranked = (
        cut.withColumn("shard", key)
        .withColumn("rank", F.row_number().over(local) - 1)
        .join(earlier, ["shard", "length"])
        .withColumn("at", place("length", F.col("rank") + F.col("earlier")))
    )
    ids = ["ids"] if with_ids else []
    placed = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset", *ids)
    return _in_fewer(placed, total)


def _in_fewer(df: DataFrame, rows: int) -> DataFrame:
    """The frame in partitions of PART_ROWS rows, but no fewer than cores, if the shuffles would leave more of them.

    Without its native library Hadoop's local file system starts a process for each file that an executor writes.
    """
    spark = df.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, -(-rows // PART_ROWS))
    return df.repartition(parts) if parts < int(spark.conf.get("spark.sql.shuffle.partitions")) else df


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
