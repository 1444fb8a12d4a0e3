"""Near duplicates: fast similarity sketching, banding, and exact verification.

The sketch of a set of 5-word shingles has COORDINATES bins (Dahlgaard, Knudsen, Thorup, "Fast Similarity
Sketching", FOCS 2017). In round i < COORDINATES each shingle falls into a hashed bin with value i + fraction;
in round COORDINATES + j each falls into bin j, so every bin fills. A document leaves the rounds once its bins
are full. Bins keep the least value, and two sets agree in a bin with the probability of their similarity.

A pair is linked at a similarity of `link` hundredths; op6 uses LINK, the pipeline a threshold of its own.
BANDS bands of ROWS bins make bucket keys. A pair at 0.85 shares no bucket with probability
(1 - 0.85^4)^32 = 6e-11, one at 0.80 with 5e-8. Documents with equal sets, told by a 128-bit hash of their words, are
one class from the start. In each bucket every class is compared with the smallest one on full sets. Links are
confirmed on the words themselves, not on hashes of them. Where classes of a bucket are then still in different
components, a prefix filter finds the remaining pairs: a set of n members shares one of its first
n - ceil(link n / 100) + 1 members, in an order common to all, with every partner, and rare members come first in
it; members of one component only cannot count. No link is lost, and a large group is not paired with itself.

Defined cases: null and empty texts and texts without words have an empty set and stand alone; texts of any
length are used whole; rows with one doc_id are one document, linked through any of its texts, and each row has
the size of its own set; a row without doc_id stands alone with a null component; an empty table gives an empty
result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, blocks, buffers, forget, saved, table
from .components import components
from .hashing import U64, exact_shingles, mix, seeds, shingle_sums

WORDS = 5
COORDINATES, BANDS = 128, 32
ROWS = COORDINATES // BANDS
#: Linked at 100 * intersection >= link * union; this one is fixed by op6.
LINK = 85

_ROUND = seeds(2 * COORDINATES, 3)
_BAND = seeds(BANDS, 4)
_PLACE = seeds(ROWS, 5) | U64(1)
_SHIFT = U64(64 - (COORDINATES.bit_length() - 1))
_FULL = U64(0xFFFFFFFFFFFFFFFF)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """One row of COORDINATES values for each set; a set without members has no filled bin."""
    out = np.full((len(sets), COORDINATES), _FULL)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    open_rows = np.flatnonzero(sizes)
    low = U64((1 << 55) - 1)
    x = np.concatenate(sets) if sets else np.zeros(0, U64)
    row = np.repeat(np.arange(len(sets)), sizes)
    for k in range(2 * COORDINATES):
        if not len(open_rows):
            break
        h = mix(x ^ _ROUND[k])
        bins = (h >> _SHIFT).astype(np.int64) if k < COORDINATES else np.int64(k - COORDINATES)
        np.minimum.at(out.reshape(-1), row * COORDINATES + bins, (U64(k) << U64(55)) | (mix(h) & low))
        still = (out[open_rows] == _FULL).any(axis=1)
        if not still.all():
            live = np.zeros(len(sets), bool)
            live[open_rows[still]] = True
            keep = live[row]
            x, row, open_rows = x[keep], row[keep], open_rows[still]
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    grouped = values.reshape(len(values), BANDS, ROWS)
    return mix((mix(grouped) * _PLACE).sum(axis=2, dtype=U64) ^ _BAND)


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, data, at in blocks(batch.column("text")):
            found = shingle_sums(data, at, WORDS)
            sets = [s for s, _ in found]
            size = np.array([len(s) for s in sets], np.int64)
            keys = band_keys(sketches(sets)).view(np.int64)
            none = size == 0
            total = np.array([t for _, t in found], U64).view(np.int64).T
            ends = np.concatenate(([0], np.cumsum(np.where(none, 0, BANDS)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id")[first:last],
                    pa.array(size),
                    *(pa.array(t, mask=none) for t in total),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[~none].ravel())),
                ],
                ["doc_id", "n_shingles", "k1", "k2", "keys"],
            )


def _verified(link: int):
    """An Arrow pass that keeps the pairs whose sets of words reach the threshold."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.rename_columns(["a", "b", "text", "other"])
            for first, last, data, at in blocks(batch.column("text"), BLOCK_BYTES // 2):
                more, more_at = buffers(batch.column("other")[first:last])
                sets = exact_shingles(np.concatenate((data, more)), np.concatenate((at, len(data) + more_at[1:])), WORDS)
                linked = []
                for x, y in zip(sets[: last - first], sets[last - first :], strict=True):
                    small, large = sorted((x, y), key=len)
                    if not len(small) or 100 * len(small) < link * len(large):
                        linked.append(False)
                        continue
                    spot = np.minimum(np.searchsorted(large, small), len(large) - 1)
                    both = int((large[spot] == small).sum())
                    linked.append(100 * both >= link * (len(x) + len(y) - both))
                mask = pa.array(linked, pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(c)[first:last].filter(mask) for c in ("a", "b")], ["a", "b"])

    return each


def _members(docs: DataFrame) -> DataFrame:
    """(doc_id, component, own, n, shingle): a row for each member of each set; own tells the texts of a doc_id apart."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, at in blocks(batch.column("text")):
                found = shingle_sums(data, at, WORDS)
                size = np.array([len(x) for x, _ in found])
                row = pa.array(np.repeat(np.arange(first, last), size))
                own = np.array([t[0] for _, t in found], U64).view(np.int64)
                members = np.concatenate([x for x, _ in found]).view(np.int64)
                columns = [*(batch.column(c).take(row) for c in ("doc_id", "component")), *(pa.array(np.repeat(x, size)) for x in (own, size)), pa.array(members)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "component", "own", "n", "shingle"])

    return docs.select("doc_id", "component", "text").mapInArrow(
        each, "doc_id long, component long, own long, n long, shingle long"
    )


def _prefixes(docs: DataFrame, link: int) -> DataFrame:
    """(doc_id, component, n, useful, place, shingle): the prefix of each set that can reach a set of another component.

    Members that occur in one component only are useless for that, so they come first in the common order;
    the others follow by rarity. A set needs ceil(link n / 100) useful members, and n - ceil(link n / 100) + 1
    less the useless ones are its prefix.
    """
    members = _members(docs)
    across = (
        members.groupBy("shingle")
        .agg(F.count("*").alias("df"), F.min("component").alias("lo"), F.max("component").alias("hi"))
        .filter("lo < hi")
        .select("shingle", "df")
    )
    own = Window.partitionBy("doc_id", "own")
    return (
        members.join(saved(across, "across"), "shingle")
        .withColumn("useful", F.count("*").over(own))
        .withColumn("place", F.row_number().over(own.orderBy("df", "shingle")))
        .filter(f"place <= useful + 1 - ceil({link} * n / 100.0)")
        .select("doc_id", "component", "n", "useful", "place", "shingle")
    )


def _links(pairs: DataFrame, texts: DataFrame, link: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the threshold."""
    one = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("left"))
    two = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("right"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "left", "right")
    return both.mapInArrow(_verified(link), "a long, b long")


def _same_id(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of the texts of one doc_id, for the ids that have several."""
    several = rows.groupBy("doc_id").agg(F.min("k1").alias("lo"), F.max("k1").alias("hi")).filter("lo < hi").select("doc_id")
    of = rows.select("doc_id", "k1", "k2").join(several, "doc_id").distinct().join(classes.select("k1", "k2", "rep"), ["k1", "k2"])
    least = of.groupBy("doc_id").agg(F.min("rep").alias("a"))
    return of.join(least, "doc_id").filter("a < rep").select("a", F.col("rep").alias("b"))


def near_duplicates(docs: DataFrame, link: int = LINK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs (doc_id, text), linked at `link` hundredths."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    base = saved(
        docs.mapInArrow(_sketched, "doc_id long, n_shingles long, k1 long, k2 long, keys array<long>"), "sketches"
    )
    some = base.filter("doc_id IS NOT NULL AND k1 IS NOT NULL")
    equal = some.groupBy("k1", "k2")
    classes = saved(equal.agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys")), "classes")
    spread = classes.select("rep", "n", F.explode("keys").alias("key"))
    # The hub of a bucket is its smallest class; its size travels with it.
    hubs = spread.groupBy("key").agg(F.count("*").alias("c"), F.min(F.struct("rep", "n")).alias("hub")).filter("c > 1")
    hubs = saved(hubs.select("key", F.col("hub.rep").alias("hub"), F.col("hub.n").alias("m")), "hubs")
    buckets = saved(spread.join(hubs, "key"), "buckets")
    wanted = buckets.select(F.col("rep").alias("doc_id")).distinct()
    texts = saved(docs.join(wanted, "doc_id").dropDuplicates(["doc_id", "text"]), "texts")
    reach = f"100 * least(n, m) >= {link} * greatest(n, m)"
    first = buckets.filter("rep <> hub").filter(reach)
    tried = saved(first.select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")
    links = saved(_links(tried, texts, link).union(_same_id(some, classes)).distinct(), "linked")
    found = components(links)
    # Buckets whose classes are not yet one component: compare across the components.
    named = (
        buckets.join(found.withColumnRenamed("node", "rep"), "rep", "left")
        .select("key", "rep", F.coalesce("component", "rep").alias("component"))
    )
    split = named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi")
    split = saved(split.select("key"), "split")
    open_ = named.join(split, "key").groupBy(F.col("rep").alias("doc_id")).agg(F.max("component").alias("component"))
    unsettled = saved(texts.join(open_, "doc_id"), "unsettled")
    left = saved(_prefixes(unsettled, link), "prefixes")
    other = left.selectExpr("shingle", "doc_id AS b", "n AS m", "useful AS m_useful", "place AS m_place", "component AS with")
    # A pair needs enough members in common; at its first common one, none come before, so no more than the rest follow.
    # Rows at later common members of a pair may fail, as one row of it is enough.
    rest = (
        left.join(other, "shingle")
        .filter(f"component <> with AND doc_id < b AND {reach}")
        .filter(f"(1 + least(useful - place, m_useful - m_place)) * {100 + link} >= {link} * (n + m)")
        .select(F.col("doc_id").alias("a"), "b")
        .distinct()
        .join(tried, ["a", "b"], "left_anti")
    )
    rest = saved(rest, "rest")
    more = saved(_links(rest, texts, link).distinct(), "linked")
    if not more.isEmpty():
        found = components(links.unionByName(more))
    forget(hubs, buckets, texts, tried, links, split, unsettled, left, rest, more)
    owner = classes.drop("keys").join(found.withColumnRenamed("node", "rep"), "rep", "left").select(
        "k1", "k2", F.coalesce("component", "rep").alias("component")
    )
    return (
        base.drop("keys")
        .join(owner, ["k1", "k2"], "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
        .withColumn("kept", F.col("doc_id") == F.col("component_id"))
    )


def keep_one(docs: DataFrame, link: int = LINK) -> DataFrame:
    """The rows of docs without those that a smaller doc_id of their component stands for."""
    kept = near_duplicates(docs, link).filter("kept").select("doc_id").distinct()
    chosen = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return chosen.unionByName(docs.filter("doc_id IS NULL"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), LINK)
