"""Byte-level BPE: Spark higher-order functions fold ranked merges over byte arrays of distinct words.

A block of documents becomes one row: its distinct words as arrays of byte ids with the ranks of neighbours, and
the number of each word of its texts among them. In the JVM, `aggregate` folds over each word: a step finds the
neighbours whose joined bytes have the least rank, the leftmost of equals, and merges them; ranks come from a
literal table. The table is laid out by row displacement: the entry of a pair lies at the place of its left id
plus its right id, so a lookup is two array reads, and the ranks of neighbours that a merge leaves alone are kept.
Words of all lengths are folded; one over CHUNK bytes is held in chunks of its parts, so that a step looks at the
least entries of the chunks and at four chunks, not at the whole word. A word that is itself a token takes its own
id. The frequent words of a bounded sample are folded once beforehand; any sample gives the same ids. A document's
ids are those of its words, joined; decoding joins the binary pieces of the ids.

Words are told apart by their bytes: a hash groups them, and each is held against the first of its group.

Defined cases: a null or empty text has no ids; texts and words of any length are used whole; repeated rows are
encoded each; a null doc_id is kept; of two pairs of equal rank the leftmost merges first; an empty table gives an
empty result; other columns play no part.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, blocks, buffers, free_name, table
from .hashing import distinct_spans, same_spans, span_hashes

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Bytes of text in a block, and of a word in a chunk.
BLOCK, CHUNK = 4 << 20, 128
#: The words of this many documents, of their first SAMPLE_CHARS characters, are folded once beforehand: the
#: most frequent SAMPLE_WORDS of them. A word that is missing there is folded in its block, so any sample will do.
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_WORDS = 12_288, 4096, 3 << 17
#: A lookup that finds no pair gives at least this; ids are below it.
NO_MERGE = 1 << 16
EMPTY = 1 << 62
#: An entry of a word under folding: rank with the next part * 2^RANK + first byte of the part * 2^16 + its id.
RANK = 46
LIMIT = NO_MERGE << RANK
PLACE = (1 << RANK) - NO_MERGE
#: An entry of the table: left id * 2^LEFT + rank of the joined bytes.
LEFT = 17


@lru_cache(maxsize=2)
def ranks(path: str) -> dict[bytes, int]:
    """The ids of a rank file: lines of base64 bytes and a number below NO_MERGE."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


@lru_cache(maxsize=2)
def pair_table(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Places p and entries e: e[p[left id] + right id] xor left id * 2^LEFT is the rank of the joined bytes.

    An entry of another left id, or an EMPTY one, gives NO_MERGE or more.
    """
    known = ranks(path)
    rows: dict[int, dict[int, int]] = {}
    for token, rank in known.items():
        for cut in range(1, len(token)):
            left, right = known.get(token[:cut]), known.get(token[cut:])
            if left is not None and right is not None:
                rows.setdefault(left, {})[right] = rank
    most = max(known.values()) + 1
    free, reached = np.ones(16 * most, bool), {}
    places, entries = np.zeros(most, np.int32), np.full(len(free), EMPTY, np.int64)
    for left, row in sorted(rows.items(), key=lambda r: (-len(r[1]), r[0])):
        rights = np.array(sorted(row))
        begin = max(0, reached.get(len(row), 0) - int(rights[0]))
        while True:  # a place where the whole row is free, from where the last one of its size was found
            spots = np.arange(begin, begin + 4096)
            for right in rights.tolist():
                spots = spots[free[spots + right]]
                if not len(spots):
                    break
            else:
                break
            begin += 4096
        places[left] = spots[0]
        free[places[left] + rights] = False
        entries[places[left] + rights] = (left << LEFT) + np.array([row[r] for r in rights.tolist()])
        reached[len(row)] = int(places[left] + rights[0])
    return places, entries[: int(places.max()) + most]


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda bound, _: bound, body)


def _constant(spark: SparkSession, **values: pa.Array) -> Column:
    """A literal row of arrays, as a scalar subquery: plans name it where an inline literal would be written out."""
    row = pa.table({name: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for name, v in values.items()})
    return spark.createDataFrame(row).select(F.struct(*values)).scalar()


def pair_ranks(ids: np.ndarray, table_: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The ranks of neighbours in a flat array of ids, NO_MERGE where they do not join."""
    places, entries = table_
    left = ids[:-1].astype(np.int64)
    return np.minimum(entries[places[left] + ids[1:]] ^ (left << LEFT), NO_MERGE)


def with_ranks(blocks_: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """blocks with the literal rank map in a column `ranks`, for folded()."""
    places, entries = pair_table(path)
    return blocks_.withColumn("ranks", _constant(blocks_.sparkSession, places=pa.array(places), entries=pa.array(entries)))


def folded(words: Column, chunked: Column, table_: Column) -> Column:
    """Ids of each word of array<array<bigint>>, then of each of array<array<array<bigint>>>: entries for its bytes, see RANK."""

    def all_(t: Column) -> Column:
        merge = _merge(t["places"], t["entries"])
        return F.concat(F.transform(words, _fold(merge)), F.transform(chunked, _chunked_fold(merge)))

    return _bind(table_, all_)


def _id(entry: Column) -> Column:
    return entry.bitwiseAND(NO_MERGE - 1).cast("int")


def _merge(places: Column, entries: Column) -> Callable[[Column, Column], Column]:
    """A function of parts and the entry of the one to be merged with the next; its rank is the id of both together."""

    def part(left: Column, right: Column, place: Column) -> Column:
        """The entry of a part `left` that `right` follows."""
        found = F.get(entries, F.get(places, left) + right).bitwiseXOR(F.shiftleft(left.cast("bigint"), LEFT))
        return F.shiftleft(F.least(found, F.lit(NO_MERGE)), RANK).bitwiseOR(place).bitwiseOR(left)

    def merged(parts: Column, least: Column) -> Column:
        new = F.shiftright(least, RANK).cast("int")

        def at(place: Column) -> Column:
            def beside(before: Column) -> Column:
                n, after = F.size(before), F.get(parts, F.size(before) + 2)
                joined = F.when(
                    n + 2 < F.size(parts), _bind(new, lambda one: part(one, _id(after), place))
                ).otherwise(place.bitwiseOR(new).bitwiseOR(LIMIT))
                rest = F.slice(parts, n + 3, F.size(parts))

                def renewed(last: Column) -> Column:
                    changed = _bind(_id(last), lambda left: part(left, new, last.bitwiseAND(PLACE)))
                    return F.concat(F.slice(before, F.lit(1), n - 1), F.array(changed, joined), rest)

                return F.when(n > 0, _bind(F.get(before, n - 1), renewed)).otherwise(F.concat(F.array(joined), rest))

            return _bind(F.filter(parts, lambda e: e.bitwiseAND(PLACE) < place), beside)

        return _bind(least.bitwiseAND(PLACE), at)

    return merged


def _fold(merge: Callable[[Column, Column], Column]) -> Callable[[Column], Column]:
    """A function of a word; a word of n bytes takes at most n - 1 merges."""

    def step(parts: Column, _: Column) -> Column:
        return _bind(F.array_min(parts), lambda least: F.when(least < LIMIT, merge(parts, least)).otherwise(parts))

    return lambda word: F.transform(F.aggregate(F.slice(word, F.lit(2), F.size(word)), word, step), _id)


def _chunked_fold(merge: Callable[[Column, Column], Column]) -> Callable[[Column], Column]:
    """The same fold of a long word in chunks that are never empty; `least` has each chunk's least entry.

    A merge at most reaches the last part of the chunk before and the two parts after it: these four chunks are
    joined, merged and cut again where they were, and the last of them goes if nothing is left of it.
    """

    def state(chunks: Column) -> Column:
        return F.struct(chunks.alias("chunks"), F.transform(chunks, F.array_min).alias("least"))

    def merged(old: Column, least: Column) -> Column:
        chunks, minima = old["chunks"], old["least"]

        def near(first: Column) -> Column:
            some = F.slice(chunks, first, F.lit(4))

            def cut(parts: Column) -> Column:
                ends = F.transform(some, lambda _, k: F.aggregate(F.slice(some, F.lit(1), k + 1), F.lit(0), lambda n, c: n + F.size(c)))
                pieces = F.transform(some, lambda c, k: F.slice(parts, F.get(ends, k) - F.size(c) + 1, F.size(c)))
                kept = F.filter(pieces, lambda c: F.size(c) > 0)
                far = first + 4

                def joined(new: Column) -> Column:
                    def whole(all_: Column, fresh: Column) -> Column:
                        return F.concat(F.slice(all_, F.lit(1), first - 1), fresh, F.slice(all_, far, F.size(all_)))

                    return F.struct(whole(chunks, new).alias("chunks"), whole(minima, F.transform(new, F.array_min)).alias("least"))

                return _bind(kept, joined)

            return _bind(merge(F.flatten(some), least), cut)

        before = F.size(F.filter(chunks, lambda c: F.get(c, F.lit(0)).bitwiseAND(PLACE) <= least.bitwiseAND(PLACE)))
        return _bind(F.greatest(before - 1, F.lit(1)), near)

    def step(old: Column, _: Column) -> Column:
        return _bind(F.array_min(old["least"]), lambda least: F.when(least < LIMIT, merged(old, least)).otherwise(old))

    def ids(word: Column) -> Column:
        turns = F.slice(F.flatten(word), F.lit(2), F.aggregate(word, F.lit(0), lambda n, c: n + F.size(c)))
        return F.aggregate(turns, state(word), step, lambda done: F.transform(F.flatten(done["chunks"]), _id))

    return ids


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """For each code point: 0 other, 1 letter, 2 number, 3 white space."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((1, r"\p{L}"), (2, r"\p{N}"), (3, r"\s")):
        out[np.frombuffer("".join(regex.findall(pattern, every)).encode("utf-32-le"), "<u4")] = kind
    return out


def piece_starts(code: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where the matches of the split pattern begin, in rows of code points with borders `at`.

    The pattern takes runs of letters, of numbers or of others, each with one space before; a run of white
    space before them gives up its last character, which is a match of its own unless it is that space; an
    apostrophe that begins a match, with s, t, re, ve, m, ll or d after it, is a match without what follows.
    """
    n = len(code)
    kind = _classes()[code]
    start = np.ones(n, bool)
    start[1:] = kind[1:] != kind[:-1]
    first = at[:-1][at[:-1] < n]
    start[first] = True
    fresh = np.zeros(n + 1, bool)
    fresh[at] = True
    turn = np.flatnonzero(start[1:] & (kind[:-1] == 3) & (kind[1:] != 3) & ~fresh[1:n]) + 1
    start[turn - 1] = True
    start[turn[code[turn - 1] == 0x20]] = False
    mark = np.flatnonzero((code == 0x27) & start)
    if len(mark):
        end = at[np.searchsorted(at, mark, side="right")]
        far = np.concatenate((code, np.zeros(2, code.dtype)))
        one, two = far[mark + 1], far[mark + 2]
        pair = (one << 8) | np.minimum(two, 255)
        size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 2, 0)
        size[np.isin(pair, [ord(a) << 8 | ord(b) for a, b in ("re", "ve", "ll")]) & (mark + 3 <= end)] = 3
        size[mark + 2 > end] = 0
        mark, end, size = mark[size > 0], end[size > 0], size[size > 0]
        start[mark + 1] = False
        after = mark + size
        start[after[after < end]] = True
    return np.flatnonzero(start)


class Known:
    """Words and their ids: the word of the k-th hash in order is bytes data[at[k]:at[k] + long[k]], its ids values[first[k]:first[k] + size[k]]."""

    def __init__(self, words: list[bytes], size: np.ndarray, values: np.ndarray):
        self.data = np.frombuffer(b"".join(words), np.uint8)
        long = np.fromiter(map(len, words), np.int64, len(words))
        at = np.cumsum(long) - long
        hashes = span_hashes(self.data, at, at + long)
        order = np.argsort(hashes, kind="stable")
        first = np.cumsum(size) - size
        self.hashes, self.at, self.long = hashes[order], at[order].astype(np.int32), long[order].astype(np.int32)
        self.first, self.size, self.values = first[order].astype(np.int32), size[order].astype(np.int32), values.astype(np.int32)

    def slots(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The place of each word of data among the known ones, -1 where it is unknown."""
        spot = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        n = self.long[spot].astype(np.int64)
        same = (self.hashes[spot] == hashes) & (n == ends - starts)
        same[same] = same_spans(data, starts[same], self.data, self.at[spot[same]].astype(np.int64), n[same])
        return np.where(same, spot, -1)

    def ids(self, slots: np.ndarray) -> pa.ListArray:
        size = self.size[slots].astype(np.int64)
        return _lists(self.values[_ranges(self.first[slots].astype(np.int64), size)], size)


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers first[k]..first[k] + size[k] - 1 of all k, in a row."""
    return np.arange(int(size.sum())) + np.repeat(first - (np.cumsum(size) - size), size)


def _lists(values, size: np.ndarray) -> pa.ListArray:
    """values cut into lists of the sizes."""
    ends = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), values if isinstance(values, pa.Array) else pa.array(values))


def _words(rows: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The rows' bytes, starts and ends of its words there, and the number of words in each row."""
    borders = np.concatenate(([0], np.cumsum([len(x) for x in rows], dtype=np.int64)))
    text = "".join(rows)
    raw, code = np.frombuffer(text.encode(), np.uint8), np.frombuffer(text.encode("utf-32-le"), "<u4")
    found = piece_starts(code, borders) if len(code) else np.zeros(0, np.int64)
    count = np.diff(np.searchsorted(found, borders))
    if len(raw) > len(code):  # from code points to bytes
        found = np.concatenate(([0], np.cumsum(1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF), dtype=np.int64)))[found]
    return raw, found, np.append(found[1:], len(raw))[: len(found)], count


def _entries(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, path: str, table_: tuple[np.ndarray, np.ndarray]) -> tuple[pa.Array, pa.Array]:
    """What folded() takes for the words of data: those up to CHUNK bytes, and the longer ones in chunks."""
    known = ranks(path)
    byte = np.array([known[bytes([b])] for b in range(256)], np.int64)

    def entries(starts: np.ndarray, size: np.ndarray) -> np.ndarray:
        flat = byte[data[_ranges(starts, size)]]
        rank = np.append(pair_ranks(flat, table_), NO_MERGE) if len(flat) else flat
        rank[np.cumsum(size) - 1] = NO_MERGE
        return (rank << RANK) | (_ranges(np.zeros_like(size), size) << 16) | flat

    size = ends - starts
    long = size > CHUNK
    chunks = -(-size[long] // CHUNK)
    each = np.full(int(chunks.sum()), CHUNK)
    each[np.cumsum(chunks) - 1] = size[long] - (chunks - 1) * CHUNK
    return _lists(entries(starts[~long], size[~long]), size[~long]), _lists(_lists(entries(starts[long], size[long]), each), chunks)


def known_words(docs: DataFrame, path: str = VOCABULARY) -> Known:
    """The tokens of the vocabulary, and the frequent words of a bounded sample, folded."""
    words, values = list(ranks(path)), np.array(list(ranks(path).values()), np.int32)
    size, tokens_ = np.ones(len(words), np.int64), frozenset(words)
    often: dict[bytes, int] = {}
    head = [r[0] for r in docs.select(F.substring("text", 1, SAMPLE_CHARS)).head(SAMPLE_DOCS) if r[0]]
    for k in range(0, len(head), 128):
        raw, starts, ends, _ = _words(head[k : k + 128])
        places, first = distinct_spans(raw, starts, ends)
        data = raw.tobytes()
        for a, b, n in zip(starts[first].tolist(), ends[first].tolist(), np.bincount(places).tolist(), strict=True):
            often[data[a:b]] = often.get(data[a:b], 0) + n
    del head
    some = sorted((w for w in often if w not in tokens_ and len(w) <= CHUNK), key=lambda w: (-often[w], w))[:SAMPLE_WORDS]
    if not some:
        return Known(words, size, values)
    table_ = pair_table(path)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, chunk in zip(batch.column("k").to_pylist(), batch.column("words"), strict=True):
                data, at = buffers(chunk.values)
                one = _lists(_entries(data, at[:-1], at[1:], path, table_)[0], np.array([len(at) - 1]))
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), one], ["k", "words"])

    size_of = np.array([min(4096, len(some) - k) for k in range(0, len(some), 4096)])
    rows = pa.table({"k": pa.array(range(len(size_of))), "words": _lists(pa.array(some, pa.binary()), size_of)})
    spread = docs.sparkSession.createDataFrame(rows).repartition(len(size_of), "k").mapInArrow(entries, "k long, words array<array<bigint>>")
    none = F.array().cast("array<array<array<bigint>>>")
    done = with_ranks(spread, path).select("k", folded(F.col("words"), none, F.col("ranks")).alias("ids")).toArrow().sort_by("k")
    ids = done.column("ids").combine_chunks().flatten()
    more = np.diff(ids.offsets.to_numpy())[: len(ids)].astype(np.int64)
    return Known(words + some, np.concatenate((size, more)), np.concatenate((values, ids.flatten().to_numpy(zero_copy_only=False))))


def split_words(docs: DataFrame, known: Known, path: str = VOCABULARY, block: int = BLOCK) -> DataFrame:
    """A row for each block: its documents' doc_id with the numbers of their words, and the distinct words.

    Words are numbered along `given`, the ids of known ones, then `words` and `chunked`, for folded().
    """
    table_ = pair_table(path)

    def row(ids: list, sizes: list, raws: list, starts: list, ends: list) -> pa.RecordBatch:
        raw, start, end = np.concatenate(raws), np.concatenate(starts), np.concatenate(ends)
        hashes = span_hashes(raw, start, end)
        places, first = distinct_spans(raw, start, end, hashes)
        start, end = start[first], end[first]
        slots = known.slots(raw, start, end, hashes[first])
        kind = np.where(slots >= 0, 0, np.where(end - start <= CHUNK, 1, 2))
        order = np.argsort(kind, kind="stable")
        number = np.empty(len(order), np.int32)
        number[order] = np.arange(len(order))
        new = order[kind[order] > 0]
        words, chunked = _entries(raw, start[new], end[new], path, table_)
        each = _lists(number[places], np.concatenate(sizes))
        docs = pa.StructArray.from_arrays([pa.array(ids, pa.int64()), each], ["doc_id", "places"])
        columns = [_lists(x, np.array([len(x)])) for x in (docs, known.ids(slots[order[kind[order] == 0]]), words, chunked)]
        return pa.RecordBatch.from_arrays(columns, ["docs", "given", "words", "chunked"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: tuple[list, ...] = ([], [], [], [], [])
        total = 0
        for batch in batches:
            for first, last, data, at in blocks(batch.column("text"), BLOCK_BYTES // 4):
                ids, *parts = state
                raw, start, end, size = _words([data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)])
                ids += batch.column("doc_id")[first:last].to_pylist()
                for to, value in zip(parts, (size, raw, start + total, end + total), strict=True):
                    to.append(value)
                total += len(raw)
                if total >= block:
                    yield row(*state)
                    state, total = ([], [], [], [], []), 0
        if state[0]:
            yield row(*state)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        split,
        "docs array<struct<doc_id: long, places: array<int>>>, given array<array<int>>, words array<array<bigint>>, chunked array<array<array<bigint>>>",
    )


def encode(docs: DataFrame, path: str = VOCABULARY, block: int = BLOCK) -> DataFrame:
    """(doc_id, ids) of every row of docs (doc_id, text)."""
    known = known_words(docs, path)

    def documents(ids: Column) -> Column:
        def whole(doc: Column) -> Column:
            return F.struct(doc["doc_id"].alias("doc_id"), F.flatten(F.transform(doc["places"], lambda k: F.get(ids, k))).alias("ids"))

        return F.transform("docs", whole)

    every = F.concat("given", folded(F.col("words"), F.col("chunked"), F.col("ranks")))
    split = with_ranks(split_words(docs, known, path, block), path)
    return split.select(F.inline(_bind(every, documents)))


def decode(rows: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """rows with `bytes`: the binary pieces of their ids, joined."""
    known, name = {i: b for b, i in ranks(path).items()}, free_name(rows, "pieces")
    pieces = pa.array([known.get(i, b"").hex() for i in range(max(known) + 1)])
    text = F.array_join(F.transform("ids", lambda i: F.get(F.col(name)["pieces"], i)), "")
    return rows.withColumn(name, _constant(rows.sparkSession, pieces=pieces)).withColumn("bytes", F.unhex(text)).drop(name)


def op5_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids and of the bytes they decode to."""
    return decode(encode(table(spark, sf_dir, "documents"))).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )
