"""Quality classifier: hashed word n-gram logistic regression, scored as sparse dot products.

Tokens are runs of letters, digits and non-ASCII bytes, or runs of other visible bytes; A-Z is lowered.
Features are the tokens and the pairs of neighbours, hashed into a fixed number of places; a token that
repeats its neighbour counts as one common feature. The value of a feature is its share of the document's
tokens, times SCALE, so a score is one gather and one sum over the text.

Defined cases: null and empty texts have no features and get the score of the bias; text of any length is
used whole; repeated rows get equal scores; a null doc_id has no label, is in no fold and is scored like any other;
labels that tie in the sample's order are taken by doc_id; an empty table gives an empty result; other columns play no
part; with no labelled row, or
labels of one kind only, the model is fitted to what there is (every score 0.5 without any).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from . import ftrl
from .common import blocks, table
from .hashing import LOWER, SPACE, U64, mix, runs, seeds, span_hashes

BITS = 18
SCALE = 16.0
#: A label is learned from at most this many rows, the first by a hash of doc_id.
SAMPLE_ROWS = 6000
#: Rows whose crc32(doc_id as text) leaves this remainder are never learned from.
FOLDS, HELD = 5, 0
#: At and above this score a document is kept.
KEEP_AT = 0.3

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_MARK = ~_WORD & ~SPACE
_ONE, _TWO, _SAME = seeds(3, 10)


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features of a block in text order, where each row's begin, and each row's number of tokens."""
    low = LOWER[data]
    starts, ends = runs(_WORD[low], at)
    more, more_ends = runs(_MARK[low], at)
    starts, ends = np.concatenate((starts, more)), np.concatenate((ends, more_ends))
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], ends[order]
    h = span_hashes(low, starts, ends)
    first = np.searchsorted(starts, at)
    shift = U64(64 - BITS)
    both = np.empty((len(h), 2), np.int32)
    both[:, 0] = mix(h ^ _ONE) >> shift
    if len(h):
        before = np.roll(h, 1)
        before[first[:-1][first[:-1] < len(h)]] = U64(0)
        pair = mix(h + before * (_TWO | U64(1)))
        pair[h == before] = _SAME
        both[:, 1] = pair >> shift
    return both.ravel(), 2 * first, np.diff(first)


def eligible(doc_id: Column, folds: int = FOLDS, held: int = HELD) -> Column:
    """True for rows of the held-out fold; a null id is in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == held, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, rows: int) -> DataFrame:
    """At most `rows` labelled texts outside the held-out fold, chosen by a hash of their ids: (doc_id, y, text)."""
    chosen = (
        labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~eligible(F.col("doc_id"), folds, held))
        .select("doc_id", F.col(label).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "y")
        .limit(rows)
    )
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text")


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> ftrl.Model:
    """Learns `labels.quality` from a bounded sample outside the held-out fold."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, at in blocks(batch.column("text")):
                index, begin, _ = features(data, at)
                found = [np.unique(index[a:b], return_counts=True) for a, b in zip(begin[:-1], begin[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id")[first:last],
                        batch.column("y")[first:last],
                        pa.array([x.tobytes() for x, _ in found], pa.binary()),
                        pa.array([x.astype(np.int32).tobytes() for _, x in found], pa.binary()),
                    ],
                    ["doc_id", "y", "at", "n"],
                )

    got = (
        sample(docs, labels, "quality", FOLDS, HELD, rows)
        .mapInArrow(counted, "doc_id long, y int, at binary, n binary")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "y")
        .toArrow()
    )

    def each() -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        for y, at, n in zip(*(got.column(c).to_pylist() for c in ("y", "at", "n")), strict=True):
            n = np.frombuffer(n, np.int32)
            yield np.frombuffer(at, np.int32), n * (2 * SCALE / max(n.sum(), 1)), y

    return ftrl.train(each(), 1 << BITS, alpha=0.5, l1=0.3, l2=0.1, epochs=4)


def scorer(model: ftrl.Model):
    """A column function: text to the probability of quality 1."""
    weights, bias = model.weights, model.bias

    @F.arrow_udf(DoubleType())
    def score(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            out = []
            for _, _, data, at in blocks(column):
                index, begin, tokens = features(data, at)
                total = np.concatenate(([0.0], np.cumsum(weights[index], dtype=np.float64)))
                out.append((total[begin[1:]] - total[begin[:-1]]) * (SCALE / np.maximum(tokens, 1)))
            logits = np.concatenate(out) if out else np.zeros(0)
            yield pa.array(ftrl.Model(weights, bias).probability(logits), pa.float64())

    return score


def score_documents(docs: DataFrame, model: ftrl.Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    score = scorer(model)
    return docs.select("doc_id", eligible(F.col("doc_id")).alias("held_out"), score("text").alias("score")).withColumn(
        "predicted", (F.col("score") >= KEEP_AT).cast("int")
    )


def keep_good(docs: DataFrame, model: ftrl.Model) -> DataFrame:
    """The rows that the classifier does not reject, with their columns as they were."""
    return docs.filter(scorer(model)(F.col("text")) >= KEEP_AT)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
