"""Toxicity: noisy-channel deobfuscation, then a hashed-word logistic regression on the restored text.

A character trigram model is counted over all documents. A visible token is suspicious when letters stand
beside look-alike digits or signs, when a letter comes twice or more in a row, or when a separator parts its
letters; so is a row of single characters between spaces. For these a lattice holds, at each character, the
letters it may stand for, a word break, or nothing (a separator, a repetition), each with a channel cost; a letter
doubled just once is dear to drop, so usual spellings keep it. In a row of single characters a break may come
between any two, and wider gaps are breaks. Viterbi decoding finds the likeliest letters under the model. Tokens with
none of these signs stay as they are. Features are the words of the text and of its restored tokens and the beginnings of words,
hashed, with how often they come (at most MOST_OFTEN times); weights are
learned with follow-the-regularised-leader updates from a bounded sample of labelled rows.

Defined cases: null and empty texts have no features and get the score of the bias; texts of any length are
used whole; repeated rows get equal scores; a null doc_id has no label, is in no fold and is scored like any other; of
equally likely readings the first found counts; an empty table gives an empty result; with no labelled row every score
is 0.5; other columns play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from . import ftrl
from .common import blocks, table
from .hashing import LOWER, SPACE, U64, mix, runs, seeds, span_hashes
from .quality import eligible, sample

BITS = 18
#: A label is learned from at most this many rows, the first by a hash of doc_id.
SAMPLE_ROWS = 8000
#: Rows whose crc32(doc_id as text) leaves this remainder are never learned from.
FOLDS, HELD = 4, 2
TOXIC_AT = 0.3
#: A row of at least this many single characters is taken as one spaced word.
SPACED = 4
#: Lengths in bytes of the beginnings that are features, and the value at which a count stops.
BEGINNINGS = (5, 6, 7, 8)
MOST_OFTEN = 4

#: Letters that a sign may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "#": "h",
    "*": "aeiou",
}
SEPARATORS = "._-*~^'`,"
#: Log costs of the channel: a look-alike, a dropped sign, a dropped repetition, a sign as a break between words,
#: a dropped repetition where the letter comes just twice.
SUBSTITUTED, DROPPED, REPEATED, BROKEN, DOUBLED = -1.0, -0.5, -0.3, -3.0, -4.0

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[97:123] = np.arange(1, 27)
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LOOKS = np.zeros(256, bool)
_LOOKS[[ord(c) for c in LOOKALIKES]] = True
_PARTS = np.zeros(256, bool)
_PARTS[[ord(c) for c in SEPARATORS]] = True
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_SEED = seeds(16, 11)


def count_trigrams(docs: DataFrame) -> np.ndarray:
    """Counts of neighbouring letters a-z over all texts, in any case; all else counts as a break."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(27**3, np.int64)
        for batch in batches:
            for _, _, data, at in blocks(batch.column("text")):
                symbol = np.insert(_SYMBOL[LOWER[data]], np.repeat(at, 2), 0)
                total += np.bincount((symbol[:-2] * 27 + symbol[1:-1]) * 27 + symbol[2:], minlength=27**3)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(27**3)), pa.array(total)], ["spot", "n"])

    summed = docs.select("text").mapInArrow(counted, "spot long, n long").groupBy("spot").agg(F.sum("n").alias("n"))
    found = summed.toArrow()  # 27^3 rows
    out = np.zeros(27**3, np.int64)
    out[found["spot"].to_numpy()] = found["n"].to_numpy()
    return out.reshape(27, 27, 27)


def log_probabilities(counts: np.ndarray) -> np.ndarray:
    """Trigram log-probabilities, backed off to bigrams and to uniform by pseudo-counts."""
    two = counts.sum(axis=0)
    low = (two + 1.0) / (two.sum(axis=1, keepdims=True) + 27.0)
    return np.log((counts + 5.0 * low) / (counts.sum(axis=2, keepdims=True) + 5.0))


def restore(token: str, model: list, spaced: bool = False) -> str:
    """The likeliest letters of a lower-case token; spaces part the words. In a spaced one, breaks may come anywhere."""
    states: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    before = ""
    for place, sign in enumerate(token):
        after: dict[tuple[int, int], tuple[float, str]] = {}

        def reach(state: tuple[int, int], score: float, text: str, after=after) -> None:
            if state not in after or score > after[state][0]:
                after[state] = (score, text)

        twice = sign == before and token[place - 2 : place - 1] != sign and token[place + 1 : place + 2] != sign
        if sign == " ":
            options = [(0, 0.0)]
        elif "a" <= sign <= "z":
            options = [(ord(sign) - 96, 0.0)]
        else:
            options = [(ord(c) - 96, SUBSTITUTED) for c in LOOKALIKES.get(sign, "")]
            options.append((0, BROKEN))
        for (a, b), (score, text) in states.items():
            if sign == before:
                reach((a, b), score + (DOUBLED if twice and b and not spaced else REPEATED), text)
            elif sign in SEPARATORS:
                reach((a, b), score + DROPPED, text)
            for c, cost in options:
                if c or b:
                    reach((b, c), score + cost + model[a][b][c], text + (chr(96 + c) if c else " "))
                else:
                    reach((a, b), score + cost, text)
                if spaced and c and b:
                    reach((0, c), score + cost + model[a][b][0] + model[b][0][c], text + " " + chr(96 + c))
        states, before = after, sign
    return max((score + model[a][b][0], text) for (a, b), (score, text) in states.items())[1].strip() if states else ""


def suspicious(low: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int]]:
    """(row, start, end) of the tokens, and of rows of single characters, that need decoding."""
    starts, ends = runs(~SPACE[low], at)
    if not len(starts):
        return []
    row = np.searchsorted(at, starts, side="right") - 1

    def number(marked: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(marked)))
        return total[ends] - total[starts]

    #: Marks a character that continues the token of the one before it.
    goes_on = ~SPACE[low]
    goes_on[starts] = False
    letter = _LETTER[low]
    double = np.zeros(len(low), bool)
    double[1:] = (low[1:] == low[:-1]) & letter[1:] & goes_on[1:]
    inside = np.zeros(len(low), bool)
    inside[1:-1] = _PARTS[low[1:-1]] & letter[:-2] & letter[2:] & goes_on[1:-1] & goes_on[2:]
    beside = np.zeros(len(low), bool)
    beside[:-1] = _LOOKS[low[:-1]] & letter[1:] & goes_on[1:]
    beside[1:] |= _LOOKS[low[1:]] & letter[:-1] & goes_on[1:]
    odd = (number(beside) > 0) | (number(double) > 0) | (number(inside) > 0)
    odd &= number(_LETTER[low]) > 0
    out = list(zip(row[odd].tolist(), starts[odd].tolist(), ends[odd].tolist(), strict=True))
    single = (ends - starts == 1) & (_LETTER | _LOOKS)[low[starts]]
    edge = np.flatnonzero(np.diff(np.concatenate(([0], single.astype(np.int8), [0]))))
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        for r in np.unique(row[a:b]).tolist():
            x, y = a + int(np.searchsorted(row[a:b], r)), a + int(np.searchsorted(row[a:b], r, side="right"))
            if y - x >= SPACED:
                out.append((r, int(starts[x]), int(ends[y - 1])))
    return out


class Restorer:
    """Decodes tokens under a trigram model, remembering the last ones."""

    MOST = 50_000

    def __init__(self, model: np.ndarray):
        self.model, self.known = model.tolist(), {}

    def words(self, token: bytes) -> list[bytes]:
        if token not in self.known:
            if len(self.known) >= self.MOST:
                self.known.clear()
            text = token.decode("utf-8", "replace")
            spaced = len(text) > 1 and text[1].isspace()
            if spaced:
                text = re.sub(r"\s+", lambda gap: " " if len(gap[0]) > 1 else "", text)
            self.known[token] = restore(text, self.model, spaced).encode().split()
        return self.known[token]


def features(data: np.ndarray, at: np.ndarray, restorer: Restorer) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashed features of the words of a block, and of its restored tokens; with repetitions."""
    low = LOWER[data]
    starts, ends = runs(_WORD[low], at)
    row = np.searchsorted(at, starts, side="right") - 1
    raw = low.tobytes()
    rows, found = [row], [span_hashes(low, starts, ends) ^ _SEED[0]]
    for k in BEGINNINGS:
        long = ends - starts > k
        rows.append(row[long])
        found.append(span_hashes(low, starts[long], starts[long] + k) ^ _SEED[k])
    more = [(r, w) for r, a, b in suspicious(low, at) for w in restorer.words(raw[a:b])]
    if more:
        size = np.cumsum([len(w) for _, w in more])
        flat = np.frombuffer(b"".join(w for _, w in more), np.uint8)
        rows.append(np.array([r for r, _ in more], row.dtype))
        found.append(span_hashes(flat, np.concatenate(([0], size[:-1])), size) ^ _SEED[0])
    return np.concatenate(rows), (mix(np.concatenate(found)) >> U64(64 - BITS)).astype(np.int64)


def fit(docs: DataFrame, labels: DataFrame, model: np.ndarray, rows: int = SAMPLE_ROWS) -> ftrl.Model:
    """Learns `labels.toxic` from a bounded sample outside the held-out fold."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model)
        for batch in batches:
            for first, last, data, at in blocks(batch.column("text")):
                row, index = features(data, at, restorer)
                found, often = np.unique((row << BITS) | index, return_counts=True)
                often = np.minimum(often, MOST_OFTEN).astype(np.int8)
                cut = np.searchsorted(found >> BITS, np.arange(last - first + 1))
                index = (found & ((1 << BITS) - 1)).astype(np.int32)
                part = [(index[a:b].tobytes(), often[a:b].tobytes()) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id")[first:last],
                        batch.column("y")[first:last],
                        *(pa.array([x[c] for x in part], pa.binary()) for c in (0, 1)),
                    ],
                    ["doc_id", "y", "at", "n"],
                )

    got = (
        sample(docs, labels, "toxic", FOLDS, HELD, rows)
        .mapInArrow(distinct, "doc_id long, y int, at binary, n binary")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "y")
        .toArrow()
    )

    def each() -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        for y, at, n in zip(*(got.column(c).to_pylist() for c in ("y", "at", "n")), strict=True):
            yield np.frombuffer(at, np.int32), np.frombuffer(n, np.int8).astype(np.float64), y

    return ftrl.train(each(), 1 << BITS, alpha=0.3, l1=6.0, l2=0.05, epochs=6)


def scorer(model: np.ndarray, learned: ftrl.Model):
    """A column function: text to the probability of toxic 1."""
    weights, bias = learned.weights, learned.bias

    @F.arrow_udf(DoubleType())
    def score(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        restorer = Restorer(model)
        for column in columns:
            out = []
            for first, last, data, at in blocks(column):
                row, index = features(data, at, restorer)
                some = weights[index] != 0
                found, often = np.unique((row[some] << BITS) | index[some], return_counts=True)
                value = weights[found & ((1 << BITS) - 1)] * np.minimum(often, MOST_OFTEN).astype(np.float64)
                out.append(np.bincount(found >> BITS, value, minlength=last - first))
            logits = np.concatenate(out) if out else np.zeros(0)
            yield pa.array(ftrl.Model(weights, bias).probability(logits), pa.float64())

    return score


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    model = log_probabilities(count_trigrams(docs))
    score = scorer(model, fit(docs, labels, model))
    return docs.select(
        "doc_id", eligible(F.col("doc_id"), FOLDS, HELD).alias("held_out"), score("text").alias("score")
    ).withColumn("predicted", (F.col("score") >= TOXIC_AT).cast("int"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
