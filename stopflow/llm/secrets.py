"""Secret scans: fixed patterns, and a randomness test battery over other long tokens.

Patterns find assigned values, access keys and long hexadecimal strings; see BASE. Beyond them, every maximal
run of MIN_RANDOM or more token characters is a candidate; `=` parts runs, but for those that close one. A run with
`+` or `/` and also `_` or `-` fits no encoding, so it is parted at either pair of signs and each long piece is a
candidate; of random pieces within one another the longest counts. Its encoding (hexadecimal, base 32, lower or upper
case alphanumeric, alphanumeric, base 64 in either form) is inferred from its characters, and three statistics
are taken over the encoding's alphabet: chi-squared against uniform counts, runs above and below the middle,
and serial correlation of neighbours. Fisher's method joins their p-values. The sum of squared counts is also held against its distribution for
letters of running text, with exact mean and variance of a multinomial; its lower tail is a p-value of the
hypothesis "this is text". A second one is the reciprocal of a likelihood ratio: uniform draws from the encoding
against a Markov chain over vowels, consonants, capitals, digits and signs with the letters' frequencies, as words
and identifiers change them seldom. Summed over all tokens of a length, uniform draws have weight 1 in each encoding,
so by Markov's inequality the reciprocal times the number of encodings is a p-value at any length. Twice the lesser
of the two is ranked. False discoveries are controlled over all candidates of the table by the
Benjamini-Hochberg rule at rate Q within strata of length, as short tokens carry less evidence: a histogram
of p-values, a row for each stratum and bins, gives the cut-offs. Among the candidates so rejected as text, the same
rule over the joint p-values of the battery rejects, in each stratum, those that are not random either; the others
are flagged. Runs of digits alone have no encoding and are not candidates. A candidate that touches a span of the
patterns adds nothing.

Everything is built from DataFrame functions. Places are code points, ends exclusive. What depends on all earlier
matches of a text, such as their places, is a running fold in chunks, so work grows in proportion to the matches.

Defined cases: a null text counts as empty and has no spans; texts of any length are scanned whole; repeated
rows are scanned each, and count each in the histogram; of equal p-values all are rejected or none; an empty table
gives an empty result; a null doc_id is kept; other columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import forget, free_name, saved, table

#: Kind, pattern, group that counts, and its least length. Fixed values.
BASE = [
    (
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        12,
    ),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
]
RANDOM = "random"
MIN_RANDOM = 20
_RUN = r"[A-Za-z0-9+/_-]{%d,}(?:=+(?![A-Za-z0-9+/_=-]))?" % MIN_RANDOM
_PIECES = [r"[A-Za-z0-9%s]{%d,}(?:=+$)?" % (signs, MIN_RANDOM) for signs in ("+/", "_-")]
#: Lower ends of the strata of length.
STRATA = [20, 28, 40, 64]
Q = 0.01
#: Values that a running fold takes at once, and code points of a piece of text.
CHUNK, PIECE = 256, 1024
#: Bins of -log10 p: BINS_PER of them for each power of ten, the last open.
BINS_PER, BINS = 20, 400

#: Relative frequencies of the letters a to z in English text, in per cent. Fixed values.
LETTERS = [
    8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4,
    6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.074,
]
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Pattern of the token without closing `=`, alphabet, and how many letters text has in it; the first that fits.
ENCODINGS = [
    (r"^[0-9a-f]+$", _DIGITS + "abcdef", 6),
    (r"^[0-9A-F]+$", _DIGITS + "ABCDEF", 6),
    (r"^[A-Z2-7]+$", _UPPER + "234567", 26),
    (r"^[0-9a-z]+$", _DIGITS + _LOWER, 26),
    (r"^[0-9A-Z]+$", _DIGITS + _UPPER, 26),
    (r"^[0-9A-Za-z]+$", _DIGITS + _UPPER + _LOWER, 26),
    (r"^[0-9A-Za-z+/]+$", _UPPER + _LOWER + _DIGITS + "+/", 26),
    (r"^[0-9A-Za-z_-]+$", _UPPER + _LOWER + _DIGITS + "-_", 26),
]
#: The chain of text: of each group of characters, how often each group follows; last, how often each begins. Fixed values.
GROUPS = ["aeiouy", "bcdfghjklmnpqrstvwxz", "AEIOUY", "BCDFGHJKLMNPQRSTVWXZ", _DIGITS, "+/_-"]
FOLLOWS = [
    [0.15, 0.70, 0.01, 0.04, 0.03, 0.07],
    [0.50, 0.35, 0.01, 0.04, 0.03, 0.07],
    [0.05, 0.22, 0.12, 0.55, 0.02, 0.04],
    [0.27, 0.08, 0.36, 0.22, 0.03, 0.04],
    [0.02, 0.06, 0.01, 0.05, 0.72, 0.14],
    [0.15, 0.40, 0.05, 0.15, 0.20, 0.05],
    [0.15, 0.35, 0.10, 0.25, 0.10, 0.05],
]


def _within() -> list[float]:
    """The share of each character in its group."""
    weight = dict(zip(_LOWER + _UPPER, LETTERS * 2, strict=True))
    return [weight.get(c, 1.0) / sum(weight.get(x, 1.0) for x in g) for g in GROUPS for c in g]


def running(values: Column, add: Callable[[Column, Column], Column], zero: int = 0) -> Column:
    """For each of array<int> the fold of those before it; add is associative, with zero as its neutral element.

    Chunks are folded one by one from what the chunks before them fold to, so a value is copied some CHUNK times.
    """

    def one_by_one(part: Column, start: Column) -> Column:
        def step(done: Column, x: Column) -> Column:
            return F.struct(add(done["at"], x).alias("at"), F.array_append(done["out"], done["at"]).alias("out"))

        return F.aggregate(part, F.struct(start.alias("at"), F.array().cast("array<int>").alias("out")), step)["out"]

    def whole(parts: Column) -> Column:
        starts = one_by_one(F.transform(parts, lambda part: F.aggregate(part, F.lit(zero), add)), F.lit(zero))
        return F.flatten(F.zip_with(parts, starts, one_by_one))

    def guarded(values: Column) -> Column:
        last = F.floor((F.size(values) - 1) / CHUNK).cast("int")
        chunks = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(values, k * CHUNK + 1, F.lit(CHUNK)))
        return F.when(F.size(values) > 0, _bind(chunks, whole)).otherwise(F.array().cast("array<int>"))

    return _bind(values, guarded)


def _sum(a: Column, b: Column) -> Column:
    return a + b


def _most(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _fewest(a: Column, b: Column) -> Column:
    return F.least(a, b)


def matches(text: Column, pattern: str, group: int) -> Column:
    """Leftmost non-overlapping matches: array<struct<start, stop, value>>, value being a group of the match."""
    kind = "array<struct<start: int, stop: int, value: string>>"
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    items = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("whole"), value.alias("value"))
    items = F.transform(
        F.filter(items, lambda x: x["whole"].isNotNull()),
        lambda x: F.struct(F.char_length(x["gap"]).alias("gap"), F.char_length(x["whole"]).alias("size"), x["value"].alias("value")),
    )

    def placed(found: Column) -> Column:
        def one(x: Column, before: Column) -> Column:
            start = before + x["gap"]
            return F.struct(start.alias("start"), (start + x["size"]).alias("stop"), x["value"].alias("value"))

        return F.zip_with(found, running(F.transform(found, lambda x: x["gap"] + x["size"]), _sum), one)

    return F.when(F.coalesce(text, F.lit("")).rlike(pattern), _bind(items, placed)).otherwise(F.array()).cast(kind)


def base_spans(text: Column) -> Column:
    """Spans of the patterns, sorted by start, then kind."""

    def of(place: int, kind: str, pattern: str, group: int, least: int) -> Column:
        return F.transform(
            F.filter(matches(text, pattern, group), lambda m: F.char_length(m["value"]) >= least),
            lambda m: _span(m, place, kind),
        )

    return F.array_sort(F.concat(*(of(place, *rule) for place, rule in enumerate(BASE))))


def _span(m: Column, place: int, kind: str) -> Column:
    return F.struct(
        m["start"].alias("start"), F.lit(place).alias("place"), m["stop"].alias("stop"), F.lit(kind).alias("kind")
    )


def _below(z: Column) -> Column:
    """The normal distribution function, by a logistic approximation."""
    return 1.0 / (1.0 + F.exp(-(1.5976 * z + 0.07056 * z * z * z)))


def _upper(z: Column) -> Column:
    return _below(-z)


def _bind(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda bound, _: bound, body)


def _standard(squares: Column, n: Column, s2: Column, s3: Column) -> Column:
    """The sum of squared multinomial counts, standardised by its mean and variance from sums of p^2 and p^3."""
    var = 4 * n * (n - 1) * (n - 2) * s3 + 2 * n * (n - 1) * s2 - 2 * n * (n - 1) * (2 * n - 3) * s2 * s2
    return (squares - n - n * (n - 1) * s2) / F.sqrt(F.greatest(var, F.lit(1e-9)))


def _battery(chars: Column, kind: Column) -> Column:
    """struct<uniform, text>: p-values of randomness by the three tests, and of text, for an encoding's number."""

    def constant(values: list) -> Column:
        return F.get(F.array(*map(F.lit, values)), kind)

    def shares(letters: int) -> list[float]:
        return [x / sum(LETTERS[:letters]) for x in LETTERS[:letters]]

    some = [(a, m) for _, a, m in ENCODINGS]
    alphabet, k = constant([a for a, _ in some]), constant([float(len(a)) for a, _ in some])
    n = F.size(chars).cast("double")

    def tests(places: Column) -> Column:
        squares = F.aggregate(
            F.array_distinct(places),
            F.lit(0.0),
            lambda acc, c: acc + F.pow(F.size(F.filter(places, lambda x: x == c)).cast("double"), F.lit(2.0)),
        )
        middle, spread = (k - 1) / 2, (k * k - 1) / 12
        after = F.slice(places, F.lit(2), F.size(places))
        pairs = F.zip_with(places, after, lambda a, b: F.struct((a - middle).alias("a"), (b - middle).alias("b")))
        pairs = F.filter(pairs, lambda p: p["b"].isNotNull())
        changes = F.size(F.filter(pairs, lambda p: p["a"] * p["b"] < 0))
        runs = 2.0 * _upper(F.abs(changes - (n - 1) / 2) / F.sqrt((n - 1) / 4))
        product = F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + p["a"] * p["b"]) / spread
        serial = 2.0 * _upper(F.abs(product) / F.sqrt(n - 1))
        s2, s3 = ([sum(x**e for x in shares(m)) for _, m in some] for e in (2, 3))

        def joined(q: Column) -> Column:
            chi = _upper(_standard(q, n, 1 / k, 1 / (k * k)))
            half = -(F.ln(F.greatest(chi, F.lit(1e-99))) + F.ln(F.greatest(runs, F.lit(1e-99))) + F.ln(F.greatest(serial, F.lit(1e-99))))
            uniform = _bind(half, lambda h: F.exp(-h) * (1.0 + h + h * h / 2.0))
            text = _below(_standard(q, n, constant(s2), constant(s3)))
            return F.struct(uniform.alias("uniform"), text.alias("text"))

        return _bind(squares, joined)

    return _bind(F.transform(chars, lambda c: (F.instr(alphabet, c) - 1).cast("double")), tests)


def _pieces(text: Column) -> Column:
    """array<struct<start, stop, value>> of the long runs, parted where no encoding has all their signs."""

    def parted(m: Column) -> Column:
        def placed(x: Column) -> Column:
            return F.struct((m["start"] + x["start"]).alias("start"), (m["start"] + x["stop"]).alias("stop"), x["value"].alias("value"))

        parts = F.array_distinct(F.concat(*(F.transform(matches(m["value"], p, 0), placed) for p in _PIECES)))
        return F.when(m["value"].rlike("[+/]") & m["value"].rlike("[_-]"), parts).otherwise(F.array(m))

    return F.flatten(F.transform(matches(text, _RUN, 0), parted))


def _unlike_text(chars: Column, kind: Column) -> Column:
    """The log-likelihood ratio of uniform draws from the encoding to the chain of text."""
    every, end = "".join(GROUPS), len(GROUPS)
    group = F.array(*(F.lit(k) for k, g in enumerate(GROUPS) for _ in g))
    own = F.array(*(F.lit(math.log(x)) for x in _within()))
    follows = F.array(*(F.lit(math.log(x)) for row in FOLLOWS for x in row))
    size = F.get(F.array(*(F.lit(math.log(len(a))) for _, a, _ in ENCODINGS)), kind)

    def add(done: Column, c: Column) -> Column:
        def step(place: Column) -> Column:
            now = F.get(group, place)
            gain = F.get(follows, done["last"] * end + now) + F.get(own, place) + size
            return F.struct((done["sum"] - gain).alias("sum"), now.alias("last"))

        return _bind(F.instr(F.lit(every), c) - 1, step)

    return F.aggregate(chars, F.struct(F.lit(0.0).alias("sum"), F.lit(end).alias("last")), add)["sum"]


def candidates(text: Column) -> Column:
    """array<struct<start, stop, stratum, bin, rank, uniform>> of the long tokens that have an encoding.

    bin holds the p-value of the squares alone, rank the one of both tests against text, uniform that of the battery.
    """

    def encoded(bare: Column) -> Column:
        kind = F.lit(None).cast("int")
        for number, (pattern, _, _) in reversed(list(enumerate(ENCODINGS))):
            kind = F.when(bare.rlike(pattern), F.lit(number)).otherwise(kind)
        return F.when((F.char_length(bare) >= MIN_RANDOM) & ~bare.rlike("^[0-9]+$"), kind)

    def named(m: Column) -> Column:
        def with_kind(bare: Column) -> Column:
            return F.struct(
                m["start"].alias("start"),
                m["stop"].alias("stop"),
                sum((F.char_length(bare) >= n).cast("int") for n in STRATA).alias("stratum"),
                encoded(bare).alias("kind"),
                F.filter(F.split(bare, ""), lambda c: c != "").alias("chars"),
            )

        return _bind(F.regexp_replace(m["value"], "=+$", ""), with_kind)

    def binned(m: Column) -> Column:
        def power(p: Column) -> Column:
            return F.least(F.floor(-F.log10(F.greatest(p, F.lit(1e-99))) * BINS_PER).cast("int"), F.lit(BINS))

        def with_bin(p: Column) -> Column:
            chain = len(ENCODINGS) * F.exp(-_unlike_text(m["chars"], m["kind"]))
            return F.struct(
                m["start"],
                m["stop"],
                m["stratum"],
                power(p["text"]).alias("bin"),
                power(F.least(2 * F.least(p["text"], chain), F.lit(1.0))).alias("rank"),
                power(p["uniform"]).alias("uniform"),
                p["uniform"].alias("p_uniform"),
            )

        return _bind(_battery(m["chars"], m["kind"]), with_bin)

    found = F.filter(F.transform(_pieces(text), named), lambda m: m["kind"].isNotNull())
    return F.transform(found, binned)


def _rejected(counts: DataFrame, bin_: str) -> DataFrame:
    """(stratum, at): for rows (stratum, bins, n) the least bin of p-values that the Benjamini-Hochberg rule rejects, if any."""
    most = Window.partitionBy("stratum")
    from_here = most.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)
    summed = counts.groupBy("stratum", F.col(bin_).alias("bin")).agg(F.sum("n").alias("n"))
    ruled = summed.select("stratum", "bin", F.sum("n").over(from_here).alias("rejected"), F.sum("n").over(most).alias("all"))
    ruled = ruled.filter(F.pow(F.lit(10.0), -F.col("bin") / BINS_PER) * F.col("all") <= F.col("rejected") * Q)
    return ruled.groupBy("stratum").agg(F.min("bin").alias("at"))


def with_candidates(docs: DataFrame, name: str) -> DataFrame:
    """docs with a column of their long tokens; analysed once for all that use it."""
    return docs.withColumn(name, candidates(F.coalesce(F.col("text"), F.lit(""))))


def cutoffs(found: DataFrame, name: str) -> dict[int, tuple[int, int]]:
    """From with_candidates(): for each stratum that has any, the least bin rejected as text, and, among these, the least
    bin rejected as random."""
    found = found.select(F.explode(name).alias("c")).select("c.stratum", "c.rank", "c.uniform")
    counts = saved(found.groupBy("stratum", "rank", "uniform").agg(F.count("*").alias("n")), "histogram")  # bounded by the bins
    text = _rejected(counts, "rank")
    left = counts.join(text, "stratum").filter("rank >= at").drop("at")
    both = text.join(_rejected(left, "uniform").withColumnRenamed("at", "random"), "stratum", "left")
    limits = {r["stratum"]: (r["at"], BINS + 1 if r["random"] is None else r["random"]) for r in both.collect()}
    forget(counts)
    return limits


def _untouched(found: Column, base: Column) -> Column:
    """The spans of found that overlap none of base; found is in order of starts."""
    kind = "array<struct<start: int, own: int, stop: int>>"
    every = F.array_sort(
        F.concat(
            F.transform(base, lambda b: F.struct(b["start"].alias("start"), F.lit(-1).alias("own"), b["stop"].alias("stop"))).cast(kind),
            F.transform(found, lambda m, k: F.struct(m["start"].alias("start"), k.alias("own"), m["stop"].alias("stop"))).cast(kind),
        )
    )
    none = (1 << 31) - 1

    def marked(all_: Column) -> Column:
        """The numbers of found that no base span before or at their start reaches, and no one after it begins in."""
        reach = running(F.transform(all_, lambda x: F.when(x["own"] < 0, x["stop"]).otherwise(0)), _most)
        begin = F.reverse(running(F.reverse(F.transform(all_, lambda x: F.when(x["own"] < 0, x["start"]).otherwise(none))), _fewest, none))
        near = F.arrays_zip(all_.alias("x"), reach.alias("reach"), begin.alias("begin"))
        clear = F.filter(near, lambda n: (n["x"]["own"] >= 0) & (n["reach"] <= n["x"]["start"]) & (n["begin"] >= n["x"]["stop"]))
        return F.transform(clear, lambda n: F.get(found, n["x"]["own"]))

    return F.when((F.size(base) > 0) & (F.size(found) > 0), _bind(every, marked)).otherwise(found)


def _outermost(found: Column) -> Column:
    """The spans of found, in order of starts and of descending stops, that lie within no other."""
    before = running(F.transform(found, lambda m: m["stop"]), _most)
    return F.transform(F.filter(F.arrays_zip(found.alias("m"), before.alias("before")), lambda x: x["before"] < x["m"]["stop"]), lambda x: x["m"])


def with_spans(docs: DataFrame, base: str = "base_spans", spans: str = "spans") -> DataFrame:
    """docs with two columns of spans, array<struct<start, place, stop, kind>>: of the patterns, and of all."""
    own = free_name(docs, "random_spans")
    docs = with_candidates(docs, own)
    limits = cutoffs(docs, own)

    def random(m: Column) -> Column:
        low, high = F.lit(BINS + 1), F.lit(BINS + 1)
        for stratum, (at, until) in limits.items():
            low = F.when(m["stratum"] == stratum, at).otherwise(low)
            high = F.when(m["stratum"] == stratum, until).otherwise(high)
        return (m["rank"] >= low) & (m["uniform"] < high)

    def ends(m: Column) -> Column:
        return F.struct(m["start"].alias("start"), (-m["stop"]).alias("back"), m["stop"].alias("stop"))

    # Column by column, as the analyser resolves nested lambda functions level by level.
    found = docs.withColumn(base, base_spans(F.coalesce(F.col("text"), F.lit("")))).withColumn(own, F.filter(own, random))
    found = found.withColumn(own, F.array_sort(F.transform(own, ends))).withColumn(own, _outermost(F.col(own)))
    found = found.withColumn(own, _untouched(F.col(own), F.col(base)))
    added = F.transform(own, lambda m: _span(m, len(BASE), RANDOM))
    return found.withColumn(spans, F.array_sort(F.concat(F.col(base), added))).drop(own)


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of `text` replaced by the mark; spans that overlap are replaced as one."""
    names = [free_name(docs, name) for name in ("base_spans", "all_spans", "text_pieces", "covered")]
    base, spans, pieces, covered = names

    def between(start: Column, stop: Column) -> Column:
        first = F.floor(start / PIECE).cast("int")
        some = F.slice(pieces, first + 1, F.floor(stop / PIECE).cast("int") - first + 1)
        return F.substr(F.array_join(some, ""), start % PIECE + 1, stop - start)

    def shown(span: Column, at: Column) -> Column:
        return F.when(span["start"] >= at, F.concat(between(at, span["start"]), F.lit(mark))).otherwise("")

    stops = F.transform(spans, lambda s: s["stop"])
    hit = F.col("text").isNotNull() & (F.size(spans) > 0)
    found = with_spans(docs, base, spans)
    found = found.withColumn(pieces, F.when(hit, F.regexp_extract_all("text", F.lit("(?s).{1,%d}" % PIECE), F.lit(0))))
    found = found.withColumn(covered, F.when(hit, running(stops, _most)))  # by the spans before each
    clean = F.concat(F.array_join(F.zip_with(spans, covered, shown), ""), between(F.array_max(stops), F.char_length("text")))
    return found.withColumn("text", F.when(hit, clean).otherwise(F.col("text"))).select(*docs.columns)


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind, *_ in BASE]
    return found.select(
        "doc_id", *counts, F.sha2(listed(F.col("base_spans")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")
    )
