"""Many shuffles of matching in Arrow passes: a shuffle is some array operations, not rows that are dealt and written.

The same results as stats.permuted() with matching.matched_pairs(), deltas(), within_caliper() and delta_summary();
rows are dealt once for each block of shuffles, and only the means of each shuffle leave a pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.mixer import mixed
from ..sources.working import materialised
from .matching import CALIPER, ID
from .stats import ordinals

#: The iteration of people as they are, beside those of the shuffles.
SEEN = -1
#: Shuffled rows of a block, its fewest shuffles, and the most distances held at a time.
WORK, FEWEST, CELLS = 250_000, 16, 1_000_000
#: Tasks of a core.
WAVES = 4
#: Most rows of a scope that one pass may hold.
LARGEST = 1_000_000


def half_away(x: np.ndarray) -> np.ndarray:
    """Whole numbers, halves away from zero as SQL engines round the scaled double."""
    return np.trunc(x + np.copysign(0.5, x))


class People:
    """The rows of a scope in the order of their places."""

    def __init__(self, gender: np.ndarray, visits: np.ndarray, locations: np.ndarray, metrics: dict[str, np.ndarray]):
        self.gender, self.locations, self.metrics = gender, locations, metrics
        self.places = np.arange(len(gender), dtype=np.int64)
        least = locations.min()
        _, one, self.point = np.unique(visits * (locations.max() - least + 1) + locations - least, return_index=True, return_inverse=True)
        self.v, self.l = visits[one], locations[one]

    def shuffled(self, b: int) -> np.ndarray:
        """The genders of iteration b."""
        return self.gender if b == SEEN else self.gender[np.argsort(mixed(self.places, b), kind="stable")]

    def nearest(self, asking: np.ndarray, offered: np.ndarray) -> np.ndarray:
        """For each asking row the nearest offered row, in z-space of the asking side; equal distances go to the first place."""
        sv, sl = (self._deviation(asking, x) for x in (self.v, self.l))
        first = np.full(len(self.v), -1)
        first[self.point[offered[::-1]]] = offered[::-1]  # of repeated points the last value stays
        wanted = np.unique(self.point[asking])
        best = np.full(len(self.v), -1)
        if sv > 0 and sl > 0 and max(sv, sl) ** 2 < 1e9:  # no other point is at a distance that rounds to 0
            best[wanted] = first[wanted]
            wanted = wanted[first[wanted] < 0]
        others = np.sort(first[first >= 0])  # so that the first of equal distances has the first place
        v, l = self.v[self.point[others]], self.l[self.point[others]]
        step = max(CELLS // len(others), 1)
        for some in (wanted[i : i + step] for i in range(0, len(wanted), step)):
            dist2 = np.zeros((len(some), len(others)))
            for mine, theirs, spread in ((self.v, v, sv), (self.l, l, sl)):
                if spread > 0:
                    dist2 += ((mine[some, None] - theirs) / spread) ** 2
            best[some] = others[np.argmin(half_away(dist2 * 1e9), axis=1)]
        return best[self.point[asking]]

    def _deviation(self, asking: np.ndarray, of: np.ndarray) -> float:
        """The deviation over asking rows of a value by point; sums are of Python integers, and exact."""
        counts = np.bincount(self.point[asking], minlength=len(of))
        held = np.flatnonzero(counts)
        each = list(zip(counts[held].tolist(), of[held].tolist(), strict=True))
        n, total, squares = len(asking), sum(c * x for c, x in each), sum(c * x * x for c, x in each)
        return (n * squares - total * total) ** 0.5 / n

    def pairs(self, gender: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Men and women of the pairs of both directions."""
        men, women = np.flatnonzero(gender == 0), np.flatnonzero(gender == 1)
        if not len(men) or not len(women):
            return men[:0], women[:0]
        theirs = self.nearest(men, women)
        left = np.ones(len(gender), dtype=bool)
        left[theirs] = False
        rest = women[left[women]]
        if not len(rest):
            return men, theirs
        return np.concatenate([men, self.nearest(rest, men)]), np.concatenate([theirs, rest])

    def means(self, b: int, caliper: int) -> Iterator[tuple[str, float | None]]:
        """Each metric's mean relative difference over the pairs that the caliper allows; nothing without pairs."""
        m, f = self.pairs(self.shuffled(b))
        near = np.abs(self.locations[m] - self.locations[f]) <= caliper
        m, f = m[near], f[near]
        for name, x in self.metrics.items() if len(m) else ():
            diff, whole = x[m] - x[f], x[m] + x[f]
            some = np.abs(whole) > 0  # not null either
            millionths = half_away(diff[some] / whole[some] * 1e6).astype(np.int64)
            n = len(millionths)
            yield name, float(half_away(np.float64(int(millionths.sum()) / 1e6 / n * 1e12)) / 1e12) if n else None


def mean_differences(rows: DataFrame, metrics: list[str], scope: list[str], group: str, times: int) -> DataFrame:
    """Scope, b, metric and mean_rel of each of the shuffles 0..times-1 and of the rows as they are (b = SEEN).

    group is the column of scope with the group of the caliper; a group without one is an error. Ids are unique within
    a scope, of at most LARGEST rows.
    """
    wanted = [*metrics, *(m for m in ("locations", "visits") if m not in metrics)]
    kinds = dict(rows.dtypes)
    at = ordinals(rows, scope, ID, keep=materialised)
    blocks = F.least(F.ceil(F.col("n") * (times + 1) / F.lit(WORK)), F.lit(-(-(times + 1) // FEWEST))).cast("int")
    sex = F.when(F.col("gender") == "MALE", 0).when(F.col("gender") == "FEMALE", 1).otherwise(2)
    values = [F.col(m).cast("double").alias(f"_{m}") for m in wanted]
    each_block = at.select(
        *scope, "place", sex.alias("sex"), F.col("visits").cast("long").alias("visits"), F.col("locations").cast("long").alias("locations"), *values,
        blocks.alias("blocks"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"),
    )

    def passed(keys: tuple, table: pa.Table) -> pa.Table:
        named = dict(zip([*scope, "block"], (k.as_py() for k in keys), strict=True))
        if named[group] not in CALIPER:
            raise ValueError(f"no caliper for group {named[group]}")
        table = table.sort_by("place")
        array = {c: table.column(c).to_numpy() for c in ("sex", "visits", "locations", *(f"_{m}" for m in wanted))}
        people = People(array["sex"], array["visits"], array["locations"], {m: array[f"_{m}"] for m in wanted})
        turns = range(SEEN + named["block"], times, table.column("blocks")[0].as_py())
        found = [(b, *mean) for b in turns for mean in people.means(b, CALIPER[named[group]])]
        columns = [pa.array([named[c]] * len(found)).cast(pa.string()) for c in scope]
        b, metric, mean = ([row[i] for row in found] for i in range(3))
        return pa.table([*columns, pa.array(b, pa.int64()), pa.array(metric, pa.string()), pa.array(mean, pa.float64())], [*scope, "b", "metric", "mean_rel"])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in scope), "b long", "metric string", "mean_rel double"])
    # By number: few bytes are much work, and Spark would put them into one task.
    spread = each_block.repartition(WAVES * rows.sparkSession.sparkContext.defaultParallelism, *scope, "block")
    return spread.groupBy(*scope, "block").applyInArrow(passed, schema)
