"""Vector searches against brute force."""

import numpy as np
import pytest

from stopflow.llm import ann, topk, vectors


@pytest.fixture(scope="module")
def odd(spark):
    """Vectors with ties, repetitions, and every kind that takes no part."""
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).round(1).tolist(), 1.0) for i in range(300)]
    rows += [(1000 + i, rows[0][1], 2.0) for i in range(40)] + [(0, rows[0][1], 1.0)]
    rows += [(2000, None, 0.0), (2050, [float("nan")] * 8, 0.0), (2100, [None] * 8, 0.0), (2150, [0.0] * 8, 0.0), (None, [1.0] * 8, 0.0), (2200, [float("inf")] * 8, 0.0), (2250, [], 0.0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score double")


def arrays(df):
    rows = df.collect()
    return np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)


def brute(ids, x, measure, every, k):
    out = {}
    for one in sorted({int(i) for i in ids if i % every == 0}):
        score = measure(x, x[np.flatnonzero(ids == one)[0]])
        left = np.flatnonzero(ids != one)
        best = left[np.lexsort((ids[left], -score[left]))[:k]]
        out[one] = [(r + 1, int(ids[b]), score[b]) for r, b in enumerate(best)]
    return out


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return out


def test_exact_topk(spark, sf, odd):
    for rows in (vectors.valid(odd), vectors.valid(spark.read.parquet(f"{sf}/embeddings.parquet"))):
        ids, x = arrays(rows)
        whole = topk.integers(x)
        assert answers(topk.search(rows)) == brute(ids, whole, lambda m, q: (m * q).sum(axis=1), topk.EVERY, topk.K)


def test_exact_topk_with_few_rows(spark, odd):
    few = vectors.valid(odd).filter("vec_id IN (50, 51, 52)")
    assert [len(v) for v in answers(topk.search(few)).values()] == [2]
    assert topk.search(vectors.valid(odd.limit(0))).count() == 0


def test_exact_topk_of_huge_components_and_several_lengths(spark):
    """Integers of any size, scores at the ends of a long, and each length among its own rows."""
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=5) * 10.0 ** rng.integers(-2, 12)).tolist()) for i in range(300)]
    rows += [(400 + i, [1e30, -1e30, 1.0, float(i), 2.0**60]) for i in range(3)] + [(500 + i, [1.0, float(i)]) for i in range(60)]
    got = answers(topk.search(vectors.valid(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), every=50, k=5))
    whole = {i: [int(np.floor(256 * c)) for c in v] for i, v in rows}
    for one in (i for i, _ in rows if i % 50 == 0):
        score = {i: sum(a * b for a, b in zip(v, whole[one], strict=True)) for i, v in whole.items() if i != one and len(v) == len(whole[one])}
        score = {i: min(max(s, -(1 << 63)), (1 << 63) - 1) for i, s in score.items()}
        best = sorted(score, key=lambda i: (-score[i], i))[:5]
        assert got[one] == [(r + 1, i, score[i]) for r, i in enumerate(best)], one


def test_a_longer_row_empties_nothing(spark, odd):
    rows = vectors.valid(odd, nonzero=True)
    more = rows.union(spark.createDataFrame([(3000, [1.0] * 9), (3001, [2.0] * 9)], "vec_id long, embedding array<double>"))
    for of, every, k in ((topk, 50, 5), (ann, 20, 20)):
        one, two = answers(of.search(rows, every, k)), answers(of.search(more, every, k))
        assert len(one) > 5 and {q: v for q, v in two.items() if q != 3000} == one
        assert [v for _, v, _ in two[3000]] == [3001]


def test_a_group_larger_than_a_part(spark, monkeypatch):
    """A third of the rows in one list: it is cut into parts, and nothing is lost."""
    monkeypatch.setattr(ann, "GROUP_ROWS", 50)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 7)
    rng = np.random.default_rng(8)
    rows = [(i, ([1.0] * 6 if i % 3 == 0 else rng.normal(size=6).round(2).tolist())) for i in range(900)]
    found = vectors.valid(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), nonzero=True)
    ids, x = arrays(found)
    want, got = brute(ids, x, lambda m, q: (m * q).sum(axis=1), 20, 20), answers(ann.search(found))
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert sum(len({v for _, v, _ in got[q]} & {v for _, v, _ in want[q]}) for q in want) >= 0.9 * 20 * len(want)


def test_candidates_hold_the_best():
    rng = np.random.default_rng(3)
    x, q = rng.integers(-300, 300, (2000, 12)), rng.integers(-300, 300, (30, 12))
    x[5], q[3], q[4] = x[6], 0, np.abs(q[4])
    for one, left in zip(q, topk.Lists(x).candidates(q, np.full(30, 6)), strict=True):
        score = x @ one
        assert set(np.flatnonzero(score >= np.sort(score)[-6])) <= set(left.tolist())


def test_nearest_neighbours(spark, sf, odd):
    rows = vectors.valid(spark.read.parquet(f"{sf}/embeddings.parquet"), nonzero=True)
    ids, x = arrays(rows)
    want, got = brute(ids, x, lambda m, q: (m * q).sum(axis=1), ann.EVERY, ann.K), answers(ann.search(rows))
    assert set(got) == set(want) and all([r for r, _, _ in v] == list(range(1, ann.K + 1)) for v in got.values())
    scores = {(q, v): s for q, best in want.items() for _, v, s in best}
    assert all(s == pytest.approx(scores[q, v], abs=1e-12) for q, best in got.items() for _, v, s in best if (q, v) in scores)
    hits = sum(len({v for _, v, _ in got[q]} & {v for _, v, _ in want[q]}) for q in want)
    assert hits / (ann.K * len(want)) >= 0.9


def test_nearest_neighbours_of_odd_rows(spark, odd):
    rows = vectors.valid(odd, nonzero=True)
    ids, x = arrays(rows)
    want, got = brute(ids, x, lambda m, q: (m * q).sum(axis=1), ann.EVERY, ann.K), answers(ann.search(rows))
    assert set(got) == set(want)
    assert [v for _, v, _ in got[0]] == [v for _, v, _ in want[0]]
    few = rows.filter("vec_id IN (20, 21, 22)")
    assert [len(v) for v in answers(ann.search(few)).values()] == [2]
    assert ann.search(vectors.valid(odd.limit(0))).count() == 0


def test_working_tables_are_shared_and_released(spark):
    from stopflow.llm.common import forget, saved
    from stopflow.sources.working import release

    table = saved(spark.range(5), "spare")
    assert table.count() == 5 and table.dtypes == spark.range(5).dtypes
    other = saved(spark.range(5), "spare")
    forget(other)
    assert release(spark, "spare") == 1
