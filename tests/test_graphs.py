"""Closed forms and identities of the graph kernel."""

from itertools import combinations

import numpy as np
import pytest

from stopflow.operators import graph_kernel as k


def graph(pairs, weight=1, home=None):
    return k.Graph([{"u": a, "v": b, "w": weight} for a, b in pairs], None, home)


PATH = [(0, 1), (1, 2), (2, 3)]
CYCLE = [(0, 1), (1, 2), (2, 3), (3, 4), (0, 4)]
STAR = [(0, i) for i in range(1, 5)]
COMPLETE = [(a, b) for a in range(5) for b in range(a + 1, 5)]
BOWTIE = [(0, 1), (0, 2), (1, 2), (2, 3), (2, 4), (3, 4)]


@pytest.mark.parametrize(
    ("pairs", "node", "edge", "diameter"),
    [(PATH, 1, 1, 3), (CYCLE, 2, 2, 2), (STAR, 1, 1, 2), (COMPLETE, 4, 4, 1)],
)
def test_connectivity_and_diameter(pairs, node, edge, diameter):
    g = graph(pairs)
    assert k.node_connectivity(g) == node
    assert k.edge_connectivity(g) == edge
    assert k.eccentricities(g)["diameter"] == diameter


def test_cycle_basis():
    assert k.cycle_lengths(graph(CYCLE)) == [5]
    assert sorted(k.cycle_lengths(graph(BOWTIE))) == [3, 3]
    assert k.cycle_lengths(graph(PATH)) == []
    assert len(k.cycle_lengths(graph(COMPLETE))) == 10 - 5 + 1


def test_efficiency():
    assert k.global_efficiency(graph(COMPLETE)) == 1
    assert k.global_efficiency(graph(PATH)) == pytest.approx((6 + 4 / 2 + 2 / 3) / 12)
    assert k.local_efficiency(graph(STAR)) == 0
    assert k.local_efficiency(graph(COMPLETE)) == 1


def test_centralities():
    assert k.betweenness(graph(STAR))[0] == pytest.approx(1)
    assert k.closeness(graph(STAR))[0] == pytest.approx(1)
    star = k.eigenvector(graph(STAR))
    assert star[0] == pytest.approx(2 * star[1])


def test_hitting_times_satisfy_their_equations():
    rng = np.random.default_rng(5)
    weight = np.triu(rng.integers(0, 4, (7, 7)), 1) + np.eye(7, k=1)
    weight = weight + weight.T
    times = k.hitting_times(weight)
    step = weight / weight.sum(axis=1, keepdims=True)
    for v in range(7):
        for u in range(7):
            if u != v:
                assert times[u, v] == pytest.approx(1 + step[u] @ times[:, v])
    assert k.hitting_times(graph(COMPLETE).weight)[0, 1] == pytest.approx(4)
    two = graph([(0, 1)], 7, home=0)
    assert k.passage_times(two) == {"nwide_MFPT_lovasz": pytest.approx(1), "home_GMFPT_lovasz": pytest.approx(1)}


def test_degenerate_graphs():
    assert k.passage_times(graph([]))["nwide_MFPT_lovasz"] is None
    assert k.distance_efficiency(graph([])) == 0
    assert k.passage_times(graph(PATH, home=9))["home_GMFPT_lovasz"] is None


def random_graphs(seed, count=12, n=7):
    """Connected graphs of n nodes: a random tree and some more edges."""
    rng = np.random.default_rng(seed)
    for _ in range(count):
        pairs = {(int(rng.integers(i)), i) for i in range(1, n)}
        pairs |= {(a, b) for a, b in combinations(range(n), 2) if rng.random() < 0.25}
        yield sorted(pairs)


def shortest(n, pairs, length=lambda a, b: 1.0):
    """All distances by relaxing every edge until none changes."""
    far = {(a, b): 0.0 if a == b else np.inf for a in range(n) for b in range(n)}
    for a, b in pairs:
        far[a, b] = far[b, a] = length(a, b)
    for k in range(n):
        for a in range(n):
            for b in range(n):
                far[a, b] = min(far[a, b], far[a, k] + far[k, b])
    return far


def all_paths(near, s, t, size):
    """Every simple path of `size` edges from s to t."""
    if size == 0:
        return [[s]] if s == t else []
    return [[s, *rest] for x in near[s] for rest in all_paths(near, x, t, size - 1) if s not in rest]


def neighbours(n, pairs):
    return {x: [b if a == x else a for a, b in pairs if x in (a, b)] for x in range(n)}


def reaches(near, s, t, without=frozenset()):
    seen, queue = {s}, [s]
    while queue:
        for y in near[queue.pop()]:
            if y not in seen and y not in without:
                seen.add(y)
                queue.append(y)
    return t in seen


def test_betweenness_by_enumerated_paths():
    for pairs in random_graphs(1):
        near, far = neighbours(7, pairs), shortest(7, pairs)
        want = np.zeros(7)
        for s, t in combinations(range(7), 2):
            paths = all_paths(near, s, t, int(far[s, t]))
            for x in set(range(7)) - {s, t}:
                want[x] += sum(x in p for p in paths) / len(paths)
        assert k.betweenness(graph(pairs)) == pytest.approx(want / (6 * 5 / 2))


def test_local_efficiency_by_relaxation():
    for pairs in random_graphs(2):
        near, want = neighbours(7, pairs), []
        for x in range(7):
            own = sorted(near[x])
            inner = [(own.index(a), own.index(b)) for a, b in pairs if a in own and b in own]
            far = shortest(len(own), inner)
            want.append(sum(1 / d for (a, b), d in far.items() if a != b) / (len(own) * (len(own) - 1)) if len(own) > 1 else 0.0)
        assert k.local_efficiency(graph(pairs)) == pytest.approx(np.mean(want))


def test_eigenvector_is_the_leading_one():
    rng = np.random.default_rng(3)
    for pairs in random_graphs(3):
        g = k.Graph([{"u": a, "v": b, "w": int(rng.integers(1, 9))} for a, b in pairs])
        x = k.eigenvector(g)
        y = g.weight @ x
        assert np.linalg.norm(x) == pytest.approx(1) and (x >= 0).all()
        assert y == pytest.approx(np.linalg.eigvalsh(g.weight).max() * x, abs=1e-9)


def test_connectivity_by_cuts():
    """Menger: paths without common inner nodes are as many as the nodes that must go; a shared edge is one more."""
    for pairs in random_graphs(4, 8, 6):
        want = []
        for s, t in combinations(range(6), 2):
            direct = (s, t) in pairs
            near = neighbours(6, [p for p in pairs if p != (s, t)])
            others = set(range(6)) - {s, t}
            cut = next(size for size in range(5) for gone in combinations(others, size) if not reaches(near, s, t, frozenset(gone)))
            want.append(cut + direct)
        assert k.node_connectivity(graph(pairs)) == pytest.approx(np.mean(want))
        least = next(size for size in range(1, 6) for gone in combinations(pairs, size) if any(not reaches(neighbours(6, [p for p in pairs if p not in gone]), 0, t) for t in range(1, 6)))
        assert k.edge_connectivity(graph(pairs)) == least


def test_distance_efficiency_by_relaxation():
    """Ideal over observed lengths of shortest ways in log metres; places that no observed edge has do not count."""
    rng = np.random.default_rng(5)
    for pairs in random_graphs(5):
        seen = {p: float(rng.uniform(1, 6)) if rng.random() < 0.9 else None for p in pairs}
        ideal = {p: float(rng.uniform(1, 4)) for p in combinations(range(8), 2)}
        on = sorted({x for p, v in seen.items() if v for x in p})
        rows = [{"ei": a, "ej": b, "log_ideal": v, "log_observed": seen.get((a, b))} for (a, b), v in ideal.items()]
        place = {x: i for i, x in enumerate(on)}
        ways = [(place[a], place[b]) for (a, b), v in seen.items() if v]
        observed = shortest(len(on), ways, lambda a, b: seen[on[a], on[b]])
        full = shortest(len(on), list(combinations(range(len(on)), 2)), lambda a, b: ideal[on[a], on[b]])
        want = sum(full[x] / observed[x] for x in full if x[0] != x[1]) / (len(on) * (len(on) - 1))
        g = k.Graph([{"u": a, "v": b, "w": 1} for a, b in pairs], rows)
        assert k.distance_efficiency(g) == pytest.approx(want)


def test_largest_component(spark):
    from stopflow.operators.graph import largest_component

    rows = [("u", 1, 2), ("u", 2, 3), ("u", 4, 5), ("v", 1, 2), ("v", 3, 4), ("w", 9, 10), ("w", 10, 11), ("w", 1, 2), ("w", 3, 4)]
    edge = spark.createDataFrame([(*r, 1) for r in rows], "useruuid string, u long, v long, w long")
    got = sorted(tuple(r)[:3] for r in largest_component(edge, ["useruuid"]).select("useruuid", "u", "v").collect())
    assert got == [("u", 1, 2), ("u", 2, 3), ("v", 1, 2), ("w", 9, 10), ("w", 10, 11)]


def test_largest_component_broadcasts_no_labels(spark, monkeypatch):
    """Working tables are small on disk and large in memory: below the limit for broadcasts they filled the driver."""
    from stopflow.operators import graph

    plans, real = [], graph.materialised

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, name)

    monkeypatch.setattr(graph, "materialised", seen)
    edge = real(spark.createDataFrame([("u", i, i + 1, 1) for i in range(5)] + [("u", 8, 9, 1)], "useruuid string, u long, v long, w long"), "edges")
    found = graph.largest_component(edge, ["useruuid"])
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert sum("SortMergeJoin" in p for p in plans) > 1 and not any("Broadcast" in p for p in plans)
    assert sorted(r.u for r in found.collect()) == [0, 1, 2, 3, 4]
