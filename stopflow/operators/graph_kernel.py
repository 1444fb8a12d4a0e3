"""Graph metrics that are inherently iterative: one Arrow pass, each graph decoded once."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..sources.stops import KEYS


class Graph:
    """A simple undirected weighted graph with its nodes in ascending order."""

    def __init__(self, edges: list[dict], pairs: list[dict] | None = None, home: int | None = None):
        self.ids = sorted({e["u"] for e in edges} | {e["v"] for e in edges})
        place = {x: i for i, x in enumerate(self.ids)}
        n = self.n = len(self.ids)
        self.weight = np.zeros((n, n))
        for e in edges:
            if e["u"] != e["v"]:
                i, j = place[e["u"]], place[e["v"]]
                self.weight[i, j] = self.weight[j, i] = e["w"]
        self.link = self.weight > 0
        self.m = int(self.link.sum()) // 2
        self.near = [np.flatnonzero(row).tolist() for row in self.link]
        self.home = place.get(home)
        self.pairs, self.place = pairs or [], place
        self._hops: np.ndarray | None = None

    @property
    def hops(self) -> np.ndarray:
        """Shortest path lengths in edges; infinite where there is none."""
        if self._hops is None:
            self._hops = hop_counts(self.link)
        return self._hops


def hop_counts(link: np.ndarray) -> np.ndarray:
    n = len(link)
    out = np.full((n, n), np.inf)
    np.fill_diagonal(out, 0)
    front = reached = np.eye(n, dtype=bool)
    for depth in range(1, n):
        front = (front.astype(np.int32) @ link.astype(np.int32) > 0) & ~reached
        if not front.any():
            break
        out[front] = depth
        reached = reached | front
    return out


def _efficiency(hops: np.ndarray) -> float:
    n = len(hops)
    if n < 2:
        return 0.0
    away = ~np.eye(n, dtype=bool)
    return float((1.0 / hops[away]).sum() / (n * (n - 1)))


def global_efficiency(g: Graph) -> float | None:
    return _efficiency(g.hops)


def local_efficiency(g: Graph) -> float | None:
    """The mean over nodes of the efficiency among a node's neighbours."""
    return float(np.mean([_efficiency(hop_counts(g.link[np.ix_(x, x)])) if len(x) > 1 else 0.0 for x in g.near])) if g.n else None


def eccentricities(g: Graph) -> dict:
    far = g.hops.max(axis=1) if g.n else np.array([np.inf])
    if not np.isfinite(far).all() or g.n < 2:
        return {"eccentricity_max": None, "eccentricity_mean": None, "diameter": None}
    return {"eccentricity_max": float(far.max()), "eccentricity_mean": float(far.mean()), "diameter": float(far.max())}


def closeness(g: Graph) -> np.ndarray:
    reach = np.isfinite(g.hops)
    total = np.where(reach, g.hops, 0).sum(axis=1)
    others = reach.sum(axis=1) - 1
    return np.divide(others, total, out=np.zeros(g.n), where=total > 0) * others / max(g.n - 1, 1)


def betweenness(g: Graph) -> np.ndarray:
    """Shares of shortest paths through each node, by dependency accumulation from every source."""
    score = np.zeros(g.n)
    for s in range(g.n):
        paths, depth, order = np.zeros(g.n), np.full(g.n, -1), []
        paths[s], depth[s] = 1, 0
        queue = deque([s])
        while queue:
            x = queue.popleft()
            order.append(x)
            for y in g.near[x]:
                if depth[y] < 0:
                    depth[y] = depth[x] + 1
                    queue.append(y)
                if depth[y] == depth[x] + 1:
                    paths[y] += paths[x]
        lean = np.zeros(g.n)
        for y in reversed(order):
            for x in g.near[y]:
                if depth[x] == depth[y] - 1:
                    lean[x] += paths[x] / paths[y] * (1 + lean[y])
        lean[s] = 0
        score += lean
    pairs = (g.n - 1) * (g.n - 2)
    return score / pairs if pairs > 0 else score


def eigenvector(g: Graph) -> np.ndarray:
    """The leading eigenvector of the weighted adjacency, non-negative, of length 1."""
    return np.abs(np.linalg.eigh(g.weight)[1][:, -1]) if g.n else np.zeros(0)


def _max_flow(capacity: dict[int, dict[int, int]], s: int, t: int) -> int:
    """Unit augmenting paths by breadth-first search."""
    left = {a: dict(b) for a, b in capacity.items()}
    total = 0
    while True:
        came, queue = {s: s}, deque([s])
        while queue and t not in came:
            x = queue.popleft()
            for y, room in left[x].items():
                if room > 0 and y not in came:
                    came[y] = x
                    queue.append(y)
        if t not in came:
            return total
        y = t
        while y != s:
            x = came[y]
            left[x][y] -= 1
            left[y][x] = left[y].get(x, 0) + 1
            y = x
        total += 1


def node_connectivity(g: Graph) -> float | None:
    """The mean over pairs of the number of paths that share no inner node: unit flows with every node split."""
    if g.n < 2:
        return None
    split: dict[int, dict[int, int]] = {}
    for x in range(g.n):
        split.setdefault(2 * x, {})[2 * x + 1] = 1
        split.setdefault(2 * x + 1, {}).update({2 * y: 1 for y in g.near[x]})
    for x in range(g.n):
        for y in g.near[x]:
            split[2 * y].setdefault(2 * x + 1, 0)
        split[2 * x + 1].setdefault(2 * x, 0)
    return float(np.mean([_max_flow(split, 2 * a + 1, 2 * b) for a, b in combinations(range(g.n), 2)]))


def edge_connectivity(g: Graph) -> int | None:
    if g.n < 2:
        return None
    arcs = {x: dict.fromkeys(g.near[x], 1) for x in range(g.n)}
    return min(_max_flow(arcs, 0, t) for t in range(1, g.n))


def cycle_lengths(g: Graph) -> list[int]:
    """Lengths of a cycle basis: a tree grown last-in first-out from the smallest node, a cycle for each other edge."""
    lengths, seen = [], set()
    for root in range(g.n):
        if root in seen:
            continue
        parent, depth, stack, used = {root: root}, {root: 0}, [root], set()
        while stack:
            x = stack.pop()
            for y in g.near[x]:
                if y not in parent:
                    parent[y], depth[y] = x, depth[x] + 1
                    stack.append(y)
        for x in parent:
            for y in g.near[x]:
                if x < y and parent.get(y) != x and parent.get(x) != y and (x, y) not in used:
                    used.add((x, y))
                    a, b, size = x, y, 1
                    while a != b:
                        if depth[a] < depth[b]:
                            a, b = b, a
                        a, size = parent[a], size + 1
                    lengths.append(size)
        seen |= set(parent)
    return lengths


def hitting_times(weight: np.ndarray) -> np.ndarray | None:
    """Mean first-passage times of the weighted random walk, from the spectrum of the normalised adjacency."""
    degree = weight.sum(axis=1)
    if len(weight) < 2 or (degree <= 0).any():
        return None
    root = np.sqrt(degree)
    values, vectors = np.linalg.eigh(weight / np.outer(root, root))
    if 1 - values[-2] < 1e-12:
        return None
    share = vectors[:, :-1] / np.sqrt(1 - values[:-1])
    green = share @ share.T
    scaled = green / np.outer(root, root)
    out = degree.sum() * (np.diag(scaled)[None, :] - scaled)
    np.fill_diagonal(out, 0)
    return np.maximum(out, 0)


def passage_times(g: Graph) -> dict:
    times = hitting_times(g.weight) if g.n > 1 else None
    if times is None:
        return {"nwide_MFPT_lovasz": None, "home_GMFPT_lovasz": None}
    at_home = None if g.home is None else float(times[:, g.home].sum() / (g.n - 1))
    return {"nwide_MFPT_lovasz": float(times.sum() / (g.n * (g.n - 1))), "home_GMFPT_lovasz": at_home}


def distance_efficiency(g: Graph) -> float:
    """Ideal over observed shortest log distances, averaged over ordered pairs of observed nodes."""
    on = sorted({x for p in g.pairs if (p["log_observed"] or 0) > 0 for x in (p["ei"], p["ej"])})
    if len(on) < 2:
        return 0.0
    place, n = {x: i for i, x in enumerate(on)}, len(on)
    seen, full = np.full((n, n), np.inf), np.full((n, n), np.inf)
    for p in g.pairs:
        if p["ei"] in place and p["ej"] in place:
            i, j = place[p["ei"]], place[p["ej"]]
            for matrix, name in ((seen, "log_observed"), (full, "log_ideal")):
                if (p[name] or 0) > 0:
                    matrix[i, j] = matrix[j, i] = p[name]
    for matrix in (seen, full):
        np.fill_diagonal(matrix, 0)
        for k in range(n):
            np.minimum(matrix, matrix[:, k, None] + matrix[None, k, :], out=matrix)
    away = ~np.eye(n, dtype=bool) & np.isfinite(full)
    return float((full[away] / seen[away]).sum() / (n * (n - 1)))


def _top(name: str, of: Callable[[Graph], np.ndarray]) -> Callable[[Graph], dict]:
    def best(g: Graph) -> dict:
        found = sorted(of(g).tolist(), reverse=True)[:3]
        return {f"top{i + 1}_{name}": (found[i] if i < len(found) else None) for i in range(3)}

    return best


def _cycles(g: Graph) -> dict:
    found = cycle_lengths(g)
    return {"avg_len_cycles_all": float(np.mean(found)) if found else 0.0}


def _one(name: str, of: Callable) -> Callable[[Graph], dict]:
    return lambda g: {name: of(g)}


def _three(name: str) -> list[str]:
    return [f"top{i}_{name}" for i in (1, 2, 3)]


#: Registry: name -> (function of a graph, its output fields).
REGISTRY: dict[str, tuple[Callable[[Graph], dict], list[str]]] = {
    "avg_node_connectivity": (_one("avg_node_connectivity", node_connectivity), ["avg_node_connectivity"]),
    "edge_connectivity": (_one("edge_connectivity", edge_connectivity), ["edge_connectivity"]),
    "cycle_lengths": (_cycles, ["avg_len_cycles_all"]),
    "betweenness_centrality_top": (_top("betweenness", betweenness), _three("betweenness")),
    "closeness_centrality_top": (_top("closeness", closeness), _three("closeness")),
    "eigenvector_centrality_top": (_top("eigenvector", eigenvector), _three("eigenvector")),
    "eccentricity_stats": (eccentricities, ["eccentricity_max", "eccentricity_mean", "diameter"]),
    "local_efficiency": (_one("local_efficiency", local_efficiency), ["local_efficiency"]),
    "global_efficiency_edges": (_one("global_efficiency_edges", global_efficiency), ["global_efficiency_edges"]),
    "global_efficiency_distance": (_one("global_efficiency_distance", distance_efficiency), ["global_efficiency_distance"]),
    "mfpt": (passage_times, ["nwide_MFPT_lovasz", "home_GMFPT_lovasz"]),
}


def kernel(graphs: DataFrame, names: list[str] | None = None, keys: list[str] = KEYS) -> DataFrame:
    """keys and the fields of the metrics named (KeyError if unknown), from graph.compressed() rows.

    An optional column home_loc names the home node.
    """
    names = list(REGISTRY) if names is None else names
    chosen = [REGISTRY[n] for n in names]
    fields = [f for _, out in chosen for f in out]
    kinds = dict(graphs.dtypes)
    columns = [*keys, "edges", *(c for c in ("pairs", "home_loc") if c in kinds)]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.select([c for c in columns if c not in keys]).to_pylist():
                g = Graph(row["edges"], row.get("pairs"), row.get("home_loc"))
                found = {k: v for of, _ in chosen for k, v in of(g).items()}
                rows.append([None if found[f] is None else round(float(found[f]), 6) for f in fields])
            values = [pa.array([r[i] for r in rows], pa.float64()) for i in range(len(fields))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *values], [*keys, *fields])

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), *(f"`{f}` double" for f in fields)])
    return graphs.select(*columns).mapInArrow(each, schema)
