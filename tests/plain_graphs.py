"""Measures of small graphs in plain loops over a matrix of weights."""

import heapq

import numpy as np
import pandas as pd


def matrix(edges: pd.DataFrame) -> tuple[list[str], np.ndarray]:
    names = sorted({*edges["a"], *edges["b"]})
    at = {n: i for i, n in enumerate(names)}
    w = np.zeros((len(names), len(names)))
    for a, b, x in zip(edges["a"], edges["b"], edges["weight"], strict=True):
        if a != b:
            w[at[a], at[b]] = w[at[b], at[a]] = x
    return names, w


def modularity(w: np.ndarray, member: np.ndarray) -> float:
    total, d = w.sum(), w.sum(axis=1)
    same = member[:, None] == member[None, :]
    return float(((w - np.outer(d, d) / total) * same).sum() / total) if total else 0.0


def pagerank(w: np.ndarray, damping: float = 0.85) -> np.ndarray:
    n, out = len(w), w.sum(axis=1)
    step = np.divide(w, out[:, None], out=np.zeros_like(w), where=out[:, None] > 0)
    x = np.full(n, 1 / n)
    for _ in range(500):
        new = (1 - damping) / n + damping * (x @ step + x[out == 0].sum() / n)
        if np.abs(new - x).sum() < 1e-12:
            return new
        x = new
    return x


def betweenness(w: np.ndarray) -> np.ndarray:
    """Shares of shortest paths, edge weights taken as lengths; normalised for an undirected graph."""
    n, total = len(w), np.zeros(len(w))
    near = [np.flatnonzero(w[i]) for i in range(n)]
    for s in range(n):
        dist, count, before, order = {}, np.zeros(n), [[] for _ in range(n)], []
        best, heap = {s: 0.0}, [(0.0, s)]
        count[s] = 1
        while heap:
            d, v = heapq.heappop(heap)
            if v in dist:
                continue
            dist[v] = d
            order.append(v)
            for u in near[v].tolist():
                to = d + w[v, u]
                if u not in dist and to < best.get(u, np.inf) - 1e-12:
                    best[u], count[u], before[u] = to, count[v], [v]
                    heapq.heappush(heap, (to, u))
                elif u not in dist and abs(to - best[u]) <= 1e-12:
                    count[u] += count[v]
                    before[u].append(v)
        share = np.zeros(n)
        for v in reversed(order):
            for u in before[v]:
                share[u] += count[u] / count[v] * (1 + share[v])
            if v != s:
                total[v] += share[v]
    return total / ((n - 1) * (n - 2)) if n > 2 else total


def closeness(w: np.ndarray) -> np.ndarray:
    """By numbers of steps, scaled by the part of the graph that a node reaches."""
    n, out = len(w), np.zeros(len(w))
    for s in range(n):
        seen, front, d, total = {s}, [s], 0, 0
        while front:
            front = sorted({int(u) for v in front for u in np.flatnonzero(w[v])} - seen)
            d += 1
            total += d * len(front)
            seen.update(front)
        if total:
            out[s] = (len(seen) - 1) / total * (len(seen) - 1) / (n - 1)
    return out


def core_numbers(w: np.ndarray) -> np.ndarray:
    d, left, out, k = (w > 0).sum(axis=1).astype(int), set(range(len(w))), np.zeros(len(w), int), 0
    while left:
        v = min(left, key=lambda i: (d[i], i))
        k = max(k, int(d[v]))
        out[v] = k
        left.remove(v)
        for u in np.flatnonzero(w[v]).tolist():
            if u in left:
                d[u] -= 1
    return out


def holes(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Burt's constraint and the effective size of every node."""
    on, out = w > 0, w.sum(axis=1, keepdims=True)
    p = np.divide(w, out, out=np.zeros_like(w), where=out > 0)
    m = np.divide(w, w.max(axis=1, keepdims=True), out=np.zeros_like(w), where=out > 0)
    return (((p + p @ p) ** 2) * on).sum(axis=1), on.sum(axis=1) - ((p @ m.T) * on).sum(axis=1)


def clustering(w: np.ndarray, weighted: bool = False) -> np.ndarray:
    """Local clustering; weighted by the cube root of the three weights as shares of the largest."""
    on = (w > 0).astype(float)
    d = on.sum(axis=1)
    x = np.cbrt(w / w.max()) if weighted and w.any() else on
    return np.divide(np.diagonal(x @ x @ x), d * (d - 1), out=np.zeros(len(w)), where=d > 1)


def pieces(w: np.ndarray) -> int:
    left, n = set(range(len(w))), 0
    while left:
        n += 1
        front = {left.pop()}
        while front:
            front = {int(u) for v in front for u in np.flatnonzero(w[v])} & left
            left -= front
    return n
