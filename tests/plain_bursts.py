"""Bursts by trying every path of states."""

from itertools import groupby, product
from math import log


def all_paths(counts, totals, years, ratio=2.0, gamma=1.0):
    """(start, end, strength, peak) along the cheapest of all paths; of equal ones the one that is in the base state latest."""
    if sum(counts) < 2 or sum(totals) <= 0:
        return []
    quiet = min(max(sum(counts) / sum(totals), 1e-6), 0.999999)
    costs = [[-(k * log(p) + (m - k) * log(max(1 - p, 1e-9))) for k, m in zip(counts, totals, strict=True)] for p in (quiet, min(quiet * ratio, 0.999999))]
    into = gamma * log(max(len(years), 2))

    def price(path):
        return sum(costs[s][i] + into * (s > before) for i, (before, s) in enumerate(zip((0, *path), path, strict=False)))

    path = min(product((0, 1), repeat=len(years)), key=lambda p: (round(price(p), 9), p[::-1]))
    out = []
    for state, run in groupby(range(len(years)), key=lambda i: path[i]):
        if state:
            at = list(run)
            out.append((years[at[0]], years[at[-1]], round(sum(max(0.0, costs[0][i] - costs[1][i]) for i in at), 6), years[max(at, key=lambda i: (counts[i], -i))]))
    return out
