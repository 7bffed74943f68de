"""Cutting stock by column generation: which patterns of item sizes fill bins, from a histogram of sizes."""

from __future__ import annotations

from collections import Counter

import numpy as np


def best_pattern(price: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: the pattern of the largest total price that fits, and that price."""
    by_size = np.full(capacity + 1, -1.0)
    by_size[sizes] = price
    value, last = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    for w in range(1, capacity + 1):
        gain = by_size[1 : w + 1] + value[w - 1 :: -1][:w]
        k = int(gain.argmax())
        if gain[k] > value[w - 1] + 1e-12:
            value[w], last[w] = gain[k], k + 1
        else:
            value[w] = value[w - 1]
    where, counts, w = {int(s): i for i, s in enumerate(sizes)}, np.zeros(len(sizes)), capacity
    while w > 0:
        if last[w]:
            counts[where[int(last[w])]] += 1
            w -= int(last[w])
        else:
            w -= 1
    return float(value[capacity]), counts


def linear_program(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 2e-4, rounds: int = 4000) -> list[tuple[np.ndarray, float]]:
    """(pattern, times) of a basic solution of the relaxed problem: few bins whose patterns hold the demand.

    Revised simplex over generated columns. It ends once Farley's bound shows that the value is within gap, or half a bin, of the
    optimum, once a round of columns saves less than that, or after `rounds` columns; a solution that is cut short holds the demand all the same.
    Errors of the inverse, which is updated step by step, cost bins at most: items are counted in whole numbers afterwards.
    A demand a little larger than asked, by another amount for each size, keeps the steps from standing still.
    """
    m = len(sizes)
    demand = demand + 1e-3 * np.random.default_rng(3).random(m) * np.maximum(1.0, demand * 1e-3)
    each = capacity // sizes
    columns, cost = np.diag(each).astype(float), np.ones(m)
    inverse, times = np.diag(1.0 / each), demand / each
    bound, marked = 0.0, np.inf
    for step in range(1, rounds):
        dual, worth = cost @ inverse, float(cost @ times)
        if worth - bound <= max(gap * worth, 0.5):
            break
        if step % (m + 50) == 0:  # that many steps that save next to nothing: what is left is rounding
            if marked - worth <= max(gap * worth, 0.05):
                break
            marked = worth
        if dual.min() < -1e-9:  # more of an item than is asked for costs nothing
            entering, price = np.zeros(m), 0.0
            entering[dual.argmin()] = -1.0
        else:
            value, entering = best_pattern(dual, sizes, capacity)
            price, bound = 1.0, max(bound, worth / max(value, 1.0))
            if value <= 1 + 1e-9:
                break
        along = inverse @ entering
        up = along > 1e-9
        if not up.any():
            break
        ratio = np.where(up, times / np.where(up, along, 1), np.inf)
        out = int(ratio.argmin())
        times = np.maximum(times - ratio[out] * along, 0)
        times[out] = ratio[out]
        row = inverse[out] / along[out]
        inverse -= np.outer(along, row)
        inverse[out] = row
        columns[:, out], cost[out] = entering, price
    return [(columns[:, k], float(times[k])) for k in range(m) if cost[k] > 0 and times[k] > 1e-9]


def whole_patterns(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns {size: items} with whole numbers of bins that hold at least the histogram's items.

    Times of the relaxed solution are rounded down; what is left, at most a bin's items for each
    pattern, is packed by first fit in descending order.
    """
    sizes = np.array(sorted(s for s, n in histogram.items() if n > 0), dtype=np.int64)
    if not len(sizes):
        return []
    demand = np.array([histogram[int(s)] for s in sizes], dtype=float)
    found: Counter = Counter()
    left = demand.copy()
    for pattern, times in sorted(linear_program(sizes, demand, capacity), key=lambda x: -x[1]):
        if (n := int(times + 1e-6)) > 0:
            found[tuple((int(s), int(k)) for s, k in zip(sizes, pattern, strict=True) if k > 0)] += n
            left -= n * pattern
    bins: list[tuple[int, Counter]] = []
    for s, n in zip(sizes[::-1], left[::-1], strict=True):
        for _ in range(max(0, round(n))):
            at = next((k for k, (room, _) in enumerate(bins) if room >= s), None)
            if at is None:
                bins.append((capacity, Counter()))
                at = len(bins) - 1
            bins[at][1][int(s)] += 1
            bins[at] = (bins[at][0] - int(s), bins[at][1])
    for _, items in bins:
        found[tuple(sorted(items.items()))] += 1
    return [(dict(p), n) for p, n in found.items()]
