"""Cutting stock by column generation: how often to use which pattern of lengths.

The linear program asks for the fewest rolls that hold ``demand[l]`` pieces of each length ``l``. It starts from patterns
of a single length; a knapsack over the prices of the lengths gives the pattern that improves it most, until none
improves it by more than the tolerance. Sizes do not depend on the data: one row per length class.
"""

from __future__ import annotations

import numpy as np

GAP = 2e-4  # stop within this share of the bound
MOST_ROUNDS = 5_000


def best_pattern(price: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """Counts per length (1 ..) that fit into the capacity at the largest total price, by dynamic programming."""
    m = len(price)
    best, pick = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        k = min(c, m)
        values = best[c - k : c][::-1] + price[:k]
        at = int(values.argmax())
        if values[at] > best[c - 1] + 1e-12:
            best[c], pick[c] = values[at], at + 1
        else:
            best[c] = best[c - 1]
    counts, c = np.zeros(m, np.int64), capacity
    while c > 0:
        if pick[c]:
            counts[pick[c] - 1] += 1
            c -= pick[c]
        else:
            c -= 1
    return counts, float(best[capacity])


def relaxed(demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (one per row) and how often each is used in the linear program."""
    asked = np.flatnonzero(demand > 0)
    if not len(asked):
        return np.zeros((0, len(demand)), np.int64), np.zeros(0)
    patterns = np.zeros((len(asked), len(demand)), np.int64)
    patterns[np.arange(len(asked)), asked] = capacity // (asked + 1)
    inverse = np.diag(1.0 / patterns[:, asked].diagonal())
    uses = inverse @ demand[asked]
    for step in range(MOST_ROUNDS):
        price = np.zeros(len(demand))
        price[asked] = np.maximum(inverse.sum(axis=0), 0)
        column, value = best_pattern(price, capacity)
        if value <= 1 + GAP:
            break
        move = inverse @ column[asked]
        up = move > 1e-9
        ratios = np.where(up, uses / np.where(up, move, 1), np.inf)
        out = int(ratios.argmin())
        uses = np.maximum(uses - ratios[out] * move, 0)
        uses[out] = ratios[out]
        patterns[out] = column
        if step % 200 == 199:  # against rounding errors
            inverse = np.linalg.inv(patterns[:, asked].T.astype(float))
            uses = np.maximum(inverse @ demand[asked], 0)
        else:
            row = inverse[out] / move[out]
            inverse = inverse - np.outer(move, row)
            inverse[out] = row
    return patterns, uses


def plan(demand: np.ndarray, capacity: int, least_fill: float) -> list[tuple[np.ndarray, int]]:
    """Patterns and whole numbers of uses. No pattern asks for more pieces than there are; what is left over is left.

    The program's uses are rounded down; of the rest, patterns are filled greedily, large lengths first, as long as they
    fill ``least_fill`` of a roll.
    """
    patterns, uses = relaxed(demand, capacity)
    rest, out = demand.astype(np.int64).copy(), []
    sizes = np.arange(1, len(demand) + 1)

    def take(counts: np.ndarray, times: int) -> None:
        used = counts > 0
        times = min(times, int((rest[used] // counts[used]).min())) if used.any() else 0
        if times > 0 and counts @ sizes >= least_fill * capacity:
            out.append((counts, times))
            rest[:] = rest - counts * times

    for k in np.argsort(-uses, kind="stable"):
        take(patterns[k], int(uses[k] + 1e-9))
    left = rest.copy()
    while left.any():
        counts, space = np.zeros(len(demand), np.int64), capacity
        for size in range(min(len(demand), capacity), 0, -1):
            n = min(int(left[size - 1]), space // size)
            counts[size - 1], space = n, space - n * size
        if not counts.any():
            break
        used = counts > 0
        times = int((left[used] // counts[used]).min())
        take(counts, times)
        left -= counts * times
    return out
