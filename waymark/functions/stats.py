"""Small numeric helpers for what Spark has no function for."""

from __future__ import annotations

import math

import numpy as np

#: Up to so many non-zero differences the exact distribution is counted; fixed value of the test's usual definition.
EXACT_PAIRS = 50


def wilcoxon_p(statistic: float, ranks: list[float] | None, n: int, ties: float) -> float:
    """Two-sided p of a signed-rank statistic min(W+, W-).

    Up to EXACT_PAIRS pairs the ranks are given and all their sign flips are counted, by the sums that they
    can reach (ties make half ranks, so sums are counted in halves); for more the normal approximation
    with tie correction (ties: sum of t**3 - t over tied ranks) is used.
    """
    if n == 0:
        return 1.0
    if ranks is not None and n <= EXACT_PAIRS:
        halves = [round(2 * r) for r in ranks]
        ways = np.zeros(sum(halves) + 1)
        ways[0] = 1
        for h in halves:
            ways[h:] = ways[h:] + ways[: len(ways) - h]
        sums = np.arange(len(ways))
        low = np.minimum(sums, sum(halves) - sums) <= 2 * statistic + 1e-9
        return float(min(1.0, ways[low].sum() / 2.0 ** len(halves)))
    mean, var = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    return float(min(1.0, math.erfc(abs(statistic - mean) / math.sqrt(2 * var)))) if var > 0 else 1.0


def principal_axes(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, largest first, and axes as columns; each axis's largest loading is positive."""
    values, axes = np.linalg.eigh(gram)
    order = np.argsort(values)[::-1]
    values, axes = np.maximum(values[order], 0), axes[:, order]
    signs = np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    return values, axes * np.where(signs == 0, 1, signs)


def strong_components(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """A number for each of n nodes, the same for those of one strongly connected component; by two searches, without recursion."""
    ahead, behind = _adjacent(n, src, dst), _adjacent(n, dst, src)
    seen, left = [False] * n, []
    for start in range(n):
        stack = [] if seen[start] else [(start, 0)]
        seen[start] = True
        while stack:
            node, i = stack.pop()
            if i == len(ahead[node]):
                left.append(node)
                continue
            stack.append((node, i + 1))
            if not seen[to := ahead[node][i]]:
                seen[to] = True
                stack.append((to, 0))
    part = np.full(n, -1)
    for start in reversed(left):
        stack = [start] if part[start] < 0 else []
        while stack:
            node = stack.pop()
            if part[node] < 0:
                part[node] = start
                stack += behind[node]
    return part


def _adjacent(n: int, a: np.ndarray, b: np.ndarray) -> list[list[int]]:
    order = np.argsort(a, kind="stable")
    return [x.tolist() for x in np.split(b[order], np.searchsorted(a[order], np.arange(1, n)))] if n else []
