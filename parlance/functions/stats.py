"""Tail probabilities for the significance tests (scalar math on the few
result rows; SciPy is not available, so the classic series / continued
fraction forms are written out).

These run inside pandas UDFs over aggregated rows (one row per feature or per
method pair) — never over data rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd


def _betacf(a: float, b: float, x: float, max_iter: int = 500, eps: float = 3e-16) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, max_iter + 1):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < eps:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    lbeta = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    front = math.exp(lbeta)
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _betacf(a, b, x) / a
    return 1.0 - front * _betacf(b, a, 1.0 - x) / b


def t_sf(t: float, df: float) -> float:
    """P(T > t) for Student's t with ``df`` degrees of freedom."""
    if t is None or df is None or not np.isfinite(df) or df <= 0 or not np.isfinite(t):
        return float("nan")
    tail = 0.5 * betainc(df / 2.0, 0.5, df / (df + t * t))
    return tail if t > 0 else 1.0 - tail


def t_pvalue(t: float, df: float, alternative: str = "two-sided") -> float:
    if alternative == "greater":
        return t_sf(t, df)
    if alternative == "less":
        return t_sf(-t, df)
    return min(1.0, 2.0 * t_sf(abs(t), df))


def chi2_1_sf(x: float) -> float:
    """P(X > x) for chi-square with one degree of freedom."""
    return math.erfc(math.sqrt(max(x, 0.0) / 2.0))


def norm_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def direction(mean_a: float, mean_b: float) -> str:
    """The reference's choice of alternative: the direction of the means."""
    if mean_a > mean_b:
        return "greater"
    if mean_a < mean_b:
        return "less"
    return "two-sided"


def wilcoxon_zsplit(d: np.ndarray, alternative: str = "two-sided"):
    """Wilcoxon signed-rank with zero differences split half/half.

    Statistic = rank sum of positive differences (+ half the zero ranks).
    Exact null distribution when there are no zeros and no ties, for every n:
    the number of subsets of the ranks with each sum, built up rank by rank.
    With zeros or ties the normal approximation with tie correction.
    """
    d = np.asarray(d, dtype=float)
    n = len(d)
    ranks = pd.Series(np.abs(d)).rank(method="average").to_numpy()
    r_plus = ranks[d > 0].sum() + ranks[d == 0].sum() / 2.0
    zeros = int((d == 0).sum())
    ties = len(np.unique(np.abs(d))) < n
    if zeros == 0 and not ties:
        share = np.zeros(n * (n + 1) // 2 + 1)  # probability of each rank sum
        share[0] = 1.0
        for rank in range(1, n + 1):
            moved = np.zeros_like(share)
            moved[rank:] = share[:-rank]
            share = (share + moved) / 2
        at = int(round(r_plus))
        greater, less = float(share[at:].sum()), float(share[:at + 1].sum())
    else:
        mn = n * (n + 1) / 4.0
        _, counts = np.unique(np.abs(d), return_counts=True)
        var = n * (n + 1) * (2 * n + 1) / 24.0 - (counts ** 3 - counts).sum() / 48.0
        z = (r_plus - mn) / math.sqrt(var) if var > 0 else 0.0
        greater, less = norm_sf(z), norm_sf(-z)
    if alternative == "greater":
        p = greater
    elif alternative == "less":
        p = less
    else:
        p = min(1.0, 2.0 * min(greater, less))
    return float(r_plus), p


def signed_rank_p(n: int, w: float, ties: float, zeros: int, alternative: str) -> float:
    """Normal approximation of the signed-rank p-value with tie correction
    (``ties``: sum of c³ − c over the groups of equal |d|)."""
    var = n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0
    z = (w - n * (n + 1) / 4.0) / math.sqrt(var) if var > 0 else 0.0
    return one_of(norm_sf(z), norm_sf(-z), alternative)


def one_of(greater: float, less: float, alternative: str) -> float:
    return greater if alternative == "greater" else less if alternative == "less" else min(1.0, 2.0 * min(greater, less))


def signed_rank_exact(doubled: list[int], counts: list[int], plus: int, alternative: str) -> float:
    """Exact p-value given the ranks: every non-zero difference takes its sign
    at random. ``doubled`` are twice the average ranks of the tie groups (whole
    numbers), ``counts`` their sizes, ``plus`` twice the observed rank sum of
    the positive differences. The number of sign choices with each sum is
    built up rank by rank, as shares of all."""
    share = np.zeros(sum(r * c for r, c in zip(doubled, counts)) + 1)
    share[0] = 1.0
    for r, c in zip(doubled, counts):
        for _ in range(c):
            moved = np.zeros_like(share)
            moved[r:] = share[:-r]
            share = (share + moved) / 2
    return one_of(min(1.0, float(share[plus:].sum())), min(1.0, float(share[:plus + 1].sum())), alternative)
