"""Tail probabilities without a statistics package.

The numpy/``math`` helpers work on a handful of numbers (one per test or per
coefficient); ``normal_quantile_sql`` is an expression that Spark evaluates per row.
"""

from __future__ import annotations

import math


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (Lentz)."""
    if not 0.0 < x < 1.0:
        return 0.0 if x <= 0.0 else 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - betainc(b, a, 1.0 - x)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    f = d
    for m in range(1, 20000):
        even = m * (b - m) * x / ((a + 2 * m - 1.0) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1.0))
        delta = 1.0
        for term in (even, odd):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + term / c
            c = c if abs(c) > tiny else tiny
            delta = c * d
            f *= delta
        if abs(delta - 1.0) < 1e-15:
            break
    return front * f / a


def f_tail(f: float, d1: float, d2: float) -> float:
    """P(F > f)."""
    if f is None or math.isnan(f):
        return float("nan")
    if f == math.inf:
        return 0.0
    return 1.0 if f <= 0 else betainc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def t_two_sided(t: float, df: float) -> float:
    """P(|T| > |t|)."""
    if t is None or math.isnan(t) or df <= 0:
        return float("nan")
    if math.isinf(t):
        return 0.0
    return betainc(df / 2.0, 0.5, df / (df + t * t))


def z_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def bisect(fn, lo: float, hi: float, target: float) -> float:
    """Argument at which an increasing function reaches the target."""
    for _ in range(200):
        mid = (lo + hi) / 2.0
        lo, hi = (mid, hi) if fn(mid) < target else (lo, mid)
    return (lo + hi) / 2.0


def beta_quantile(p: float, a: float, b: float) -> float:
    return bisect(lambda x: betainc(a, b, x), 0.0, 1.0, p)


def t_quantile(p: float, df: float) -> float:
    """Two-sided convention: P(T <= q) = p for p >= 0.5."""
    return bisect(lambda t: 1.0 - t_two_sided(t, df) / 2.0, 0.0, 1e4, p)


def binomial_interval(x: int, n: int, level: float = 0.95) -> tuple[float, float]:
    """Clopper-Pearson interval."""
    tail = (1.0 - level) / 2.0
    low = 0.0 if x == 0 else beta_quantile(tail, x, n - x + 1)
    high = 1.0 if x == n else beta_quantile(1.0 - tail, x + 1, n - x)
    return low, high


def binomial_two_sided(x: int, n: int, p: float) -> float:
    """Exact two-sided p-value: total probability of outcomes no likelier than x.

    The probability mass rises to the mode and falls after it, so each tail is one
    range, found by bisection and summed by the incomplete beta function.
    """
    def log_pmf(k: int) -> float:
        return (math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
                + k * math.log(p) + (n - k) * math.log1p(-p))

    limit = log_pmf(x) + math.log1p(1e-7)
    mode = min(n, int((n + 1) * p))
    if log_pmf(mode) <= limit:
        return 1.0
    lo, hi = -1, mode                      # lower tail is 0..lo
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if log_pmf(mid) <= limit else (lo, mid)
    left = lo
    lo, hi = mode, n + 1                   # upper tail is hi..n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if log_pmf(mid) <= limit else (mid, hi)
    below = 0.0 if left < 0 else betainc(n - left, left + 1, 1.0 - p)
    above = 0.0 if hi > n else betainc(hi, n - hi + 1, p)
    return min(1.0, below + above)


def normal_quantile_sql(p: str) -> str:
    """Inverse normal distribution of an SQL expression (Acklam's rational approximation).

    Plain CASE arithmetic, so the text means the same in any SQL engine.
    """
    # The published coefficients of the approximation.
    a = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
         1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
    b = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
         6.680131188771972e01, -1.328068155288572e01)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
         -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
    d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)

    def horner(coef, x):
        out = f"({coef[0]!r}E0)" if "e" not in repr(coef[0]) else f"({coef[0]!r})"
        for k in coef[1:]:
            lit = repr(k) if "e" in repr(k) else f"{k!r}E0"
            out = f"({out}*{x}+({lit}))"
        return out

    centre, square = f"({p}-0.5E0)", f"(({p}-0.5E0)*({p}-0.5E0))"
    tail_lo, tail_hi = f"sqrt(-2E0*ln({p}))", f"sqrt(-2E0*ln(1E0-{p}))"
    return (
        f"(CASE WHEN {p} < 0.02425E0 THEN {horner(c, tail_lo)}/({horner(d, tail_lo)}*{tail_lo}+1E0) "
        f"WHEN {p} > 0.97575E0 THEN -{horner(c, tail_hi)}/({horner(d, tail_hi)}*{tail_hi}+1E0) "
        f"ELSE {horner(a, square)}*{centre}/({horner(b, square)}*{square}+1E0) END)"
    )
