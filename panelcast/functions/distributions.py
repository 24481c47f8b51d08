"""Closed forms and published constants used by the time-series tests.

Pure ``math``/``numpy``; evaluated inside pandas UDFs on small per-series
results only.
"""

from __future__ import annotations

import math

import numpy as np


def norm_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2.0))


def chi2_sf(x: float, k: int) -> float:
    """Upper tail of the chi-square distribution with integer ``k`` degrees of freedom."""
    if x <= 0:
        return 1.0
    h = x / 2.0
    if k % 2 == 0:
        term, total = 1.0, 1.0
        for i in range(1, k // 2):
            term *= h / i
            total += term
        return min(1.0, math.exp(-h) * total)
    total = math.erfc(math.sqrt(h))
    if k > 1:
        term = math.sqrt(2.0 * x / math.pi) * math.exp(-h)
        acc = term
        for i in range(1, (k - 1) // 2):
            term *= x / (2 * i + 1)
            acc += term
        total += acc
    return min(1.0, total)


# MacKinnon (2010) response-surface coefficients of the ADF test
# with a constant, one series; critical value = b0 + b1/n + b2/n^2 + b3/n^3.
ADF_CRIT_C = {
    "1%": (-3.43035, -6.5393, -16.786, -79.433),
    "5%": (-2.86154, -2.8903, -4.234, -40.040),
    "10%": (-2.56677, -1.5384, -2.809, 0.0),
}

# MacKinnon (1994) p-value polynomials of the ADF test with a
# constant, one series: small-t and large-t branches, split at -1.61, and the
# bounds beyond which the p-value is 0 or 1.
ADF_P_SMALL_C = (2.1659, 1.4412, 0.038269)
ADF_P_LARGE_C = (1.7339, 0.93202, -0.12745, -0.010368)
ADF_P_SPLIT = -1.61
ADF_P_MIN_T = -18.83
ADF_P_MAX_T = 2.74

# Johansen trace-test critical values without deterministic
# terms, by the number of common trends left (1..5), at 90 / 95 / 99 %.
JOHANSEN_TRACE_CRIT = {
    1: (2.9762, 4.1296, 6.9406),
    2: (10.4741, 12.3212, 16.3640),
    3: (21.7781, 24.2761, 29.5147),
    4: (37.0339, 40.1749, 46.5716),
    5: (56.2839, 60.0627, 67.6367),
}


def adf_pvalue(t: float) -> float:
    if t > ADF_P_MAX_T:
        return 1.0
    if t < ADF_P_MIN_T:
        return 0.0
    coef = ADF_P_SMALL_C if t <= ADF_P_SPLIT else ADF_P_LARGE_C
    return norm_cdf(sum(c * t**i for i, c in enumerate(coef)))


def adf_critical(nobs: int) -> dict[str, float]:
    return {k: sum(b / nobs**i for i, b in enumerate(v)) for k, v in ADF_CRIT_C.items()}


def johansen_crit(trends: int, table: dict | None = None) -> tuple[float, float, float]:
    t = table or JOHANSEN_TRACE_CRIT
    if trends not in t:
        raise ValueError(f"no trace critical values for {trends} common trends; pass a table")
    return t[trends]


def durbin_levinson(acf: np.ndarray) -> np.ndarray:
    """Partial autocorrelations 0..L from autocorrelations 0..L (pacf[0] = 1)."""
    L = len(acf) - 1
    pacf = np.zeros(L + 1)
    pacf[0] = 1.0
    if L == 0:
        return pacf
    phi = np.zeros(L + 1)
    prev = np.zeros(L + 1)
    v = 1.0
    for k in range(1, L + 1):
        num = acf[k] - sum(prev[j] * acf[k - j] for j in range(1, k))
        a = num / v if v != 0 else np.nan
        phi[k] = a
        for j in range(1, k):
            phi[j] = prev[j] - a * prev[k - j]
        v = v * (1 - a * a)
        pacf[k] = a
        prev = phi.copy()
    return pacf
