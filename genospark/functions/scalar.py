"""Special functions as columns: JVM expressions where they suffice, numpy on Arrow batches otherwise."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NU_MOST, X_LEAST = 100.0, 1e-20
#: Rows that an integral is evaluated for at once: its nodes are held for each.
ROWS = 256


def gauss(x: Column, derivative: int = 0) -> Column:
    """exp(-x^2) of |x|, or one of its first four derivatives."""
    x = F.abs(x)
    forms = {0: F.lit(1.0), 1: -2 * x, 2: 4 * x * x - 2, 3: x * (12 - 8 * x * x), 4: 12 + x * x * (16 * x * x - 48)}
    if derivative not in forms:
        raise ValueError("derivatives 0 to 4")
    return forms[derivative] * F.exp(-x * x)


def log_gauss(x: Column) -> Column:
    return -x * x


def binormal_density(x: Column, y: Column, sx: float = 1.0, sy: float = 1.0, sxy: float = 0.0) -> Column:
    """Density at (x, y) for variances sx, sy. A covariance is refused."""
    if sxy:
        raise ValueError("the covariance matrix must be diagonal")
    return F.exp(-0.5 * (x * x / sx + y * y / sy)) / (2 * math.pi * math.sqrt(sx * sy))


def half_away(x: Column) -> Column:
    """Rounds half away from zero."""
    return F.when(x < 0, -F.floor(F.lit(0.5) - x)).otherwise(F.floor(x + 0.5)).cast("double")


def positive_mod(x: Column, m: Column) -> Column:
    """x less a whole multiple of m, at least 0."""
    return x - F.floor(x / m) * m


def lgamma(x: np.ndarray) -> np.ndarray:
    return np.array([math.lgamma(v) if not (v <= 0 and v == int(v)) else math.inf for v in np.ravel(x)]).reshape(np.shape(x))


def _struve_far(x: np.ndarray, nu: np.ndarray) -> np.ndarray:
    """H for x > 20: Y plus its difference to H, both as integrals over smooth integrands. With c = (x / 2)^nu 2 / (sqrt(pi)
    Gamma(nu + 1/2)), H - Y is c times the integral of exp(-x t) (1 + t^2)^(nu - 1/2) over t > 0 (nu > -1/2 not needed there),
    and Y is the imaginary part of the Hankel function's integral of exp(-u) u^(nu - 1/2) (1 + i u / 2x)^(nu - 1/2)."""
    if x.size > ROWS:
        return np.concatenate([_struve_far(x[k : k + ROWS], nu[k : k + ROWS]) for k in range(0, x.size, ROWS)])
    if not x.size:
        return x.copy()
    # u = exp(a): the integrand falls off at both ends for nu > -1/2, as u^3m exp(-u) at most; its transform falls off as that of a peak
    # of width 1 / sqrt(3m), so that a step of 0.15 does for small orders
    most = 3 * (max(0.0, float(nu.max())) + 2)
    end, step = max(5.0, math.log(most + 10 * math.sqrt(most) + 60)), min(0.15, 2 * math.pi / (math.sqrt(84 * most) + 10))
    a = np.linspace(-40.0, end, math.ceil((40 + end) / step) + 1)
    u, step = np.exp(a), a[1] - a[0]
    lift = np.maximum(0, np.ceil(0.5 - nu))  # orders below 1/2 from two above, by the recurrence
    gamma = lambda v: np.array([math.lgamma(k) for k in v.tolist()])
    t = u / x[:, None]
    wide, turn = np.log1p(t * t), np.log1p(0.5j * t)
    values = []
    for m in (nu + lift, nu + lift + 1):
        g, c = gamma(m + 0.5), m[:, None]
        over = (np.exp(-u + (m * np.log(x / 2) - g)[:, None] + (c - 0.5) * wide) * t).sum(axis=1) * step * 2 / math.sqrt(math.pi)
        hankel = np.exp(-u + (c + 0.5) * a - g[:, None] + (c - 0.5) * turn).sum(axis=1) * step
        values.append(over + (np.sqrt(2 / (math.pi * x)) * np.exp(1j * (x - m * math.pi / 2 - math.pi / 4)) * hankel).imag)
    low, high = values
    for d in range(int(lift.max(initial=0))):  # H(m - 1) = 2m/x H(m) - H(m + 1) + (x/2)^m / (sqrt(pi) Gamma(m + 3/2))
        m, more = nu + lift - d, d < lift
        last = np.array([0.0 if k + 1.5 <= 0 and (k + 1.5) % 1 == 0 else (y / 2) ** k / (math.sqrt(math.pi) * math.gamma(k + 1.5)) for y, k in zip(x[more].tolist(), m[more].tolist(), strict=True)])
        low[more], high[more] = 2 * m[more] / x[more] * low[more] - high[more] + last, low[more]
    return low


def struve_np(x: np.ndarray, nu: np.ndarray, sign: float, scaled: bool = False) -> np.ndarray:
    """H (sign -1) or L (sign 1) by its power series, H beyond x = 20 by integrals, as the terms of alternating sign cancel
    there; 0 at 0 for nu > -1, else NaN for x <= 0."""
    x, nu = np.broadcast_arrays(np.asarray(x, float), np.asarray(nu, float))
    out = np.full(x.shape, np.nan)
    out[(x == 0) & (nu > -1)] = 0
    far = (x > 20) & (sign < 0)
    ok = (x > 0) & ~far
    h, v = x[ok] / 2, nu[ok]
    first = np.array([1 / (math.gamma(1.5) * math.gamma(n + 1.5)) if n + 1.5 > 0 or (n + 1.5) % 1 else 0.0 for n in v]) if len(v) else v
    term, total = np.ones_like(h), np.ones_like(h)
    with np.errstate(over="ignore", invalid="ignore"):
        for k in range(20_000):
            term = term * sign * h * h / ((k + 1.5) * (k + v + 1.5))
            total += term
            if not (np.abs(term) > 1e-17 * np.abs(total)).any():
                break
        out[ok] = total * first * h ** (v + 1) * (np.exp(-x[ok]) if scaled else 1)
    if far.any():
        out[far] = _struve_far(x[far], nu[far]) * (np.exp(-x[far]) if scaled else 1)
    return out


def i0_minus_l0_np(x: np.ndarray) -> np.ndarray:
    """I0 - L0: 2/pi times the integral of exp(-x sin t) over a quarter turn; by powers of 1/x for large x. NaN below 0."""
    x = np.asarray(x, float)
    if x.size > 8 * ROWS:
        return np.concatenate([i0_minus_l0_np(x.ravel()[k : k + 8 * ROWS]) for k in range(0, x.size, 8 * ROWS)]).reshape(x.shape)
    nodes, w = np.polynomial.legendre.leggauss(120)
    t = (nodes + 1) * math.pi / 4
    near = (w * np.exp(-np.outer(np.clip(x, 0, 40), np.sin(t)))).sum(axis=1) / 2
    far, term, big = np.ones_like(x), np.ones_like(x), np.maximum(x, 40)
    for k in range(1, 9):
        term = term * (2 * k - 1) ** 2 / big**2
        far += term
    return np.where(x < 0, np.nan, np.where(x <= 40, near, far * 2 / (math.pi * big)))


def log_bessel_k_np(y: np.ndarray, nu: np.ndarray) -> np.ndarray:
    """log K_nu(y), y > 0: the trapezoidal rule on the integral of exp(-y cosh t) cosh(nu t)."""
    y, nu = np.broadcast_arrays(np.asarray(y, float), np.abs(np.asarray(nu, float)))
    if y.size > ROWS:  # 1,200 nodes a row
        parts = [log_bessel_k_np(y.ravel()[a : a + ROWS], nu.ravel()[a : a + ROWS]) for a in range(0, y.size, ROWS)]
        return np.concatenate(parts).reshape(y.shape)
    top = np.arccosh(1 + 800 / y) + 1
    peak = np.arcsinh(nu / y)
    top = np.maximum(top, np.arccosh(1 + 800 / y + nu / y * (peak + 2)))
    t = top[..., None] * np.linspace(0, 1, 1200)
    with np.errstate(over="ignore"):
        e = -y[..., None] * (np.cosh(t) - 1) + nu[..., None] * t + np.log1p(np.exp(-2 * nu[..., None] * t)) - math.log(2)
    m = e.max(axis=-1)
    f = np.exp(e - m[..., None])
    s = f.sum(axis=-1) - 0.5 * (f[..., 0] + f[..., -1])
    return np.log(s * top / 1199) + m - y


def _terms(order: int) -> dict[tuple[int, int], float]:
    """The derivative of y^nu K_nu as a sum of c(nu) y^(nu - a) K_(nu - b), without nu's own factor a - b = 0."""
    terms = {(0, 0): 1.0}
    for _ in range(order):
        new: dict[tuple[int, int], float] = {}
        for (a, b), c in terms.items():  # (y^p K_q)' = (p - q) y^(p-1) K_q - y^p K_(q-1), with p - q = b - a
            if b != a:
                new[a + 1, b] = new.get((a + 1, b), 0.0) + c * (b - a)
            new[a, b + 1] = new.get((a, b + 1), 0.0) - c
        terms = new
    return terms


def _half_integer(p: int, order: int = 0) -> list[Fraction]:
    """Coefficients, from y^0 on, of the polynomial that times exp(-y) is the Matern function of p + 1/2 or its derivative."""
    f = math.factorial
    c = [Fraction(0)] * (p + 1)
    for k in range(p + 1):
        c[p - k] = Fraction(f(p) * f(p + k) * 2 ** (p - k), f(2 * p) * f(k) * f(p - k))
    for _ in range(order):  # (q e^-y)' = (q' - q) e^-y
        c = [(c[k + 1] * (k + 1) if k < p else 0) - c[k] for k in range(p + 1)]
    return c


def matern_limit(nu: float, order: int) -> float:
    """The derivative's limit at 0 from the right, for the argument y, by the series 1 + y^2 / (4 (1 - nu)) + y^4 / (32 (1 - nu)
    (2 - nu)) + ... + c y^2nu (1 + ...), where c has the sign of Gamma(-nu), or y^2nu log y for a whole nu."""
    if order == 0:
        return 1.0
    if 2 * nu > order:
        return 0.0 if order % 2 else 0.5 / (1 - nu) if order == 2 else 0.75 / ((1 - nu) * (2 - nu))
    if nu == int(nu):
        n, past = int(nu), order - 2 * int(nu)
        return math.inf * (-1) ** (n + 1) * (-1 if past == 0 else (-1) ** (past - 1))
    if 2 * nu == int(2 * nu):
        return float(_half_integer(int(nu), order)[0])
    sign = (-1) ** math.ceil(nu)
    for k in range(order):
        sign *= 1 if 2 * nu > k else -1
    return math.inf * sign


def matern_np(x: np.ndarray, nu: np.ndarray, factor: float = 0.0, order: int = 0) -> np.ndarray:
    """2^(1 - nu) / Gamma(nu) y^nu K_nu(y) with y = x factor sqrt(nu) (factor 0: y = x), or one of four derivatives
    in x, at 0 its limit from the right. nu beyond 100 counts as 100, blended with the Gaussian limit."""
    x, nu = (np.array(v, float) for v in np.broadcast_arrays(np.asarray(x, float), np.asarray(nu, float)))
    n = np.minimum(nu, NU_MOST)
    scale = factor * np.sqrt(n) if factor else np.ones_like(n)
    out = np.empty_like(x)
    small, inf = x <= X_LEAST, np.isinf(x)
    if small.any():
        out[small] = np.array([matern_limit(v, order) for v in n[small].tolist()]) * scale[small] ** order
    out[inf] = 0
    use = ~(small | inf)
    y, v = x[use] * scale[use], n[use]
    logc = math.log(2) * (1 - v) - lgamma(v)
    if order == 0:
        out[use] = np.exp(logc + v * np.log(y) + log_bessel_k_np(y, v))
    else:
        out[use] = sum(c * np.exp(logc + (v - a) * np.log(y) + log_bessel_k_np(y, v - b)) for (a, b), c in _terms(order).items()) * scale[use] ** order
    wide = nu > NU_MOST
    if wide.any():
        g, half = NU_MOST / nu[wide], factor / 2
        z = np.where(np.isinf(x[wide]), 0, x[wide]) * half
        e = np.exp(-z * z)
        gauss_part = {0: e, 1: -2 * z * e, 2: (4 * z * z - 2) * e, 3: z * (12 - 8 * z * z) * e, 4: (12 + z * z * (16 * z * z - 48)) * e}[order] * half**order
        gauss_part = np.where(np.isinf(x[wide]), 0, gauss_part)
        if order == 0:
            with np.errstate(divide="ignore"):
                out[wide] = np.exp(np.log(out[wide]) * g + (1 - g) * np.log(gauss_part))
        else:
            out[wide] = out[wide] * g + (1 - g) * gauss_part
    return out


def _upper_gamma(x: np.ndarray, s: np.ndarray) -> np.ndarray:
    """The regularised upper incomplete gamma function, s > 0: a series below s + 1, a continued fraction above."""
    out = np.ones_like(x)
    out[np.isinf(x)] = 0
    use = np.flatnonzero((x > 0) & ~np.isinf(x))
    front = np.exp(s[use] * np.log(x[use]) - x[use] - lgamma(s[use]))
    low = x[use] < s[use] + 1
    y, k = x[use][low], s[use][low].copy()
    term = 1 / k
    total = term.copy()
    while (np.abs(term) > 1e-17 * np.abs(total)).any():
        k += 1
        term = term * y / k
        total += term
    out[use[low]] = 1 - front[low] * total
    y, v = x[use][~low], s[use][~low]
    b = y + 1 - v
    c, d = np.full_like(y, 1e300), 1 / b
    h = d.copy()
    for k in range(1, 10_000):
        a = -k * (k - v)
        b = b + 2
        d, c = a * d + b, b + a / c
        d, c = 1 / np.where(d == 0, 1e-300, d), np.where(c == 0, 1e-300, c)
        h *= c * d
        if not (np.abs(c * d - 1) > 1e-16).any():
            break
    out[use[~low]] = front[~low] * h
    return out


def incomplete_gamma_np(start: np.ndarray, end: np.ndarray, s: np.ndarray) -> np.ndarray:
    """The integral of t^(s-1) exp(-t) from start to end; NaN for s <= 1 from 0."""
    start, end, s = (np.array(v, float) for v in np.broadcast_arrays(*(np.asarray(v, float) for v in (start, end, s))))
    out = np.full(start.shape, np.nan)
    ok = ~((s <= 1) & (start == 0)) & ~np.isnan(start + end + s)
    up = ok & (s > 0)
    out[up] = np.exp(lgamma(s[up])) * (_upper_gamma(start[up], s[up]) - _upper_gamma(end[up], s[up]))
    zero = ok & (s == 0)
    if zero.any():  # Gauss-Legendre on a logarithmic scale; beyond 60 nothing is left
        nodes, w = np.polynomial.legendre.leggauss(200)
        lo, hi = np.log(start[zero]), np.log(np.minimum(end[zero], start[zero] + 60))
        t = np.exp(lo[:, None] + (nodes + 1) / 2 * (hi - lo)[:, None])
        out[zero] = (w * np.exp(-t)).sum(axis=1) * (hi - lo) / 2
    down = ok & (s < 0)
    if down.any():
        a, b, v = start[down], end[down], s[down]
        with np.errstate(invalid="ignore", over="ignore"):
            edge = lambda t: np.where(np.isinf(t), 0, t**v * np.exp(-t))
            out[down] = (edge(b) - edge(a) + incomplete_gamma_np(a, b, v + 1)) / v
    return out


def incomplete_gamma_py(start: float, end: float, s: float) -> float:
    return float(incomplete_gamma_np(np.array([start]), np.array([end]), np.array([s]))[0])


def struve(x: Column, nu: Column, kind: str = "H", scaled: bool = False) -> Column:
    """Struve's H or L as a column."""
    sign = -1.0 if kind == "H" else 1.0

    @F.pandas_udf("double")
    def f(x: pd.Series, nu: pd.Series) -> pd.Series:
        return pd.Series(struve_np(x.to_numpy(float), nu.to_numpy(float), sign, scaled))

    return f(x.cast("double"), nu.cast("double"))


def i0_minus_l0(x: Column) -> Column:
    @F.pandas_udf("double")
    def f(x: pd.Series) -> pd.Series:
        return pd.Series(i0_minus_l0_np(x.to_numpy(float)))

    return f(x.cast("double"))


def bessel_k(x: Column, nu: Column) -> Column:
    @F.pandas_udf("double")
    def f(x: pd.Series, nu: pd.Series) -> pd.Series:
        return pd.Series(np.exp(log_bessel_k_np(x.to_numpy(float), nu.to_numpy(float))))

    return f(x.cast("double"), nu.cast("double"))


def matern(x: Column, nu: float | Column, factor: float = 0.0, order: int = 0, log: bool = False) -> Column:
    """The Matern function or a derivative, see matern_np(). For a number p + 1/2 of up to 10 as nu it is a polynomial times
    exp(-y), which stays in the JVM."""
    if order not in range(5):
        raise ValueError("derivatives 0 to 4")
    if not isinstance(nu, Column) and nu <= 10.5 and nu % 1 == 0.5:
        scale = factor * math.sqrt(nu) if factor else 1.0
        y, total = x.cast("double") * F.lit(scale), F.lit(0.0)
        for c in reversed(_half_integer(int(nu), order)):
            total = total * y + F.lit(float(c))
        v = F.when(y == F.lit(math.inf), F.lit(0.0)).otherwise(total * F.exp(-y) * F.lit(scale**order))
        return F.when(v == 0, F.lit(-math.inf)).otherwise(F.log(v)) if log else v

    @F.pandas_udf("double")
    def f(x: pd.Series, nu: pd.Series) -> pd.Series:
        v = matern_np(x.to_numpy(float), nu.to_numpy(float), factor, order)
        with np.errstate(divide="ignore"):
            return pd.Series(np.log(v) if log else v)

    return f(x.cast("double"), (nu if isinstance(nu, Column) else F.lit(nu)).cast("double"))


def incomplete_gamma(start: Column, end: Column, s: float | Column) -> Column:
    """See incomplete_gamma_np(). For a whole number of 1 to 20 as s it is a polynomial times exp(-t), which stays in the JVM."""
    if not isinstance(s, Column) and s == int(s) and 1 <= s <= 20:
        n = int(s)

        def upper(t: Column) -> Column:
            total = F.lit(0.0)
            for k in range(n - 1, -1, -1):
                total = total * t + F.lit(float(math.factorial(n - 1) // math.factorial(k)))
            return F.when(t == F.lit(math.inf), F.lit(0.0)).otherwise(total * F.exp(-t))

        a, b = start.cast("double"), end.cast("double")
        return F.when((a == 0) & F.lit(n == 1), F.lit(math.nan)).otherwise(upper(a) - upper(b))

    @F.pandas_udf("double")
    def f(a: pd.Series, b: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series(incomplete_gamma_np(a.to_numpy(float), b.to_numpy(float), s.to_numpy(float)))

    return f(start.cast("double"), end.cast("double"), (s if isinstance(s, Column) else F.lit(s)).cast("double"))
