"""Upper-tail probabilities of the F, Student t and chi-square distributions.

Driver-side functions for the p-values of the association tests and of backward selection (one
statistic per variable).  The regularized incomplete beta and gamma functions come from their
series and continued fractions.  These converge in a number of steps that grows with the square
root of the parameters; a sum that has not converged by then raises, it is never returned.  The
leading factors are written as deviances plus Stirling remainders, so that no large logarithms
cancel and the results stay good to 1e-8 for up to 1e10 degrees of freedom.
"""

from __future__ import annotations

import math

_EPS = 1e-16
_TINY = 1e-300


def _steps(size: float) -> int:
    return 10_000 + int(60 * math.sqrt(size))


def _excess(d: float) -> float:
    """log(1 + d) - d without cancellation near 0."""
    if abs(d) > 0.01:
        return math.log1p(d) - d
    total, power, n = 0.0, d * d, 2
    while True:
        term = power / n if n % 2 else -power / n
        total += term
        if abs(term) <= abs(total) * 1e-18:
            return total
        power, n = power * d, n + 1


def _remainder(z: float) -> float:
    """lgamma(z) minus Stirling's (z - 1/2) log z - z + log(2 pi) / 2."""
    if z < 15:
        return math.lgamma(z) - ((z - 0.5) * math.log(z) - z + 0.5 * math.log(2 * math.pi))
    w = 1.0 / (z * z)
    return (1 / 12 - w * (1 / 360 - w * (1 / 1260 - w * (1 / 1680 - w / 1188)))) / z


def _lentz(first: float, terms, size: float) -> float:
    """Continued fraction by the modified Lentz method; ``terms`` yields (numerator, denominator)."""
    def away(v):
        return v if abs(v) > _TINY else _TINY

    h, c, d = away(first), away(first), 0.0
    for _, (num, den) in zip(range(_steps(size)), terms):
        d, c = 1.0 / away(den + num * d), away(den + num / c)
        h *= c * d
        if abs(c * d - 1.0) < 4 * _EPS:
            return h
    raise ArithmeticError("continued fraction has not converged")


def _beta_fraction(a: float, b: float, x: float) -> float:
    def terms():
        yield -(a + b) * x / (a + 1.0), 1.0
        m = 1
        while True:
            yield m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0
            yield -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0
            m += 1
    return 1.0 / _lentz(1.0, terms(), max(a, b))


def betainc(a: float, b: float, x: float, y: float | None = None) -> float:
    """Regularized incomplete beta I_x(a, b); ``y`` is 1 - x, where it is known more exactly."""
    y = 1.0 - x if y is None else y
    if x <= 0.0:
        return 0.0
    if y <= 0.0:
        return 1.0
    n = a + b
    shift = x * b - y * a                                     # n (x - a / n)
    log_front = (a * _excess(shift / a) + b * _excess(-shift / b) + 0.5 * math.log(a / n * b / (2 * math.pi))
                 + _remainder(n) - _remainder(a) - _remainder(b))
    front = math.exp(log_front)
    if x < (a + 1.0) / (n + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, y) / b


def gamma_upper(a: float, x: float) -> float:
    """Regularized upper incomplete gamma Q(a, x)."""
    if x <= 0.0:
        return 1.0
    front = math.exp(a * _excess((x - a) / a) + 0.5 * math.log(a / (2 * math.pi)) - _remainder(a))
    if x < a + 1.0:                                           # series for the lower part
        term = total = 1.0 / a
        for n in range(1, _steps(a)):
            term *= x / (a + n)
            total += term
            if term < total * _EPS:
                return 1.0 - front * total
        raise ArithmeticError("series has not converged")

    def terms():
        i = 1
        while True:
            yield i * (a - i), x + 2 * i + 1 - a
            i += 1
    return front / _lentz(x + 1.0 - a, terms(), a)


def _bad(*xs) -> bool:
    return any(v is None or (isinstance(v, float) and math.isnan(v)) for v in xs)


def f_sf(f: float, d1: float, d2: float) -> float:
    """P(F(d1, d2) > f)."""
    if _bad(f, d1, d2) or d1 <= 0 or d2 <= 0:
        return float("nan")
    if math.isinf(f):
        return 0.0
    if f <= 0:
        return 1.0
    whole = d2 + d1 * f
    return betainc(d2 / 2.0, d1 / 2.0, d2 / whole, d1 * f / whole)


def t_sf2(t: float, dof: float) -> float:
    """Two-sided P(|T(dof)| > |t|)."""
    if _bad(t, dof) or dof <= 0:
        return float("nan")
    return f_sf(t * t, 1.0, dof)


def chi2_sf(x: float, k: float) -> float:
    """P(chi2(k) > x)."""
    if _bad(x, k) or k <= 0:
        return float("nan")
    if math.isinf(x):
        return 0.0
    return gamma_upper(k / 2.0, x / 2.0)
