"""Interval and test statistics as closed-form Column expressions
(u_wilson, u_poisson, u_mde, fn_safe_div, fn_round)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: two-sided 95% normal quantile used by the reference's intervals.
Z95 = 1.959964


def _c(x) -> Column:
    if isinstance(x, str):
        return F.col(x)
    if isinstance(x, (int, float)):
        return F.lit(x)
    return x


def safe_div(num, den) -> Column:
    """Undefined is not zero: null when the denominator is 0 or null."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))


def rnd(x, dp: int = 6) -> Column:
    return F.round(_c(x).cast("double"), dp)


def wilson_bounds(x, n, z: float = Z95) -> tuple[Column, Column]:
    """Wilson score interval for x successes of n; null when n = 0."""
    x, n = _c(x).cast("double"), _c(n).cast("double")
    p = safe_div(x, n)
    z2 = z * z
    centre = p + F.lit(z2) / (2 * n)
    half = F.lit(z) * F.sqrt(p * (1 - p) / n + F.lit(z2) / (4 * n * n))
    den = 1 + F.lit(z2) / n
    lo = F.greatest(F.lit(0.0), (centre - half) / den)
    hi = F.least(F.lit(1.0), (centre + half) / den)
    ok = n > 0
    return F.when(ok, lo), F.when(ok, hi)


def poisson_bounds(x, z: float = Z95) -> tuple[Column, Column]:
    """Byar / Wilson-Hilferty interval for a Poisson count; lower = 0 at x = 0."""
    x = _c(x).cast("double")
    x1 = x + 1
    lo = x * F.pow(1 - 1 / (9 * x) - F.lit(z) / (3 * F.sqrt(x)), 3)
    hi = x1 * F.pow(1 - 1 / (9 * x1) + F.lit(z) / (3 * F.sqrt(x1)), 3)
    return F.when(x > 0, lo).otherwise(F.lit(0.0)), hi


def normal_cdf(z) -> Column:
    """Standard normal CDF via the Abramowitz-Stegun 7.1.26 erf approximation
    (|error| < 1.5e-7), as a pure Column expression."""
    z = _c(z).cast("double")
    x = F.abs(z) / math.sqrt(2.0)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741
                + t * (-1.453152027 + t * 1.061405429))))
    erf = 1 - poly * F.exp(-x * x)
    return F.when(z >= 0, 0.5 * (1 + erf)).otherwise(0.5 * (1 - erf))


# Coefficients of the Chebyshev-fitted complementary error function
# (fractional error below 1.2e-7 for every argument), lowest order first.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587,
        -0.82215223, 0.17087277)


def normal_tail(z) -> Column:
    """P(Z > z), z >= 0, with relative accuracy however small it is (the
    complement of :func:`normal_cdf` is noise below 1e-7)."""
    x = _c(z).cast("double") / math.sqrt(2.0)
    t = 1 / (1 + 0.5 * x)
    poly = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        poly = c + t * poly
    return 0.5 * t * F.exp(-x * x + poly)


def ln_gamma(x) -> Column:
    """Logarithm of the gamma function for x > 0: Stirling's series eight places up."""
    x = _c(x).cast("double")
    y = x + 8
    low = F.lit(0.0)
    for i in range(8):
        low = low + F.log(x + i)
    series = 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3))) + 1 / (1260 * F.pow(y, F.lit(5)))
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - low


#: Intervals of the Simpson rule and Newton steps of :func:`t_quantile`.
T_CELLS, T_STEPS = 64, 14


def t_quantile(nu, alpha: float = 0.05) -> Column:
    """Two-sided Student t quantile for ``nu`` >= 1 degrees of freedom (need not be
    whole; null below 1): Newton's method on P(|T| <= t) = 1 - alpha from the normal
    quantile. The probability is concave in t and the start below the solution, so
    the steps rise to it from one side. With t = sqrt(nu) tan(a) the probability is
    2 / B times the integral of cos(x)^(nu - 1) up to a, by Simpson's rule."""
    z = -normal_quantile(alpha / 2)
    n0 = _c(nu).cast("double")
    ln_b = ln_gamma(n0 / 2) + 0.5 * math.log(math.pi) - ln_gamma((n0 + 1) / 2)

    def solved(s: Column) -> Column:
        n, scale = s["n"], 2 / F.exp(s["ln_b"])

        def step(t: Column, _: Column) -> Column:
            cell = F.atan(t / F.sqrt(n)) / T_CELLS
            area = F.aggregate(F.sequence(F.lit(0), F.lit(T_CELLS)), F.lit(0.0), lambda acc, i: acc + F.when(
                (i == 0) | (i == T_CELLS), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0) * F.exp((n - 1) * F.log(F.cos(i * cell)))) * cell / 3
            slope = scale / F.sqrt(n) * F.exp(-(n + 1) / 2 * F.log1p(t * t / n))
            return t - (scale * area - (1 - alpha)) / slope

        return F.aggregate(F.sequence(F.lit(1), F.lit(T_STEPS)), F.lit(z), step)

    bound = F.transform(F.array(F.struct(n0.alias("n"), ln_b.alias("ln_b"))), solved)
    return F.when(n0 >= 1, F.get(bound, F.lit(0)))


def normal_quantile(p: float) -> float:
    """Driver-side parameter helper (inverse normal CDF, Acklam's rational
    approximation); used to turn alpha/power parameters into z values."""
    if not 0 < p < 1:
        raise ValueError("p must be in (0, 1)")
    a = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
         1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00]
    b = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
         6.680131188771972e+01, -1.328068155288572e+01]
    c = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
         -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00]
    d = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
         3.754408661907416e+00]
    lo = 0.02425
    if p < lo:
        q = math.sqrt(-2 * math.log(p))
        return (((((c[0]*q+c[1])*q+c[2])*q+c[3])*q+c[4])*q+c[5]) / \
            ((((d[0]*q+d[1])*q+d[2])*q+d[3])*q+1)
    if p > 1 - lo:
        return -normal_quantile(1 - p)
    q = p - 0.5
    r = q * q
    return (((((a[0]*r+a[1])*r+a[2])*r+a[3])*r+a[4])*r+a[5])*q / \
        (((((b[0]*r+b[1])*r+b[2])*r+b[3])*r+b[4])*r+1)
