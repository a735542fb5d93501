"""SQL text fragments for the DuckDB oracles that mirror the Column formulas
in :mod:`plumbline.functions.stats` term by term (same constants, same
evaluation order), so both engines round to the same figures."""

from __future__ import annotations

from plumbline.functions.stats import ERFC, T_CELLS, T_STEPS, Z95, normal_quantile


def f(x: float) -> str:
    return repr(float(x))


def normal_cdf_sql(z: str) -> str:
    x = f"(abs({z}) / {f(2 ** 0.5)})"
    t = f"(1 / (1 + 0.3275911 * {x}))"
    poly = (f"({t} * (0.254829592 + {t} * (-0.284496736 + {t} * (1.421413741 "
            f"+ {t} * (-1.453152027 + {t} * 1.061405429)))))")
    erf = f"(1 - {poly} * exp(-{x} * {x}))"
    return f"(CASE WHEN {z} >= 0 THEN 0.5 * (1 + {erf}) ELSE 0.5 * (1 - {erf}) END)"


def normal_tail_sql(z: str) -> str:
    x = f"(({z}) / {f(2 ** 0.5)})"
    t = f"(1 / (1 + 0.5 * {x}))"
    poly = f(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        poly = f"({f(c)} + {t} * {poly})"
    return f"(0.5 * {t} * exp(-{x} * {x} + {poly}))"


def t_quantile_ctes(table: str, nu: str, alpha: float = 0.05) -> str:
    """CTEs that end in ``tq``: ``table`` with the two-sided t quantile ``t`` of ``nu``."""
    z = f"CAST({-normal_quantile(alpha / 2)!r} AS DOUBLE)"
    area = (f"list_sum(list_transform(range(0, {T_CELLS + 1}), lambda i: (CASE WHEN i IN (0, {T_CELLS}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
            f" * pow(cos(i * atan(t / sqrt(nu)) / {T_CELLS}), nu - 1))) * atan(t / sqrt(nu)) / {3 * T_CELLS}")
    parts = [f"t0 AS (SELECT *, CAST({nu} AS DOUBLE) AS nu, {z} AS t FROM {table})",
             "s0 AS (SELECT *, 2 / exp(lgamma(nu / 2) + lgamma(0.5) - lgamma((nu + 1) / 2)) AS sc FROM t0 WHERE nu >= 1)"]
    for k in range(1, T_STEPS + 1):
        parts.append(f"s{k} AS (SELECT * REPLACE (t - (sc * {area} - {f(1 - alpha)}) * sqrt(nu) / sc "
                     f"* pow(1 + t * t / nu, (nu + 1) / 2) AS t) FROM s{k - 1})")
    parts.append(f"tq AS (SELECT * FROM s{T_STEPS} UNION ALL SELECT * REPLACE (NULL AS t), NULL AS sc FROM t0 WHERE nu IS NULL OR nu < 1)")
    return ",\n".join(parts)


def wilson_sql(x: str, n: str, z: float = Z95) -> tuple[str, str]:
    xd, nd = f"CAST({x} AS DOUBLE)", f"CAST({n} AS DOUBLE)"
    p = f"({xd} / NULLIF({nd}, 0))"
    z2 = z * z
    centre = f"({p} + {f(z2)} / (2 * {nd}))"
    half = f"({f(z)} * sqrt({p} * (1 - {p}) / {nd} + {f(z2)} / (4 * {nd} * {nd})))"
    den = f"(1 + {f(z2)} / {nd})"
    lo = f"(CASE WHEN {nd} > 0 THEN greatest(0.0, ({centre} - {half}) / {den}) END)"
    hi = f"(CASE WHEN {nd} > 0 THEN least(1.0, ({centre} + {half}) / {den}) END)"
    return lo, hi


def poisson_sql(x: str, z: float = Z95) -> tuple[str, str]:
    xd = f"CAST({x} AS DOUBLE)"
    x1 = f"({xd} + 1)"
    lo = f"(CASE WHEN {xd} > 0 THEN {xd} * pow(1 - 1 / (9 * {xd}) - {f(z)} / (3 * sqrt({xd})), 3) ELSE 0.0 END)"
    hi = f"({x1} * pow(1 - 1 / (9 * {x1}) + {f(z)} / (3 * sqrt({x1})), 3))"
    return lo, hi

def hidden_sql(inner: str, labels: list[str], figures: list[str]) -> str:
    """``inner`` (a SELECT with a stability column) with the figures of suppressed rows nulled."""
    cols = ", ".join(f"CASE WHEN stability <> 'suppressed' THEN {c} END AS {c}" for c in figures)
    return f"SELECT {', '.join(labels)}, {cols}, stability FROM ({inner}) shown"


# Figures in RE2, whose word boundary knows ASCII only: all other letters and
# numerals are made "x" first, so that a figure beside one is none.
ASCII_WORDS = r"regexp_replace(text, '[\p{L}\p{No}\p{Nl}]', 'x', 'g')"
FIGURE_RE2 = r"\b([0-9]{1,3}(?:,[0-9]{3})+|[0-9]+[.][0-9])\b"
