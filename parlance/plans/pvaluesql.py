"""Tail probabilities as DuckDB expressions, for the oracles of M09-M12: the
power series of the normal integral and of the incomplete beta function, and
no function that Spark's side uses."""

from __future__ import annotations

TERMS = 400  # of a series; its terms fall like a geometric one
BETA_TERMS = 20000


def norm_sf(z: str) -> str:
    """P(Z > z): 1/2 − φ(z) (z + z³/3 + z⁵/(3·5) + ...)."""
    odd = "(k + 1) * ln(2) + lgamma(k + 1.5) - 0.5 * ln(pi())"  # ln of 1·3···(2k+1)
    return (f"CASE WHEN abs({z}) < 1e-12 THEN 0.5 WHEN abs({z}) > 12 THEN CASE WHEN {z} > 0 THEN 0.0 ELSE 1.0 END ELSE 0.5 - sign({z}) * exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * "
            f"list_sum(list_transform(range({TERMS}), lambda k: exp((2 * k + 1) * ln(abs({z})) - ({odd})))) END")


def one_of(greater: str, less: str) -> str:
    return f"(CASE alternative WHEN 'greater' THEN {greater} WHEN 'less' THEN {less} ELSE least(1.0, 2 * least({greater}, {less})) END)"


def _beta(a: str, b: str, x: str) -> str:
    """I_x(a, b) by its power series (x below its mean)."""
    front = f"exp(lgamma(({a}) + ({b})) - lgamma({a}) - lgamma({b}) + ({a}) * ln({x}) + ({b}) * ln(1 - ({x})))"
    term = f"exp(lgamma(({a}) + ({b}) + k) - lgamma(({a}) + ({b})) + lgamma(({a}) + 1) - lgamma(({a}) + 1 + k) + k * ln({x}))"
    return f"{front} / ({a}) * list_sum(list_transform(range({BETA_TERMS}), lambda k: {term}))"


def t_two_sided(t: str, df: str) -> str:
    """P(|T| > |t|) = I_{df / (df + t²)}(df / 2, 1/2)."""
    a, x, y = f"({df}) / 2.0", f"({df}) / (({df}) + ({t}) * ({t}))", f"({t}) * ({t}) / (({df}) + ({t}) * ({t}))"
    return (f"(CASE WHEN {t} = 0 THEN 1.0 WHEN {x} < (({a}) + 1) / (({a}) + 2.5) THEN {_beta(a, '0.5', x)} "
            f"ELSE 1 - {_beta('0.5', a, y)} END)")


def t_directed(t: str, df: str, alternative: str) -> str:
    two = t_two_sided(t, df)
    up = f"(CASE WHEN {t} > 0 THEN {two} / 2 ELSE 1 - {two} / 2 END)"
    return f"(CASE {alternative} WHEN 'greater' THEN {up} WHEN 'less' THEN 1 - {up} ELSE {two} END)"
