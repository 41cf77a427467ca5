"""Upper-tail p-values of chi-square, F and Student t as Spark SQL expressions.

The regularized incomplete gamma and beta functions are evaluated by their
textbook series and continued fractions, unrolled over ``sequence(1, n)`` with
``aggregate``; n is enough for parameters up to ``LARGE``. Beyond it the tail of the
density is integrated outright: near its mode such a density is close to a normal one
on the scale of its own width, so that a fixed number of Gauss-Legendre points gives
full precision at any size, and the density itself comes from differences that are
computed as such. They run on result rows (one per test or category), never on data
rows. Arguments are SQL text: column names, or expressions of them.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_TINY = "1E-300D"
_HALF_LOG_2PI = "0.9189385332046727D"

LARGE = 2000
PANELS = 32
# The Gauss-Legendre rule of eight points, between 0 and 1.
_NODES = (
    0.019855071751231884, 0.10166676129318664, 0.2372337950418355, 0.4082826787521751,
    0.5917173212478249, 0.7627662049581645, 0.8983332387068134, 0.9801449282487681,
)
_WEIGHTS = (
    0.05061426814518813, 0.1111905172266872, 0.15685332293894366, 0.1813418916891810,
    0.1813418916891810, 0.15685332293894366, 0.1111905172266872, 0.05061426814518813,
)

# Lanczos coefficients for g = 7, nine terms.
_LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028,
    771.32342877765313, -176.61502916214059, 12.507343278686905,
    -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)


def _double(x) -> str:
    return f"CAST({x} AS DOUBLE)"


def log_gamma(x: str) -> str:
    """ln Gamma(x) for x >= 0.5."""
    terms = " + ".join(f"({c!r}D) / ({x} + {i - 1}D)" for i, c in enumerate(_LANCZOS) if i)
    return (
        f"({_HALF_LOG_2PI} + ({x} - 0.5D) * ln({x} + 6.5D) - ({x} + 6.5D) + ln({_LANCZOS[0]!r}D + {terms}))"
    )


def _stirling_rest(x: str) -> str:
    return f"(1D / (12D * {x}) - 1D / (360D * {x} * {x} * {x}) + 1D / (1260D * {x} * {x} * {x} * {x} * {x}))"


def log_gamma_ratio(a: str, b: str) -> str:
    """ln Gamma(a+b) - ln Gamma(a), without cancellation when ``a`` is large."""
    s = f"({a} + {b})"
    large = (
        f"({a} - 0.5D) * log1p({b} / {a}) + {b} * ln({s}) - {b} + {_stirling_rest(s)} - {_stirling_rest(a)}"
    )
    return f"(CASE WHEN {a} > 100D THEN {large} ELSE {log_gamma(s)} - {log_gamma(a)} END)"


def _nonzero(x: str) -> str:
    return f"(CASE WHEN abs({x}) < {_TINY} THEN {_TINY} ELSE {x} END)"


def _gamma_steps(a: str) -> str:
    """Enough steps for convergence: both expansions need O(sqrt(a))."""
    return f"sequence(1, CAST(100D + 12D * sqrt({a}) AS INT))"


def _gamma_series(a: str, x: str) -> str:
    term = f"(s.term * {x} / ({a} + i))"
    return (
        f"aggregate({_gamma_steps(a)}, named_struct('total', 1D / {a}, 'term', 1D / {a}), "
        f"(s, i) -> named_struct('total', s.total + {term}, 'term', {term}), s -> s.total)"
    )


def _gamma_fraction(a: str, x: str) -> str:
    b0 = f"({x} + 1D - {a})"
    an, b = f"(-i * (i - {a}))", f"({b0} + 2D * i)"
    d = f"(1D / {_nonzero(f'({an} * s.d + {b})')})"
    c = _nonzero(f"({b} + {an} / s.c)")
    return (
        f"aggregate({_gamma_steps(a)}, "
        f"named_struct('c', 1D / {_TINY}, 'd', 1D / {_nonzero(b0)}, 'h', 1D / {_nonzero(b0)}), "
        f"(s, i) -> named_struct('c', {c}, 'd', {d}, 'h', s.h * {c} * {d}), s -> s.h)"
    )


def _log1p_rest(v: str) -> str:
    """ln(1 + v) - v, without cancellation when ``v`` is small."""
    series = "1D / 12D"
    for k in range(11, 1, -1):
        series = f"(1D / {k}D - {v} * {series})"
    return f"(CASE WHEN abs({v}) < 0.02D THEN -{v} * {v} * {series} ELSE ln(1D + {v}) - {v} END)"


def _with(values: dict[str, str], body: str) -> str:
    """``body`` with names for values that are computed once; later values may use earlier names."""
    for name, value in reversed(values.items()):
        body = f"aggregate(array({value}), CAST(NULL AS DOUBLE), (z_{name}, {name}) -> {body})"
    return body


def _tail(slope: str, width: str, ratio: str, most: str) -> str:
    """The integral of a density beyond a point, as a multiple of the density there.

    ``slope`` is how fast the density's logarithm falls there (per unit), ``width`` the standard deviation that
    belongs to its curvature, and ``ratio`` the logarithm of the density at distance ``s`` against the
    density at the point. Beyond ``reach`` less than 1e-20 of the integral is left.
    """
    nodes, weights = (f"array({', '.join(f'{v!r}D' for v in values)})" for values in (_NODES, _WEIGHTS))
    fall = f"({slope} * {width})"
    reach = f"least({most}, 1.3D * {width} * 100D / (sqrt({fall} * {fall} + 100D) + {fall}))"
    at = f"reach * (i DIV 8 + element_at({nodes}, CAST(i % 8 + 1 AS INT))) / {PANELS}D"
    total = (
        f"aggregate(sequence(0, {8 * PANELS - 1}), 0D, (t, i) -> t + element_at({weights}, CAST(i % 8 + 1 AS INT)) * "
        f"{_with({'s': at}, f'exp({ratio})')})"
    )
    return _with({"reach": reach}, f"(reach / {PANELS}D * {total})")


def _gamma_large(a: str, x: str) -> str:
    """Q(a, x) for large ``a``: f(x) dx integrated upwards from x, or downwards where that is the smaller part."""
    names = {"a": a, "x": x, "m": "(x - a) / a"}
    density = f"sqrt(a) * exp(a * {_log1p_rest('m')} - {_stirling_rest('a')} - {_HALF_LOG_2PI}) / x"
    # ln f(x + s) - ln f(x), its slope at x and the width of its curvature; downwards with s against the axis
    ratio = f"((a - 1D) * {_log1p_rest('(SIGN s / x)')} - SIGN s * (x - a + 1D) / x)"
    up = _tail("((x - a + 1D) / x)", "(x / sqrt(a - 1D))", ratio.replace("SIGN", "(1D) *"), "DOUBLE('Infinity')")
    down = _tail("((a - 1D - x) / x)", "(x / sqrt(a - 1D))", ratio.replace("SIGN", "(-1D) *"), "0.999D * x")
    return _with(names, f"CASE WHEN x > a THEN {density} * {up} ELSE 1D - {density} * {down} END")


def gamma_upper(a: str, x: str) -> str:
    """Regularized upper incomplete gamma Q(a, x)."""
    scale = f"exp({a} * ln({x}) - {x} - {log_gamma(a)})"
    return (
        f"(CASE WHEN {a} IS NULL OR {x} IS NULL OR {a} <= 0D THEN NULL WHEN {x} <= 0D THEN 1D "
        f"WHEN {a} > {LARGE}D THEN {_gamma_large(a, x)} "
        f"WHEN {x} < {a} + 1D THEN 1D - {scale} * {_gamma_series(a, x)} ELSE {scale} * {_gamma_fraction(a, x)} END)"
    )


def _beta_fraction(a: str, b: str, x: str) -> str:
    """1 / (1 + k1 / (1 + k2 / ...)). The coefficients are laid out first, so each is computed once."""
    steps = (
        f"sequence(1, CAST(least(120D, 20D + 6D * sqrt(greatest({a}, {b}))) + 20D * sqrt(least({a}, {b})) AS INT))"
    )
    m, span = "floor(j / 2D)", f"(({a} + j - 1D) * ({a} + j))"
    even = f"{m} * ({b} - {m}) * {x} / {span}"
    odd = f"-({a} + {m}) * ({a} + {b} + {m}) * {x} / {span}"
    coefficients = f"transform({steps}, j -> CASE WHEN j % 2 = 0 THEN {even} ELSE {odd} END)"
    c, d = "(1D + try_divide(k, s.c))", "(1D + k * s.d)"
    return (
        f"(1D / aggregate({coefficients}, named_struct('c', 1D, 'd', 0D, 'h', 1D), "
        f"(s, k) -> named_struct('c', {c}, 'd', try_divide(1D, {d}), 'h', try_divide(s.h * {c}, {d})), s -> s.h))"
    )


def _beta_large(a: str, b: str, x: str, y: str, d: str) -> str:
    """I_x(a, b) where both parameters are large; ``d`` is x - a / (a + b), given apart."""
    names = {
        "a": a, "b": b, "x": x, "y": y, "d": d, "u": "d * (a + b) / a", "w": "-d * (a + b) / b",
        # the slope of the logarithm of the density, from the distance to its mode
        "g": "((a - b) / (a + b) - (a + b - 2D) * d) / (x * y)", "width": "1D / sqrt((a - 1D) / (x * x) + (b - 1D) / (y * y))",
    }
    rests = f"{_stirling_rest('(a + b)')} - {_stirling_rest('a')} - {_stirling_rest('b')}"
    density = f"sqrt(a * b / (a + b)) * exp(a * {_log1p_rest('u')} + b * {_log1p_rest('w')} + {rests} - {_HALF_LOG_2PI}) / (x * y)"
    ratio = f"((a - 1D) * {_log1p_rest('(SIGN s / x)')} + (b - 1D) * {_log1p_rest('(-SIGN s / y)')} + SIGN s * g)"
    up = _tail("(-g)", "width", ratio.replace("SIGN", "(1D) *"), "0.999D * y")
    down = _tail("g", "width", ratio.replace("SIGN", "(-1D) *"), "0.999D * x")
    return _with(names, f"CASE WHEN d < 0D THEN {density} * {down} ELSE 1D - {density} * {up} END")


def beta_lower(a: str, b: str, x: str, y: str, d: str | None = None) -> str:
    """Regularized incomplete beta I_x(a, b); ``y`` is 1 - x, given apart so that neither loses digits.

    ``d`` is x - a / (a + b), for parameters that are both large.
    """
    large_both = f"WHEN least({a}, {b}) > {LARGE}D THEN {_beta_large(a, b, x, y, d)} " if d else ""
    small, large = f"least({a}, {b})", f"greatest({a}, {b})"
    log_beta = f"({log_gamma(small)} - {log_gamma_ratio(large, small)})"
    log_x = f"(CASE WHEN {x} > 0.5D THEN log1p(-{y}) ELSE ln({x}) END)"
    log_y = f"(CASE WHEN {y} > 0.5D THEN log1p(-{x}) ELSE ln({y}) END)"
    scale = f"exp({a} * {log_x} + {b} * {log_y} - {log_beta})"
    return (
        f"(CASE WHEN {a} IS NULL OR {b} IS NULL OR {x} IS NULL OR {a} <= 0D OR {b} <= 0D THEN NULL "
        f"WHEN {x} <= 0D THEN 0D WHEN {y} <= 0D THEN 1D {large_both}"
        f"WHEN {x} * ({a} + {b} + 2D) < {a} + 1D THEN {scale} * {_beta_fraction(a, b, x)} / {a} "
        f"ELSE 1D - {scale} * {_beta_fraction(b, a, y)} / {b} END)"
    )


def chi2_p_value(statistic: str, df: str) -> Column:
    """P(chi-square with ``df`` degrees of freedom >= statistic)."""
    return F.expr(gamma_upper(f"({_double(df)} / 2D)", f"({_double(statistic)} / 2D)"))


def f_p_value(statistic: str, df1: str, df2: str) -> Column:
    """P(F(df1, df2) >= statistic); an infinite statistic gives 0."""
    f, d1, d2 = _double(statistic), _double(df1), _double(df2)
    total = f"({d2} + {d1} * {f})"
    tail = beta_lower(
        f"({d2} / 2D)", f"({d1} / 2D)", f"try_divide({d2}, {total})", f"try_divide({d1} * {f}, {total})",
        f"({d2} / {total} * {d1} * (1D - {f}) / ({d1} + {d2}))",
    )
    return F.expr(f"CASE WHEN {f} = DOUBLE('Infinity') THEN 0D WHEN {f} <= 0D THEN 1D ELSE {tail} END")


def correlation_p_value(r: str, n: str) -> Column:
    """Two-sided p-value of a Pearson correlation ``r`` over ``n`` points."""
    r, a = _double(r), f"(({_double(n)} - 2D) / 2D)"
    tail = beta_lower(a, "0.5D", f"((1D - {r}) * (1D + {r}))", f"({r} * {r})")
    return F.expr(f"CASE WHEN abs({r}) >= 1D THEN 0D WHEN {r} = 0D THEN 1D ELSE {tail} END")
