"""P-values against the JVM's commons-math3 (a test-only reference)."""

import math

import pytest
from skewlens.functions.special import chi2_p_value, correlation_p_value, f_p_value


def _close(got, want):
    assert math.isclose(got, want, rel_tol=1e-8, abs_tol=1e-14), (got, want)


@pytest.mark.parametrize("statistic,df", [
    (36.874, 11), (0.5, 1), (3.84, 1), (10.0, 10), (24.0, 24), (1000.0, 900), (5100.0, 5000), (100.0, 11), (1e-9, 3),
])
def test_chi_square(spark, statistic, df):
    dist = spark._jvm.org.apache.commons.math3.distribution.ChiSquaredDistribution(float(df))
    got = spark.range(1).select(chi2_p_value(f"{statistic!r}D", str(df))).first()[0]
    want = 1 - dist.cumulativeProbability(statistic)
    if want > 1e-13:
        _close(got, want)
    else:
        assert 0 <= got < 1e-12


@pytest.mark.parametrize("f,d1,d2", [
    (2.7, 3, 96), (0.5, 4, 995), (10.0, 4, 1_000_000), (1.0, 6, 14_993), (0.05, 5, 60_000), (1.01, 2_000, 3_000),
    (4.0, 1, 8), (1.0, 1, 1), (1.0, 40, 12), (1.1, 90_000, 90_000), (1.2, 5, 1_000_000_000),
])
def test_f(spark, f, d1, d2):
    dist = spark._jvm.org.apache.commons.math3.distribution.FDistribution(float(d1), float(d2))
    got = spark.range(1).select(f_p_value(f"{f!r}D", str(d1), str(d2))).first()[0]
    if d2 > 10_000_000:  # with so many values F times d1 is a chi-square
        chi = spark._jvm.org.apache.commons.math3.distribution.ChiSquaredDistribution(float(d1))
        assert math.isclose(got, 1 - chi.cumulativeProbability(f * d1), rel_tol=1e-6)
    else:
        _close(got, 1 - dist.cumulativeProbability(f))


@pytest.mark.parametrize("r,n", [(0.95, 3), (-0.61, 7), (0.1, 50), (0.999999, 4), (1e-6, 12), (0.02, 10_000), (0.3, 300), (0.5, 20), (0.05, 5)])
def test_correlation(spark, r, n):
    dist = spark._jvm.org.apache.commons.math3.distribution.TDistribution(float(n - 2))
    t = abs(r) * math.sqrt((n - 2) / (1 - r * r))
    got = spark.range(1).select(correlation_p_value(f"{r!r}D", str(n))).first()[0]
    _close(got, 2 * (1 - dist.cumulativeProbability(t)))


def _log_p(spark, expr):
    p = spark.range(1).select(expr).first()[0]
    return math.log(p) if p > 0 else -math.inf


def _normal_like_chi_square(a, x):
    """ln Q(a, x) by the uniform asymptotic expansion in erfc, to two terms: independent of the library's way."""
    m = (x - a) / a
    phi = sum((-1) ** k * m ** k / k for k in range(2, 16)) if abs(m) < 0.02 else m - math.log1p(m)
    eta = math.copysign(math.sqrt(2 * phi), m)
    c0 = -1 / 3 + eta / 12 - 2 * eta ** 2 / 135 + eta ** 3 / 864 + eta ** 4 / 2835 - 139 * eta ** 5 / 777600
    c1 = -1 / 540 - eta / 288 + eta ** 2 / 378 - 77 * eta ** 3 / 77760
    return math.log(0.5 * math.erfc(eta * math.sqrt(a / 2)) + math.exp(-a * phi) / math.sqrt(2 * math.pi * a) * (c0 + c1 / a))


@pytest.mark.parametrize("df", [4010, 10_000, 10**6, 10**8, 10**10, 10**12])
@pytest.mark.parametrize("sigmas", [-6, -1, 0, 0.3, 3, 8, 20, 35])
def test_chi_square_of_very_many_degrees(spark, df, sigmas):
    x = df + sigmas * math.sqrt(2.0 * df)
    got = _log_p(spark, chi2_p_value(f"{x!r}D", f"{df}"))
    want = _normal_like_chi_square(df / 2, x / 2)
    if df > 9000 or abs(sigmas) < 9:
        assert math.isclose(got, want, rel_tol=1e-9, abs_tol=2e-9), (got, want)
    if df <= 10**6:
        gamma = spark._jvm.org.apache.commons.math3.special.Gamma
        assert math.isclose(got, math.log(gamma.regularizedGammaQ(df / 2.0, x / 2.0, 1e-15, 10**7)), rel_tol=1e-9, abs_tol=1e-8)


@pytest.mark.parametrize("d1,d2", [(4_100, 4_200), (5_000, 300_000), (10**6, 10**6), (10**5, 10**7)])
@pytest.mark.parametrize("sigmas", [-4, -0.5, 0.5, 3, 8, 25])
def test_f_of_very_many_degrees(spark, d1, d2, sigmas):
    f = 1 + sigmas * math.sqrt(2 / d1 + 2 / d2)
    got = _log_p(spark, f_p_value(f"{f!r}D", str(d1), str(d2)))
    beta = spark._jvm.org.apache.commons.math3.special.Beta
    x = d2 / (d2 + d1 * f)
    want = beta.regularizedBeta(x, d2 / 2.0, d1 / 2.0, 1e-15, 10**7)
    assert math.isclose(got, math.log(want), rel_tol=1e-8, abs_tol=1e-8 + 2e-15 * (d1 + d2)), (got, math.log(want))


@pytest.mark.parametrize("d1,d2", [(10**8, 10**8), (10**10, 3 * 10**9), (10**12, 10**12)])
def test_f_of_any_size_is_symmetric_and_close_to_normal(spark, d1, d2):
    assert spark.range(1).select(f_p_value("1D", "4000000000", "4000000000")).first()[0] == pytest.approx(0.5, rel=1e-12)
    for sigmas in (0.5, 2, 6, 30):
        f = 1 + sigmas * math.sqrt(2 / d1 + 2 / d2)
        p = spark.range(1).select(f_p_value(f"{f!r}D", str(d1), str(d2)), f_p_value(f"{1 / f!r}D", str(d2), str(d1))).first()
        assert p[0] + p[1] == pytest.approx(1, rel=1e-9)
        z = math.log1p(f - 1) / math.sqrt(2 / d1 + 2 / d2)  # on the scale of logarithms F is symmetric
        assert math.log(p[0]) == pytest.approx(math.log(math.erfc(z / math.sqrt(2)) / 2), rel=2e-4)


@pytest.mark.parametrize("n", [5, 100, 3000, 10**6, 10**10])
@pytest.mark.parametrize("t", [0.2, 2.0, 6.0, 30.0])
def test_t_tails_as_logarithms(spark, n, t):
    r = t / math.sqrt(n - 2 + t * t)
    got = _log_p(spark, correlation_p_value(f"{r!r}D", str(n)))
    a = (n - 2) / 2
    beta = spark._jvm.org.apache.commons.math3.special.Beta
    if n <= 10**6:
        assert got == pytest.approx(math.log(beta.regularizedBeta((n - 2) / (n - 2 + t * t), a, 0.5, 1e-15, 10**6)), rel=1e-9, abs=1e-9)
    else:
        assert got == pytest.approx(math.log(math.erfc(t / math.sqrt(2))), rel=1e-6)


def test_small_and_large_ways_meet(spark, monkeypatch):
    from skewlens.functions import special

    for x in (3800.0, 3990.0, 4000.0, 4300.0):
        near = spark.range(1).select(chi2_p_value(f"{x!r}D", "3998")).first()[0]
        monkeypatch.setattr(special, "LARGE", 1000)
        far = spark.range(1).select(chi2_p_value(f"{x!r}D", "3998")).first()[0]
        f = spark.range(1).select(f_p_value("1.08D", "3000", "3900")).first()[0]
        monkeypatch.undo()
        assert near == pytest.approx(far, rel=1e-9) and f == pytest.approx(spark.range(1).select(f_p_value("1.08D", "3000", "3900")).first()[0], rel=1e-9)


def test_edges(spark):
    row = spark.range(1).select(
        correlation_p_value("1.0", "5").alias("perfect"),
        correlation_p_value("NULL", "5").alias("none"),
        correlation_p_value("0.0", "5").alias("zero"),
        f_p_value("DOUBLE('Infinity')", "2", "9").alias("inf"),
        f_p_value("NULL", "2", "9").alias("f_none"),
        f_p_value("0.0", "2", "9").alias("f_zero"),
        chi2_p_value("0.0", "4").alias("chi_zero"),
        chi2_p_value("3.0", "0").alias("chi_no_df"),
    ).first()
    assert row.perfect == 0.0 and row.none is None and row.zero == 1.0
    assert row.inf == 0.0 and row.f_none is None and row.f_zero == 1.0
    assert row.chi_zero == 1.0 and row.chi_no_df is None
