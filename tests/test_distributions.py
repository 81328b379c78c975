"""Upper tails over the whole range of degrees of freedom, against closed forms and asymptotics."""

import math

import pytest

from varkit.functions.distributions import chi2_sf, f_sf, t_sf2


def _normal_sf(z):
    return 0.5 * math.erfc(z / math.sqrt(2))


@pytest.mark.parametrize("k", [1e3, 1e4, 1e5, 1e6, 1e7, 1e8, 1e9, 1e10])
def test_chi2_near_its_mean(k):
    """Q at the mean: 1/2 - (1/3) sqrt(1/(pi k)) + O(k^-3/2) (expansion of the incomplete gamma function)."""
    assert abs(chi2_sf(k, k) - (0.5 - 1 / (3 * math.sqrt(math.pi * k)))) < max(1e-8, k ** -1.5)


@pytest.mark.parametrize("x,m", [(0.5, 1), (3.0, 2), (40.0, 10), (700.0, 300), (2000.0, 1000)])
def test_chi2_even_degrees(x, m):
    term, total = math.exp(-x / 2), 0.0
    total = math.fsum(math.exp(-x / 2 + i * math.log(x / 2) - math.lgamma(i + 1)) for i in range(m)) if m > 1 else term
    assert abs(chi2_sf(x, 2 * m) - total) < 1e-10


@pytest.mark.parametrize("d2", [1, 2, 7, 1e3, 1e6, 1e8, 1e10])
@pytest.mark.parametrize("f", [1e-3, 0.5, 1.0, 3.0, 12.0])
def test_f_with_two_numerator_degrees(f, d2):
    assert abs(f_sf(f, 2, d2) - math.exp(-d2 / 2 * math.log1p(2 * f / d2))) < 1e-8


@pytest.mark.parametrize("dof", [1e9, 1e10])
@pytest.mark.parametrize("t", [0.0, 0.1, 1.0, 2.5, 5.0])
def test_t_tends_to_normal(t, dof):
    assert abs(t_sf2(t, dof) - 2 * _normal_sf(abs(t))) < 1e-8


def test_t_small_and_edges():
    assert abs(t_sf2(1.0, 1) - 0.5) < 1e-12 and abs(t_sf2(math.sqrt(2), 2) - (1 - math.sqrt(0.5))) < 1e-12
    assert abs(f_sf(1.0, 1e10, 1e10) - 0.5) < 1e-8 and abs(f_sf(1.0, 5, 5) - 0.5) < 1e-12
    assert math.isnan(chi2_sf(float("nan"), 3)) and chi2_sf(float("inf"), 3) == 0.0 and chi2_sf(0, 3) == 1.0
