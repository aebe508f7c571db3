"""The tables of ISO 286 against the standard's own formulas: values are rounded there, so a share of each is allowed."""

from __future__ import annotations

from itertools import pairwise
from math import sqrt

import pytest

from dimlark.functions import standards as S

#: multiples of the tolerance unit for each grade from 6 on; 5 is 7 of them
UNITS = {5: 7, 6: 10, 7: 16, 8: 25, 9: 40, 10: 64, 11: 100, 12: 160}
#: a fundamental deviation in micrometres: factor and power of the mean diameter
SHAFTS = {"d": (16, 0.44), "e": (11, 0.41), "f": (5.5, 0.41), "g": (2.5, 0.34)}
MEANS = [sqrt(max(lo, 1) * hi) for lo, hi in pairwise((0, *S.BANDS))]


def unit(d):
    return 0.45 * d ** (1 / 3) + 0.001 * d


@pytest.mark.parametrize("grade", sorted(UNITS))
def test_tolerance_grades_follow_the_unit(grade):
    for i, (d, value) in enumerate(zip(MEANS, S.IT[grade], strict=True)):
        # below 3 mm the standard rounds up further
        assert value == pytest.approx(UNITS[grade] * unit(d), rel=0.12 if i else 0.16, abs=1), (d, value)


def test_grades_and_bands_grow():
    for low, high in pairwise(sorted(S.IT)):
        assert all(a < b for a, b in zip(S.IT[low], S.IT[high], strict=True))
    assert all(a <= b for row in S.IT.values() for a, b in pairwise(row))


@pytest.mark.parametrize("letter", sorted(SHAFTS))
def test_clearance_deviations_follow_their_power(letter):
    factor, power = SHAFTS[letter]
    for d, value in zip(MEANS, S.UPPER[letter], strict=True):
        assert -value == pytest.approx(factor * d**power, rel=0.12, abs=1.5), (d, value)


def test_interference_deviations_follow_their_rules():
    for i, d in enumerate(MEANS):
        assert S.LOWER["k"][i] == pytest.approx(0.6 * d ** (1 / 3), abs=1.2)
        assert S.LOWER["m"][i] == pytest.approx(S.IT[7][i] - S.IT[6][i], abs=2)
        assert S.LOWER["n"][i] == pytest.approx(5 * d**0.34, rel=0.1, abs=1.5 if i else 2.1)
        assert 0 <= S.LOWER["p"][i] - S.IT[7][i] <= 6 or S.LOWER["p"][i] == pytest.approx(S.IT[7][i], abs=6)


def test_fine_bands_rise_between_their_neighbours():
    for letter, row in S.FINE_LOWER.items():
        assert all(a <= b for a, b in pairwise(row)), letter
        lower = [S.LOWER["p"][next(i for i, hi in enumerate(S.BANDS) if hi >= edge)] for edge in S.FINE_BANDS]
        assert all(v > p for v, p in zip(row, lower, strict=True)), letter


def test_general_tolerances_grow_with_size_and_class():
    for kind, (_, table, _) in S.GENERAL.items():
        for row in table.values():
            values = [v for v in row if v is not None]
            assert all(a >= b for a, b in pairwise(values)) if kind == "angle" else all(a <= b for a, b in pairwise(values)), kind
        for fine, coarse in pairwise(table.values()):
            assert all(a <= b for a, b in zip(fine, coarse, strict=True) if a is not None and b is not None), kind
