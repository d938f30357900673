"""The share from which on a subject counts."""

import numpy as np
import pytest

from strandloom.llm.subjects import fit_curve, label_noise, share_odds


def test_exactly_one_sentence_in_six_counts():
    assert all(share_odds(n / (6 * n)) > 0 for n in range(1, 10))
    assert share_odds(1 / 7) < 0 and share_odds(1 / 8) < 0


def test_the_fitted_zero_follows_the_labels():
    """Labels that begin at a quarter move the zero there, missing ones don't move it up; without labels it stays at SHARE."""
    r = np.random.RandomState(5)
    shares = r.choice(np.arange(1, 12) / 12, 3000)
    told = ((shares > 0.24) & (r.rand(3000) > 0.3)).astype(float)
    noise = label_noise(np.r_[shares, np.zeros(500)], np.r_[told, np.zeros(500)])
    assert noise[0] < 0.01 and abs(noise[1] - 0.3) < 0.05
    slope, zero = fit_curve(shares, told, noise)
    assert share_odds(2 / 12) < zero < share_odds(3 / 12) and slope > 5
    assert fit_curve(np.zeros(0), np.zeros(0), noise)[1] == pytest.approx(0.0, abs=1e-9)
    own = fit_curve(shares[:30], told[:30], noise, (slope, zero), (0.3, 0.1))
    assert abs(own[1] - zero) < 0.2  # few labels of a subject stay near all subjects'
