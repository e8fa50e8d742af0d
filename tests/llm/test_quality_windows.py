"""The worst stretch of a text is found wherever it lies."""

import numpy as np
import pytest

from windgrid.llm import quality

WORST = [quality.NAMES.index(f"worst_window_{x}") for x in ("mark", "upper", "distinct")]


def text(n, start, count, spoilt):
    return " ".join(spoilt if start <= k < start + count else f"w{k}" for k in range(n))


@pytest.mark.parametrize(("n", "start", "count", "least"), [(127, 64, 63, 63 / 64), (200, 140, 60, 59 / 64), (100, 90, 10, 10 / 64), (320, 48, 32, 0.5), (65, 64, 1, 1 / 64)])
def test_spoilt_stretch(n, start, count, least):
    assert quality.features(text(n, start, count, "#"))[WORST[0]] >= least - 1e-9
    assert quality.features(text(n, start, count, "BUY"))[WORST[1]] >= least - 1e-9
    assert quality.features(text(n, start, count, "buy"))[WORST[2]] >= least - 1 / 64 - 1e-9


def test_short_texts_are_one_window():
    for n in (1, 63, 64):
        x = quality.features(text(n, 0, n // 2, "#"))
        assert np.isclose(x[WORST[0]], (n // 2) / n)
