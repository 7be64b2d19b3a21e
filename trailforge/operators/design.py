"""Low-pass coefficients, worked out on the driver."""

from __future__ import annotations

import math


def low_pass(cutoff: float, taps: int = 21) -> list[float]:
    """A windowed sinc (Hamming) of unit gain; cutoff is a share of half the sampling rate."""
    if taps < 3:
        raise ValueError("a low-pass filter needs 3 taps or more")
    if not 0 < cutoff <= 1:
        raise ValueError("the cutoff must be above 0 and at most 1")
    middle = (taps - 1) / 2
    ideal = [cutoff if k == middle else math.sin(math.pi * cutoff * (k - middle)) / (math.pi * (k - middle)) for k in range(taps)]
    shaped = [h * (0.54 - 0.46 * math.cos(2 * math.pi * k / (taps - 1))) for k, h in enumerate(ideal)]
    gain = sum(shaped)
    return [h / gain for h in shaped]
