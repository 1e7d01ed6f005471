"""Amplitudes of series by frequency."""

from __future__ import annotations

import numpy as np

#: Cosine coefficients of the windows.
WINDOWS = {"none": (1.0,), "hamming": (0.54, -0.46), "hann": (0.5, -0.5), "flat_top": (1.0, -1.93, 1.29, -0.388, 0.028)}


def amplitude(series: np.ndarray, window: str = "none") -> np.ndarray:
    """RMS amplitude of each frequency of a series, filled with zeros to a power of two; the first is the mean."""
    n = len(series)
    size = 1 << int(np.ceil(np.log2(max(n, 2))))
    phase = 2 * np.pi * np.arange(n) / n
    weights = sum(c * np.cos(k * phase) for k, c in enumerate(WINDOWS[window]))
    out = np.abs(np.fft.rfft(series * weights, size))[: size // 2] / weights.sum()
    out[1:] *= np.sqrt(2)
    return out
