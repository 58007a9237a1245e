"""Tapers and Gaussians, in numpy and as Columns."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of the cosine sums of the tapers.
TAPERS = {"hamming": (0.54, 0.46), "hann": (0.5, 0.5), "blackman": (0.42, 0.5, 0.08)}


def taper(kind: str, i: Column, n: int) -> Column:
    """Value i of a taper of n values."""
    if kind not in TAPERS:
        raise ValueError(f"taper {kind}")
    a = TAPERS[kind]
    total: Column = F.lit(a[0])
    for k, weight in enumerate(a[1:], 1):
        total = total + F.lit((-1) ** k * weight) * F.cos(F.lit(2 * math.pi * k) * i / F.lit(max(n - 1, 1)))
    return total


def gauss(size: int, width: float, x0: float = 0.0, y0: float = 0.0, intensity: float = 1.0) -> np.ndarray:
    """A Gaussian over a grid from -size/2 in steps of one, summing to intensity; an odd size lies half a pixel off."""
    at = np.arange(-size / 2, size / 2)
    g = np.exp(-((at[:, None] - x0) ** 2 + (at[None, :] - y0) ** 2) / (2 * width**2))
    return g / g.sum() * intensity


def smoothing_kernel(sigma: float) -> np.ndarray:
    radius = int(4 * sigma + 0.5)
    g = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return g / g.sum()


def smoothed(images: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing of the last two axes; the image is mirrored at its edges."""
    k = smoothing_kernel(sigma)
    radius = len(k) // 2
    for axis in (-2, -1):
        n = images.shape[axis]
        at = np.arange(-radius, n + radius) % (2 * n)
        at = np.where(at >= n, 2 * n - 1 - at, at)
        wide = np.take(images, at, axis=axis)
        images = sum(w * np.take(wide, np.arange(n) + j, axis=axis) for j, w in enumerate(k))
    return images


_POLE = np.sqrt(3.0) - 2


def _mirrored(at: np.ndarray, n: int) -> np.ndarray:
    """Indices beyond 0 to n - 1 mirrored about the outermost pixels."""
    if n == 1:
        return np.zeros_like(at)
    at = np.abs(at) % (2 * n - 2)
    return np.where(at >= n, 2 * n - 2 - at, at)


def spline_coefficients(x: np.ndarray, axis: int) -> np.ndarray:
    """Coefficients of the cubic B-spline through x along an axis, mirrored about its ends: a pass up and a pass down."""
    c = np.moveaxis(np.array(x, float), axis, 0)
    n = len(c)
    if n == 1:
        return np.array(x, float)
    c *= 6
    reach = min(n, 40)  # the pole's 40th power is below a double's rounding
    weights = _POLE ** np.arange(reach)
    if reach < n:
        first = np.tensordot(weights, c[:reach], 1)
    else:  # the sum over the mirrored signal's whole period
        both = np.concatenate([c, c[-2:0:-1]])
        first = np.tensordot(_POLE ** np.arange(len(both)), both, 1) / (1 - _POLE ** len(both))
    c[0] = first
    for k in range(1, n):
        c[k] += _POLE * c[k - 1]
    c[-1] = _POLE / (_POLE**2 - 1) * (c[-1] + _POLE * c[-2])
    for k in range(n - 2, -1, -1):
        c[k] = _POLE * (c[k + 1] - c[k])
    return np.moveaxis(c, 0, axis)


def spline_shifted(x: np.ndarray, shift: tuple[float, float]) -> np.ndarray:
    """Images moved by any shift along their last two axes, by cubic splines; 0 where nothing was."""
    for axis, by in zip((-2, -1), shift, strict=True):
        n = x.shape[axis]
        at = np.arange(n) - float(by)
        whole = np.floor(at).astype(int)
        t = at[0] - whole[0]
        weights = ((1 - t) ** 3 / 6, (4 - 6 * t**2 + 3 * t**3) / 6, (1 + 3 * t + 3 * t**2 - 3 * t**3) / 6, t**3 / 6)
        c = spline_coefficients(x, axis)
        inside = ((at >= 0) & (at <= n - 1)).reshape((-1, 1) if axis == -2 else (1, -1))
        x = sum(w * np.take(c, _mirrored(whole + k, n), axis=axis) for k, w in zip((-1, 0, 1, 2), weights, strict=True)) * inside
    return x
