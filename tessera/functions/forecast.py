"""Forecasts of a series beyond its last point."""

from __future__ import annotations

import numpy as np

#: The two-sided 95 % quantile and the smoothing parameters.
Z95 = 1.959963984540054
ALPHA, BETA, GAMMA = 0.4, 0.1, 0.2
METHODS = {"linear": "linear", "holt_winters": "holt_winters", "holt-winters": "holt_winters", "holtwinters": "holt_winters", "hw": "holt_winters"}


def linear(t: np.ndarray, y: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, float]:
    """(values at times ``at``, residual deviation) of the least-squares line over seconds since the first point."""
    x, ok = (t - t[0]) / 1000.0, ~np.isnan(y)
    x, y = x[ok], y[ok]
    if len(y) < 2:
        raise ValueError("two points are needed at least")
    centred = x - x.mean()
    spread = float(centred @ centred)
    slope = float(centred @ (y - y.mean())) / spread if spread else 0.0
    start = float(y.mean()) - slope * float(x.mean())
    rest = y - (start + slope * x)
    return start + slope * (at - t[0]) / 1000.0, float(np.sqrt(rest @ rest / max(1, len(y) - 2)))


def smoothed(y: np.ndarray, horizon: int, season: int = 0) -> tuple[np.ndarray, float]:
    """Additive exponential smoothing with trend, and with a season if two whole ones are there."""
    n = len(y)
    wave = None
    level, trend = np.nan, 0.0
    if season > 1 and n >= 2 * season:
        rounds = y[: n // season * season].reshape(-1, season)
        means = np.nan_to_num(np.array([np.nanmean(r) if not np.isnan(r).all() else 0.0 for r in rounds]))
        off = rounds - means[:, None]
        wave = np.array([np.nanmean(c) if not np.isnan(c).all() else 0.0 for c in off.T])
        level, trend = float(means[0]), float(means[1] - means[0]) / season
    errors: list[float] = []
    for i, x in enumerate(y.tolist()):
        if x != x:
            level += trend  # stays nan before the first value
            continue
        if level != level:
            level = x
            continue
        extra = 0.0 if wave is None else float(wave[i % season])
        guess = level + trend
        errors.append(x - guess - extra)
        if wave is None and len(errors) == 1:
            level, trend = x, x - level
            continue
        new = ALPHA * (x - extra) + (1 - ALPHA) * guess
        level, trend = new, BETA * (new - level) + (1 - BETA) * trend
        if wave is not None:
            wave[i % season] = GAMMA * (x - level) + (1 - GAMMA) * extra
    if level != level:
        raise ValueError("two points are needed at least")
    ahead = np.arange(1, horizon + 1)
    out = level + ahead * trend
    if wave is not None:
        out = out + wave[(n + ahead - 1) % season]
    return out, float(np.sqrt(np.square(errors).sum() / (len(errors) - 1))) if len(errors) > 1 else 0.0


def forecast(t: np.ndarray, y: np.ndarray, horizon: int, method: str = "linear", season: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(times, values, half width of the 95 % band, which widens with the square root of the step)."""
    if len(t) < 2 or horizon < 1:
        raise ValueError("two points and a horizon of one step are needed at least")
    step = max(1, int(t[-1] - t[0]) // (len(t) - 1))
    ahead = np.arange(1, horizon + 1)
    at = t[-1] + step * ahead
    kind = METHODS[method.lower()]
    values, deviation = linear(t, y, at) if kind == "linear" else smoothed(y, horizon, season)
    return at, values, Z95 * deviation * np.sqrt(ahead)
