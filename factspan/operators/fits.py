"""Small fits repeated over many series.

Spark groups the series; one task fits one series with NumPy. Inputs are grid tables (one
row per series and period or bin), so a group holds a calendar or an age scale, never the
events behind it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from factspan.operators.metrics import grid_difference


def _schema(df: DataFrame, series: Sequence[str], *extra: tuple[str, T.DataType]) -> T.StructType:
    fields = [df.schema[s] for s in series]
    return T.StructType([*fields, *[T.StructField(n, t) for n, t in extra]])


# --- penalised Poisson trend ---------------------------------------------------


def trend_log_rate(y: np.ndarray, exposure: np.ndarray, penalty: float) -> np.ndarray:
    """Log rate that minimises the Poisson loss plus penalty/2 x squared second differences.

    The loss is convex; damped Newton steps stop on a gradient of 1e-8.
    """
    d2 = np.diff(np.eye(y.size), n=2, axis=0)
    stiffness = penalty * d2.T @ d2

    def loss(z: np.ndarray) -> float:
        mean = exposure * np.exp(np.clip(z, -30, 30))
        return float(np.sum(mean - y * (np.log(exposure) + z)) + 0.5 * z @ stiffness @ z)

    z = np.log((y + 0.5) / exposure)
    for _ in range(200):
        mean = exposure * np.exp(np.clip(z, -30, 30))
        gradient = mean - y + stiffness @ z
        if np.max(np.abs(gradient)) <= 1e-8 * max(1.0, float(np.max(y))):
            break
        step = np.linalg.solve(stiffness + np.diag(mean + 1e-12), gradient)
        size, here = 1.0, loss(z)
        while size > 1e-10 and loss(z - size * step) > here - 1e-4 * size * (gradient @ step):
            size /= 2
        if size <= 1e-10:
            break
        z = z - size * step
    return z


def innovation_scale(z: np.ndarray) -> float:
    bends = np.diff(z, n=2)
    return max(float(np.sqrt(np.mean(bends**2))) if bends.size else 0.05, 1e-3)


def fit_trend(
    grid: DataFrame,
    series: Sequence[str],
    step: str,
    value: str,
    offset: str | None = None,
    penalty: float = 30.0,
) -> DataFrame:
    """Penalised trend of every series: log_fitted, fitted and innovation_scale per step."""
    if penalty < 0:
        raise ValueError(f"a trend penalty is at least 0, not {penalty}")
    out = _schema(
        grid,
        series,
        (step, grid.schema[step].dataType),
        ("observed", T.DoubleType()),
        ("log_fitted", T.DoubleType()),
        ("fitted", T.DoubleType()),
        ("innovation_scale", T.DoubleType()),
    )

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(step)
        y = frame[value].to_numpy(float)
        e = np.ones_like(y) if offset is None else frame[offset].to_numpy(float)
        if y.size < 3 or (y < 0).any() or (e <= 0).any():
            raise ValueError("a trend needs three nonnegative counts with positive offsets")
        z = trend_log_rate(y, e, penalty)
        return frame[[*series, step]].assign(
            observed=y, log_fitted=z, fitted=e * np.exp(z), innovation_scale=innovation_scale(z)
        )

    return grid.groupBy(*series).applyInPandas(one, out)


def rolling_backtest(
    grid: DataFrame,
    series: Sequence[str],
    step: str,
    value: str,
    minimum_training: int = 8,
    penalty: float = 30.0,
) -> DataFrame:
    """One-step forecasts from every origin, each fitted on the steps before it."""
    if minimum_training < 3:
        raise ValueError("minimum_training must be at least three")
    out = _schema(
        grid,
        series,
        ("origin", T.LongType()),
        ("actual", T.DoubleType()),
        ("forecast", T.DoubleType()),
        ("error", T.DoubleType()),
    )

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(step)
        y = frame[value].to_numpy(float)
        origins = np.arange(minimum_training, y.size)
        forecasts = []
        for origin in origins:
            z = trend_log_rate(y[:origin], np.ones(origin), penalty)
            forecasts.append(np.exp(2 * z[-1] - z[-2]))
        result = pd.DataFrame(
            {"origin": origins, "actual": y[origins], "forecast": np.array(forecasts, float)}
        )
        result["error"] = result["actual"] - result["forecast"]
        for name in series:
            result[name] = frame[name].iloc[0] if len(frame) else None
        return result[[f.name for f in out.fields]]

    return grid.groupBy(*series).applyInPandas(one, out)


# --- rate schedule from binned counts ------------------------------------------


def spline_knots(lower: float, upper: float, df: int, degree: int = 3) -> np.ndarray:
    inner = np.linspace(lower, upper, df - degree + 1)[1:-1]
    return np.concatenate([[lower] * (degree + 1), inner, [upper] * (degree + 1)])


def spline_basis(x: np.ndarray, knots: np.ndarray, degree: int = 3) -> np.ndarray:
    """B-spline basis by the Cox-de Boor recurrence; the end cells extrapolate."""
    x = np.atleast_1d(np.asarray(x, float))
    count = len(knots) - degree - 1
    cell = np.clip(np.searchsorted(knots, x, side="right") - 1, degree, count - 1)
    basis = np.zeros((x.size, len(knots) - 1))
    basis[np.arange(x.size), cell] = 1.0
    for k in range(1, degree + 1):
        size = len(knots) - 1 - k
        rise, fall = knots[k : k + size] - knots[:size], knots[k + 1 : k + 1 + size] - knots[1 : 1 + size]
        left = np.divide(x[:, None] - knots[:size], rise, out=np.zeros((x.size, size)), where=rise > 0)
        right = np.divide(
            knots[k + 1 : k + 1 + size] - x[:, None], fall, out=np.zeros((x.size, size)), where=fall > 0
        )
        basis = left * basis[:, :size] + right * basis[:, 1 : size + 1]
    return basis


def spline_slope(x: np.ndarray, knots: np.ndarray, degree: int = 3) -> np.ndarray:
    """Derivative of every basis function."""
    low = spline_basis(x, knots[1:-1], degree - 1)
    count = len(knots) - degree - 1
    gaps = knots[degree + 1 : degree + count] - knots[1:count]
    scaled = np.divide(degree * low, gaps, out=np.zeros_like(low), where=gaps > 0)
    slope = np.zeros((len(np.atleast_1d(x)), count))
    slope[:, 1:] += scaled
    slope[:, :-1] -= scaled
    return slope


def _bin_cells(knots, low, high, exposure, degree, density=None, order=32):
    nodes, weights = np.polynomial.legendre.leggauss(order)
    cells = []
    for a, b, e in zip(low, high, exposure, strict=True):
        x, w = (a + b) / 2 + (b - a) / 2 * nodes, (b - a) / 2 * weights
        if density is None:
            w = w * e / (b - a)
        else:
            ages, level, years = density
            w = years * w * np.interp(x, ages, level)
        cells.append((spline_basis(x, knots, degree), w))
    return cells


def _bin_means(theta, cells):
    mean, jacobian, curved = [], [], []
    for basis, weights in cells:
        eta = basis @ theta
        active = (eta > -30) & (eta < 10)
        part = weights * np.exp(np.clip(eta, -30, 10))
        mean.append(max(part.sum(), 1e-12))
        jacobian.append((part * active) @ basis)
        curved.append((basis * (part * active)[:, None]).T @ basis)
    return np.array(mean), np.array(jacobian), curved


def fit_spline_rate(
    low: np.ndarray,
    high: np.ndarray,
    counts: np.ndarray,
    exposure: np.ndarray,
    df: int = 8,
    penalty: float = 20.0,
    degree: int = 3,
    monotone_from: float | None = None,
    density: tuple[np.ndarray, np.ndarray, float] | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and knots of a log-rate spline fitted to binned counts.

    The optional tail constraint (log rate not falling from ``monotone_from``) is linear
    in the coefficients; it is met through a log barrier that is tightened step by step.
    """
    knots = spline_knots(low.min(), high.max(), df, degree)
    bends = np.diff(np.eye(df), n=2, axis=0)
    stiffness = penalty * bends.T @ bends
    cells = _bin_cells(knots, low, high, exposure, degree, density)
    slope = None
    theta = np.full(df, np.log(max(counts.sum() / exposure.sum(), 1e-12)))
    if monotone_from is not None:
        slope = spline_slope(np.linspace(monotone_from, high.max(), 16 * df + 1), knots, degree)
        # a straight, slightly rising start is strictly inside the constraint
        centres = np.array([knots[i + 1 : i + degree + 1].mean() for i in range(df)])
        theta = theta + 1e-3 * (centres - centres.mean())

    def loss(t: np.ndarray, barrier: float) -> float:
        mean, _, _ = _bin_means(t, cells)
        value = np.sum(mean - counts * np.log(mean)) + 0.5 * t @ stiffness @ t
        if slope is not None:
            room = slope @ t - 1e-4
            if (room <= 0).any():
                return np.inf
            value -= barrier * np.log(room).sum()
        return float(value)

    for barrier in [0.0] if slope is None else 10.0 ** np.arange(0, -11, -1):
        for _ in range(200):
            mean, jacobian, curved = _bin_means(theta, cells)
            ratio = counts / mean
            gradient = jacobian.T @ (1 - ratio) + stiffness @ theta
            hessian = stiffness + sum(
                (1 - r) * c for r, c in zip(ratio, curved, strict=True)
            ) + jacobian.T @ (jacobian * (ratio / mean)[:, None])
            if slope is not None:
                room = slope @ theta - 1e-4
                gradient = gradient - barrier * slope.T @ (1 / room)
                hessian = hessian + barrier * slope.T @ (slope / (room**2)[:, None])
            shift = max(0.0, 1e-9 - np.linalg.eigvalsh(hessian)[0])
            step = np.linalg.solve(hessian + shift * np.eye(df), gradient)
            size, here = 1.0, loss(theta, barrier)
            if gradient @ step < 1e-13 * max(1.0, abs(here)):
                break
            while size > 1e-12 and loss(theta - size * step, barrier) > here - 1e-4 * size * (
                gradient @ step
            ):
                size /= 2
            if size <= 1e-12:
                break
            theta = theta - size * step
    return theta, knots


def spline_rate(theta: np.ndarray, knots: np.ndarray, ages: np.ndarray, degree: int = 3):
    """Rate at ages; zero outside the fitted range."""
    ages = np.asarray(ages, float)
    rate = np.exp(np.clip(spline_basis(ages, knots, degree) @ theta, -30, 10))
    return np.where((ages >= knots[0]) & (ages <= knots[-1]), rate, 0.0)


def fit_rate_schedule(
    bins: DataFrame,
    series: Sequence[str],
    ages: Sequence[float],
    df: int = 8,
    penalty: float = 20.0,
    monotone_from: float | None = None,
    open_end: float | None = None,
) -> DataFrame:
    """Rates at ``ages`` per series from (age_lower, age_upper, events, exposure) bins."""
    out = _schema(bins, series, ("age", T.DoubleType()), ("rate", T.DoubleType()))
    points = np.asarray(ages, float)

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("age_lower")
        theta, knots = _fit_frame(frame, df, penalty, monotone_from, open_end)
        result = pd.DataFrame({"age": points, "rate": spline_rate(theta, knots, points)})
        for name in series:
            result[name] = frame[name].iloc[0]
        return result[[f.name for f in out.fields]]

    return bins.groupBy(*series).applyInPandas(one, out)


def predict_bins(
    bins: DataFrame,
    series: Sequence[str],
    df: int = 8,
    penalty: float = 20.0,
    monotone_from: float | None = None,
    open_end: float | None = None,
) -> DataFrame:
    """Expected events of every bin under the fitted schedule of its series."""
    out = T.StructType([*bins.schema.fields, T.StructField("expected", T.DoubleType())])

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("age_lower")
        theta, knots = _fit_frame(frame, df, penalty, monotone_from, open_end)
        low, high, _, exposure = _bin_arrays(frame, open_end)
        mean, _, _ = _bin_means(theta, _bin_cells(knots, low, high, exposure, 3))
        return frame.assign(expected=mean)

    return bins.groupBy(*series).applyInPandas(one, out)


def _bin_edges(frame: pd.DataFrame, open_end: float | None) -> tuple[np.ndarray, np.ndarray]:
    low, high = frame["age_lower"].to_numpy(float), frame["age_upper"].to_numpy(float)
    if np.isnan(high).any():
        if open_end is None:
            raise ValueError("an open bin needs open_end")
        high = np.where(np.isnan(high), open_end, high)
    if not np.isfinite(low).all() or (low < 0).any() or (high <= low).any():
        raise ValueError("bins must be finite, nonnegative and rise")
    return low, high


def _bin_arrays(frame: pd.DataFrame, open_end: float | None):
    low, high = _bin_edges(frame, open_end)
    return low, high, frame["events"].to_numpy(float), frame["exposure"].to_numpy(float)


def _fit_frame(frame, df, penalty, monotone_from, open_end):
    low, high, counts, exposure = _bin_arrays(frame, open_end)
    if (counts < 0).any() or (exposure <= 0).any():
        raise ValueError("events must be nonnegative and exposure positive")
    return fit_spline_rate(low, high, counts, exposure, df, penalty, 3, monotone_from)


# --- total-preserving ungrouping -----------------------------------------------


def _roughness(grid: np.ndarray) -> np.ndarray:
    if grid.size == 2:
        return np.eye(2)
    h0, h1 = np.diff(grid)[:-1], np.diff(grid)[1:]
    rows = np.arange(grid.size - 2)
    bend = np.zeros((grid.size - 2, grid.size))
    bend[rows, rows] = 2 / (h0 * (h0 + h1))
    bend[rows, rows + 1] = -2 / (h0 * h1)
    bend[rows, rows + 2] = 2 / (h1 * (h0 + h1))
    energy = bend.T @ (0.5 * (h0 + h1)[:, None] * bend)
    return energy / max(np.trace(energy) / grid.size, 1.0) + 1e-12 * np.eye(grid.size)


def _bin_matrix(grid: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Integral of a piecewise linear curve over each bin, as weights of its nodes."""
    x0, x1 = grid[:-1], grid[1:]
    start, end = np.maximum(low[:, None], x0), np.minimum(high[:, None], x1)
    z0, z1 = start - x0, np.maximum(end, start) - x0
    right = (z1**2 - z0**2) / (2 * (x1 - x0))
    matrix = np.zeros((low.size, grid.size))
    matrix[:, :-1] += (z1 - z0) - right
    matrix[:, 1:] += right
    return matrix


def smooth_density(grid: np.ndarray, low: np.ndarray, high: np.ndarray, totals: np.ndarray):
    """Smoothest nonnegative curve whose bin integrals equal the totals.

    Quadratic programme solved by a primal-dual interior point: every step solves the
    equality-constrained system, so the totals are met to rounding.
    """
    scale = float(totals.max()) or 1.0
    matrix, target, energy = _bin_matrix(grid, low, high), totals / scale, _roughness(grid)
    n, m = grid.size, totals.size
    x = np.full(n, max(target.sum() / (grid[-1] - grid[0]), 1e-3))
    s, y = np.ones(n), np.zeros(m)
    for _ in range(200):
        dual = energy @ x - matrix.T @ y - s
        primal = matrix @ x - target
        gap = x @ s / n
        if max(np.abs(dual).max(), np.abs(primal).max()) < 1e-12 and gap < 1e-14:
            break

        def direction(centre):
            hessian = energy + np.diag(s / x)
            system = np.block([[hessian, -matrix.T], [matrix, np.zeros((m, m))]])
            rhs = np.concatenate([-dual - s + centre / x, -primal])
            try:
                solved = np.linalg.solve(system, rhs)
            except np.linalg.LinAlgError:
                solved = np.linalg.lstsq(system, rhs, rcond=None)[0]
            dx = solved[:n]
            return dx, solved[n:], (centre - s * dx) / x - s

        def longest(v, dv):
            falling = dv < 0
            return min(1.0, 0.9995 * float((-v[falling] / dv[falling]).min())) if falling.any() else 1.0

        dx, _, ds = direction(0.0)
        ahead = (x + longest(x, dx) * dx) @ (s + longest(s, ds) * ds) / n
        dx, dy, ds = direction(gap * min(max((ahead / gap) ** 3, 1e-6), 1.0))
        size = min(longest(x, dx), longest(s, ds))
        x, y, s = x + size * dx, y + size * dy, s + size * ds
    # last correction of the totals, spread over nodes by their size
    spread = matrix * x
    correction = np.linalg.lstsq(spread @ matrix.T, target - matrix @ x, rcond=None)[0]
    x = np.maximum(x * (1 + matrix.T @ correction), 0.0)
    return x * scale, matrix


def ungroup(
    bins: DataFrame,
    series: Sequence[str],
    nodes: Sequence[float],
    value: str = "count",
    open_end: float | None = None,
    tolerance: float = 1e-7,
) -> DataFrame:
    """Density at the grid nodes per series; bin totals are preserved to ``tolerance``."""
    grid = np.asarray(nodes, float)
    if not np.isfinite(grid).all() or (np.diff(grid) <= 0).any() or tolerance <= 0:
        raise ValueError("nodes must be finite and increase; tolerance must be positive")
    out = _schema(bins, series, ("node", T.DoubleType()), ("density", T.DoubleType()))

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("age_lower")
        low, high = _bin_edges(frame, open_end)
        if low.min() < grid[0] or high.max() > grid[-1]:
            raise ValueError("every bin must lie inside the grid")
        totals = frame[value].to_numpy(float)
        if (totals < 0).any() or not np.isfinite(totals).all():
            raise ValueError("totals must be finite and nonnegative")
        density, matrix = smooth_density(grid, low, high, totals)
        if (np.abs(matrix @ density - totals) > tolerance).any():
            raise ValueError("bin totals could not be preserved")
        result = pd.DataFrame({"node": grid, "density": density})
        for name in series:
            result[name] = frame[name].iloc[0]
        return result[[f.name for f in out.fields]]

    return bins.groupBy(*series).applyInPandas(one, out)


def refined(nodes: Sequence[float], factor: int = 2) -> list[float]:
    """Grid with every cell cut into ``factor`` equal parts."""
    if factor < 2:
        raise ValueError("factor must be at least two")
    grid = np.asarray(nodes, float)
    steps = np.arange(factor) / factor
    inner = grid[:-1, None] + np.diff(grid)[:, None] * steps
    return [*inner.ravel().tolist(), float(grid[-1])]


def compare_ungrouping(
    bins: DataFrame,
    series: Sequence[str],
    nodes: Sequence[float],
    value: str = "count",
    open_end: float | None = None,
    factor: int = 2,
) -> DataFrame:
    """Difference of the curves on a grid and on its refinement, at the shared nodes."""
    coarse = ungroup(bins, series, nodes, value, open_end)
    fine = ungroup(bins, series, refined(nodes, factor), value, open_end)
    return grid_difference(coarse, fine, [*series, "node"], series, "density")
