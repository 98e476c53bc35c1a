"""The segment equations: as Spark columns, as numpy functions, and their fits."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

OMEGA = 2 * math.pi / 24
#: The equations in the order in which they are tried, with the points each needs.
HARMONIC_SET = {"harmonic": 24, "linear_harmonic": 24, "damped_harmonic": 24, "exponential": 3, "linear": 2, "constant": 1}
PLAIN_SET = {"exponential": 3, "linear": 2, "constant": 1}
FIT = "eq_type string, L double, c double, lam double, A double, B double, rms double, n_points long"


def value_at(fit: Column, t: Column) -> Column:
    """The value of a fit (a struct column of FIT) at step t."""
    eq, low, c, lam, a, b = (fit[k] for k in ("eq_type", "L", "c", "lam", "A", "B"))
    wave = a * F.cos(F.lit(OMEGA) * t) + b * F.sin(F.lit(OMEGA) * t)
    return (
        F.when(eq == "linear", low + c * t)
        .when(eq == "exponential", low + a * F.exp(-lam * t))
        .when(eq == "harmonic", low + wave)
        .when(eq == "linear_harmonic", low + c * t + wave)
        .when(eq == "damped_harmonic", low + F.exp(-lam * t) * wave)
        .otherwise(low)
    )


@dataclass(frozen=True)
class Fit:
    eq_type: str
    L: float = 0.0
    c: float = 0.0
    lam: float = 0.0
    A: float = 0.0
    B: float = 0.0
    rms: float = 0.0
    n_points: int = 0

    def at(self, t):
        t = np.asarray(t, dtype=float)
        wave = self.A * np.cos(OMEGA * t) + self.B * np.sin(OMEGA * t)
        return {
            "linear": lambda: self.L + self.c * t,
            "exponential": lambda: self.L + self.A * np.exp(-self.lam * t),
            "harmonic": lambda: self.L + wave,
            "linear_harmonic": lambda: self.L + self.c * t + wave,
            "damped_harmonic": lambda: self.L + np.exp(-self.lam * t) * wave,
        }.get(self.eq_type, lambda: np.full_like(t, self.L))()


def _linear_in(columns: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, float]:
    design = np.column_stack(columns)
    w = np.linalg.lstsq(design, y, rcond=None)[0]
    return w, float(np.sqrt(np.mean((y - design @ w) ** 2)))


def _best_rate(loss, low: float, high: float) -> float:
    """The rate between low and high of least loss: a grid on a log scale, then golden sections about its best point."""
    grid = np.concatenate([[low], np.geomspace(max(low, 1e-6), high, 25)])
    values = [loss(x) for x in grid]
    k = int(np.argmin(values))
    a, z = grid[max(k - 1, 0)], grid[min(k + 1, len(grid) - 1)]
    g = (math.sqrt(5) - 1) / 2
    p, q = z - g * (z - a), a + g * (z - a)
    fp, fq = loss(p), loss(q)
    for _ in range(40):
        if fp <= fq:
            z, q, fq = q, p, fp
            p = z - g * (z - a)
            fp = loss(p)
        else:
            a, p, fp = p, q, fq
            q = a + g * (z - a)
            fq = loss(q)
        if z - a < 1e-9 * (1 + abs(z)):
            break
    best = (a + z) / 2
    return float(best if loss(best) <= values[k] else grid[k])


def _grid(low: float, high: float) -> np.ndarray:
    return np.concatenate([[low], np.geomspace(max(low, 1e-6), high, 25)])


def _refined(losses, grid: np.ndarray, values: np.ndarray) -> float:
    """The rate of least loss about the best point of a grid: rounds of 25 rates between its neighbours, all evaluated at once."""
    k = int(np.argmin(values))
    a, z = grid[max(k - 1, 0)], grid[min(k + 1, len(grid) - 1)]
    best, least = grid[k], float(losses(grid[k : k + 1])[0])
    while z - a >= 1e-9 * (1 + abs(z)):
        rates = np.linspace(a, z, 25)
        found = losses(rates)
        j = int(np.argmin(found))
        if found[j] < least:
            best, least = rates[j], float(found[j])
        a, z = rates[max(j - 1, 0)], rates[min(j + 1, 24)]
    return float(best)


def _exponential(t: np.ndarray, y: np.ndarray, high: float, grid_losses: np.ndarray | None = None) -> Fit:
    """L + (y0 - L) exp(-lam t). For a given rate the best L is a ratio of sums, so only the rate is searched."""
    y0 = float(y[0])
    u = y - y0

    def losses(rates: np.ndarray) -> np.ndarray:
        g = -np.expm1(-np.outer(rates, t))
        gg = np.einsum("ij,ij->i", g, g)
        d = np.where(gg > 1e-300, g @ u / np.where(gg > 1e-300, gg, 1), 0.0)
        off = u - d[:, None] * g
        return np.einsum("ij,ij->i", off, off) / len(u)

    grid = _grid(1e-6, high)
    lam = _refined(losses, grid, losses(grid) if grid_losses is None else grid_losses)
    g = -np.expm1(-lam * t)
    gg = float(g @ g)
    d = float(g @ u) / gg if gg > 1e-300 else 0.0
    rms = float(np.sqrt(np.mean((u - d * g) ** 2)))
    return Fit("exponential", L=y0 + d, lam=lam, A=-d, rms=rms, n_points=len(y))


def _damped(t: np.ndarray, y: np.ndarray, grid_losses: np.ndarray | None = None) -> Fit:
    """For a given rate L, A and B follow by linear least squares, so only the rate is searched."""
    one, cos, sin = np.ones_like(t), np.cos(OMEGA * t), np.sin(OMEGA * t)

    def losses(rates: np.ndarray) -> np.ndarray:
        e = np.exp(-np.outer(rates, t))
        q = np.linalg.qr(np.stack([np.broadcast_to(one, e.shape), e * cos, e * sin], axis=2))[0]
        off = y - np.einsum("rnk,rk->rn", q, np.einsum("rnk,n->rk", q, y))
        return np.einsum("ij,ij->i", off, off) / len(y)

    grid = _grid(0.0, 5.0)
    lam = _refined(losses, grid, losses(grid) if grid_losses is None else grid_losses)
    e = np.exp(-lam * t)
    w, rms = _linear_in([one, e * cos, e * sin], y)
    return Fit("damped_harmonic", L=float(w[0]), lam=lam, A=float(w[1]), B=float(w[2]), rms=rms, n_points=len(y))


#: Places of the basis 1, t, cos, sin that the equations linear in their parameters take.
_LINEAR = {"harmonic": (0, 2, 3), "linear_harmonic": (0, 1, 2, 3), "linear": (0, 1), "constant": (0,)}
#: Below this share of the mean square the sums have lost the digits of a residual, and it is taken from the points.
_LOST = 1e-9


class Moments:
    """Points of one segment, at steps 0, 1, 2 ..., and their sums: of 1, t, cos, sin and their products, of these times y, and of
    y squared; and for each rate of a grid the sums that the equations with a rate need. A point adds to them once, so a fit that is linear
    in its parameters takes as long for many points as for few, and so does the search's grid. Missing points (NaN) take a step.
    """

    def __init__(self, kinds: dict[str, int] = HARMONIC_SET, fastest: float = 10.0):
        self.kinds, self.fastest = kinds, fastest
        self.n_steps, self.n, self.first = 0, 0, 0.0
        self._t: list[np.ndarray] = []
        self._y: list[np.ndarray] = []
        self.gram, self.right, self.square = np.zeros((4, 4)), np.zeros(4), 0.0
        self.slow, self.turning = _grid(1e-6, fastest), _grid(0.0, 5.0)
        self.gg, self.gu = np.zeros(26), np.zeros(26)
        self.wave, self.wave_u = np.zeros((26, 3, 3)), np.zeros((26, 3))

    def add(self, y: np.ndarray) -> None:
        """The next steps' values."""
        y = np.asarray(y, dtype=float)
        t = np.arange(self.n_steps, self.n_steps + len(y), dtype=float)
        self.n_steps += len(y)
        ok = np.isfinite(y)
        t, y = t[ok], y[ok]
        if not len(y):
            return
        if not self.n:
            self.first = float(y[0])
        self.n += len(y)
        self._t.append(t)
        self._y.append(y)
        u = y - self.first
        basis = np.stack([np.ones_like(t), t, np.cos(OMEGA * t), np.sin(OMEGA * t)])
        self.gram += basis @ basis.T
        self.right += basis @ u
        self.square += float(u @ u)
        if "exponential" in self.kinds:
            g = -np.expm1(-np.outer(self.slow, t))
            self.gg += np.einsum("ij,ij->i", g, g)
            self.gu += g @ u
        if "damped_harmonic" in self.kinds:
            e = np.exp(-np.outer(self.turning, t))
            w = np.stack([np.broadcast_to(basis[0], e.shape), e * basis[2], e * basis[3]], axis=1)
            self.wave += w @ w.transpose(0, 2, 1)
            self.wave_u += w @ u

    def points(self) -> tuple[np.ndarray, np.ndarray]:
        """Steps and values of all points that aren't missing."""
        if len(self._t) > 1:
            self._t, self._y = [np.concatenate(self._t)], [np.concatenate(self._y)]
        return (self._t[0], self._y[0]) if self._t else (np.zeros(0), np.zeros(0))

    def linear(self, kind: str) -> Fit:
        """The fit of an equation that is linear in its parameters, from the sums."""
        at = list(_LINEAR[kind])
        size = np.sqrt(np.maximum(self.gram.diagonal()[at], 1e-300))
        w = np.linalg.lstsq(self.gram[np.ix_(at, at)] / np.outer(size, size), self.right[at] / size, rcond=1e-14)[0] / size
        mean = (self.square - float(w @ self.right[at])) / self.n
        if mean > _LOST * self.square / self.n:
            rms = math.sqrt(mean)
        else:
            t, y = self.points()
            basis = (np.ones_like(t), t, np.cos(OMEGA * t), np.sin(OMEGA * t))
            w, rms = _linear_in([basis[i] for i in at], y - self.first)
        full = np.zeros(4)
        full[at] = w
        return Fit(kind, L=full[0] + self.first, c=full[1], A=full[2], B=full[3], rms=rms)

    def grid_losses(self, kind: str) -> np.ndarray:
        """Mean square errors at the grid's rates, from the sums."""
        if kind == "exponential":
            some = self.gg > 1e-300
            return (self.square - np.where(some, self.gu**2 / np.where(some, self.gg, 1), 0.0)) / self.n
        size = np.sqrt(np.maximum(np.einsum("rii->ri", self.wave), 1e-300))
        inverse = np.linalg.pinv(self.wave / (size[:, :, None] * size[:, None, :]), rcond=1e-13, hermitian=True)
        right = self.wave_u / size
        return (self.square - np.einsum("ri,rij,rj->r", right, inverse, right)) / self.n

    def best(self) -> Fit:
        """The equation of least rms; the earlier of the kinds on a tie."""
        best: Fit | None = None
        for kind, points in self.kinds.items():
            if self.n < max(points, 1):
                continue
            if kind in _LINEAR:
                fit = self.linear(kind)
            elif kind == "damped_harmonic":
                fit = _damped(*self.points(), self.grid_losses(kind))
            else:
                fit = _exponential(*self.points(), self.fastest, self.grid_losses(kind))
            if best is None or fit.rms < best.rms:
                best = fit
        f = best or Fit("constant", L=self.first + (self.right[0] / self.n if self.n else 0.0))
        return Fit(f.eq_type, float(f.L), float(f.c), float(f.lam), float(f.A), float(f.B), float(f.rms), self.n)


def best_fit(y: np.ndarray, kinds: dict[str, int] = HARMONIC_SET, fastest: float = 10.0) -> Fit:
    """The equation of least rms over steps 0, 1, 2 ...; the earlier of ``kinds`` on a tie. NaNs are left out."""
    m = Moments(kinds, fastest)
    m.add(y)
    return m.best()


class Walk:
    """A walk along one series, fed in order in any portions. A segment's equation is fitted on its first points; where a step
    misses it by more than the tolerance, it is fitted anew on all points so far; where the new one misses that step too, a segment starts.
    """

    def __init__(self, tolerance: float, first: int = 24, kinds: dict[str, int] = HARMONIC_SET, fastest: float = 10.0):
        self.tolerance, self.first, self.kinds, self.fastest = tolerance, first, kinds, fastest
        self.start, self.open, self.at = 0, np.zeros(0), 0  # of the open segment: its place, its points, and how many of them the fit is known to hold
        self.fit: Fit | None = None
        self.moments: Moments | None = None

    def feed(self, y: np.ndarray, last: bool = False) -> list[tuple[int, int, Fit]]:
        """(start, end, fit) of the segments that the points close; with ``last`` the open one too."""
        self.open = np.concatenate([self.open, np.asarray(y, dtype=float)])
        out = []
        while len(self.open):
            if self.fit is None:
                if len(self.open) < self.first and not last:
                    break
                self.at = min(self.first, len(self.open))
                self.moments = None
                self.fit = self._fitted(self.at)
            ahead = np.arange(self.at, len(self.open))
            miss = np.abs(self.open[self.at :] - self.fit.at(ahead)) > self.tolerance  # steps up to the next miss are found at once
            if not miss.any():
                self.at = len(self.open)
                if last:
                    out.append((self.start, self.start + self.at - 1, self.fit))
                    self.open = self.open[:0]
                break
            k = self.at + int(np.argmax(miss))
            new = self._fitted(k + 1)
            if abs(self.open[k] - float(new.at(float(k)))) > self.tolerance:
                out.append((self.start, self.start + k - 1, self.fit))
                self.start, self.open, self.fit = self.start + k, self.open[k:], None
            else:
                self.fit, self.at = new, k + 1
        return out

    def _fitted(self, n: int) -> Fit:
        """The fit of the first n points of the open segment; the sums have those of the fit before it already."""
        if self.moments is None:
            self.moments = Moments(self.kinds, self.fastest)
        self.moments.add(self.open[self.moments.n_steps : n])
        return self.moments.best()


# Equations of four kinds on standardised values, for segments of a whole system of channels.

#: The kinds by number, with the points each needs and its parameters beyond the start value.
DYNAMICS = {"level": (1, 1), "linear": (2, 1), "exponential": (3, 2), "oscillatory": (10, 5)}
PENALTY = 0.15
FASTEST, HIGHEST = 10.0, math.pi
DYN = "kind string, L double, c double, lam double, omega double, A double, B double, mse double, x0 double, std double"


def dominant_omega(y: np.ndarray) -> float:
    """The frequency of the largest Fourier term but the mean, within [0.001, pi]; 0.1 for fewer than four points."""
    if len(y) < 4:
        return 0.1
    size = np.abs(np.fft.rfft(y - y.mean()))
    k = int(np.argmax(size[1:])) + 1
    return float(np.clip(2 * math.pi * k / len(y), 1e-3, HIGHEST))


def dynamics_value(d: dict, t, x0: float = 0.0):
    """A standardised dynamics at steps t from standardised start x0."""
    t = np.asarray(t, dtype=float)
    if d["kind"] == "level":
        return np.full_like(t, d["L"])
    if d["kind"] == "linear":
        return x0 + d["c"] * t
    if d["kind"] == "exponential":
        return d["L"] + (x0 - d["L"]) * np.exp(-d["lam"] * t)
    return d["L"] + np.exp(-d["lam"] * t) * (d["A"] * np.cos(d["omega"] * t) + d["B"] * np.sin(d["omega"] * t))


def fit_dynamics(x: np.ndarray) -> dict:
    """The kind of least mean square error after a mark-up of 15 % per parameter beyond one; the simpler on a tie."""
    ok = np.isfinite(x)
    first = float(x[0]) if len(x) and np.isfinite(x[0]) else (float(x[ok][0]) if ok.any() else 0.0)
    std = float(x[ok].std()) if ok.any() else 0.0
    scale, mean = (std if std > 1e-8 else 1.0), (float(x[ok].mean()) if ok.any() else 0.0)
    base = {"kind": "level", "L": 0.0, "c": 0.0, "lam": 0.0, "omega": 0.0, "A": 0.0, "B": 0.0, "mse": 0.0, "x0": first, "std": std}
    if not ok.any():
        return base
    t, y = np.arange(len(x), dtype=float)[ok], (x[ok] - mean) / scale
    found = [base | {"L": float(y.mean()), "mse": float(y.var())}]
    if len(y) >= 2:
        w, rms = _linear_in([np.ones_like(t), t], y)
        found.append(base | {"kind": "linear", "c": float(w[1]), "mse": rms**2})
    if len(y) >= 3:
        f = _exponential(t - t[0], y, FASTEST)
        found.append(base | {"kind": "exponential", "L": f.L, "lam": f.lam, "mse": f.rms**2})
    if len(y) >= 10:
        omega0 = dominant_omega(y)
        best = None
        for omega in np.clip(omega0 * np.linspace(0.8, 1.2, 9), 1e-3, HIGHEST):
            cos, sin, one = np.cos(omega * t), np.sin(omega * t), np.ones_like(t)
            lam = _best_rate(lambda r, c=cos, s=sin, o=one: _linear_in([o, np.exp(-r * t) * c, np.exp(-r * t) * s], y)[1], 1e-6, FASTEST)
            e = np.exp(-lam * t)
            w, rms = _linear_in([one, e * cos, e * sin], y)
            if best is None or rms < best[0]:
                best = (rms, base | {"kind": "oscillatory", "L": float(w[0]), "lam": lam, "omega": float(omega), "A": float(w[1]), "B": float(w[2]), "mse": rms**2})
        found.append(best[1])
    marked = [d["mse"] * (1 + PENALTY * (DYNAMICS[d["kind"]][1] - 1)) for d in found]
    return found[int(np.argmin(marked))]
