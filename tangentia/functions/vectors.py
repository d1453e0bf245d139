"""Geometries of vectors: flat space, spheres, the simplex, hyperbolic spaces, the torus."""

from __future__ import annotations


import numpy as np

from tangentia.functions.base import (
    ULP,
    Geometry,
    acosh_over_root,
    angle_over_sine,
    atanhc_of,
    cos_of,
    cosh_of,
    dots,
    sinc_of,
    sinhc_of,
    stretched,
    tanhc_of,
    wrap,
)

HJ = {**Geometry.kinds, "hessian": "exact", "rgrad_jvp": "exact"}


class Euclidean(Geometry):
    name = "euclidean"
    kinds = HJ

    @property
    def dim(self):
        return self.length

    def belongs(self, x, atol=None):
        return np.isfinite(x).all(axis=tuple(range(-self.axes, 0)))

    def project(self, x):
        return np.asarray(x, float)

    def tangent_project(self, x, u):
        return np.asarray(u, float)

    def exp(self, x, u):
        return x + u

    def log(self, x, y):
        return y - x

    def transport(self, x, y, u):
        return u + 0 * (x + y)

    def pair_mean(self, x, y):
        return 0.5 * (x + y)


class Sphere(Geometry):
    """Unit vectors; log and transport are NaN at the antipode."""

    name = "sphere"
    kinds = HJ

    def __init__(self, n: int, **more):
        super().__init__(n, **more)
        if n < 2:
            raise ValueError("a sphere needs two coordinates at least")

    @property
    def dim(self):
        return self.size[0] - 1

    def belongs(self, x, atol=None):
        return np.abs(np.sqrt(dots(x, x, 1)) - 1) <= (atol or self.atol)

    def project(self, x):
        r = np.linalg.norm(x, axis=-1, keepdims=True)
        first = np.zeros(self.shape)
        first[0] = 1
        return np.where(r <= self.eps, first, x / np.where(r <= self.eps, 1, r))

    def tangent_project(self, x, u):
        return u - dots(x, u, 1)[..., None] * x

    def exp(self, x, u):
        s = dots(u, u, 1)[..., None]
        return self.project(cos_of(s) * x + sinc_of(s) * u)

    def _towards(self, x, y):
        c = dots(x, y, 1)[..., None]
        away = y - c * x
        s2 = dots(away, away, 1)[..., None]
        cut = (c < 0) & (np.sqrt(s2) <= 64 * ULP)
        return c, away, s2, cut

    def log(self, x, y):
        c, away, s2, cut = self._towards(x, y)
        return np.where(cut, np.nan, angle_over_sine(c, s2) * away)

    def squared_dist(self, x, y):
        return np.arccos(np.clip(dots(x, y, 1), -1, 1)) ** 2

    def dist(self, x, y):
        return np.arccos(np.clip(dots(x, y, 1), -1, 1))

    def transport(self, x, y, u):
        _, _, _, cut = self._towards(x, y)
        c = dots(x, y, 1)[..., None]
        return np.where(cut, np.nan, u - (dots(y, u, 1)[..., None] / np.where(cut, 1, 1 + c)) * (x + y))

    def geodesic_flow(self, x, v, s):
        """(position, velocity) after time s."""
        r2 = dots(v, v, 1)[..., None]
        s = np.asarray(s, float)[..., None]
        a, b = cos_of(r2 * s * s), sinc_of(r2 * s * s)
        return self.project(a * x + s * b * v), a * v - s * b * r2 * x

    def ehess_to_rhess(self, x, g, h, u):
        return self.tangent_project(x, h) - dots(x, g, 1)[..., None] * u


class SphereExtrinsic(Sphere):
    name = "sphere_extrinsic"

    def embed(self, x):
        return x

    def from_embedding(self, z):
        return self.project(z)

    def squared_chordal_dist(self, x, y):
        return dots(x - y, x - y, 1)

    def chordal_dist(self, x, y):
        return np.sqrt(self.squared_chordal_dist(x, y))

    def extrinsic_mean(self, points, weights=None):
        m = np.average(points, axis=0, weights=weights)
        r = np.linalg.norm(m)
        return m / r if r > self.eps else np.full(self.shape, np.nan)


class Oblique(Geometry):
    """n x m matrices with unit columns: a product of spheres."""

    name = "oblique"

    def __init__(self, n: int, m: int, **more):
        super().__init__(n, m, **more)
        self.column = Sphere(n, atol=self.atol)

    @property
    def dim(self):
        return self.size[1] * (self.size[0] - 1)

    def _by_column(self, f, *a):
        return np.swapaxes(f(*(np.swapaxes(x, -1, -2) for x in a)), -1, -2)

    def belongs(self, x, atol=None):
        return self.column.belongs(np.swapaxes(x, -1, -2), atol or self.atol).all(-1)

    def project(self, x):
        return self._by_column(self.column.project, x)

    def tangent_project(self, x, u):
        return self._by_column(self.column.tangent_project, x, u)

    def exp(self, x, u):
        return self._by_column(self.column.exp, x, u)

    def log(self, x, y):
        return self._by_column(self.column.log, x, y)

    def squared_dist(self, x, y):
        return self.column.squared_dist(np.swapaxes(x, -1, -2), np.swapaxes(y, -1, -2)).sum(-1)

    def transport(self, x, y, u):
        return self._by_column(self.column.transport, x, y, u)


class ProbabilitySimplex(Geometry):
    """Positive vectors of sum 1 with the Fisher-Rao metric, by way of the sphere of roots."""

    name = "simplex"
    eps = 1e-10

    @property
    def dim(self):
        return self.size[0] - 1

    def belongs(self, x, atol=None):
        return (x.min(-1) > 0) & (np.abs(x.sum(-1) - 1) <= (atol or self.atol))

    def project(self, x):
        p = np.maximum(x, max(self.eps, 32 * ULP))
        return p / p.sum(-1, keepdims=True)

    def tangent_project(self, x, u):
        return u - x * u.sum(-1, keepdims=True)

    def is_tangent(self, x, u, atol=None):
        return np.abs(u.sum(-1)) <= (atol or self.atol) * np.maximum(1, np.abs(u).max(-1))

    def inner(self, x, u, v):
        return (u * v / x).sum(-1)

    def exp(self, x, u):
        r = np.sqrt(x)
        s = 0.25 * self.inner(x, u, u)[..., None]
        z = cos_of(s) * r + sinc_of(s) * u / (2 * r)
        out = z * z
        return np.where((z <= 0).any(-1, keepdims=True), np.nan, out / out.sum(-1, keepdims=True))

    def retr(self, x, u, step=1.0):
        return self.project(x + stretched(step, 1) * u)

    def log(self, x, y):
        rx, ry = np.sqrt(x), np.sqrt(y)
        c = (rx * ry).sum(-1, keepdims=True)
        away = ry - c * rx
        f = angle_over_sine(c, dots(away, away, 1)[..., None])
        return self.tangent_project(x, 2 * f * rx * away)

    def squared_dist(self, x, y):
        return 4 * np.arccos(np.clip(np.sqrt(x * y).sum(-1), -1, 1)) ** 2

    def dist(self, x, y):
        return 2 * np.arccos(np.clip(np.sqrt(x * y).sum(-1), -1, 1))

    def transport(self, x, y, u):
        rx, ry = np.sqrt(x), np.sqrt(y)
        a = u / (2 * rx)
        moved = a - (dots(ry, a, 1) / (1 + dots(rx, ry, 1)))[..., None] * (rx + ry)
        return self.tangent_project(y, 2 * ry * moved)

    def egrad_to_rgrad(self, x, g):
        return x * (g - dots(x, g, 1)[..., None])

    def random_point(self, rng, n):
        return self.project(rng.dirichlet(np.full(self.size[0], 2.0), n))


class PoincareBall(Geometry):
    name = "poincare"
    eps = 1e-10

    @property
    def dim(self):
        return self.size[0]

    def belongs(self, x, atol=None):
        return dots(x, x, 1) < 1

    def project(self, x):
        r = np.linalg.norm(x, axis=-1, keepdims=True)
        most = 1 - self.margin
        return x * np.where(r > most, most / np.where(r > 0, r, 1), 1)

    def tangent_project(self, x, u):
        return np.asarray(u, float) + 0 * x

    def conformal_factor(self, x):
        return 2 / np.maximum(1 - dots(x, x, 1), ULP)

    def mobius_add(self, x, y):
        xy, x2, y2 = dots(x, y, 1)[..., None], dots(x, x, 1)[..., None], dots(y, y, 1)[..., None]
        return ((1 + 2 * xy + y2) * x + (1 - x2) * y) / np.maximum(1 + 2 * xy + x2 * y2, ULP)

    def inner(self, x, u, v):
        return self.conformal_factor(x) ** 2 * dots(u, v, 1)

    def exp(self, x, u):
        half = 0.5 * self.conformal_factor(x)[..., None] * u
        return self.project(self.mobius_add(x, tanhc_of(dots(half, half, 1))[..., None] * half))

    def log(self, x, y):
        z = self.mobius_add(-x, y)
        return (2 / self.conformal_factor(x) * atanhc_of(dots(z, z, 1)))[..., None] * z

    def squared_dist(self, x, y):
        z = self.mobius_add(-x, y)
        s = dots(z, z, 1)
        return 4 * s * atanhc_of(s) ** 2

    def gyration(self, x, y, u):
        return self.mobius_add(-self.mobius_add(x, y), self.mobius_add(x, self.mobius_add(y, u)))

    def transport(self, x, y, u):
        # The gyration is linear in u; a small multiple stays within the ball.
        r = np.maximum(np.linalg.norm(u, axis=-1, keepdims=True), 1e-300)
        turned = self.gyration(y, -x, 0.5 * u / r) * r / 0.5
        return (self.conformal_factor(x) / self.conformal_factor(y))[..., None] * turned

    def egrad_to_rgrad(self, x, g):
        return g / self.conformal_factor(x)[..., None] ** 2

    def random_point(self, rng, n):
        v = rng.normal(size=(n, *self.shape))
        return 0.8 * rng.random((n, 1)) ** (1 / self.size[0]) * v / np.linalg.norm(v, axis=-1, keepdims=True)


class Hyperboloid(Geometry):
    """The upper sheet, time first, with the Lorentz form."""

    name = "hyperboloid"

    @property
    def dim(self):
        return self.size[0] - 1

    def lorentz_inner(self, u, v):
        return dots(u, v, 1) - 2 * u[..., 0] * v[..., 0]

    def belongs(self, x, atol=None):
        return (x[..., 0] > 0) & (np.abs(self.lorentz_inner(x, x) + 1) <= (atol or self.atol) + 32 * ULP * dots(x, x, 1))

    def project(self, x):
        out = np.array(x, float)
        out[..., 0] = np.sqrt(1 + (out[..., 1:] ** 2).sum(-1))
        return out

    def tangent_project(self, x, u):
        return u + self.lorentz_inner(x, u)[..., None] * x

    def inner(self, x, u, v):
        return self.lorentz_inner(u, v)

    def exp(self, x, u):
        s = np.maximum(self.lorentz_inner(u, u), 0)[..., None]
        return self.project(cosh_of(s) * x + sinhc_of(s) * u)

    def _alpha(self, x, y):
        return np.maximum(-self.lorentz_inner(x, y), 1)

    def log(self, x, y):
        a = self._alpha(x, y)[..., None]
        return self.tangent_project(x, acosh_over_root(a) * (y - a * x))

    def squared_dist(self, x, y):
        return np.arccosh(self._alpha(x, y)) ** 2

    def dist(self, x, y):
        return np.arccosh(self._alpha(x, y))

    def transport(self, x, y, u):
        f = self.lorentz_inner(y, u) / (1 - self.lorentz_inner(x, y))
        return self.tangent_project(y, u + f[..., None] * (x + y))

    def geodesic_flow(self, x, v, s):
        r2 = np.maximum(self.lorentz_inner(v, v), 0)[..., None]
        s = np.asarray(s, float)[..., None]
        a, b = cosh_of(r2 * s * s), sinhc_of(r2 * s * s)
        return self.project(a * x + s * b * v), a * v + s * b * r2 * x

    def to_poincare(self, x):
        return x[..., 1:] / (1 + x[..., :1])

    def from_poincare(self, p):
        p = PoincareBall(self.size[0] - 1, atol=self.atol).project(p)
        r = dots(p, p, 1)[..., None]
        return np.concatenate([(1 + r) / (1 - r), 2 * p / (1 - r)], -1)

    def egrad_to_rgrad(self, x, g):
        g = np.array(g, float)
        g[..., 0] *= -1
        return self.tangent_project(x, g)

    def random_point(self, rng, n):
        return self.project(np.concatenate([np.ones((n, 1)), rng.normal(size=(n, self.size[0] - 1))], -1))


class Torus(Geometry):
    """Angles in [-pi, pi)."""

    name = "torus"
    kinds = HJ

    @property
    def dim(self):
        return self.size[0]

    def belongs(self, x, atol=None):
        a = atol or self.atol
        return ((x >= -np.pi - a) & (x < np.pi + a)).all(-1)

    def wrap(self, x):
        return wrap(x)

    def project(self, x):
        return wrap(np.asarray(x, float))

    def tangent_project(self, x, u):
        return np.asarray(u, float) + 0 * x

    def exp(self, x, u):
        return wrap(x + u)

    def log(self, x, y):
        return wrap(y - x)

    def transport(self, x, y, u):
        return u + 0 * (x + y)

    def random_point(self, rng, n):
        return rng.uniform(-np.pi, np.pi, (n, *self.shape))


def hyperspherical(angles: np.ndarray) -> np.ndarray:
    """Unit vectors of n - 1 angles: products of sines, each times the next cosine."""
    s = np.concatenate([np.ones((*angles.shape[:-1], 1)), np.cumprod(np.sin(angles), -1)], -1)
    return s * np.concatenate([np.cos(angles), np.ones((*angles.shape[:-1], 1))], -1)


