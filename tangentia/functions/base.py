"""The contract of a geometry's batched kernels, and what follows from it.

A point is an array that ends in the geometry's shape; any leading axes are a batch, and
one point meets many by broadcasting. Capabilities name how an operation relates to the
Riemannian one; operators ask for what they need before any job runs.
"""

from __future__ import annotations

import math

import numpy as np

ATOL = 1e-6
ULP = np.finfo(float).eps


class CapabilityError(ValueError):
    """A geometry offers no exact form of an operation that an operator needs."""


def dots(x: np.ndarray, y: np.ndarray, axes: int) -> np.ndarray:
    """Sum of products over the last `axes` axes."""
    return (x * y).sum(axis=tuple(range(-axes, 0)))


def stretched(a: np.ndarray, axes: int) -> np.ndarray:
    """A scalar per point, ready to multiply points."""
    return np.asarray(a)[(...,) + (None,) * axes]


# Functions of a squared radius whose removable singularity at 0 a series fills.
_SMALL = math.sqrt(ULP)


def _filled(s: np.ndarray, full, series) -> np.ndarray:
    s = np.asarray(s, float)
    small = s <= _SMALL
    return np.where(small, series(s), full(np.sqrt(np.where(small, 0.25, s))))


def cos_of(s):
    return _filled(s, np.cos, lambda s: 1 - s / 2)


def sinc_of(s):
    return _filled(s, lambda r: np.sin(r) / r, lambda s: 1 - s / 6)


def cosh_of(s):
    return _filled(s, np.cosh, lambda s: 1 + s / 2)


def sinhc_of(s):
    return _filled(s, lambda r: np.sinh(r) / r, lambda s: 1 + s / 6)


def tanhc_of(s):
    return _filled(s, lambda r: np.tanh(r) / r, lambda s: 1 - s / 3)


def atanhc_of(s, eps: float = 1e-12):
    return _filled(np.minimum(s, (1 - eps) ** 2), lambda r: np.arctanh(r) / r, lambda s: 1 + s / 3)


def angle_over_sine(c: np.ndarray, sine2: np.ndarray) -> np.ndarray:
    """theta / sin(theta) of an angle with this cosine and squared sine."""
    small = sine2 <= _SMALL * 1e-2
    sine = np.sqrt(np.where(small, 1.0, sine2))
    return np.where(small & (c > 0), 1 + sine2 / 6, np.arctan2(sine, c) / sine)


def acosh_over_root(alpha: np.ndarray) -> np.ndarray:
    """acosh(a) / sqrt(a^2 - 1) for a >= 1."""
    t = np.maximum(alpha - 1, 0)
    small = t <= _SMALL
    a = np.where(small, 2.0, alpha)
    return np.where(small, 1 - t / 3, np.arccosh(a) / np.sqrt(a * a - 1))


def wrap(a):
    """Angles to [-pi, pi)."""
    return a - 2 * np.pi * np.floor((a + np.pi) / (2 * np.pi))


def sym(a: np.ndarray) -> np.ndarray:
    return 0.5 * (a + np.swapaxes(a, -1, -2))


def skew(a: np.ndarray) -> np.ndarray:
    return 0.5 * (a - np.swapaxes(a, -1, -2))


def t(a: np.ndarray) -> np.ndarray:
    return np.swapaxes(a, -1, -2)


def signed_columns(q: np.ndarray) -> np.ndarray:
    """Columns turned so that their entry of the largest size, the first of equal ones, isn't negative."""
    at = np.abs(q).argmax(-2)
    sign = np.sign(np.take_along_axis(q, at[..., None, :], -2))
    return q * np.where(sign == 0, 1, sign)


def orthonormal(a: np.ndarray) -> np.ndarray:
    """QR's Q with a positive diagonal of R."""
    q, r = np.linalg.qr(a)
    d = np.sign(np.diagonal(r, axis1=-2, axis2=-1))
    return q * np.where(d == 0, 1, d)[..., None, :]


def expm(a: np.ndarray) -> np.ndarray:
    """Batched matrix exponential: scaling and squaring of a Taylor polynomial of degree 18."""
    norm = np.abs(a).sum(-1).max(initial=0)
    if not np.isfinite(norm):
        return np.full(a.shape, np.nan)
    k = max(0, int(np.ceil(np.log2(max(norm, 1e-300)))) + 1)
    b = a / 2.0**k
    eye = np.broadcast_to(np.eye(a.shape[-1]), a.shape)
    out = eye.copy()
    for i in range(18, 0, -1):
        out = eye + b @ out / i
    for _ in range(k):
        out = out @ out
    return out


class Geometry:
    """Defaults; subclasses are frozen configurations, and equal ones have equal specs."""

    name = "geometry"
    eps = 1e-12
    #: exp, log, dist: exact, numerical-local or proxy; transport: parallel, isometric or vector; hessian, rgrad_jvp: exact or projection.
    kinds = {"exp": "exact", "log": "exact", "dist": "exact", "transport": "parallel", "hessian": "projection", "rgrad_jvp": "projection"}

    def __init__(self, *size: int, atol: float = ATOL):
        self.size, self.atol = tuple(int(x) for x in size), atol
        if any(x < 1 for x in self.size):
            raise ValueError(f"{self.name}: sizes are positive")

    @property
    def shape(self) -> tuple[int, ...]:
        return self.size

    @property
    def axes(self) -> int:
        return len(self.shape)

    @property
    def dim(self) -> int:
        raise NotImplementedError

    @property
    def length(self) -> int:
        return math.prod(self.shape)

    @property
    def margin(self) -> float:
        """How far from a boundary projected points stay."""
        return max(self.eps, 2 * self.atol, 32 * ULP)

    def spec(self) -> dict:
        return {"name": self.name, "size": list(self.size), "atol": self.atol}

    def __eq__(self, other) -> bool:
        return isinstance(other, Geometry) and self.spec() == other.spec()

    def __hash__(self) -> int:
        return hash(repr(self.spec()))

    def __repr__(self) -> str:
        return f"{type(self).__name__}({', '.join(map(str, self.size))})"

    def operation_kind(self, operation: str) -> str:
        operation = {"ehess_to_rhess": "hessian"}.get(operation, operation)
        if operation not in self.kinds:
            raise ValueError(f"no operation {operation}")
        return self.kinds[operation]

    def require(self, *operations: str) -> None:
        """Raise unless all of these are exact (transport: parallel or isometric)."""
        missing = [f"{o}={self.operation_kind(o)}" for o in operations if self.operation_kind(o) not in ("exact", "parallel", "isometric")]
        if missing:
            raise CapabilityError(f"{self!r} lacks exact operations: {', '.join(missing)}")

    # What a metric that is the ambient one gives; others override.
    def inner(self, x, u, v):
        return dots(u, v, self.axes)

    def norm(self, x, u):
        return np.sqrt(np.maximum(self.inner(x, u, u), 0))

    def lincomb(self, x, *terms):
        """tangent_project(sum of c * u) of c1, u1, c2, u2, ..."""
        if not terms or len(terms) % 2:
            raise ValueError("coefficients and tangents come in pairs")
        return self.tangent_project(x, sum(stretched(c, self.axes) * u for c, u in zip(terms[::2], terms[1::2])))

    def is_tangent(self, x, u, atol=None):
        gap = u - self.tangent_project(x, u)
        return dots(gap, gap, self.axes) <= ((atol or self.atol) * np.maximum(1, np.sqrt(dots(u, u, self.axes)))) ** 2

    def squared_dist(self, x, y):
        u = self.log(x, y)
        return np.maximum(self.inner(x, u, u), 0)

    def dist(self, x, y):
        return np.sqrt(np.maximum(self.squared_dist(x, y), 0))

    def retr(self, x, u, step=1.0):
        return self.exp(x, stretched(step, self.axes) * u)

    def invretr(self, x, y):
        return self.log(x, y)

    def pair_mean(self, x, y):
        return self.exp(x, 0.5 * self.log(x, y))

    def egrad_to_rgrad(self, x, g):
        return self.tangent_project(x, g)

    def ehess_to_rhess(self, x, g, h, u):
        return self.tangent_project(x, h)

    def interpolate(self, x, y, s):
        return self.exp(x, stretched(s, self.axes) * self.log(x, y))

    def random_tangent(self, rng, x, scale=1.0, normalize=False):
        u = self.tangent_project(x, rng.normal(size=np.shape(x)))
        if normalize:
            u = u / stretched(np.maximum(self.norm(x, u), 1e-300), self.axes)
        return scale * u

    def random_point(self, rng, n: int):
        return self.project(rng.normal(size=(n, *self.shape)))

    def belongs(self, x, atol=None):
        raise NotImplementedError


class Retraction(Geometry):
    """Geometries that only have a retraction: exp, log and dist are stand-ins by projection."""

    kinds = {**Geometry.kinds, "exp": "proxy", "log": "proxy", "dist": "proxy", "transport": "vector"}
    eps = 1e-10

    def retr(self, x, u, step=1.0):
        return self.project(x + stretched(step, self.axes) * u)

    def exp(self, x, u):
        return self.retr(x, u)

    def log(self, x, y):
        return self.tangent_project(x, y - x)

    def invretr(self, x, y):
        return self.log(x, y)

    def squared_dist(self, x, y):
        d = y - x
        return dots(d, d, self.axes)

    def transport(self, x, y, u):
        return self.tangent_project(y, u)
