"""Products of geometries over a tree of dicts, lists and tuples, as one flat vector of leaves."""

from __future__ import annotations

import numpy as np

from tangentia.functions.base import Geometry


def leaves(tree) -> list[tuple[str, Geometry]]:
    """(path, geometry) depth first, dict keys in order; entries of lists are _0, _1, ..."""
    if isinstance(tree, Geometry):
        return [("", tree)]
    items = sorted(tree.items()) if isinstance(tree, dict) else [(f"_{i}", x) for i, x in enumerate(tree)]
    return [(f"{k}.{p}" if p else k, g) for k, x in items for p, g in leaves(x)]


class Product(Geometry):
    """A point is the leaves' flattened values, one after the other."""

    name = "product"

    def __init__(self, tree, atol: float = 1e-6):
        self.tree, self.parts = tree, leaves(tree)
        if not self.parts:
            raise ValueError("a product needs a factor")
        super().__init__(sum(g.length for _, g in self.parts), atol=atol)
        kinds = {}
        for op in Geometry.kinds:
            own = {g.operation_kind(op) for _, g in self.parts}
            order = ["proxy", "numerical-local", "exact"] if op in ("exp", "log", "dist") else ["vector", "isometric", "parallel"] if op == "transport" else ["projection", "exact"]
            kinds[op] = next(k for k in order if k in own)
        self.kinds = kinds

    def spec(self) -> dict:
        return {"name": self.name, "parts": [[p, g.spec()] for p, g in self.parts]}

    def __repr__(self) -> str:
        return f"Product({', '.join(f'{p}: {g!r}' for p, g in self.parts)})"

    @property
    def dim(self):
        return sum(g.dim for _, g in self.parts)

    def split(self, x: np.ndarray) -> list[np.ndarray]:
        cuts = np.cumsum([g.length for _, g in self.parts])[:-1]
        return [a.reshape(*a.shape[:-1], *g.shape) for a, (_, g) in zip(np.split(np.asarray(x, float), cuts, -1), self.parts)]

    def join(self, values: list[np.ndarray]) -> np.ndarray:
        batch = np.broadcast_shapes(*(v.shape[: v.ndim - g.axes] for v, (_, g) in zip(values, self.parts)))
        return np.concatenate([np.broadcast_to(v, (*batch, *g.shape)).reshape(*batch, -1) for v, (_, g) in zip(values, self.parts)], -1)

    def _each(self, op: str, *a):
        return [getattr(g, op)(*x) for (_, g), *x in zip(self.parts, *(self.split(v) for v in a))]

    def belongs(self, x, atol=None):
        return np.all([g.belongs(v, atol) for (_, g), v in zip(self.parts, self.split(x))], 0)

    def is_tangent(self, x, u, atol=None):
        return np.all([g.is_tangent(a, b, atol) for (_, g), a, b in zip(self.parts, self.split(x), self.split(u))], 0)

    def project(self, x):
        return self.join(self._each("project", x))

    def tangent_project(self, x, u):
        return self.join(self._each("tangent_project", x, u))

    def inner(self, x, u, v):
        return sum(self._each("inner", x, u, v))

    def exp(self, x, u):
        return self.join(self._each("exp", x, u))

    def retr(self, x, u, step=1.0):
        return self.join([g.retr(a, b, step) for (_, g), a, b in zip(self.parts, self.split(x), self.split(u))])

    def log(self, x, y):
        return self.join(self._each("log", x, y))

    def invretr(self, x, y):
        return self.join(self._each("invretr", x, y))

    def squared_dist(self, x, y):
        return np.maximum(sum(self._each("squared_dist", x, y)), 0)

    def transport(self, x, y, u):
        return self.join(self._each("transport", x, y, u))

    def pair_mean(self, x, y):
        return self.join(self._each("pair_mean", x, y))

    def egrad_to_rgrad(self, x, g):
        return self.join(self._each("egrad_to_rgrad", x, g))

    def ehess_to_rhess(self, x, g, h, u):
        return self.join(self._each("ehess_to_rhess", x, g, h, u))

    def random_point(self, rng, n):
        return self.join([g.random_point(rng, n) for _, g in self.parts])

    def embed(self, x):
        return np.concatenate([_embedded(g, v) for (_, g), v in zip(self.parts, self.split(x))], -1)


def _embedded(g: Geometry, v: np.ndarray) -> np.ndarray:
    if g.name != "euclidean" and not hasattr(g, "embed"):
        raise ValueError(f"{g!r} has no embedding")
    z = v if g.name == "euclidean" else g.embed(v)
    return z.reshape(*v.shape[: v.ndim - g.axes], -1)
