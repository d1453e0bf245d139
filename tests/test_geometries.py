"""Invariants of every geometry, and known values."""

import numpy as np
import pytest

from tangentia.functions import *  # noqa: F403
from tangentia.functions import CATALOGUE, CapabilityError, from_spec
from tangentia.functions.base import expm

B = np.diag([1, 1.5, 2, 3])
GEOMETRIES = [
    Euclidean(2), Oblique(4, 2), ProbabilitySimplex(4), PoincareBall(3), Sphere(4), SphereExtrinsic(4), Grassmann(5, 2), GrassmannProjection(5, 2),
    GeneralizedStiefel(4, 2, metric=B), GeneralizedGrassmann(4, 2, metric=B), Stiefel(5, 2), StiefelEuclidean(5, 2), SPDLogEuclidean(3), SPDAffineInvariant(3),
    SPDBuresWasserstein(3), FixedRank(4, 3, 2), RankKPSD(4, 2), RankKPSDBuresWasserstein(4, 2), Elliptope(4, 2), Spectrahedron(4, 2), CorrelationECM(3),
    CorrelationLEC(3), CorrelationAffineQuotient(3), Hyperboloid(3), Torus(3), SpecialOrthogonal(3), SpecialOrthogonal(4), SpecialEuclidean(2), KendallShape(4, 2),
    Product({"sphere": Sphere(3), "torus": Torus(2)}), Product({"a": Sphere(3), "s": [Torus(2), {"c": SPDLogEuclidean(2)}]}),
]
EXACT = [m for m in GEOMETRIES if m.operation_kind("exp") == "exact"]


@pytest.fixture(params=GEOMETRIES, ids=repr)
def m(request):
    return request.param


def drawn(m, n=5):
    rng = np.random.default_rng(0)
    x = m.random_point(rng, n)
    return rng, x, m.random_tangent(rng, x, 0.1, True), m.random_tangent(rng, x, 0.1, True)


def test_spec_round_trip(m):
    assert from_spec(m.spec()) == m and hash(from_spec(m.spec())) == hash(m)


def test_membership_and_projection(m):
    rng, x, u, _ = drawn(m)
    assert m.belongs(x).all() and m.is_tangent(x, u).all()
    assert np.allclose(m.tangent_project(x, u), u, atol=1e-7)
    assert m.belongs(m.project(np.zeros((1, *m.shape)))).all()
    assert m.belongs(m.project(10 * rng.normal(size=(3, *m.shape)))).all()
    assert m.belongs(m.retr(x, u)).all()


@pytest.mark.parametrize("m", EXACT, ids=repr)
def test_exponential_and_logarithm(m):
    rng, x, u, v = drawn(m)
    y = m.exp(x, 2 * v)
    log = m.log(x, y)
    assert np.allclose(m.dist(m.exp(x, log), y), 0, atol=1e-6)
    assert np.allclose(m.norm(x, log), m.dist(x, y), atol=1e-6)
    assert np.allclose(m.log(x, m.exp(x, u)), u, atol=1e-6)
    assert np.allclose(m.dist(x, y), m.dist(y, x), atol=1e-6)
    mid = m.pair_mean(x, y)
    assert np.allclose(m.dist(x, mid), 0.5 * m.dist(x, y), atol=1e-6)


@pytest.mark.parametrize("m", EXACT, ids=repr)
def test_transport(m):
    rng, x, u, v = drawn(m)
    y = m.exp(x, 2 * v)
    moved = m.transport(x, y, u)
    assert m.is_tangent(y, moved).all()
    if m.operation_kind("transport") != "vector":
        assert np.allclose(m.inner(y, moved, m.transport(x, y, v)), m.inner(x, u, v), atol=1e-6)
    if m.operation_kind("transport") == "parallel":
        assert np.allclose(m.transport(x, y, m.log(x, y)), -m.log(y, x), atol=1e-5)


def test_gradient_of_a_linear_function(m):
    if isinstance(m, (Grassmann, GeneralizedGrassmann, KendallShape)):
        pytest.skip("a linear function isn't one of classes")
    rng, x, u, _ = drawn(m)
    c = rng.normal(size=m.shape)
    f = lambda p: (p * c).sum(tuple(range(1, p.ndim)))
    h, move = 1e-5, m.exp if m in EXACT else m.retr
    slope = (f(move(x, h * u)) - f(move(x, -h * u))) / (2 * h)
    assert np.allclose(slope, m.inner(x, m.egrad_to_rgrad(x, np.broadcast_to(c, x.shape)), u), atol=1e-5)


def test_known_values():
    s, e = Sphere(3), np.eye(3)
    assert s.dist(e[0], -e[0]) == pytest.approx(np.pi)
    assert np.isnan(s.log(e[0], -e[0])).all() and np.isnan(s.transport(e[0], -e[0], e[1])).all()
    near = np.array([np.cos(np.pi - 1e-3), np.sin(np.pi - 1e-3), 0])
    assert s.norm(e[0], s.log(e[0], near)) == pytest.approx(np.pi - 1e-3, abs=2e-5)
    x = SphereExtrinsic(3)
    assert x.chordal_dist(e[0], e[1]) == pytest.approx(np.sqrt(2))
    assert np.allclose(x.extrinsic_mean(e[:2]), [np.sqrt(0.5), np.sqrt(0.5), 0])
    assert np.isnan(x.extrinsic_mean(np.stack([e[0], -e[0]]))).all()
    g = Grassmann(4, 2)
    a, b = np.eye(4)[:, :2], np.eye(4)[:, [0, 2]]
    assert g.dist(a, b) == pytest.approx(np.pi / 2) and np.isnan(g.log(a, b)).all()
    w, p, q = SPDBuresWasserstein(2), np.diag([1.0, 4]), np.diag([4.0, 9])
    assert w.squared_dist(p, q) == pytest.approx(2)
    assert np.allclose(w.optimal_transport_map(p, q), np.diag([2, 1.5]))
    u = np.array([[1.0, 2], [2, 3]])
    assert w.inner(np.eye(2), u, u) == pytest.approx(0.25 * (u**2).sum())
    h = Hyperboloid(3)
    z = h.random_point(np.random.default_rng(1), 4)
    assert np.allclose(h.from_poincare(h.to_poincare(z)), z, atol=2e-6)
    assert np.allclose(PoincareBall(2).dist(h.to_poincare(z[:2]), h.to_poincare(z[2:])), h.dist(z[:2], z[2:]))
    half = 0.5 * np.eye(3)
    assert np.allclose(expm(half), np.exp(0.5) * np.eye(3))


def test_hessian_of_a_linear_function_on_the_sphere():
    s, rng, x, u = Sphere(4), *drawn(Sphere(4))[:3]
    c = np.arange(4.0)
    g = np.broadcast_to(c, x.shape)
    assert np.allclose(s.ehess_to_rhess(x, g, 0 * g, u), -(x @ c)[:, None] * u)


def test_capabilities():
    with pytest.raises(CapabilityError, match="log=proxy"):
        FixedRank(3, 3, 2).require("exp", "log")
    with pytest.raises(ValueError):
        Sphere(3).operation_kind("rotate")
    assert Product({"a": Sphere(3), "b": RankKPSD(3, 2)}).operation_kind("log") == "proxy"
    assert len(CATALOGUE) == 28
