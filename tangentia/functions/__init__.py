"""Geometries: batched kernels, and their form as column expressions."""

from tangentia.functions.base import CapabilityError, Geometry
from tangentia.functions.matrices import (
    CorrelationAffineQuotient,
    CorrelationECM,
    CorrelationLEC,
    Elliptope,
    FixedRank,
    GeneralizedGrassmann,
    GeneralizedStiefel,
    Grassmann,
    GrassmannProjection,
    KendallShape,
    RankKPSD,
    RankKPSDBuresWasserstein,
    SPDAffineInvariant,
    SPDBuresWasserstein,
    SPDLogEuclidean,
    SpecialEuclidean,
    SpecialOrthogonal,
    Spectrahedron,
    Stiefel,
    StiefelEuclidean,
)
from tangentia.functions.product import Product
from tangentia.functions.vectors import Euclidean, Hyperboloid, Oblique, PoincareBall, ProbabilitySimplex, Sphere, SphereExtrinsic, Torus

CATALOGUE = {
    g.name: g
    for g in (
        Euclidean, Sphere, SphereExtrinsic, Oblique, ProbabilitySimplex, PoincareBall, Hyperboloid, Torus, Grassmann, GrassmannProjection, Stiefel, StiefelEuclidean,
        GeneralizedStiefel, GeneralizedGrassmann, SpecialOrthogonal, SpecialEuclidean, SPDLogEuclidean, SPDAffineInvariant, SPDBuresWasserstein, CorrelationECM,
        CorrelationLEC, CorrelationAffineQuotient, FixedRank, RankKPSD, RankKPSDBuresWasserstein, Elliptope, Spectrahedron, KendallShape,
    )
}


def from_spec(spec: dict) -> Geometry:
    """The geometry of a spec, as column metadata holds it."""
    if spec["name"] == "product":
        return Product({p: from_spec(s) for p, s in spec["parts"]}) if all("." not in p for p, _ in spec["parts"]) else Product(_nested(spec["parts"]))
    kind, size = CATALOGUE[spec["name"]], spec["size"]
    if "metric" in spec:
        return kind(*size, metric=[spec["metric"][i : i + size[0]] for i in range(0, size[0] ** 2, size[0])], atol=spec["atol"])
    return kind(*size, atol=spec["atol"])


def _nested(parts: list) -> dict:
    tree: dict = {}
    for path, s in parts:
        *way, last = path.split(".")
        at = tree
        for k in way:
            at = at.setdefault(k, {})
        at[last] = from_spec(s)
    return tree


__all__ = ["CATALOGUE", "CapabilityError", "Geometry", "Product", "from_spec", *(g.__name__ for g in CATALOGUE.values())]
