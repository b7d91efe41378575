"""Three-vectors as lists of columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = list[Column]


def of(struct: Column) -> Vec:
    return [struct[a] for a in "xyz"]


def lit(*v: float) -> Vec:
    return [F.lit(float(x)) for x in v]


def add(a: Vec, b: Vec) -> Vec:
    return [x + y for x, y in zip(a, b)]


def sub(a: Vec, b: Vec) -> Vec:
    return [x - y for x, y in zip(a, b)]


def scale(a: Vec, s) -> Vec:
    return [x * s for x in a]


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Vec) -> Vec:
    """Unit vector; null for a zero vector."""
    n = norm(a)
    return [F.when(n > 0, x / n) for x in a]


def project(a: Vec, b: Vec) -> Vec:
    """The part of a along b."""
    d = dot(b, b)
    return [F.when(d > 0, x * dot(a, b) / d) for x in b]


def lerp(a: Vec, b: Vec, t: Column) -> Vec:
    return [x + (y - x) * t for x, y in zip(a, b)]
