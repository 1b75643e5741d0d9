"""Vectors of three components as struct columns (x, y, z)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def vec(x, y, z) -> Column:
    lit = lambda c: c if isinstance(c, Column) else F.lit(float(c))
    return F.struct(lit(x).alias("x"), lit(y).alias("y"), lit(z).alias("z"))


def add(a: Column, b: Column) -> Column:
    return vec(a.x + b.x, a.y + b.y, a.z + b.z)


def sub(a: Column, b: Column) -> Column:
    return vec(a.x - b.x, a.y - b.y, a.z - b.z)


def scale(a: Column, k) -> Column:
    return vec(a.x * k, a.y * k, a.z * k)


def negative(a: Column) -> Column:
    return scale(a, -1.0)


def dot(a: Column, b: Column) -> Column:
    return a.x * b.x + a.y * b.y + a.z * b.z


def cross(a: Column, b: Column) -> Column:
    return vec(a.y * b.z - a.z * b.y, a.z * b.x - a.x * b.z, a.x * b.y - a.y * b.x)


def length(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Column, b: Column) -> Column:
    return length(sub(a, b))


def normalize(a: Column) -> Column:
    """a at length 1; null components for the null vector."""
    return scale(a, 1.0 / F.nullif(length(a), F.lit(0.0)))


def angle(a: Column, b: Column) -> Column:
    """Degrees between two vectors; null if one is null."""
    return F.degrees(F.acos(dot(a, b) / F.nullif(length(a) * length(b), F.lit(0.0))))
