"""Vector, rotation and probability algebra as column expressions (P01, P02, W19, section 2.9)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Vector = Sequence[Column]


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def cross(a: Vector, b: Vector) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def unit(a: Vector, floor: float = 1e-9) -> list[Column]:
    n = F.greatest(norm(a), F.lit(floor))
    return [x / n for x in a]


def apply(m: Sequence[Vector], v: Vector) -> list[Column]:
    return [dot(row, v) for row in m]


def rotation_to_z(u: Vector) -> list[list[Column]]:
    """Shortest-arc rotation of a unit vector onto +Z; identity when it is there, diag(1, -1, -1) when opposite."""
    x, y, c = u
    s2 = x * x + y * y
    still, k = F.sqrt(s2) < 1e-9, (1 - c) / F.when(s2 > 0, s2).otherwise(1.0)
    flip = F.when(c > 0, 1.0).otherwise(-1.0)
    m = [[1 - x * x * k, -x * y * k, -x], [-x * y * k, 1 - y * y * k, -y], [x, y, 1 - s2 * k]]
    at_rest = [[F.lit(1.0), F.lit(0.0), F.lit(0.0)], [F.lit(0.0), flip, F.lit(0.0)], [F.lit(0.0), F.lit(0.0), flip]]
    return [[F.when(still, r).otherwise(v) for r, v in zip(a, b, strict=True)] for a, b in zip(at_rest, m, strict=True)]


def degrees_between_z(z: Column) -> Column:
    return F.degrees(F.acos(F.least(F.greatest(z, F.lit(-1.0)), F.lit(1.0))))


def pitch_roll(a: Vector) -> tuple[Column, Column]:
    return F.degrees(F.atan2(a[0], F.hypot(a[1], a[2]))), F.degrees(F.atan2(a[1], F.hypot(a[0], a[2])))


def calibrated(counts: Vector, divisor: Column, bias: Vector | None = None) -> list[Column]:
    """(counts - bias) / divisor; a divisor that is not positive raises."""
    d = F.when(divisor > 0, divisor).otherwise(F.raise_error(F.lit("divisors must be positive")).cast("double"))
    return [(c - (b if b is not None else F.lit(0.0))) / d for c, b in zip(counts, bias or [None] * 3, strict=True)]


def magnetometer_to_body(m: Vector) -> list[Column]:
    """(x, y, z) to (y, -x, z)."""
    return [m[1], -m[0], m[2]]


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.log(q / (1 - q))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def fused(branches: Sequence[Column], weights: Sequence[float]) -> Column:
    """Weighted mean of logits, back to a probability."""
    total = sum(weights)
    if total <= 0:
        raise ValueError("weights must sum to something positive")
    return sigmoid(sum((logit(b) * (w / total) for b, w in zip(branches[1:], weights[1:], strict=True)), logit(branches[0]) * (weights[0] / total)))


def simplex(n: int, steps: int = 10) -> list[tuple[float, ...]]:
    """All weights of the given resolution that sum to one, in lexicographic order."""
    if n == 1:
        return [(1.0,)]
    out: list[tuple[int, ...]] = [()]
    for _ in range(n - 1):
        out = [(*t, k) for t in out for k in range(steps - sum(t) + 1)]
    return [tuple(x / steps for x in t) + ((steps - sum(t)) / steps,) for t in out]


def random_rotation(seed: int, yaw: float = 180.0, tilt: float = 35.0) -> list[list[Column]]:
    """A 3 x 3 rotation per row, Rz(yaw) Ry(pitch) Rx(roll), angles drawn evenly within their limits in degrees (2.9d)."""
    a, b, c = (F.radians((F.rand(seed + k) * 2 - 1) * limit) for k, limit in enumerate((yaw, tilt, tilt)))
    return euler(a, b, c)


def euler(yaw: Column, pitch: Column, roll: Column) -> list[list[Column]]:
    """Rz(yaw) Ry(pitch) Rx(roll)."""
    (sa, ca), (sb, cb), (sc, cc) = ((F.sin(x), F.cos(x)) for x in (yaw, pitch, roll))
    return [[ca * cb, ca * sb * sc - sa * cc, ca * sb * cc + sa * sc], [sa * cb, sa * sb * sc + ca * cc, sa * sb * cc - ca * sc], [-sb, cb * sc, cb * cc]]


def augmented(df: DataFrame, group: list[str], channels: list[list[str]], seed: int, scale: float = 0.03, noise: dict[str, float] | None = None) -> DataFrame:
    """Training copies of a signal: each group is turned by one rotation and scaled within 1 +- scale, each value gets its
    channel's normal noise (2.9e). ``channels`` are triples of axes. The group's draw is made once per group and joined.
    """
    turn = random_rotation(seed)
    draws = df.select(*group).distinct().select(*group, (1 + (F.rand(seed + 7) * 2 - 1) * scale).alias("_k"), *[x.alias(f"_r{i}{j}") for i, row in enumerate(turn) for j, x in enumerate(row)])
    d = df.join(draws, group)
    turned = {}
    for triple in channels:
        for i, name in enumerate(triple):
            turned[name] = F.col("_k") * sum((F.col(f"_r{i}{j}") * F.col(c) for j, c in enumerate(triple)), F.lit(0.0)) + F.randn(seed + 11 + len(turned)) * (noise or {}).get(name, 0.0)
    return d.withColumns(turned).drop("_k", *[f"_r{i}{j}" for i in range(3) for j in range(3)])
