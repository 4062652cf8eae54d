"""Column expressions on voxel coordinates, radii, flags, names and times."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("x", "y", "z")
FACE6 = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]


def linear_id(x: Column, y: Column, z: Column, lx: int, ly: int) -> Column:
    """x-fastest linear id of a voxel in an image of lx by ly by any depth."""
    return z.cast("long") * F.lit(lx * ly) + y.cast("long") * F.lit(lx) + x.cast("long")


def from_linear_id(i: Column, lx: int, ly: int) -> tuple[Column, Column, Column]:
    per = lx * ly
    return (i % lx).cast("int"), F.floor((i % per) / lx).cast("int"), F.floor(i / per).cast("int")


def trunc_div(a: Column, b: int) -> Column:
    """Division that truncates toward zero, as integers divide in the source formats."""
    q = a / F.lit(b)
    return F.when(q < 0, F.ceil(q)).otherwise(F.floor(q)).cast("int")


def ceil_div(a: Column | int, b: int) -> Column:
    return F.ceil((a if isinstance(a, Column) else F.lit(a)) / F.lit(b)).cast("int")


def distance(a: tuple[Column, ...], b: tuple[Column, ...], scale: tuple[float, ...] = (1, 1, 1)) -> Column:
    return F.sqrt(sum(((p - q) * F.lit(float(s))) * ((p - q) * F.lit(float(s))) for p, q, s in zip(a, b, scale, strict=True)))


def ball_offsets(radius: float) -> list[tuple[int, int, int]]:
    """Integer offsets in the box of half side floor(radius) at distance radius or less."""
    n = math.floor(radius)
    r2 = radius * radius
    span = range(-n, n + 1)
    return [(i, j, k) for i in span for j in span for k in span if i * i + j * j + k * k <= r2]


def offsets(cells: list[tuple[int, int, int]]) -> Column:
    """An array of (dx, dy, dz) structs, to explode."""
    make = lambda d: F.struct(*(F.lit(v).alias(f"d{a}") for v, a in zip(d, AXES, strict=True)))
    return F.array(*map(make, cells))


def flag(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(1 << bit) != 0


def with_flag(flags: Column, bit: int, on: bool = True) -> Column:
    return flags.bitwiseOR(1 << bit) if on else flags.bitwiseAND(~(1 << bit))


def volume_to_radius(volume: Column) -> Column:
    return F.cbrt(F.lit(3.0) * volume / F.lit(4 * math.pi))


def radius_to_volume(radius: Column) -> Column:
    return F.floor(F.lit(4 / 3 * math.pi) * radius * radius * radius).cast("long")


def scaled_volume(volume: Column, voxel: tuple[float, float, float]) -> Column:
    return F.floor(volume * F.lit(voxel[0] * voxel[1] * voxel[2])).cast("long")


def anisotropy(voxel: tuple[float, float, float]) -> int:
    return int(max(voxel) / min(voxel) + 0.5)


def to_voxels(um: Column, edge: float) -> Column:
    return F.round(um / F.lit(edge)).cast("int")


def elapsed_text(seconds: Column) -> Column:
    """Whole seconds as d:h:m:s."""
    s = seconds.cast("long")
    return F.concat_ws(":", F.floor(s / 86400).cast("string"), F.floor(s % 86400 / 3600).cast("string"), F.floor(s % 3600 / 60).cast("string"), (s % 60).cast("string"))


def elapsed_seconds(text: Column) -> Column:
    part = F.split(text, ":")
    return sum(part[i].cast("long") * k for i, k in enumerate((86400, 3600, 60, 1)))


def coords_in_name(name: Column) -> Column:
    """Integer triple out of `[x,y,z]...` or `...-x-y-z`."""
    boxed = r"\[(-?\d+),(-?\d+),(-?\d+)\]"
    dashed = r"-(\d+)-(\d+)-(\d+)"
    pick = lambda i: F.when(name.rlike(boxed), F.regexp_extract(name, boxed, i)).otherwise(F.regexp_extract(name, dashed, i)).cast("int")
    return F.struct(pick(1).alias("x"), pick(2).alias("y"), pick(3).alias("z"))


def tree_file_name(x: Column, y: Column, z: Column, radius_um: Column) -> Column:
    return F.format_string("[%d,%d,%d]-r=%d-µm", x, y, z, radius_um.cast("int"))


def weight(pixel: Column, low: float, high: float) -> Column:
    """Grey-distance weight exp(10 (1 - i/255)^2) of the level i = (p - low) / high * 255."""
    level = F.floor((pixel - F.lit(low)) / F.lit(high) * 255)
    f = F.lit(1.0) - level / F.lit(255.0)
    return F.exp(F.lit(10.0) * f * f)


def intersection_volume(r: Column, s: Column, d: Column) -> Column:
    """Volume shared by two balls of radii r and s whose centres are d apart."""
    lens = F.lit(math.pi) * (r + s - d) * (r + s - d) * (d * d + 2 * d * s - 3 * s * s + 2 * d * r + 6 * r * s - 3 * r * r) / (12 * d)
    small = F.least(r, s)
    return F.when(d >= r + s, F.lit(0.0)).when(d <= F.abs(r - s), F.lit(4 / 3 * math.pi) * small * small * small).otherwise(lens)
