"""Stable keys and colour arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FNV_OFFSET, FNV_PRIME, MASK32 = 2166136261, 16777619, 4294967295


def fnv1a(seed: int, key: Column) -> Column:
    """32-bit FNV-1a of an ASCII key, from an offset mixed with ``seed``."""
    start = F.lit((seed ^ FNV_OFFSET) & MASK32).cast("long")
    step = lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * FNV_PRIME).bitwiseAND(F.lit(MASK32).cast("long"))
    return F.aggregate(F.filter(F.split(key, ""), lambda c: c != ""), start, step)


def version(c: Column) -> Column:
    """Eight hex digits that name a content."""
    return F.substring(F.sha2(c, 256), 1, 8)


def linear_rgb(lightness: Column, chroma: Column, hue: Column) -> list[Column]:
    """OKLCH to linear sRGB."""
    a, b = chroma * F.cos(F.radians(hue)), chroma * F.sin(F.radians(hue))
    # The published OKLab matrices.
    to_lms = ((0.3963377774, 0.2158037573), (-0.1055613458, -0.0638541728), (-0.0894841775, -1.291485548))
    to_rgb = ((4.0767416621, -3.3077115913, 0.2309699292), (-1.2684380046, 2.6097574011, -0.3413193965), (-0.0041960863, -0.7034186147, 1.707614701))
    cubes = [F.pow(lightness + a * x + b * y, F.lit(3.0)) for x, y in to_lms]
    return [sum((c * w for c, w in zip(cubes[1:], row[1:], strict=True)), cubes[0] * row[0]) for row in to_rgb]


def luminance(rgb: list[Column]) -> Column:
    r, g, b = (F.least(F.lit(1.0), F.greatest(F.lit(0.0), v)) for v in rgb)
    return r * 0.2126 + g * 0.7152 + b * 0.0722


def contrast(front: list[Column], back: list[Column], alpha: Column) -> Column:
    """Contrast ratio of ``front`` at ``alpha`` over ``back`` (both OKLCH)."""
    f, b = linear_rgb(*front), linear_rgb(*back)
    mixed = luminance([x * alpha + y * (1 - alpha) for x, y in zip(f, b, strict=True)])
    plain = luminance(b)
    return (F.greatest(mixed, plain) + 0.05) / (F.least(mixed, plain) + 0.05)
