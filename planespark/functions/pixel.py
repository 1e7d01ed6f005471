"""Per-pixel maths as column expressions: all of it stays inside whole-stage code generation.

``bits`` is 8, 16 or 32; 8 and 16 are unsigned integers that are clamped to
their range, 32 is floating point.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def clamp(v: Column, bits: int) -> Column:
    return v if bits == 32 else F.greatest(F.lit(0), F.least(F.lit((1 << bits) - 1), v)).cast("int")


def rounded(v: Column) -> Column:
    """Half up, also below zero."""
    return F.floor(v + 0.5)


def add(v: Column, k: float, bits: int = 8) -> Column:
    return clamp(v + (int(k) if bits != 32 else k), bits)


def subtract(v: Column, k: float, bits: int = 8) -> Column:
    return clamp(v - (int(k) if bits != 32 else k), bits)


def multiply(v: Column, k: float, bits: int = 8) -> Column:
    return v * k if bits == 32 else clamp(rounded(v * k), bits)


def divide(v: Column, k: float, bits: int = 8) -> Column:
    """Integer planes stay as they are when divided by 0."""
    if not k:
        return v if bits != 32 else v / F.lit(0.0)
    return multiply(v, 1.0 / k, bits)


def bit_and(v: Column, k: int) -> Column:
    return v.bitwiseAND(F.lit(k))


def bit_or(v: Column, k: int) -> Column:
    return v.bitwiseOR(F.lit(k))


def bit_xor(v: Column, k: int) -> Column:
    return v.bitwiseXOR(F.lit(k))


def raise_to(v: Column, least: float) -> Column:
    return F.greatest(v, F.lit(least))


def lower_to(v: Column, most: float) -> Column:
    return F.least(v, F.lit(most))


def gamma(v: Column, g: float, bits: int = 8) -> Column:
    """Power of the value relative to full range; 0 stays 0."""
    if bits == 32:
        return F.when(v <= 0, 0.0).otherwise(F.exp(g * F.log(v)))
    full = (1 << bits) - 1
    return F.when(v <= 0, 0).otherwise(clamp(rounded(F.exp(F.log(v / full) * g) * full), bits)).cast("int")


def log(v: Column, bits: int = 8) -> Column:
    if bits == 32:
        return F.log(v)
    full = (1 << bits) - 1
    return F.when(v <= 0, 0).otherwise(clamp(rounded(F.log(v) * (full / F.log(F.lit(float(full))))), bits)).cast("int")


def exp(v: Column, bits: int = 8) -> Column:
    if bits == 32:
        return F.exp(v)
    full = (1 << bits) - 1
    return clamp(rounded(F.exp(v * (F.log(F.lit(float(full))) / full))), bits)


def square(v: Column, bits: int = 8) -> Column:
    return clamp(v * v, bits)


def root(v: Column, bits: int = 8) -> Column:
    out = F.when(v <= 0, 0.0).otherwise(F.sqrt(v.cast("double")))
    return out if bits == 32 else clamp(rounded(out), bits)


def reciprocal(v: Column) -> Column:
    return F.when(v == 0, F.lit(NAN)).otherwise(1.0 / v)


def invert(v: Column, least: Column | float = 0, most: Column | float = 255) -> Column:
    return most - (v - least) if isinstance(least, Column) or isinstance(most, Column) else F.lit(most) - (v - F.lit(least))


def background_to_nan(v: Column, lower: float, upper: float) -> Column:
    return F.when(v.between(lower, upper), v.cast("double")).otherwise(F.lit(NAN))


def threshold(v: Column, level: float) -> Column:
    """0 up to the level, 255 above."""
    return F.when(v <= level, 0).otherwise(255)


def mask(v: Column, lower: float, upper: float) -> Column:
    return F.when(v.between(lower, upper), 255).otherwise(0)


def to_8bit(v: Column, least: Column, most: Column) -> Column:
    """Scaled conversion: the range from least to most goes to 0..255."""
    return F.greatest(F.lit(0), F.least(F.lit(255), ((v - least) * 256.0 / (most - least + 1) + 0.5).cast("int")))


def gray(r: Column, g: Column, b: Column, weights: tuple[float, float, float] = (1 / 3, 1 / 3, 1 / 3)) -> Column:
    return (r * weights[0] + g * weights[1] + b * weights[2] + 0.5).cast("int")


def hsb(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue, saturation and brightness, each 0 to 1; grey has hue 0."""
    most, least = F.greatest(r, g, b), F.least(r, g, b)
    span = (most - least).cast("double")
    hue = F.when(r == most, (g - b) / span).when(g == most, 2 + (b - r) / span).otherwise(4 + (r - g) / span) / 6
    return F.when(span == 0, 0.0).when(hue < 0, hue + 1).otherwise(hue), F.when(most == 0, 0.0).otherwise(span / most), most / 255.0


def rgb_of_hsb(h: Column, s: Column, b: Column) -> tuple[Column, Column, Column]:
    """Red, green and blue (0 to 255) of hue, saturation and brightness from 0 to 1.

    A channel falls by saturation times its hue's distance from the channel's
    own sixth, counted from one sixth on and cut at one.
    """
    part = lambda home: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.abs(F.pmod(h * 6 - home + 3, F.lit(6.0)) - 3) - 1))
    return tuple(F.floor(255 * b * (1 - s * part(home)) + 0.5).cast("int") for home in (0, 2, 4))


#: Linear sRGB to XYZ (D65), and its white point.
SRGB_TO_XYZ = ((0.4124, 0.3576, 0.1805), (0.2126, 0.7152, 0.0722), (0.0193, 0.1192, 0.9505))
WHITE_D65 = (95.0429, 100.0, 108.89)


def xyz(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    line = lambda v: F.when(v / 255.0 <= 0.04045, v / 255.0 / 12.92).otherwise(F.pow((v / 255.0 + 0.055) / 1.055, F.lit(2.4)))
    parts = [line(c) for c in (r, g, b)]
    return tuple(sum(w * p for w, p in zip(row, parts, strict=True)) * 100 for row in SRGB_TO_XYZ)


def lab(x: Column, y: Column, z: Column, white: tuple[float, float, float] = WHITE_D65) -> tuple[Column, Column, Column]:
    bend = lambda v, w: F.when(v / w > 0.008856, F.cbrt(v / w)).otherwise(7.787 * (v / w) + 16.0 / 116.0)
    fx, fy, fz = (bend(v, w) for v, w in zip((x, y, z), white, strict=True))
    return 116 * fy - 16, 500 * (fx - fy), 200 * (fy - fz)


def rgb_of_xyz(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    bend = lambda v: F.when(v <= 0.0031308, 12.92 * v).otherwise(1.055 * F.pow(F.greatest(v, F.lit(0.0)), F.lit(1 / 2.4)) - 0.055)
    lines = [sum(float(w) * p / 100 for w, p in zip(row, (x, y, z), strict=True)) for row in np.linalg.inv(np.array(SRGB_TO_XYZ))]
    return tuple(F.greatest(F.lit(0), F.least(F.lit(255), F.floor(bend(v) * 255 + 0.5))).cast("int") for v in lines)


def xyz_of_lab(l: Column, a: Column, b: Column, white: tuple[float, float, float] = WHITE_D65) -> tuple[Column, Column, Column]:  # noqa: E741
    fy = (l + 16) / 116
    straight = lambda f: F.when(f * f * f > 0.008856, f * f * f).otherwise((f - 16.0 / 116.0) / 7.787)
    return tuple(straight(f) * w for f, w in zip((a / 500 + fy, fy, fy - b / 200), white, strict=True))


def xyy(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Chromaticity x and y, and Y; black has the chromaticity of the white point."""
    total, white = x + y + z, sum(WHITE_D65)
    return F.when(total == 0, WHITE_D65[0] / white).otherwise(F.try_divide(x, total)), F.when(total == 0, WHITE_D65[1] / white).otherwise(F.try_divide(y, total)), y


def calibrated(p: Column, origin: float, size: float) -> Column:
    return (p - origin) * size


def uncalibrated(c: Column, origin: float, size: float) -> Column:
    return c / size + origin


def optical_density(v: Column) -> Column:
    return F.when(v == 0, F.log10(F.lit(255.0 / 0.5))).otherwise(F.log10(255.0 / v))


def polynomial(v: Column, coefficients: list[float]) -> Column:
    """Horner form, lowest power first."""
    out = F.lit(0.0)
    for c in reversed(coefficients):
        out = out * v + c
    return out


def polar(x: Column, y: Column, width: int, height: int) -> tuple[Column, Column]:
    """Distance from the centre and angle (0 to 2 pi, counter-clockwise from the x axis)."""
    dx, dy = x - (width - 1) / 2.0, (height - 1) / 2.0 - y
    angle = F.atan2(dy, dx)
    return F.sqrt(dx * dx + dy * dy), F.when(angle < 0, angle + 2 * F.pi()).otherwise(angle)


def looked_up(v: Column, table: list[int]) -> Column:
    """The table's entry for each value (8- or 16-bit)."""
    return F.element_at(F.array(*map(F.lit, table)), v + 1)


def windowed(v: Column, lower: int, upper: int) -> Column:
    """8-bit values with [lower, upper] spread over 0..255 and the rest cut off."""
    return F.greatest(F.lit(0), F.least(F.lit(255), F.floor((v - lower) * 256.0 / (upper - lower + 1) + 0.5))).cast("int")
