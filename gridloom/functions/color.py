"""Colour arithmetic as Spark columns (no UDFs).

Packed colours are 24-bit integers ``r<<16 | g<<8 | b``.  Every literal is a double, so
Spark and a SQL engine with decimal literals agree.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# OKLab matrices (Ottosson), sRGB/XYZ D65 matrix, D65 white, CIE thresholds.
RGB_TO_LMS = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
LMS_TO_OKLAB = ((0.2104542553, 0.793617785, -0.0040720468), (1.9779984951, -2.428592205, 0.4505937099), (0.0259040371, 0.7827717662, -0.808675766))
OKLAB_TO_LMS = ((1.0, 0.3963377774, 0.2158037573), (1.0, -0.1055613458, -0.0638541728), (1.0, -0.0894841775, -1.291485548))
LMS_TO_RGB = ((4.0767416621, -3.3077115913, 0.2309699292), (-1.2684380046, 2.6097574011, -0.3413193965), (-0.0041960863, -0.7034186147, 1.707614701))
RGB_TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.072175), (0.0193339, 0.119192, 0.9503041))
XYZ_TO_RGB = ((3.2404542, -1.5371385, -0.4985314), (-0.969266, 1.8760108, 0.041556), (0.0556434, -0.2040259, 1.0572252))
D65 = (95.047, 100.0, 108.883)
LAB_EPSILON = 216 / 24389
LAB_KAPPA = 24389 / 27


def rnd(c: Column) -> Column:
    """Round half up, as integers: floor(x + 0.5)."""
    return F.floor(c + F.lit(0.5)).cast("long")


def clamp_byte(c: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.least(F.lit(255).cast("long"), rnd(c)))


def pack(r: Column, g: Column, b: Column) -> Column:
    return F.shiftleft(r.cast("long"), 16).bitwiseOR(F.shiftleft(g.cast("long"), 8)).bitwiseOR(b.cast("long"))


def rgb(c: Column) -> tuple[Column, Column, Column]:
    return F.shiftright(c, 16).bitwiseAND(255), F.shiftright(c, 8).bitwiseAND(255), c.bitwiseAND(255)


def hex_of(c: Column) -> Column:
    return F.concat(F.lit("#"), F.lower(F.lpad(F.hex(c), 6, "0")))


def from_hex(c: Column) -> Column:
    return F.conv(F.substring(c, -6, 6), 16, 10).cast("long")


def five_bit(c: Column) -> Column:
    """Drop the low three bits of each packed channel."""
    return c.bitwiseAND(0xF8F8F8)


def bucket15(r: Column, g: Column, b: Column) -> Column:
    return F.shiftleft(F.shiftright(r, 3), 10).bitwiseOR(F.shiftleft(F.shiftright(g, 3), 5)).bitwiseOR(F.shiftright(b, 3))


def bucket12(r: Column, g: Column, b: Column) -> Column:
    return F.shiftleft(F.shiftright(r, 4), 8).bitwiseOR(F.shiftleft(F.shiftright(g, 4), 4)).bitwiseOR(F.shiftright(b, 4))


def run_key(r: Column, g: Column, b: Column, a: Column) -> Column:
    """Three bits per channel, alpha included."""
    return (
        F.shiftleft(F.shiftright(r, 5), 9).bitwiseOR(F.shiftleft(F.shiftright(g, 5), 6))
        .bitwiseOR(F.shiftleft(F.shiftright(b, 5), 3)).bitwiseOR(F.shiftright(a, 5))
    )


def _dot(row: tuple[float, float, float], v: tuple[Column, Column, Column]) -> Column:
    return F.lit(row[0]) * v[0] + F.lit(row[1]) * v[1] + F.lit(row[2]) * v[2]


def linear(v: Column) -> Column:
    u = v.cast("double") / F.lit(255.0)
    return F.when(u <= 0.04045, u / F.lit(12.92)).otherwise(F.pow((u + F.lit(0.055)) / F.lit(1.055), F.lit(2.4)))


def gamma_byte(v: Column) -> Column:
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    return clamp_byte(F.when(c <= 0.0031308, c * 12.92).otherwise(F.lit(1.055) * F.pow(c, F.lit(1 / 2.4)) - F.lit(0.055)) * 255.0)


def oklab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    lin = (linear(r), linear(g), linear(b))
    lms = tuple(F.cbrt(_dot(row, lin)) for row in RGB_TO_LMS)
    return tuple(_dot(row, lms) for row in LMS_TO_OKLAB)


def oklab_struct(color: Column) -> Column:
    l, a, b = oklab(*rgb(color))
    return F.struct(l.alias("l"), a.alias("a"), b.alias("b"))


def oklab_to_rgb(l: Column, a: Column, b: Column) -> Column:
    lms = tuple(_dot(row, (l, a, b)) for row in OKLAB_TO_LMS)
    cubes = tuple(v * v * v for v in lms)
    return pack(*[gamma_byte(_dot(row, cubes)) for row in LMS_TO_RGB])


def xyz(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    lin = (linear(r), linear(g), linear(b))
    return tuple(_dot(row, lin) * F.lit(100.0) for row in RGB_TO_XYZ)


def cielab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    def pivot(t: Column) -> Column:
        return F.when(t > LAB_EPSILON, F.cbrt(t)).otherwise((F.lit(LAB_KAPPA) * t + F.lit(16.0)) / F.lit(116.0))

    fx, fy, fz = (pivot(v / F.lit(w)) for v, w in zip(xyz(r, g, b), D65))
    return F.lit(116.0) * fy - F.lit(16.0), F.lit(500.0) * (fx - fy), F.lit(200.0) * (fy - fz)


def cielab_to_rgb(l: Column, a: Column, b: Column) -> Column:
    def inverse(t: Column) -> Column:
        cube = t * t * t
        return F.when(cube > LAB_EPSILON, cube).otherwise((F.lit(116.0) * t - F.lit(16.0)) / F.lit(LAB_KAPPA))

    fy = (l + 16.0) / 116.0
    f = (fy + a / 500.0, fy, fy - b / 200.0)
    v = tuple(F.lit(w) * inverse(t) / F.lit(100.0) for w, t in zip(D65, f))
    return pack(*[gamma_byte(_dot(row, v)) for row in XYZ_TO_RGB])


def distance_sq(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    d = [x - y for x, y in zip(a, b)]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


def l1(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    out = F.abs(a[0] - b[0])
    for x, y in zip(a[1:], b[1:]):
        out = out + F.abs(x - y)
    return out


def max_channel_delta(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    return F.greatest(*[F.abs(x - y) for x, y in zip(a, b)])


def luma709(r: Column, g: Column, b: Column) -> Column:
    return r * F.lit(0.2126) + g * F.lit(0.7152) + b * F.lit(0.0722)


def luma601(r: Column, g: Column, b: Column) -> Column:
    return r * F.lit(0.299) + g * F.lit(0.587) + b * F.lit(0.114)


def spread(r: Column, g: Column, b: Column) -> Column:
    return F.greatest(r, g, b) - F.least(r, g, b)


def colorfulness(r: Column, g: Column, b: Column) -> Column:
    return F.abs(r - g) + F.abs(g - b) + F.abs(b - r)


def saturation(r: Column, g: Column, b: Column) -> Column:
    top = F.greatest(r, g, b)
    return F.when(top == 0, F.lit(0.0)).otherwise(spread(r, g, b).cast("double") / top)


def hue_sextant(r: Column, g: Column, b: Column) -> Column:
    top, d = F.greatest(r, g, b), spread(r, g, b).cast("double")
    hue = (
        F.when(d == 0, F.lit(0.0)).when(top == r, (g - b) / d).when(top == g, (b - r) / d + 2.0).otherwise((r - g) / d + 4.0)
    ) * 60.0
    hue = F.when(hue < 0, hue + 360.0).otherwise(hue)
    return F.least(F.lit(5), F.floor(hue / 60.0)).cast("long")


def chroma_family(r: Column, g: Column, b: Column) -> Column:
    """Bit mask 1/2/4 of the channels near the maximum; 0 for dark or flat colours."""
    top, s = F.greatest(r, g, b), spread(r, g, b)
    cut = top - F.greatest(F.lit(24).cast("long"), rnd(s * F.lit(0.35)))
    mask = F.when(r >= cut, 1).otherwise(0) + F.when(g >= cut, 2).otherwise(0) + F.when(b >= cut, 4).otherwise(0)
    return F.when((top < 48) | (s < 32), 0).otherwise(mask).cast("long")


def matte_family(r: Column, g: Column, b: Column) -> Column:
    """``chroma_family`` with a rule for dark green and dark magenta."""
    dark = (
        F.when((g >= 24) & (g - r >= 18) & (g - b >= 18), 2)
        .when((r >= 32) & (b >= 24) & (F.least(r, b) - g >= 18), 5).otherwise(0)
    )
    fam = chroma_family(r, g, b)
    return F.when(fam == 0, dark).otherwise(fam).cast("long")


def protected_silhouette(r: Column, g: Column, b: Column) -> Column:
    top, low, s, br = F.greatest(r, g, b), F.least(r, g, b), spread(r, g, b), r + g + b
    return ((br >= 620) & (s <= 56)) | ((top <= 72) & (s <= 56)) | ((top <= 128) & (low >= 24) & (br <= 300) & (s <= 96))


def presentation_matte(r: Column, g: Column, b: Column, bg: tuple[Column, Column, Column]) -> Column:
    """Green or magenta matte colours that differ from the background colour."""
    fam, bg_fam = chroma_family(r, g, b), chroma_family(*bg)
    same = (fam != 0) & (fam == bg_fam) & (l1((r, g, b), bg) <= 64)
    top, s, cf = F.greatest(r, g, b), spread(r, g, b), colorfulness(r, g, b)
    weak = ((top < 56) | (s < 38) | (cf < 72)) & ((top < 150) | (s < 88) | (cf < 160))
    return ~same & ~weak & fam.isin(2, 5)


def near_black(color: Column) -> Column:
    r, g, b = rgb(color)
    return ((r * 299 + g * 587 + b * 114) <= 72000) & (F.greatest(r, g, b) <= 96)
