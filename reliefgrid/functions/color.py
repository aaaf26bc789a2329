"""Colour expressions: hex codes, CIELAB, colour distance. All are plain column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Linear sRGB -> XYZ, to four digits (rule side) and six digits (pixel side).
RULE_MATRIX = (
    (0.4124, 0.3576, 0.1805),
    (0.2126, 0.7152, 0.0722),
    (0.0193, 0.1192, 0.9505),
)
PIXEL_MATRIX = (
    (0.412453, 0.357580, 0.180423),
    (0.212671, 0.715160, 0.072169),
    (0.019334, 0.119193, 0.950227),
)
# D65 white point and the CIE breakpoints.
WHITE = (0.95047, 1.0, 1.08883)
GAMMA_BREAK = 0.04045
LAB_BREAK = 0.008856
LAB_SLOPE = 7.787


def hex_to_rgb(code: Column) -> Column:
    """``#rrggbb`` -> struct<r,g,b>; anything but six hex digits raises."""
    digits = F.regexp_replace(code, "^#+", "")
    checked = F.when(digits.rlike("^[0-9a-fA-F]{6}$"), digits).otherwise(
        F.raise_error(F.concat(F.lit("Invalid hex color: "), digits))
    )

    def channel(start: int) -> Column:
        return F.conv(F.substring(checked, start, 2), 16, 10).cast("int")

    return F.struct(channel(1).alias("r"), channel(3).alias("g"), channel(5).alias("b"))


def rgb_to_hex(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("#%02x%02x%02x", r.cast("int"), g.cast("int"), b.cast("int"))


def _linear(channel: Column) -> Column:
    c = channel.cast("double") / 255.0
    return F.when(c > GAMMA_BREAK, F.pow((c + 0.055) / 1.055, F.lit(2.4))).otherwise(c / 12.92)


def _lab_curve(t: Column) -> Column:
    return F.when(t > LAB_BREAK, F.pow(t, F.lit(1.0 / 3.0))).otherwise(LAB_SLOPE * t + 16.0 / 116.0)


def rgb_to_lab(r: Column, g: Column, b: Column, matrix=PIXEL_MATRIX) -> Column:
    """0-255 channels -> struct<L,a,b>."""
    lin = [_linear(c) for c in (r, g, b)]
    x, y, z = (
        _lab_curve(sum((k * c for k, c in zip(row, lin)), F.lit(0.0)) / w)
        for row, w in zip(matrix, WHITE)
    )
    return F.struct(
        (116.0 * y - 16.0).alias("L"), (500.0 * (x - y)).alias("a"), (200.0 * (y - z)).alias("b")
    )


def delta_e(p: Column, q: Column) -> Column:
    """Euclidean distance of two struct<L,a,b> columns."""
    return F.sqrt(sum((F.pow(p[k] - q[k], F.lit(2.0)) for k in ("L", "a", "b")), F.lit(0.0)))
