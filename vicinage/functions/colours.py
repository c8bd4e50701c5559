"""Colours as column expressions: ramps through CIE L*a*b*, and the colours of a plot's annotation columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.selection import quantiles
from .shared import numbered
from .views import KELLY, rgb

# Fixed values of sRGB and CIE L*a*b* under D65.
WHITE = (95.047, 100.0, 108.883)
TO_XYZ = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
FROM_XYZ = ((3.240479, -1.537150, -0.498535), (-0.969256, 1.875992, 0.041556), (0.055648, -0.204043, 1.057311))
#: Colours of the least, middle and largest tenth of a numeric annotation, and the quantiles at which they stand.
STOPS, AT = ("#0000FF", "#FFFFFF", "#FF0000"), (0.1, 0.5, 0.9)


def lab(colour: str) -> tuple[float, float, float]:
    """L*, a*, b* of a colour."""
    light = [c / 12.92 if c <= 0.03928 else ((c + 0.055) / 1.055) ** 2.4 for c in (x / 255 for x in rgb(colour))]
    share = [100 * sum(m * c for m, c in zip(row, light)) / white for row, white in zip(TO_XYZ, WHITE)]
    x, y, z = (t ** (1 / 3) if t > 0.008856 else 7.787 * t + 16 / 116 for t in share)
    return (116 * y - 16 if share[1] > 0.008856 else 903.3 * share[1]), 500 * (x - y), 200 * (y - z)


def _named(value: Column, use: Callable[[Column], Column]) -> Column:
    """An expression of a value that it uses several times, which is evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def lab_hex(lightness: Column, a: Column, b: Column) -> Column:
    """#RRGGBB of L*, a*, b*; what lies outside of sRGB is brought to its border."""
    back = lambda f: F.when(f * f * f > 0.008856, f * f * f).otherwise((f - 16 / 116) / 7.787)

    def share(c: Column) -> Column:
        t = F.when(c["l"] <= 8, c["l"] / 903.3).otherwise(F.pow((c["l"] + 16) / 116, F.lit(3.0)))
        return F.struct(t.alias("y"), c["a"].alias("a"), c["b"].alias("b"))

    def others(c: Column) -> Column:
        f = F.when(c["y"] > 0.008856, F.cbrt(c["y"])).otherwise(7.787 * c["y"] + 16 / 116)
        return F.struct((f + c["a"] / 500).alias("x"), c["y"].alias("y"), (f - c["b"] / 200).alias("z"))

    def light(c: Column) -> Column:
        xyz = [part * white / 100 for part, white in zip((c["x"], c["y"], c["z"]), WHITE)]
        return F.array(*(row[0] * xyz[0] + row[1] * xyz[1] + row[2] * xyz[2] for row in FROM_XYZ))

    def digits(x: Column) -> Column:
        curve = F.when(x > 0.0031308, 1.055 * F.pow(x, F.lit(1 / 2.4)) - 0.055).otherwise(12.92 * x)
        return F.lpad(F.hex(F.rint(F.least(F.greatest(curve, F.lit(0.0)), F.lit(1.0)) * 255).cast("long")), 2, "0")

    c = _named(F.struct(lightness.alias("l"), a.alias("a"), b.alias("b")), share)
    c = _named(c, others)
    c = _named(c, lambda o: F.struct(back(o["x"]).alias("x"), o["y"].alias("y"), back(o["z"]).alias("z")))
    return F.concat(F.lit("#"), F.array_join(F.transform(_named(c, light), digits), ""))


def ramp_hex(value: Column, breaks: list[float], colours: list[str]) -> Column:
    """The colour of a value between breaks, mixed in L*a*b*; beyond the first and last break theirs, null for null and NaN.
    Breaks go in any order, of equal ones the first counts; two different ones at least."""
    if len(breaks) != len(colours):
        raise ValueError("a ramp has a colour for each break")
    stops: dict[float, tuple] = {}
    for at, colour in zip(breaks, colours):
        stops.setdefault(float(at), lab(colour))
    if len(stops) < 2:
        raise ValueError("a ramp has two different breaks at least")
    points = sorted(stops.items())
    inside = F.greatest(F.least(value.cast("double"), F.lit(points[-1][0])), F.lit(points[0][0]))

    def mixed(v: Column) -> Column:
        out = F.lit(None).cast("array<double>")
        for (low, x), (high, y) in reversed(list(zip(points, points[1:]))):
            w = (v - low) / (high - low)
            out = F.when(v <= high, F.array(*(p * (1 - w) + q * w for p, q in zip(x, y)))).otherwise(out)
        return out

    shade = _named(_named(inside, mixed), lambda c: lab_hex(c[0], c[1], c[2]))
    return F.when(value.isNotNull() & ~F.isnan(value.cast("double")), shade)


def level_hex(n: Column, levels: Column, palette: list[str]) -> Column:
    """The colour of the n-th of some levels, from 1: that of the palette, or with more levels than colours one along straight lines through it."""
    if len(palette) < 2:
        raise ValueError("a palette has two colours at least")
    place = (n - 1) * F.lit(float(len(palette) - 1)) / F.greatest(levels - 1, F.lit(1))

    def along(at: Column) -> Column:
        i = F.least(F.floor(at), F.lit(len(palette) - 2)).cast("int")
        part = lambda k: F.array(*(F.lit(rgb(c)[k]) for c in palette))
        mix = [F.get(part(k), i) + (F.get(part(k), i + 1) - F.get(part(k), i)) * (at - i) for k in range(3)]
        return F.concat(F.lit("#"), *(F.lpad(F.hex(F.floor(m + 0.5).cast("long")), 2, "0") for m in mix))

    return F.when(levels <= len(palette), F.get(F.array(*map(F.lit, palette)), (n - 1).cast("int"))).otherwise(_named(place, along))


def annotation(rows: DataFrame, key: str, columns: list[str], palettes: dict[str, list[str]] | None = None, missing: str = "#BEBEBE") -> DataFrame:
    """(key, column, colour): the colours of annotation columns. Numbers take a ramp from blue over white to red at their 10, 50 and 90 % quantiles
    (one colour, white, if the outer two are equal), other levels the colours of a palette (named for the column, else the fixed one) in the order of
    the levels as text. A missing value has the colour ``missing``; true and false are levels."""
    out = None
    for c in columns:
        if isinstance(rows.schema[c].dataType, T.NumericType):
            at = [r["value"] for r in quantiles(rows, c, AT).orderBy("at").collect()]  # three numbers
            flat = at[0] is None or not at[0] < at[2]
            colour = F.when(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")), F.lit(STOPS[1])) if flat else ramp_hex(F.col(c), at, STOPS)
            part = rows.select(F.col(key).alias("key"), F.lit(c).alias("column"), F.coalesce(colour, F.lit(missing)).alias("colour"))
        else:
            levels = numbered(rows.select(F.col(c).cast("string").alias("level")).filter("level is not null").distinct(), "level")
            coloured = levels.select("level", level_hex(F.col("n"), F.lit(levels.count()), (palettes or {}).get(c) or list(KELLY[1:])).alias("colour"))
            named = rows.select(F.col(key).alias("key"), F.lit(c).alias("column"), F.col(c).cast("string").alias("level")).join(coloured, "level", "left")
            part = named.select("key", "column", F.coalesce("colour", F.lit(missing)).alias("colour"))
        out = part if out is None else out.unionByName(part)
    return out
