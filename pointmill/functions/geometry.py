"""Column functions of points: frames, cells, spacings, colours, formats."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of point classes (fixed values).
CLASS_NAMES = {
    0: "Never classified", 1: "Unclassified", 2: "Ground", 3: "Low vegetation", 4: "Medium vegetation", 5: "High vegetation", 6: "Building", 7: "Low noise",
    8: "Model key-point", 9: "Water", 10: "Rail", 11: "Road surface", 12: "Overlap", 13: "Wire, guard", 14: "Wire, conductor", 15: "Transmission tower", 16: "Wire connector",
    17: "Bridge deck", 18: "High noise", 19: "Overhead structure", 20: "Ignored ground", 21: "Snow", 22: "Temporal exclusion",
}
#: Colours of point classes, and of all others (fixed values).
CLASS_COLOURS = {
    0: "#8d99a6", 1: "#b6bfc7", 2: "#a2764a", 3: "#8fbf5a", 4: "#5d9e43", 5: "#2f7a34", 6: "#c0553c", 7: "#7a3f6d", 8: "#d98cb3", 9: "#2f7fc1", 10: "#6f5b8e", 11: "#5c6570", 12: "#9aa2ab",
    13: "#d8b94a", 14: "#e0c33f", 15: "#b08a2e", 16: "#cfae55", 17: "#9c6f4f", 18: "#a3427c", 19: "#7f8b96", 20: "#8a7154", 21: "#e8eef2", 22: "#6b7480",
}
OTHER_COLOUR = "#4d5560"
NOISE_CLASSES = (7, 18)


def js_round(v: Column, digits: int = 0) -> Column:
    """Half up, also for negative values, and never minus zero."""
    f = 10.0**digits
    return F.floor(v * F.lit(f) + F.lit(0.5)).cast("double") / F.lit(f) + F.lit(0.0)


def origin_coordinate(lo: Column, hi: Column) -> Column:
    """The centre of an extent rounded to the next thousand."""
    return F.floor((lo + hi) / F.lit(2.0) / F.lit(1000.0) + F.lit(0.5)).cast("double") * F.lit(1000.0)


def map_coordinates(x: Column, y: Column, z: Column, origin: tuple[float, float, float]) -> list[Column]:
    """East, north and elevation of a local point."""
    ox, oy, oz = map(F.lit, map(float, origin))
    return [(ox + x).alias("east"), (-(oz + z) + F.lit(0.0)).alias("north"), (oy + y).alias("elevation")]


def cell_index(v: Column, origin: float | Column, cell: float | Column, count: int | Column | None = None) -> Column:
    """Grid index of a coordinate; clamped into the grid where its number of cells is given."""
    origin = origin if isinstance(origin, Column) else F.lit(float(origin))
    cell = cell if isinstance(cell, Column) else F.lit(float(cell))
    i = F.floor((v - origin) / cell).cast("int")
    if count is None:
        return i
    count = count if isinstance(count, Column) else F.lit(count)
    return F.greatest(F.lit(0), F.least(count - 1, i)).cast("int")


def clamp(v: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), v))


def noise_radius(area: Column, n: Column) -> Column:
    return clamp(F.lit(6.0) * F.sqrt(area / n), 0.75, 5)


def object_cell(area: Column, n: Column) -> Column:
    return clamp(F.lit(2.0) / F.sqrt(n / area), 0.5, 2)


def surface_cell(area: Column, n: Column) -> Column:
    return clamp(F.lit(2.5) * F.sqrt(F.greatest(area, F.lit(1.0)) / n), 0.25, 1)


def point_spacing(area: Column, n: Column) -> Column:
    return F.greatest(F.sqrt(F.greatest(area, F.lit(1e-6)) / n), F.lit(0.005))


def measure_between(dx: Column, dy: Column, dz: Column) -> list[Column]:
    """Distance, horizontal, vertical and slope in degrees from one point to another (y is up)."""
    horizontal = F.hypot(dx, dz)
    slope = F.when((dy == 0) & (horizontal == 0), F.lit(0.0)).otherwise(F.degrees(F.atan2(F.abs(dy), horizontal)))
    return [F.sqrt(dx * dx + dy * dy + dz * dz).alias("distance"), horizontal.alias("horizontal"), dy.alias("vertical"), slope.alias("slope")]


def class_name(code: Column) -> Column:
    out = F.concat(F.lit("Class "), code.cast("string"))
    for k, name in CLASS_NAMES.items():
        out = F.when(code == k, F.lit(name)).otherwise(out)
    return out


def class_colour(code: Column) -> Column:
    """A class's colour as #rrggbb."""
    return F.coalesce(F.create_map(*(F.lit(v) for pair in CLASS_COLOURS.items() for v in pair))[code.cast("int")], F.lit(OTHER_COLOUR))


def is_noise(code: Column) -> Column:
    return F.coalesce(code.isin(*NOISE_CLASSES), F.lit(False))


def flight_line_hue(source: Column) -> Column:
    turn = source * F.lit(0.6180339887)
    return turn - F.floor(turn)


def density_colour(v: Column) -> Column:
    """Band of a cell's density: none, sparse, thin or good."""
    return F.when(v.isNull(), "none").when(v <= 0, "empty").when(v < 2, "sparse").when(v < 8, "thin").otherwise("good")


#: Colours of empty, sparse and thin cells; a good one's from the ends of a ramp that twice the median reaches (fixed values).
DENSITY_COLOURS = {"empty": (214, 48, 49), "sparse": (232, 110, 44), "thin": (232, 176, 52)}
DENSITY_RAMP = ((40, 120, 70), (100, 220, 110))


def density_rgb(v: Column, median: Column) -> Column:
    """A cell's colour as an array of red, green and blue up to 255; null where no density is known."""
    t = F.least(F.lit(1.0), v / F.greatest(F.lit(8.0), median * 2))
    good = F.array(*(js_round(F.lit(float(a)) + t * (b - a)).cast("int") for a, b in zip(*DENSITY_RAMP, strict=True)))
    band = density_colour(v)
    out = F.when(band == "good", good)
    for name, rgb in DENSITY_COLOURS.items():
        out = F.when(band == name, F.array(*map(F.lit, rgb))).otherwise(out)
    return out


# Colours of points: arrays of red, green and blue from 0 to 1.

#: Fixed values of the colour modes: stops over the ground, under it, and points of no object.
ABOVE_STOPS = ((0.0, (0.13, 0.42, 0.50)), (0.33, (0.30, 0.66, 0.36)), (0.66, (0.92, 0.82, 0.30)), (1.0, (0.93, 0.42, 0.24)))
AT_GROUND, UNDER, DEEP_UNDER = (0.635, 0.463, 0.290), (0.42, 0.34, 0.70), (0.20, 0.14, 0.42)
NO_OBJECT, NO_OBJECT_GROUND = (0.19, 0.21, 0.24), (0.27, 0.22, 0.17)
LOW_HEIGHT, HIGH_HEIGHT = (0.0, 0.2, 0.6), (1.0, 0.9, 0.3)


def _mix(a, b, t: Column) -> Column:
    return F.array(*(F.lit(float(x)) + (F.lit(float(y)) - F.lit(float(x))) * t for x, y in zip(a, b, strict=True)))


def _unit(v: Column) -> Column:
    return clamp(v, 0, 1)


def _fraction(v: Column) -> Column:
    return v - F.floor(v)


def hsl(hue: Column, saturation: float, lightness: Column) -> Column:
    """Red, green and blue of a hue in turns."""

    def part(shift: float) -> Column:
        turn = hue * 6 + shift
        full = _unit(F.abs(turn - F.floor(turn / 6) * 6 - 3) - 1)
        return lightness + F.lit(saturation) * (full - 0.5) * (1 - F.abs(2 * lightness - 1))

    return F.array(part(0.0), part(4.0), part(2.0))


def colour_by_height(y: Column, low: Column, high: Column) -> Column:
    return _mix(LOW_HEIGHT, HIGH_HEIGHT, _unit(F.coalesce((y - low) / F.nullif(high - low, F.lit(0.0)), F.lit(0.0))))


def colour_by_rgb(r: Column, g: Column, b: Column) -> Column:
    return F.array(r / 255.0, g / 255.0, b / 255.0)


def colour_by_class(code: Column) -> Column:
    hexed = class_colour(code)
    return F.array(*(F.conv(F.substring(hexed, 2 + 2 * k, 2), 16, 10).cast("double") / 255.0 for k in range(3)))


def colour_above_ground(h: Column, top: Column) -> Column:
    """Violet below the ground, earth within 0.25 m of it, above it a ramp over the square root of height up to ``top``."""
    t = F.sqrt(_unit((h - 0.25) / F.greatest(top - 0.25, F.lit(0.001))))
    out = None
    for (t0, a), (t1, b) in reversed(list(zip(ABOVE_STOPS, ABOVE_STOPS[1:], strict=False))):
        part = _mix(a, b, (t - t0) / (t1 - t0))
        out = part if out is None else F.when(t < t1, part).otherwise(out)
    out = F.when(h < 0.25, F.array(*map(F.lit, AT_GROUND))).otherwise(out)
    return F.when(h < -0.25, _mix(UNDER, DEEP_UNDER, _unit((-h - 0.25) / 4.0))).otherwise(out)


def colour_by_object(object_id: Column, code: Column, buildings: Column) -> Column:
    """Buildings in reds and ambers, trees in greens, each id apart from the ones beside it; points of no object dark."""
    k = F.coalesce(object_id.cast("double"), F.lit(0.0))
    hue, shade = _fraction(k * 0.6180339887), _fraction(k * 0.7548776662)
    none = F.when(code == 2, F.array(*map(F.lit, NO_OBJECT_GROUND))).otherwise(F.array(*map(F.lit, NO_OBJECT)))
    return F.when(k < 0.5, none).when(k <= buildings + 0.5, hsl(hue * 0.12, 0.75, shade * 0.14 + 0.5)).otherwise(hsl(hue * 0.2 + 0.22, 0.6, shade * 0.18 + 0.38))


def colour_by_intensity(v: Column, low: Column, high: Column) -> Column:
    grey = F.pow(_unit((v - low) / F.greatest(high - low, F.lit(0.0001))), F.lit(0.8)) * 0.92 + 0.04
    return F.array(grey, grey, grey)


def colour_by_line(source: Column) -> Column:
    return hsl(flight_line_hue(source.cast("double")), 0.72, F.lit(0.56))


def slug(name: Column) -> Column:
    """A file stem of at most 120 safe characters."""
    s = F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), r"[^A-Za-z0-9._-]+", "-")
    s = F.substring(F.regexp_replace(s, "^[-.]+|[-.]+$", ""), 1, 120)
    return F.when(s == "", F.lit("scan")).otherwise(s)


def csv_field(v: Column) -> Column:
    return F.when(v.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)


def grid_size(size: float, cell: float) -> int:
    return int(math.floor(size / cell)) + 1


def constrained(dx: Column, dy: Column, dz: Column, axis: str) -> list[Column]:
    """A step held to an axis: x east, y north (z), z up (y), level, or free."""
    keep = {"x": (1, 0, 0), "y": (0, 0, 1), "z": (0, 1, 0), "level": (1, 0, 1), "free": (1, 1, 1)}
    if axis not in keep:
        raise ValueError(f"axis is one of {', '.join(keep)}")
    return [(d if k else F.lit(0.0)).alias(n) for d, k, n in zip((dx, dy, dz), keep[axis], ("dx", "dy", "dz"), strict=True)]


def snapped(v: Column, step: float = 1.0) -> Column:
    return js_round(v / F.lit(float(step))) * F.lit(float(step))
