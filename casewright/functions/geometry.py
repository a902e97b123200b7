"""Map geometry: equal-area projection, ring areas, line simplification, paths; axis ticks and ordinals."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def albers(lon: Column, lat: Column, lat1: float = 29.5, lat2: float = 45.5, lon0: float = -96.0, lat0: float = 37.5) -> tuple[Column, Column]:
    """(x, y) of the conic equal-area projection on the unit sphere."""
    r = math.radians
    n = (math.sin(r(lat1)) + math.sin(r(lat2))) / 2
    c = math.cos(r(lat1)) ** 2 + 2 * n * math.sin(r(lat1))
    rho0 = math.sqrt(c - 2 * n * math.sin(r(lat0))) / n
    rho = F.sqrt(c - 2 * n * F.sin(F.radians(lat))) / n
    theta = n * F.radians(lon - lon0)
    return rho * F.sin(theta), rho0 - rho * F.cos(theta)


def ring_area(ring: Column) -> Column:
    """Area of a closed ring, array<struct<x, y>>, by the shoelace formula."""
    n = F.size(ring)
    cross = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.try_element_at(ring, i)["x"] * F.try_element_at(ring, i % n + 1)["y"] - F.try_element_at(ring, i % n + 1)["x"] * F.try_element_at(ring, i)["y"])
    return F.when(n >= 3, F.abs(F.aggregate(cross, F.lit(0.0), lambda a, v: a + v)) / 2).otherwise(0.0)


def fit_box(points: list[tuple[float, float]], width: float, height: float, margin: float = 0.0) -> tuple[float, float, float]:
    """(scale, dx, dy) that puts the points' bounding box, y downward, into a frame."""
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    scale = min((width - 2 * margin) / ((max(xs) - min(xs)) or 1.0), (height - 2 * margin) / ((max(ys) - min(ys)) or 1.0))
    return scale, margin - min(xs) * scale, margin + max(ys) * scale


def simplify(points: list[tuple[float, float]], tolerance: float = 0.35) -> list[tuple[float, float]]:
    """Douglas-Peucker: the points whose distance from the kept line exceeds the tolerance."""
    keep, todo = {0, len(points) - 1}, [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        (x1, y1), (x2, y2) = points[a], points[b]
        length = math.hypot(x2 - x1, y2 - y1)
        far = (tolerance, None)
        for i in range(a + 1, b):
            x, y = points[i]
            d = abs((x2 - x1) * (y1 - y) - (x1 - x) * (y2 - y1)) / length if length else math.hypot(x - x1, y - y1)
            if d > far[0]:
                far = (d, i)
        if far[1] is not None:
            keep.add(far[1])
            todo += [(a, far[1]), (far[1], b)]
    return [p for i, p in enumerate(points) if i in keep]


def svg_path(rings: list[list[tuple[float, float]]], digits: int = 1) -> str:
    return "".join("M" + "L".join(f"{x:.{digits}f},{y:.{digits}f}" for x, y in ring) + "Z" for ring in rings if len(ring) > 2)


#: Steps of an axis (fixed values).
TICK_STEPS = (1, 2, 2.5, 5, 10, 20, 25, 50, 100, 200, 250, 500, 1000)


def nice_ticks(high: float) -> list[float]:
    """Ticks from 0 to ``high`` by the first fixed step that needs five at most, else by a fifth of ``high``."""
    step = next((s for s in TICK_STEPS if high <= 5 * s), high / 5)
    return [i * step for i in range(math.floor(high / step + 0.001) + 1)]


def ordinal(n: Column) -> Column:
    """1st, 2nd, 3rd, 4th ...; 11 to 20 take th."""
    last, teen = n % 10, (n % 100).between(11, 20)
    suffix = F.when(teen, "th").when(last == 1, "st").when(last == 2, "nd").when(last == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), suffix)
