"""Points near stretches by a spatial grid: both are written to cells, and only those of one cell are compared."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.geometry import segment_distance
from fieldloom.operators.rounds import settled

CELL = ("__cx", "__cy", "__cz")
#: Cells of one level have 2^STEP times the side of the next finer one's.
STEP = 2
#: A little more than rounding errors make of a distance.
SLACK = 1e-9


def xyz(end: str = "") -> list[Column]:
    """x, y and z of a point, or of an end of a link (tx_, rx_)."""
    return [F.col(f"{end}{a}") for a in "xyz"]


def _cells(point: Sequence[Column], side: float) -> list[Column]:
    return [F.floor(c / side).alias(n) for c, n in zip(point, CELL, strict=True)]


def _known(columns: Sequence[Column]) -> Column:
    good = F.lit(True)
    for c in columns:
        good = good & F.coalesce(F.abs(c) < float("inf"), F.lit(False))
    return good


def corridor_cells(links: DataFrame, keys: Sequence[str], reach: float) -> tuple[DataFrame, float]:
    """(keys, link_id, tx_*, rx_*, cell): each cell, once, that may hold a point within `reach` of a link; and the
    cells' side. Marks stand on a link at most reach / 2 apart, so such a point is within 1.25 reach of one, which is the side:
    it is in the mark's cell or beside it. A link is in about 9 cells for each `reach` of its length."""
    side = 1.25 * reach * (1 + SLACK)
    length = F.sqrt(sum(((b - a) * (b - a) for a, b in zip(xyz("tx_"), xyz("rx_"), strict=True)), F.lit(0.0)))
    marks = links.where(_known([*xyz("tx_"), *xyz("rx_")])).withColumn("__steps", F.greatest(F.lit(1), F.ceil(2 * length / reach))).withColumn("__k", F.explode(F.sequence(F.lit(0), F.col("__steps"))))
    share = F.col("__k") / F.col("__steps")
    own = [*keys, "link_id", *[f"{e}{a}" for e in ("tx_", "rx_") for a in "xyz"]]
    at = marks.select(*own, *_cells([a + (b - a) * share for a, b in zip(xyz("tx_"), xyz("rx_"), strict=True)], side)).distinct()
    beside = F.array(*[F.struct(*[F.lit(d).alias(n) for d, n in zip((i, j, k), "ijk", strict=True)]) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    around = at.withColumn("__d", F.explode(beside)).select(*own, *[(F.col(c) + F.col(f"__d.{d}")).alias(c) for c, d in zip(CELL, "ijk", strict=True)])
    return around.distinct(), side


def near_links(points: DataFrame, links: DataFrame, keys: Sequence[str], reach: float) -> DataFrame:
    """Each point with each link that may be within `reach`, and their distance d_link: every such pair once, and
    of the others only some in the same cells."""
    corridors, side = corridor_cells(links, keys, reach)
    dots = points.where(_known(xyz())).withColumns(dict(zip(CELL, _cells(xyz(), side), strict=True)))
    return dots.join(corridors, [*keys, *CELL]).drop(*CELL).withColumn("d_link", segment_distance(xyz(), xyz("tx_"), xyz("rx_")))


def least_distances(points: DataFrame, links: DataFrame, keys: Sequence[str], side: float) -> DataFrame:
    """(keys, link_id, least): the distance of each link to the nearest point, whatever it is.

    The cells that hold points are looked at from the coarsest ones down. Of a link's cells those stay that may hold a
    point as near as the farthest corner of the best of them; their inner cells are next, at last their points. There are as many
    levels as the extent is powers of 2^STEP times `side`.
    """
    links = settled(links.where(_known([*xyz("tx_"), *xyz("rx_")])).select(*keys, "link_id", *xyz("tx_"), *xyz("rx_")), "far-links")
    none = links.select(*keys, "link_id", F.lit(None).cast("double").alias("least")).limit(0)
    if links.isEmpty():
        return none
    dots = points.where(_known(xyz()))
    cells = settled(dots.select(*keys, *_cells(xyz(), side)).distinct(), "cells")
    ends = cells.agg(*[f(c).alias(f"{n}{c}") for c in CELL for n, f in (("low", F.min), ("high", F.max))]).first()
    if ends[0] is None:
        return none
    levels = 0
    while any((ends[f"high{c}"] >> (STEP * levels)) - (ends[f"low{c}"] >> (STEP * levels)) > 1 for c in CELL):
        levels += 1
    at = lambda k: [F.shiftright(c, STEP * k).alias(c) for c in CELL]
    top = cells.select(*keys, *at(levels)).distinct()
    # at most eight cells for each key
    found = links.join(top, list(keys)) if keys else links.crossJoin(F.broadcast(top))
    for k in range(levels, -1, -1):
        if k < levels:
            upper = [F.shiftright(c, STEP * (k + 1)).alias(f"{c}_up") for c in CELL]
            inner = cells.select(*keys, *upper, *at(k)).distinct()
            found = found.withColumnsRenamed({c: f"{c}_up" for c in CELL}).join(inner, [*keys, *[f"{c}_up" for c in CELL]]).drop(*[f"{c}_up" for c in CELL])
        wide = side * 2 ** (STEP * k)
        half = wide * 0.75**0.5 * (1 + SLACK) + SLACK
        found = settled(found.withColumn("__d", segment_distance([(F.col(c) + 0.5) * wide for c in CELL], xyz("tx_"), xyz("rx_"))), "far-cells")
        best = found.groupBy(*keys, "link_id").agg((F.min("__d") + half).alias("__best"))
        found = found.join(best, [*keys, "link_id"]).where(F.col("__d") - half <= F.col("__best") * (1 + SLACK)).drop("__d", "__best")
    inside = dots.withColumns(dict(zip(CELL, _cells(xyz(), side), strict=True)))
    pairs = inside.join(found, [*keys, *CELL])
    return pairs.groupBy(*keys, "link_id").agg(F.min(segment_distance(xyz(), xyz("tx_"), xyz("rx_"))).alias("least"))
