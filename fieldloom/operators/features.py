"""Features of links and the objects around them: overlapping subsets, distances, occupancy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions.geometry import Point, distance, segment_distance
from fieldloom.operators import grid
from fieldloom.operators.rounds import settled

#: Suffixes of the statistics of a subset.
DISTANCES = ("rx_dist", "tx_dist", "line_dist")
STATISTICS = (
    "count",
    "centroid_count",
    *(f"{d}_{s}" for d in DISTANCES for s in ("mean", "min")),
    "volume_sum",
    "volume_mean",
    "vertex_sum",
    "face_sum",
    *(f"centroid_{a}_{s}" for a in "xyz" for s in ("mean", "std")),
)


def subset_keys(**kinds: Column) -> Column:
    """The subsets that a row belongs to: `kind_value`, or `kind` where the value is true; null and false: none."""
    return F.array_compact(F.array(*kinds.values()))


def with_distances(df: DataFrame, centre: Point, tx: Point, rx: Point) -> DataFrame:
    """Adds centroid_x, _y, _z and the distances of the centre to both ends and to the stretch between."""
    found = dict(zip(DISTANCES, (distance(centre, rx), distance(centre, tx), segment_distance(centre, tx, rx)), strict=True))
    return df.withColumns({f"centroid_{a}": c for a, c in zip("xyz", centre, strict=True)} | found)


def statistics(nulls: bool = False) -> list[Column]:
    """The 18 aggregates. Without rows a mean or sum is 0 unless `nulls`."""
    zero = (lambda c: c) if nulls else (lambda c: F.coalesce(c, F.lit(0.0)))
    out = [F.count(F.lit(1)).alias("count"), F.count("centroid_x").alias("centroid_count")]
    for d in DISTANCES:
        out += [zero(F.avg(d)).alias(f"{d}_mean"), zero(F.min(d)).alias(f"{d}_min")]
    out += [zero(F.sum("volume")).alias("volume_sum"), zero(F.avg("volume")).alias("volume_mean")]
    out += [F.coalesce(F.sum(c), F.lit(0)).alias(f"{s}_sum") for c, s in (("vertex_count", "vertex"), ("face_count", "face"))]
    for a in "xyz":
        out += [zero(F.avg(f"centroid_{a}")).alias(f"centroid_{a}_mean"), zero(F.stddev_pop(f"centroid_{a}")).alias(f"centroid_{a}_std")]
    return out


def subset_statistics(objects: DataFrame, keys: Sequence[str], subsets: Column) -> DataFrame:
    """Long form: a row per `keys` and subset. Rows are copied to each of their subsets and combined before the
    shuffle, so the shuffle carries a row per task, key and subset."""
    return objects.withColumn("subset", F.explode(subsets)).groupBy(*keys, "subset").agg(*statistics())


def widened(long: DataFrame, keys: Sequence[str], subsets: Sequence[str]) -> DataFrame:
    """Wide form: `subset_statistic` columns in alphabetical order; a subset without rows has zeros."""
    values = [c for c in long.columns if c not in (*keys, "subset")]
    wide = long.groupBy(*keys).pivot("subset", list(subsets)).agg(*[F.first(v).alias(v) for v in values])
    names = sorted(f"{s}_{v}" for s in subsets for v in values)
    return wide.select(*keys, *[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in names])


def occupancy(vertices: DataFrame, links: DataFrame, frame: str | None, radii: Sequence[float] = (0.25, 0.5, 1.0), ends: float = 0.5) -> DataFrame:
    """For each link, how many vertices lie within each radius of it and of its ends, the least distance and the
    share within `ends` of it. vertices: x, y, z; links: link_id, tx_*, rx_*; both with `frame` if given, in which
    link_id is unique. A link meets the vertices in the cells of a grid that its corridor crosses; if none is within the
    largest radius, the least distance is found by going down the grid from its coarsest cells. A vertex without
    coordinates counts in the share only; a link without has no distance."""
    keys = [frame] if frame else []
    reach = max(*radii, ends)
    dots = vertices.select(*keys, "x", "y", "z")
    near = grid.near_links(dots, links, keys, reach).withColumns({"d_rx": distance(grid.xyz(), grid.xyz("rx_")), "d_tx": distance(grid.xyz(), grid.xyz("tx_"))})
    name = lambda r: f"{r:.2f}m".replace(".", "p")
    counts = {f"near_link_{name(r)}": F.count_if(F.col("d_link") <= r) for r in radii}
    counts |= {f"near_{e}_{name(ends)}": F.count_if(F.col(f"d_{e}") <= ends) for e in ("rx", "tx")}
    share = f"corridor_ratio_{name(ends)}"
    found = settled(near.groupBy(*keys, "link_id").agg(*[c.alias(n) for n, c in counts.items()], F.min("d_link").alias("near"), F.count_if(F.col("d_link") <= ends).alias("inside")), "near-links")
    far = links.join(found.where(F.col("near") <= reach), [*keys, "link_id"], "left_anti")
    least = grid.least_distances(dots, far, keys, reach)
    total = vertices.groupBy(*keys).agg(F.count(F.lit(1)).alias("vertices_in_all"))
    total = total.where("vertices_in_all > 0")
    rows = links.select(*keys, "link_id")
    rows = rows.join(total, frame) if frame else rows.crossJoin(F.broadcast(total))
    rows = rows.join(found, [*keys, "link_id"], "left").join(least, [*keys, "link_id"], "left")
    minimum = F.when(F.col("near") <= reach, F.col("near")).otherwise(F.col("least"))
    return rows.select(*keys, "link_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in counts], minimum.alias("min_link_distance"), (F.coalesce("inside", F.lit(0)) / F.col("vertices_in_all")).alias(share))


def smallest_mean(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], k: int) -> DataFrame:
    """Mean of the k smallest values of each key (all, where there are fewer). Ranks are cut before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(value, *order)
    return df.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= k).groupBy(*keys).agg(F.avg(value).alias(f"mean_{value}_k{k}"), F.count(F.lit(1)).alias("n"))


def bounding_boxes(vertices: DataFrame, keys: Sequence[str]) -> DataFrame:
    return vertices.groupBy(*keys).agg(*[f(a).alias(f"{n}_{a}") for a in "xyz" for n, f in (("min", F.min), ("max", F.max))], F.count(F.lit(1)).alias("n_vertices"))
