"""Queries over subsets of objects, nearest values and boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions.geometry import box_volume, point, primitive_volume, segment_distance
from fieldloom.operators import features
from fieldloom.operators.ablation import without_prefixes
from fieldloom.plans.registry import Registry
from fieldloom.plans.tables import table

query = Registry()
QUERIES, SQL = query.queries, query.sql

TX, RX = (0.0, 0.0, 0.3), (0.4, -0.2, 0.1)


def _segment_sql(p: tuple[str, str, str], a: tuple, b: tuple) -> str:
    d = [f"({y} - {x})" for x, y in zip(a, b, strict=True)]
    size = " + ".join(f"{x} * {x}" for x in d)
    dot = " + ".join(f"({q} - {x}) * {k}" for q, x, k in zip(p, a, d, strict=True))
    t = f"greatest(0.0, least(1.0, ({dot}) / ({size})))"
    return "sqrt(" + " + ".join(f"({q} - ({x} + {t} * {k})) * ({q} - ({x} + {t} * {k}))" for q, x, k in zip(p, a, d, strict=True)) + ")"


def _distance_sql(p: tuple[str, str, str], a: tuple) -> str:
    return "sqrt(" + " + ".join(f"({q} - {x}) * ({q} - {x})" for q, x in zip(p, a, strict=True)) + ")"


_XYZ = ("x", "y", "z")
_POINTS = "SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings"


@query(
    f"""WITH p AS ({_POINTS}), d AS (SELECT *, {_segment_sql(_XYZ, TX, RX)} AS d FROM p)
    SELECT label, count(*)::BIGINT AS n, round(avg(d), 6) AS mean_d, round(min(d), 6) AS min_d, round(stddev_pop(d), 6) AS std_d FROM d GROUP BY label"""
)
def segment_distance_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = segment_distance(point(F.col("embedding")), TX, RX)
    rows = table(spark, sf_dir, "embeddings").select("label", d.alias("d"))
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("d"), 6).alias("mean_d"), F.round(F.min("d"), 6).alias("min_d"), F.round(F.stddev_pop("d"), 6).alias("std_d"))


TYPES = ("STANDARD", "SMALL", "MEDIUM", "LARGE", "ECONOMY", "PROMO")
_STATS = features.STATISTICS


def _objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as objects: their supplier is the frame, quantity, discount and tax are the centre."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_quantity", "l_discount", "l_tax", "l_linenumber", "l_returnflag")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size")
    rows = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).withColumns(
        {"volume": F.col("p_size").cast("double"), "vertex_count": F.col("l_linenumber").cast("long"), "face_count": F.col("p_size").cast("long")}
    )
    centre = [F.col("l_quantity") / 50, F.col("l_discount"), F.col("l_tax")]
    return features.with_distances(rows, centre, TX, RX)


def _subset_sql() -> str:
    out = ["count(*)::BIGINT AS count", "count(cx)::BIGINT AS centroid_count"]
    for d in features.DISTANCES:
        out += [f"round(coalesce(avg({d}), 0), 6) AS {d}_mean", f"round(coalesce(min({d}), 0), 6) AS {d}_min"]
    out += ["round(sum(v), 6) AS volume_sum", "round(avg(v), 6) AS volume_mean", "sum(nv)::BIGINT AS vertex_sum", "sum(nf)::BIGINT AS face_sum"]
    for a in "xyz":
        out += [f"round(avg(c{a}), 6) AS centroid_{a}_mean", f"round(stddev_pop(c{a}), 6) AS centroid_{a}_std"]
    return ", ".join(out)


_CENTRE = ("cx", "cy", "cz")
_SUBSETS = f"""
    WITH o AS (SELECT l_suppkey, l_returnflag, p_type, l_quantity / 50 AS cx, l_discount AS cy, l_tax AS cz, p_size::DOUBLE AS v, l_linenumber AS nv, p_size AS nf FROM lineitem JOIN part ON l_partkey = p_partkey),
    d AS (SELECT *, {_distance_sql(_CENTRE, RX)} AS rx_dist, {_distance_sql(_CENTRE, TX)} AS tx_dist, {_segment_sql(_CENTRE, TX, RX)} AS line_dist FROM o),
    m AS (SELECT *, unnest([s for s in ['all', CASE WHEN l_returnflag = 'R' THEN 'dynamic' ELSE 'static' END, 'mat_' || lower(p_type)] if s IS NOT NULL]) AS subset FROM d),
    long AS (SELECT l_suppkey, subset, {_subset_sql()} FROM m GROUP BY l_suppkey, subset)"""


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = features.subset_keys(every=F.lit("all"), moving=F.when(F.col("l_returnflag") == "R", "dynamic").otherwise("static"), material=F.concat(F.lit("mat_"), F.lower("p_type")))
    return features.subset_statistics(_objects(spark, sf_dir), ["l_suppkey"], keys)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(_SUBSETS + " SELECT * FROM long")
def subset_stats_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_long(spark, sf_dir))


_WIDE = ("all", "dynamic", "static")


@query(
    _SUBSETS
    + " SELECT l_suppkey, "
    + ", ".join(f"coalesce(max({v}) FILTER (WHERE subset = '{s}'), 0) AS {s}_{v}" for s in _WIDE for v in _STATS)
    + " FROM long WHERE subset IN ('all', 'dynamic', 'static') GROUP BY l_suppkey"
)
def subset_stats_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = _long(spark, sf_dir).where(F.col("subset").isin(*_WIDE))
    return _rounded(features.widened(long, ["l_suppkey"], _WIDE))


#: Receivers around the origin, as inline test links.
LINKS = ((0, 0.2, 0.1, 0.0), (1, -0.3, 0.2, 0.1), (2, 0.05, -0.4, 0.3))
_NEAR = ("0p25m", "0p50m", "1p00m")


@query(
    f"""WITH p AS ({_POINTS}), l(link_id, rx, ry, rz) AS (VALUES {", ".join(str(x) for x in LINKS)}),
    d AS (SELECT link_id, {_segment_sql(_XYZ, TX, ("rx", "ry", "rz"))} AS d, {_distance_sql(_XYZ, ("rx", "ry", "rz"))} AS dr, {_distance_sql(_XYZ, TX)} AS dt FROM p, l)
    SELECT link_id::INT AS link_id, {", ".join(f"(count(*) FILTER (WHERE d <= {r}))::BIGINT AS near_link_{n}" for r, n in zip((0.25, 0.5, 1.0), _NEAR, strict=True))},
        (count(*) FILTER (WHERE dr <= 0.5))::BIGINT AS near_rx_0p50m, (count(*) FILTER (WHERE dt <= 0.5))::BIGINT AS near_tx_0p50m,
        round(min(d), 6) AS min_link_distance, round(count(*) FILTER (WHERE d <= 0.5) / count(*), 6) AS corridor_ratio_0p50m FROM d GROUP BY link_id"""
)
def occupancy_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, z = point(F.col("embedding"))
    vertices = table(spark, sf_dir, "embeddings").select(x.alias("x"), y.alias("y"), z.alias("z"))
    links = spark.createDataFrame([(i, *TX, *map(float, r)) for i, *r in LINKS], "link_id int, tx_x double, tx_y double, tx_z double, rx_x double, rx_y double, rx_z double")
    return _rounded(features.occupancy(vertices, links, None))


@query(
    """WITH r AS (SELECT l_suppkey, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice, l_orderkey, l_linenumber) AS k FROM lineitem)
    SELECT l_suppkey, round(avg(l_extendedprice), 4) AS mean_l_extendedprice_k20, count(*)::BIGINT AS n FROM r WHERE k <= 20 GROUP BY l_suppkey"""
)
def bottom_k_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = features.smallest_mean(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice", ["l_orderkey", "l_linenumber"], 20)
    return out.withColumn("mean_l_extendedprice_k20", F.round("mean_l_extendedprice_k20", 4))


@query(
    f"""WITH p AS ({_POINTS}), b AS (SELECT label, {", ".join(f"min({a}) AS min_{a}, max({a}) AS max_{a}" for a in "xyz")}, count(*)::BIGINT AS n_vertices FROM p GROUP BY label)
    SELECT label, n_vertices, {", ".join(f"round((min_{a} + max_{a}) / 2, 6) AS centre_{a}" for a in "xyz")}, round((max_x - min_x) * (max_y - min_y) * (max_z - min_z), 6) AS volume FROM b"""
)
def aabb_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, z = point(F.col("embedding"))
    boxes = features.bounding_boxes(table(spark, sf_dir, "embeddings").select("label", x.alias("x"), y.alias("y"), z.alias("z")), ["label"])
    low, high = ([F.col(f"{s}_{a}") for a in "xyz"] for s in ("min", "max"))
    centres = [F.round((a + b) / 2, 6).alias(f"centre_{n}") for a, b, n in zip(low, high, "xyz", strict=True)]
    return boxes.select("label", "n_vertices", *centres, F.round(box_volume(low, high), 6).alias("volume"))


@query(
    """WITH p AS (SELECT p_partkey, CASE p_type WHEN 'STANDARD' THEN 'box' WHEN 'SMALL' THEN 'cylinder' WHEN 'PROMO' THEN 'sphere' ELSE 'mesh' END AS kind, p_size::DOUBLE AS s FROM part)
    SELECT p_partkey, kind, round(CASE kind WHEN 'box' THEN s * 2 * 0.5 WHEN 'cylinder' THEN pi() * s * s * 3 WHEN 'sphere' THEN 4.0 / 3.0 * pi() * s * s * s END, 4) AS volume FROM p"""
)
def primitive_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("p_type") == "STANDARD", "box").when(F.col("p_type") == "SMALL", "cylinder").when(F.col("p_type") == "PROMO", "sphere").otherwise("mesh")
    size = F.col("p_size").cast("double")
    volume = primitive_volume(F.col("kind"), [size, F.lit(2.0), F.lit(0.5)], size, F.lit(3.0))
    return table(spark, sf_dir, "part").withColumn("kind", kind).select("p_partkey", "kind", F.round(volume, 4).alias("volume"))


@query("SELECT l_returnflag, count(*)::BIGINT AS n, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_discount), 6) AS avg_disc FROM lineitem GROUP BY l_returnflag")
def column_prefix_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = without_prefixes(table(spark, sf_dir, "lineitem"), ["l_"], ["l_ship", "l_order"])
    return kept.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.avg("l_discount"), 6).alias("avg_disc"))
