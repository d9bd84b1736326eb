"""Queries over rigid transforms and radio formulas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import geometry as g
from fieldloom.plans.registry import Registry
from fieldloom.plans.tables import table

query = Registry()
QUERIES, SQL = query.queries, query.sql

ENTRIES = [f"m{r}{c}" for r in range(3) for c in range(4)]


def _pose(first: int) -> list[Column]:
    return [F.get(F.col("embedding"), F.lit(first + k)).cast("double") for k in range(6)]


def _pose_sql(first: int) -> list[str]:
    """The entries of a pose's affine matrix, DuckDB's lists counting from 1."""
    x, y, z, a, b, c = (f"embedding[{first + k + 1}]::DOUBLE" for k in range(6))
    ca, sa, cb, sb, cc, sc = f"cos({a})", f"sin({a})", f"cos({b})", f"sin({b})", f"cos({c})", f"sin({c})"
    return [
        f"{cc} * {cb}", f"{cc} * {sb} * {sa} - {sc} * {ca}", f"{cc} * {sb} * {ca} + {sc} * {sa}", x,
        f"{sc} * {cb}", f"{sc} * {sb} * {sa} + {cc} * {ca}", f"{sc} * {sb} * {ca} - {cc} * {sa}", y,
        f"-({sb})", f"{cb} * {sa}", f"{cb} * {ca}", z,
    ]


def _product_sql(a: list[str], b: list[str]) -> list[str]:
    return [" + ".join(f"({a[4 * r + k]}) * ({b[4 * k + c]})" for k in range(3)) + (f" + ({a[4 * r + 3]})" if c == 3 else "") for r in range(3) for c in range(4)]


def _select(rows: DataFrame, values: list[Column], names: list[str]) -> DataFrame:
    return rows.select("vec_id", *[F.round(v, 6).alias(n) for v, n in zip(values, names, strict=True)])


def _select_sql(values: list[str], names: list[str], source: str = "embeddings") -> str:
    return "SELECT vec_id, " + ", ".join(f"round({v}, 6) AS {n}" for v, n in zip(values, names, strict=True)) + f" FROM {source}"


@query(_select_sql(_pose_sql(0), ENTRIES))
def pose_to_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(table(spark, sf_dir, "embeddings"), g.pose_affine(_pose(0)), ENTRIES)


@query(_select_sql(_product_sql(_product_sql(_pose_sql(0), _pose_sql(6)), ["0.5", "0.0", "0.0", "0.0", "0.0", "2.0", "0.0", "0.0", "0.0", "0.0", "3.0", "0.0"]), ENTRIES))
def matrix_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = g.compose(g.compose(g.pose_affine(_pose(0)), g.pose_affine(_pose(6))), g.scale_affine((0.5, 2.0, 3.0)))
    return _select(table(spark, sf_dir, "embeddings"), chain, ENTRIES)


_CHAIN = "SELECT vec_id, " + ", ".join(f"{v} AS {n}" for v, n in zip(_product_sql(_pose_sql(0), _pose_sql(6)), ENTRIES, strict=True)) + " FROM embeddings"


@query(
    _select_sql(
        ["m03", "m13", "m23", "CASE WHEN flat < 1e-9 THEN atan2(-m12, m11) ELSE atan2(m21, m22) END", "atan2(-m20, flat)", "CASE WHEN flat < 1e-9 THEN 0.0 ELSE atan2(m10, m00) END"],
        ["x", "y", "z", "roll", "pitch", "yaw"],
        f"(SELECT *, sqrt(m00 * m00 + m10 * m10) AS flat FROM ({_CHAIN}))",
    )
)
def matrix_to_pose(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = g.compose(g.pose_affine(_pose(0)), g.pose_affine(_pose(6)))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", *[v.alias(n) for v, n in zip(chain, ENTRIES, strict=True)])
    return _select(rows, g.affine_pose([F.col(n) for n in ENTRIES]), ["x", "y", "z", "roll", "pitch", "yaw"])


def _quaternion_sql() -> list[str]:
    n = "sqrt(" + " + ".join(f"embedding[{k}]::DOUBLE * embedding[{k}]::DOUBLE" for k in range(1, 5)) + ")"
    x, y, z, w = (f"(embedding[{k}]::DOUBLE / {n})" for k in range(1, 5))
    a, b, c = (f"embedding[{k}]::DOUBLE" for k in (5, 6, 7))
    return [
        f"1 - 2 * ({y} * {y} + {z} * {z})", f"2 * ({x} * {y} - {z} * {w})", f"2 * ({x} * {z} + {y} * {w})", a,
        f"2 * ({x} * {y} + {z} * {w})", f"1 - 2 * ({x} * {x} + {z} * {z})", f"2 * ({y} * {z} - {x} * {w})", b,
        f"2 * ({x} * {z} - {y} * {w})", f"2 * ({y} * {z} + {x} * {w})", f"1 - 2 * ({x} * {x} + {y} * {y})", c,
    ]


@query(_select_sql(_quaternion_sql(), ENTRIES))
def quaternion_to_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = [F.get(F.col("embedding"), F.lit(k)).cast("double") for k in range(7)]
    return _select(table(spark, sf_dir, "embeddings"), g.quaternion_affine(v[:4], v[4:]), ENTRIES)


@query(_select_sql([f"({m[0]}) * p.x + ({m[1]}) * p.y + ({m[2]}) * p.z + ({m[3]})" for m in [_pose_sql(0)[4 * r : 4 * r + 4] for r in range(3)]], ["x", "y", "z"], "(SELECT *, {'x': embedding[13]::DOUBLE, 'y': embedding[14]::DOUBLE, 'z': embedding[15]::DOUBLE} AS p FROM embeddings)"))
def affine_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = g.apply(g.pose_affine(_pose(0)), g.point(F.col("embedding"), 12))
    return _select(table(spark, sf_dir, "embeddings"), moved, ["x", "y", "z"])


@query(
    """WITH p AS (SELECT vec_id, unnest(range(1, 64, 2)) AS k, embedding FROM embeddings),
    g AS (SELECT vec_id, sum(embedding[k]::DOUBLE * embedding[k]::DOUBLE + embedding[k + 1]::DOUBLE * embedding[k + 1]::DOUBLE) AS gain, min(embedding[k]) FILTER (WHERE embedding[k] > 0) AS low, max(embedding[k]) FILTER (WHERE embedding[k] > 0) AS high FROM p GROUP BY vec_id)
    SELECT vec_id, round(gain, 6) AS path_gain, round(10 * log10(gain + 1e-30), 6) + 0.0 AS gain_db, round(30.0 + 10 * log10(gain + 1e-30), 6) AS rx_power_dbm, round(high::DOUBLE - low::DOUBLE, 6) AS delay_spread FROM g"""
)
def db_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of components as complex amplitudes; the positive real parts as delays."""
    e = F.transform("embedding", lambda v: v.cast("double"))
    gain = F.aggregate(e, F.lit(0.0), lambda s, v: s + v * v)
    taus = F.filter(F.transform(F.sequence(F.lit(0), F.lit(62), F.lit(2)), lambda k: F.get(F.col("embedding"), k)), lambda v: v > 0)
    spread = F.array_max(taus).cast("double") - F.array_min(taus).cast("double")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", gain.alias("gain"), spread.alias("delay_spread"))
    db = g.decibels(F.col("gain"))
    return rows.select("vec_id", F.round("gain", 6).alias("path_gain"), (F.round(db, 6) + 0.0).alias("gain_db"), F.round(30.0 + db, 6).alias("rx_power_dbm"), F.round("delay_spread", 6).alias("delay_spread"))


@query("SELECT vec_id, round(1 / (1 + exp(-greatest(-60.0, least(60.0, embedding[1]::DOUBLE * 400)))), 6) AS p, round(embedding[2]::DOUBLE * 1e9, 2) AS hz FROM embeddings")
def sigmoid_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = [F.get(F.col("embedding"), F.lit(k)).cast("double") for k in range(2)]
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(g.sigmoid(v[0] * 400), 6).alias("p"), F.round(v[1] * 1e9, 2).alias("hz"))


@query("SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS x, round(embedding[2]::DOUBLE, 6) AS y, round(embedding[3]::DOUBLE, 6) AS z FROM embeddings")
def matrix_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = g.translation(g.nested(g.pose_affine(_pose(0))))
    return table(spark, sf_dir, "embeddings").select("vec_id", at.alias("t")).select("vec_id", *[F.round(F.get("t", F.lit(k)), 6).alias(n) for k, n in enumerate("xyz")])
