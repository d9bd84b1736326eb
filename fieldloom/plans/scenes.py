"""Queries over scene manifests, radio paths, scene documents and lookups.

A manifest has an order as model, its line items as links, and a visual of each, whose geometry goes by the line's
number."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import strings as s
from fieldloom.functions.classify import Rule
from fieldloom.functions.geometry import translation
from fieldloom.operators import frames, manifests, quality, radio
from fieldloom.operators.rounds import shared_dir
from fieldloom.operators.scans import numbered
from fieldloom.plans.registry import Registry
from fieldloom.plans.tables import table
from fieldloom.sources import actors, mesh_parts, pose_source, sinks

query = Registry()
QUERIES, SQL = query.queries, query.sql


@query(
    """WITH p AS (SELECT l_suppkey AS frame_id, l_returnflag AS rx_id, l_tax - 0.01 AS tau, l_discount AS re, l_quantity / 50 AS im, coalesce(CASE WHEN l_linenumber % 3 <> 0 THEN l_linestatus = 'F' END, l_tax - 0.01 >= 0) AS ok FROM lineitem),
    g AS (SELECT frame_id, rx_id, (count(*) FILTER (WHERE ok))::INT AS num_paths, min(tau) FILTER (WHERE ok) AS tau_min, max(tau) FILTER (WHERE ok) AS tau_max, coalesce(sum(re * re + im * im) FILTER (WHERE ok), 0) AS gain FROM p GROUP BY frame_id, rx_id)
    SELECT frame_id, rx_id, num_paths, round(tau_min, 6) AS tau_min, round(tau_max - tau_min, 6) AS delay_spread, round(gain, 6) AS path_gain_sum, round(30 + 10 * log10(gain + 1e-30), 6) AS rx_power_dbm FROM g"""
)
def link_powers(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("frame_id"), F.col("l_returnflag").alias("rx_id"), F.lit(30.0).alias("tx_power_dbm"), (F.col("l_tax") - 0.01).alias("tau"),
        F.col("l_discount").alias("re"), (F.col("l_quantity") / 50).alias("im"), F.when(F.col("l_linenumber") % 3 != 0, F.col("l_linestatus") == "F").alias("valid"),
    )
    out = radio.link_power(paths)
    return out.select("frame_id", "rx_id", "num_paths", *[F.round(c, 6).alias(c) for c in ("tau_min", "delay_spread", "path_gain_sum", "rx_power_dbm")])


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only what links are made of is gathered, and they are made of an order's sorted rows."""
    kinds, none = F.array(*map(F.lit, ("mesh", "box", "sphere", "cylinder"))), F.lit(None).cast("string")

    def link(x: Column) -> Column:
        n, supp, part = x["l_linenumber"], x["l_suppkey"], x["l_partkey"].cast("string")
        kind = F.element_at(kinds, (n % 4 + 1).cast("int"))
        visual = F.struct(
            F.when(n != 6, F.lit("v")).alias("visual_name"), F.lit("0 0 3 0 0 0").alias("visual_pose"), F.when(n != 7, kind).otherwise("cone").alias("geometry_type"),
            F.when((n % 4 == 0) & (supp % 2 == 1), F.concat(F.lit("model://m/"), supp.cast("string"), F.lit(".dae"))).alias("uri"), none.alias("scale"),
            F.when(n % 4 == 1, F.concat((supp % 5).cast("string"), F.lit(" 1 1"))).alias("size"), x["l_discount"].cast("double").alias("radius"), x["l_tax"].cast("double").alias("length"),
        )
        visuals = F.when((n == 2) & (x["l_returnflag"] == "R"), F.array().cast(f"array<{manifests.VISUAL.simpleString()}>")).otherwise(F.array(visual))
        return F.struct(part.alias("link"), F.when(n != 3, "1 0 0 0 0 0").otherwise("1 0 0").alias("link_pose"), visuals.alias("visuals"))

    lines = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_discount", "l_tax")))
    models = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(lines.alias("lines"))
    key = F.col("l_orderkey").cast("string")
    return models.select(key.alias("model"), F.concat(key, F.lit(" 2 3 0 0 0")).alias("model_pose"), (F.col("l_orderkey") % 2 == 0).alias("static"), F.transform("lines", link).alias("links"))


_MANIFEST = """WITH m AS (SELECT *, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1)::INT AS link_index, l_linenumber AS n,
        CASE WHEN l_linenumber = 7 THEN 'cone' ELSE ['mesh', 'box', 'sphere', 'cylinder'][l_linenumber % 4 + 1] END AS kind, l_linenumber = 2 AND l_returnflag = 'R' AS bare FROM lineitem),
    f AS (SELECT *, CASE WHEN n = 3 THEN 'link pose is invalid' WHEN n = 6 THEN 'visual has no name' WHEN kind = 'cone' THEN 'geometry type is not supported' WHEN kind = 'mesh' AND l_suppkey % 2 = 0 THEN 'mesh has no uri'
        WHEN kind = 'box' AND l_suppkey % 5 = 0 THEN 'size is invalid' WHEN kind IN ('sphere', 'cylinder') AND l_discount <= 0 THEN 'radius is not positive' WHEN kind = 'cylinder' AND l_tax <= 0 THEN 'length is not positive' END AS skip_reason
        FROM m WHERE NOT bare)"""


@query(_MANIFEST + " SELECT l_orderkey::VARCHAR AS model_name, link_index, 0 AS visual_index, kind AS geometry_type, skip_reason FROM f")
def manifest_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifests.flattened(_manifest(spark, sf_dir), "orders").select("model_name", "link_index", "visual_index", "geometry_type", "skip_reason")


@query(_MANIFEST + " SELECT skip_reason, count(*)::BIGINT AS n FROM f GROUP BY skip_reason")
def skip_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifests.skip_counts(manifests.flattened(_manifest(spark, sf_dir), "orders"))


@query(
    _MANIFEST
    + """, i AS (
        SELECT 'error' AS severity, 'link_pose has not six numbers' AS message FROM m WHERE n = 3
        UNION ALL SELECT 'info', 'Link has no visuals' FROM m WHERE bare
        UNION ALL SELECT 'error', 'Missing required field ''visual_name''' FROM f WHERE n = 6
        UNION ALL SELECT 'warning', 'Unsupported geometry_type ''cone''' FROM f WHERE kind = 'cone'
        UNION ALL SELECT 'error', 'mesh visual has no uri' FROM f WHERE kind = 'mesh' AND l_suppkey % 2 = 0
        UNION ALL SELECT 'warning', 'scale is missing; 1 1 1 is assumed' FROM f WHERE kind = 'mesh' AND l_suppkey % 2 = 1
        UNION ALL SELECT 'error', 'size values must be positive' FROM f WHERE kind = 'box' AND l_suppkey % 5 = 0
        UNION ALL SELECT 'error', 'radius must be positive' FROM f WHERE kind IN ('sphere', 'cylinder') AND l_discount <= 0
        UNION ALL SELECT 'error', 'length must be positive' FROM f WHERE kind = 'cylinder' AND l_tax <= 0)
    SELECT severity, 'orders' AS manifest, message, count(*)::BIGINT AS n FROM i GROUP BY severity, message"""
)
def manifest_issue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifests.validation_issues(_manifest(spark, sf_dir), "orders").groupBy("severity", "manifest", "message").agg(F.count(F.lit(1)).alias("n"))


@query(_MANIFEST + " SELECT l_orderkey::VARCHAR AS model_name, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_partkey::VARCHAR) AS links FROM m WHERE bare GROUP BY l_orderkey")
def links_without_visuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifests.nonrenderable_links(_manifest(spark, sf_dir)).select("model_name", F.array_join("links", ",").alias("links"))


@query(
    _MANIFEST
    + """ SELECT l_orderkey::VARCHAR AS model_name, count(*)::BIGINT AS n_links, (count(*) FILTER (WHERE NOT bare))::BIGINT AS n_renderable_links, (count(*) FILTER (WHERE NOT bare))::BIGINT AS n_visuals,
        coalesce(string_agg(l_partkey::VARCHAR, ',' ORDER BY l_partkey::VARCHAR) FILTER (WHERE bare), '') AS non_renderable_links FROM m GROUP BY l_orderkey"""
)
def model_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifests.model_summary(_manifest(spark, sf_dir)).withColumn("non_renderable_links", F.array_join("non_renderable_links", ","))


@query(
    """WITH p AS (SELECT p_partkey, ['mesh', 'box', 'sphere', 'cylinder'][p_partkey % 4 + 1] AS geometry_type, p_brand, p_name, p_type, p_size, p_retailprice FROM part)
    SELECT p_partkey::VARCHAR AS id, geometry_type, CASE WHEN geometry_type = 'mesh' THEN p_name END AS mesh_path, CASE WHEN geometry_type = 'box' THEN p_size END AS size,
        CASE WHEN geometry_type IN ('sphere', 'cylinder') THEN p_retailprice END AS radius, CASE WHEN geometry_type = 'cylinder' THEN p_retailprice / 2 END AS length FROM p"""
)
def member_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("mesh", "box", "sphere", "cylinder"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    names = {"model_name": "p_brand", "link_name": "p_name", "visual_name": "p_type", "material_class": "p_type", "status": "p_brand", "to_world": "p_size", "mesh_path": "p_name", "size": "p_size", "radius": "p_retailprice"}
    entries = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), kind.alias("geometry_type"), *[F.col(c).alias(n) for n, c in names.items()], (F.col("p_retailprice") / 2).alias("length"))
    return manifests.provenance(entries).select("id", "geometry_type", "mesh_path", "size", "radius", "length")


@query("SELECT c_custkey, printf('%g', c_acctbal / 7) AS short, printf('%.15g', c_acctbal / 1000) AS long FROM customer")
def general_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", s.general_text(F.col("c_acctbal") / 7).alias("short"), s.general_text(F.col("c_acctbal") / 1000, 15).alias("long"))


@query(
    """WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sample_index FROM events)
    SELECT n_nationkey AS frame_id, user_id, event_id, sample_index FROM e JOIN nation ON n_nationkey // 2 * 3 = sample_index"""
)
def selected_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = numbered(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"], "sample_index").drop("ts")
    chosen = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("frame_id"), (F.floor(F.col("n_nationkey") / 2) * 3).alias("source_sample_index"))
    return frames.selected(samples, chosen).select("frame_id", "user_id", "event_id", "sample_index")


_KINDS = (Rule("contains", "| 1", "metal"), Rule("contains", "| 2", "__skip__"))


@query(
    _MANIFEST
    + """, t AS (SELECT *, l_orderkey || ' | ' || l_partkey || ' | v' AS text FROM f WHERE skip_reason IS NULL AND l_orderkey % 2 = 0)
    SELECT l_orderkey || '__' || l_partkey || '__v' AS id, link_index, CASE WHEN contains(text, '| 1') THEN 'metal' ELSE 'composite' END AS material_class, 'ready' AS status,
        (l_orderkey + 1)::DOUBLE AS x, 2.0::DOUBLE AS y, 6.0::DOUBLE AS z FROM t WHERE contains(text, '| 1') OR NOT contains(text, '| 2')"""
)
def static_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = manifests.static_registry(manifests.flattened(_manifest(spark, sf_dir), "orders"), _KINDS)
    at = translation(F.col("to_world"))
    return out.select("id", "link_index", "material_class", "status", *[F.round(F.get(at, F.lit(k)), 6).alias(a) for k, a in enumerate("xyz")])


def _numbered(events: DataFrame, kind: str) -> DataFrame:
    rows = numbered(events.where(F.col("event_type") == kind).select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"], "place")
    return rows.select("user_id", (F.col("place") + 1).alias("place"), F.date_trunc("day", "ts").alias("day"))


@query(
    """WITH e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS place, date_trunc('day', ts) AS day FROM events),
    d AS (SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.place, b.place) AS place, a.day IS NULL AS only_right, b.day IS NULL AS only_left
        FROM (SELECT * FROM e WHERE event_type = 'click') a FULL JOIN (SELECT * FROM e WHERE event_type = 'view') b ON a.user_id = b.user_id AND a.place = b.place WHERE a.day IS DISTINCT FROM b.day)
    SELECT user_id, count(*)::BIGINT AS n, min(place)::BIGINT AS first_place, (count(*) FILTER (WHERE only_left))::BIGINT AS n_left, (count(*) FILTER (WHERE only_right))::BIGINT AS n_right FROM d GROUP BY user_id"""
)
def positional_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    out = quality.different_positions(_numbered(events, "click"), _numbered(events, "view"), ["user_id"], "place", "day")
    return out.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first_place"), F.count_if(F.col("right").isNull()).alias("n_left"), F.count_if(F.col("left").isNull()).alias("n_right"))


@query("SELECT user_id AS model, event_id // 40 AS sample_index, count(DISTINCT (event_type, date_trunc('day', ts)))::BIGINT AS n_stamps FROM events GROUP BY 1, 2 HAVING count(DISTINCT (event_type, date_trunc('day', ts))) > 1")
def stamps_of_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("model"), F.floor(F.col("event_id") / 40).alias("sample_index"), "event_type", F.date_trunc("day", "ts").alias("day"))
    return frames.inconsistent_samples(rows, ["event_type", "day"])


@query(
    r"""WITH p AS (SELECT p_partkey, p_retailprice AS x, floor(p_retailprice * 10)::BIGINT AS t, CASE p_partkey % 4 WHEN 0 THEN ' ' || p_size || '.5 ' WHEN 1 THEN 'nan' WHEN 2 THEN p_name ELSE '1e' || p_size % 9 END AS text, '/old/a/meshes/b/meshes/' || p_size || '.ply' AS path FROM part)
    SELECT p_partkey, regexp_replace(printf('%.6f', x), '\.?0+$', '') AS number, (t // 3600) || ':' || lpad((t % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((t % 60)::VARCHAR, 2, '0') AS elapsed,
        CASE WHEN isfinite(try_cast(trim(text) AS DOUBLE)) THEN try_cast(trim(text) AS DOUBLE) END AS lenient, x AS strict, '/new/meshes/' || parse_filename(path) AS moved FROM p"""
)
def number_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size, x = F.col("p_partkey") % 4, F.col("p_size").cast("string"), F.col("p_retailprice")
    text = F.when(k == 0, F.concat(F.lit(" "), size, F.lit(".5 "))).when(k == 1, "nan").when(k == 2, F.col("p_name")).otherwise(F.concat(F.lit("1e"), (F.col("p_size") % 9).cast("string")))
    path = F.concat(F.lit("/old/a/meshes/b/meshes/"), size, F.lit(".ply"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", sinks.number_text(x).alias("number"), s.elapsed(F.floor(x * 10)).alias("elapsed"), s.lenient_double(text).alias("lenient"),
        s.strict_double(x.cast("string"), "p_retailprice").alias("strict"), s.rerooted(path, "/new", "meshes").alias("moved"),
    )


@query(
    """WITH t AS (SELECT DISTINCT round(value) AS at FROM events), e AS (SELECT user_id, event_id, round(value, 1) AS time FROM events)
    SELECT user_id AS actor, event_id AS waypoint, t.at, floor(time * 25)::BIGINT AS frame, round(time * 25 - floor(time * 25), 6) AS fraction FROM e JOIN t ON abs(time - t.at) <= 1e-9"""
)
def waypoints_at_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    points = events.select(F.col("user_id").alias("actor"), F.col("event_id").alias("waypoint"), F.round("value", 1).alias("time"))
    found = actors.poses_at(points, events.select(F.round("value").alias("at")).distinct()).withColumn("sub", actors.sub_frames(F.col("time"), 25))
    return found.select("actor", "waypoint", "at", "sub.frame", F.round("sub.fraction", 6).alias("fraction"))


@query(
    """WITH j AS (SELECT o_orderkey, o_custkey, o_orderkey % 25 AS nation, c_nationkey FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey)
    SELECT 'good' AS problem, count(*)::BIGINT AS n FROM j WHERE c_nationkey = nation
    UNION ALL SELECT 'not in the index', count(*)::BIGINT FROM j WHERE c_nationkey IS NULL UNION ALL SELECT 'another nation', count(*)::BIGINT FROM j WHERE c_nationkey <> nation"""
)
def index_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("cust"), (F.col("o_orderkey") % 25).alias("nation"))
    index = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("cust"), F.col("c_nationkey").alias("nation"))
    good, bad = radio.checked_lookup(rows, index, "cust", "nation")
    return good.select(F.lit("good").alias("problem")).unionAll(bad.select("problem")).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT s_suppkey AS frame_id, s_nationkey AS rx_id, c_acctbal AS power, c_custkey IS NOT NULL AS sanity_ok, CASE WHEN c_custkey IS NULL THEN 'no recorded row' END AS error_message FROM supplier LEFT JOIN customer ON c_custkey = s_suppkey AND c_nationkey = s_nationkey")
def recorded_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("frame_id"), F.col("s_nationkey").alias("rx_id"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("frame_id"), F.col("c_nationkey").alias("rx_id"), F.col("c_acctbal").alias("power"))
    return radio.recorded(links, rows)


def _slug_sql(c: str) -> str:
    return f"trim(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]+', '_', 'g'), '_')"


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("n_nationkey") % 2 == 0, "metal").otherwise("glass")
    mesh: Column = F.concat(F.lit("meshes/"), s.slugify(F.col("n_name")), F.lit(".ply"))
    return table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("frame_id"), F.col("n_name").alias("id"), mesh.alias("mesh_path"), kind.alias("material_class"))


def _scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = "material_class string, itu_type string, relative_permittivity double, conductivity double, thickness double, scattering_coefficient double, xpd_coefficient double"
    return sinks.scene_xml(_entries(spark, sf_dir), spark.createDataFrame([("metal", None, 1.0, 1e7, 0.1, 0.25, 0.0), ("glass", "glass", None, None, 0.01, 0.0, 0.5)], columns))


def _bsdf_sql(kind: str, name: str, *values: tuple[str, str, str]) -> str:
    return f"""'    <bsdf type="{kind}" id="mat-{name}">' || chr(10) || """ + " || ".join(f"""'        <{t} name="{k}" value="{v}" />' || chr(10)""" for t, k, v in values) + " || '    </bsdf>' || chr(10)"


def _tail(thickness: str, scattering: str, xpd: str) -> list[tuple[str, str, str]]:
    return [("float", "thickness", thickness), ("float", "scattering_coefficient", scattering), ("float", "xpd_coefficient", xpd)]


_METAL = _bsdf_sql("radio-material", "metal", ("float", "relative_permittivity", "1"), ("float", "conductivity", "10000000"), *_tail("0.1", "0.25", "0"))
_GLASS = _bsdf_sql("itu-radio-material", "glass", ("string", "type", "glass"), *_tail("0.01", "0", "0.5"))


@query(
    f"""WITH e AS (SELECT n_regionkey AS frame_id, n_name, {_slug_sql("n_name")} AS slug, CASE WHEN n_nationkey % 2 = 0 THEN 'metal' ELSE 'glass' END AS kind FROM nation),
    g AS (SELECT frame_id, bool_or(kind = 'glass') AS glass, bool_or(kind = 'metal') AS metal, count(*)::INT AS n_shapes,
        string_agg('    <shape type="ply" id="' || slug || '">' || chr(10) || '        <string name="filename" value="meshes/' || slug || '.ply" />' || chr(10) || '        <ref id="mat-' || kind || '" />' || chr(10) || '    </shape>' || chr(10), '' ORDER BY n_name) AS shapes FROM e GROUP BY frame_id)
    SELECT frame_id, n_shapes, md5('<scene version="3.0.0">' || chr(10) || CASE WHEN glass THEN {_GLASS} ELSE '' END || CASE WHEN metal THEN {_METAL} ELSE '' END || shapes || '</scene>' || chr(10)) AS xml_md5 FROM g"""
)
def scene_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scenes(spark, sf_dir).select("frame_id", "n_shapes", F.md5("xml").alias("xml_md5"))


@query(
    f"""SELECT n_regionkey AS frame_id, 'meshes/' || {_slug_sql("n_name")} || '.ply' AS detail, 'file is missing' AS problem FROM nation WHERE n_nationkey % 7 = 0
    UNION ALL SELECT n_regionkey, count(*) || ' instead of ' || (count(*) + n_regionkey % 2), 'number of shapes' FROM nation GROUP BY n_regionkey HAVING n_regionkey % 2 = 1"""
)
def scene_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    listing = nation.where("n_nationkey % 7 <> 0").select(F.concat(F.lit("meshes/"), s.slugify(F.col("n_name")), F.lit(".ply")).alias("path"))
    expected = nation.groupBy(F.col("n_regionkey").alias("frame_id")).agg((F.count(F.lit(1)) + F.first("n_regionkey") % 2).alias("n_expected"))
    return quality.scene_problems(_scenes(spark, sf_dir), expected, listing)


@query(
    """WITH s AS (SELECT n_regionkey AS frame_id, n_name AS model, string_agg('"' || s_name || '":' || s_suppkey, ',' ORDER BY s_name) AS links FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2)
    SELECT frame_id, md5('{' || string_agg('"' || model || '":{"links":{' || links || '}}', ',' ORDER BY model) || '}') AS json_md5 FROM s GROUP BY frame_id"""
)
def nested_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    records = rows.select(F.col("n_regionkey").alias("frame_id"), F.col("n_name").alias("model"), F.col("s_name").alias("link"), F.col("s_suppkey").alias("record"))
    return frames.frame_structs(records).select("frame_id", F.md5(F.to_json("models")).alias("json_md5"))


@query(
    """SELECT p_partkey, CASE WHEN p_size > 5 AND p_partkey % 3 < 2 THEN '/new/meshes/' || p_size || '.ply' END AS resolved, p_size = 7 AND p_partkey % 3 = 1 AS turned,
        CASE p_partkey % 3 WHEN 0 THEN 'moved' WHEN 1 THEN 'own' ELSE 'gone' END AS kind FROM part"""
)
def moved_meshes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey") % 3
    name = F.concat(F.col("p_size").cast("string"), F.lit(".ply"))
    path = F.concat(F.when(k == 0, "/old/world/meshes/").when(k == 1, "/new/meshes/").otherwise("/gone/"), name)
    rows = part.select("p_partkey", path.alias("mesh_path"), F.when(k == 0, "moved").when(k == 1, "own").otherwise("gone").alias("kind"))
    found = manifests.resolved_paths(rows, "mesh_path", part.where("p_size > 5").select(F.concat(F.lit("/new/meshes/"), name).alias("path")), "/new", "meshes")
    turned = F.round(F.get(F.get("correction", F.lit(1)), F.lit(2)), 6) == 1
    return manifests.corrected(found, ["/new/meshes/7.ply"]).select("p_partkey", "resolved", turned.alias("turned"), "kind")


@query("SELECT p_type AS material_class, (count(*) FILTER (WHERE p_size > 10))::BIGINT AS n, (count(*) FILTER (WHERE p_size > 10))::INT AS n_members, sum(p_size)::BIGINT AS vertices FROM part GROUP BY p_type HAVING count(*) FILTER (WHERE p_size > 10) > 0")
def merged_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    entries = part.select(F.col("p_type").alias("material_class"), F.col("p_partkey").cast("string").alias("id"), F.when(F.col("p_size") > 10, "ready").otherwise("skipped").alias("status"))
    results = part.groupBy(F.col("p_type").alias("material_class")).agg(F.sum("p_size").alias("vertices"))
    return manifests.with_group_results(manifests.merge_groups(entries), results).select("material_class", "n", F.size("members").alias("n_members"), "vertices")


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


@query("SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings")
def mesh_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first components of all vectors, written as binary meshes and read again in ranges of a few rows."""
    at = [F.get("embedding", F.lit(k)).cast("double").alias(a) for k, a in enumerate("xyz")]
    files = mesh_parts.write_ply_parts(table(spark, sf_dir, "embeddings").select("vec_id", *at), _folder(spark, "meshes"))
    paths = [r.mesh_path for r in files.collect()]  # one for each task
    rows = mesh_parts.read_ply_parts(spark, paths, ["x", "vec_id", "z", "y"], part_bytes=1 << 16)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "x", "y", "z")


def _pose_log(spark: SparkSession, sf_dir: str) -> str:
    """The events as a motion log, each a block with nested ones."""
    block = (
        'pose {\n  name: "%s::%d"\n  header {\n    stamp {\n      sec: %d\n      nsec: %d\n    }\n    data {\n      key: "child_frame_id"\n      value: "%s::%d"\n    }\n'
        '    data {\n      key: "note"\n      value: "} pose {"\n    }\n  }\n  position {\n    x: %s\n    z: -1.5e0\n  }\n  orientation {\n    w: 1\n  }\n}'
    )
    e = table(spark, sf_dir, "events")
    folder = _folder(spark, "poses")
    e.select(F.format_string(block, "event_type", "user_id", "event_id", F.lit(7), "event_type", "user_id", F.col("value").cast("string"))).write.text(folder)
    return folder


_POSES = "SELECT event_type AS model, user_id::VARCHAR AS link, event_id AS sec, 7::INT AS nsec, '} pose {' AS note, value AS x, 0.0::DOUBLE AS y, -1.5::DOUBLE AS z, NULL::VARCHAR AS error FROM events"


def _poses(rows: DataFrame) -> DataFrame:
    return rows.select("model", "link", "sec", "nsec", F.col("header")["note"].alias("note"), *[F.get("at", F.lit(k)).alias(a) for k, a in enumerate("xyz")], "error")


@query(_POSES)
def pose_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log's blocks, each file read in ranges that cut blocks."""
    return _poses(pose_source.read_pose_blocks(spark, pose_source.files_below(_pose_log(spark, sf_dir)), part_bytes=1 << 18))


@query(_POSES)
def stream_pose_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream with offsets in the files."""
    from fieldloom.streaming.stateful import run_available

    return run_available(_poses(pose_source.stream_pose_blocks(spark, _pose_log(spark, sf_dir), part_bytes=1 << 18)), _folder(spark, "pose-rows"))


@query(
    """SELECT o_orderkey AS frame_id, o_custkey AS rx_id, CASE WHEN o_orderkey % 11 <> 0 THEN round(o_totalprice / 8, 6) END AS gain, (o_orderkey % 11 <> 0) AS sanity_ok,
        CASE WHEN o_orderkey % 11 = 0 THEN 'ValueError: no path' END AS error_message FROM orders"""
)
def resumed_solver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links that are solved in parts: a first run stops at a link that can't be, a second goes on with what is left."""
    links = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("frame_id"), F.col("o_custkey").alias("rx_id"), F.col("o_totalprice").cast("double").alias("price"))
    folder = _folder(spark, "solved")

    def solve(link: Mapping[str, Any]) -> Mapping[str, Any]:
        if link["frame_id"] % 11 == 0:
            raise ValueError("no path")
        return {"gain": link["price"] / 8}

    try:
        radio.solve_in_parts(links, solve, "gain double", folder, parts=4)
    except radio.UnsolvedLinks:
        pass
    out = radio.solve_in_parts(links, solve, "gain double", folder, parts=4, go_on=True)
    return out.select("frame_id", "rx_id", F.round("gain", 6).alias("gain"), "sanity_ok", "error_message")
