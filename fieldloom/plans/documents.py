"""Queries over nested documents, names and markup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import strings as s
from fieldloom.operators import presence
from fieldloom.plans.registry import Registry
from fieldloom.plans.tables import table

query = Registry()
QUERIES, SQL = query.queries, query.sql


@query(
    """SELECT o_orderkey, l_linenumber, (row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1)::INT AS visual_index, l_partkey, l_quantity
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey"""
)
def nested_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their lines nested, and flattened again with places."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))).alias("lines"))
    nested = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    flat = nested.select("o_orderkey", F.posexplode("lines").alias("visual_index", "l"))
    return flat.select("o_orderkey", "l.l_linenumber", "visual_index", "l.l_partkey", "l.l_quantity")


@query(
    """SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k, nullif(regexp_extract(props, '"(.*)"', 1), '') AS quoted FROM events"""
)
def props_map_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    header = F.from_json("props", "map<string,string>")
    return table(spark, sf_dir, "events").select("event_id", F.try_element_at(header, F.lit("k")).try_cast("long").alias("k"), s.quoted_value(F.col("props")).alias("quoted"))


@query(
    r"""WITH d AS (SELECT doc_id, trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', '_', 'g'), '_') AS slug FROM documents)
    SELECT doc_id, md5(CASE WHEN slug = '' THEN 'item' ELSE slug END) AS slug_md5, length(slug)::INT AS slug_chars FROM d"""
)
def slugify_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    slug = table(spark, sf_dir, "documents").select("doc_id", s.slugify(F.col("text"), "").alias("slug"))
    return slug.select("doc_id", F.md5(F.when(F.col("slug") == "", "item").otherwise(F.col("slug"))).alias("slug_md5"), F.length("slug").alias("slug_chars"))


@query(
    r"""SELECT p_partkey, trim(regexp_replace(p_brand || ' / ' || p_name || '.v1', '[^\p{L}\p{N}_.-]', '_', 'g'), '_') AS file_name,
    trim(regexp_replace(lower(trim(p_name)), '[^\p{L}\p{N}]+', '_', 'g'), '_') AS slug FROM part"""
)
def safe_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("p_brand", F.lit(" / "), "p_name", F.lit(".v1"))
    return table(spark, sf_dir, "part").select("p_partkey", s.safe_filename(text).alias("file_name"), s.safe_slug(F.col("p_name")).alias("slug"))


@query(
    """SELECT s_suppkey, string_split(replace(s_name, '#', '::'), '::')[1] AS scope, string_split(replace(s_name, '#', '::'), '::')[2] AS name,
        s_nationkey || '__' || s_name AS visual_id, 'frame_' || lpad(s_suppkey::VARCHAR, greatest(3, length(s_suppkey::VARCHAR))::INT, '0') AS frame_name,
        regexp_replace('rx_' || s_name || '_base', '^rx_|_base$', '', 'g') AS receiver FROM supplier"""
)
def scoped_name_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = s.scoped_parts(F.replace("s_name", F.lit("#"), F.lit("::")))
    rows = table(spark, sf_dir, "supplier").withColumn("p", parts)
    receiver = s.receiver_label(F.concat(F.lit("rx_"), "s_name", F.lit("_base")))
    return rows.select("s_suppkey", "p.scope", "p.name", s.composite_id(F.col("s_nationkey"), F.col("s_name")).alias("visual_id"), s.frame_name(F.col("s_suppkey")).alias("frame_name"), receiver.alias("receiver"))


@query(
    r"""WITH t AS (SELECT p_partkey, p_size || ' ' || p_retailprice || CASE WHEN p_size % 3 = 0 THEN ' x' WHEN p_size % 3 = 1 THEN ' -1.5' ELSE '' END AS text FROM part),
    v AS (SELECT p_partkey, list_transform(regexp_split_to_array(trim(text), '\s+'), lambda x: try_cast(x AS DOUBLE)) AS v FROM t)
    SELECT p_partkey, len(v) = 3 AND list_position(v, NULL) IS NULL AND len(list_filter(v, lambda x: x IS NULL)) = 0 AS valid,
        CASE WHEN len(v) = 3 AND len(list_filter(v, lambda x: x IS NULL)) = 0 THEN round(v[1] + v[2] + v[3], 4) END AS total FROM v"""
)
def numeric_list_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.when(F.col("p_size") % 3 == 0, " x").when(F.col("p_size") % 3 == 1, " -1.5").otherwise("")
    text = F.concat(F.col("p_size").cast("string"), F.lit(" "), F.col("p_retailprice").cast("string"), tail)
    rows = table(spark, sf_dir, "part").select("p_partkey", s.numeric_list(text, 3).alias("v"))
    return rows.select("p_partkey", F.col("v").isNotNull().alias("valid"), F.round(F.get("v", F.lit(0)) + F.get("v", F.lit(1)) + F.get("v", F.lit(2)), 4).alias("total"))


@query("SELECT page_id, substr(sha1(url), 1, 12) AS short_key FROM pages")
def sha1_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", s.short_key(F.col("url")).alias("short_key"))


@query(
    """SELECT page_id, len(regexp_extract_all(html, '<p[ >]'))::INT AS n_paragraphs, len(regexp_extract_all(html, '<a[ >]'))::INT AS n_links, len(regexp_extract_all(html, '<[a-z]'))::INT AS n_tags,
    nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title FROM pages"""
)
def markup_tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda p: F.size(F.regexp_extract_all("html", F.lit(p), F.lit(0)))
    title = F.nullif(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit(""))
    return table(spark, sf_dir, "pages").select("page_id", n("<p[ >]").alias("n_paragraphs"), n("<a[ >]").alias("n_links"), n("<[a-z]").alias("n_tags"), title.alias("title"))


@query(
    """SELECT n_regionkey AS frame_id, '<scene version="3.0.0">' || chr(10) || string_agg('    <shape type="ply" id="' || lower(n_name) || '" />', chr(10) ORDER BY n_name) || chr(10) || '</scene>' AS xml,
    count(*)::BIGINT AS n_shapes FROM nation GROUP BY n_regionkey"""
)
def xml_emit(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = F.concat(F.lit('    <shape type="ply" id="'), F.lower("n_name"), F.lit('" />'))
    shapes = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_name", shape.alias("x")))), lambda v: v["x"]), "\n")
    out = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("frame_id")).agg(F.concat(F.lit('<scene version="3.0.0">\n'), shapes, F.lit("\n</scene>")).alias("xml"), F.count(F.lit(1)).alias("n_shapes"))
    return out


@query(
    """SELECT event_id, CASE lower(trim(t)) WHEN 'true' THEN true WHEN 'false' THEN false END AS flag, CASE WHEN n IN ('0', '0.0') THEN 0 WHEN n IN ('1', '1.0') THEN 1 END AS label
    FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN ' True' WHEN 1 THEN 'FALSE' WHEN 2 THEN 'yes' END AS t, CASE event_id % 5 WHEN 0 THEN '0' WHEN 1 THEN '1.0' WHEN 2 THEN '2' END AS n FROM events)"""
)
def text_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    flag = F.when(k % 4 == 0, " True").when(k % 4 == 1, "FALSE").when(k % 4 == 2, "yes")
    label = F.when(k % 5 == 0, "0").when(k % 5 == 1, "1.0").when(k % 5 == 2, "2")
    return table(spark, sf_dir, "events").select("event_id", s.bool_text(flag).alias("flag"), s.binary_label(label).alias("label"))


def _manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document of each customer: by its number whole, with a null, without a key, with a wrong type, with a key more, cut
    off, or a list."""
    head = lambda size: F.concat(F.lit('{"id": '), "c_custkey", F.lit(f', "size": {size}, "links": []'))
    name = F.concat(F.lit(', "name": "'), "c_name", F.lit('"'))
    kinds = [
        F.concat(head("1.5"), name, F.lit("}")),
        F.concat(head("2"), F.lit(', "name": null}')),
        F.concat(head("2.5"), F.lit("}")),
        F.concat(head('"wide"'), name, F.lit("}")),
        F.concat(head("1"), name, F.lit(', "colour": 1}')),
        F.concat(head("1"), F.lit(',\n "name" ')),
        F.lit("[]"),
    ]
    value = F.get(F.array(*kinds), (F.col("c_custkey") % len(kinds)).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", value.alias("value"))


@query(
    """WITH c AS (SELECT c_custkey, c_custkey % 7 AS k FROM customer WHERE c_custkey % 7 < 5)
    SELECT c_custkey, 'id' AS key, 'present' AS state FROM c
    UNION ALL SELECT c_custkey, 'links', 'present' FROM c
    UNION ALL SELECT c_custkey, 'size', CASE WHEN k = 3 THEN 'is string' ELSE 'present' END FROM c
    UNION ALL SELECT c_custkey, 'name', CASE k WHEN 1 THEN 'null' WHEN 2 THEN 'absent' ELSE 'present' END FROM c
    UNION ALL SELECT c_custkey, 'colour', 'unknown' FROM c WHERE k = 4"""
)
def key_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return presence.key_states(_manifests(spark, sf_dir), "value", {"id": "integer", "size": "number", "links": "array", "name": "string"})


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 7 = 6 THEN 'not an object' ELSE 'Expecting '':'' delimiter' END AS error,
        CASE WHEN c_custkey % 7 = 5 THEN 2 END::INT AS line, CASE WHEN c_custkey % 7 = 5 THEN 9 END::INT AS place FROM customer WHERE c_custkey % 7 > 4"""
)
def broken_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return presence.broken_documents(_manifests(spark, sf_dir), "value")
