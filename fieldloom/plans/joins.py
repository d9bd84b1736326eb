"""Queries over joins, set operations, rules and constraint checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions.classify import Rule, first_match, semantic_class
from fieldloom.operators.rules import match_table
from fieldloom.operators import frames, manifests, quality
from fieldloom.plans.registry import Registry
from fieldloom.plans.tables import table

query = Registry()
QUERIES, SQL = query.queries, query.sql

RULES = (
    Rule("exact", "red part", "paint"),
    Rule("startswith", "BLUE", "metal"),
    Rule("contains", "small", "plastic"),
    Rule("contains", "e", "wood"),
    Rule("contains", "o", "__skip__"),
)
_RULES_SQL = "CASE " + " ".join(
    f"WHEN {'p_name = ' + repr(r.pattern) if r.match == 'exact' else ('contains' if r.match == 'contains' else 'starts_with') + f'(lower(p_name), lower({r.pattern!r}))'} THEN {r.result!r}" for r in RULES
) + " ELSE 'composite' END"


@query(f"SELECT p_partkey, {_RULES_SQL} AS material FROM part")
def rule_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", first_match(F.col("p_name"), RULES).alias("material"))


@query(f"SELECT p_partkey, p_name, {_RULES_SQL} AS result FROM part")
def rule_table_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([(i, r.match, r.pattern, r.result) for i, r in enumerate(RULES)], "rule_idx int, match_type string, pattern string, result string")
    return match_table(table(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("p_name"), rules)


@query(f"SELECT material, count(*)::BIGINT AS n FROM (SELECT {_RULES_SQL} AS material FROM part) WHERE material <> '__skip__' GROUP BY material")
def rule_skip_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "part").select(first_match(F.col("p_name"), RULES).alias("material"))
    return named.where("material <> '__skip__'").groupBy("material").agg(F.count(F.lit(1)).alias("n"))


# The words of the classes, as in functions/classify.py.
@query(
    """WITH t AS (SELECT p_partkey, p_brand, lower(p_brand || ' | ' || p_name || ' | ' || p_type) AS text FROM part),
    c AS (SELECT p_partkey, CASE
        WHEN p_brand = 'Brand#11' THEN 'robot_arm'
        WHEN starts_with(' ' || replace(text, '|', ' ') || ' ', ' x500 ') OR p_brand = 'x500' THEN 'drone'
        WHEN contains(text, 'picking_shelves') OR contains(' ' || replace(text, '|', ' ') || ' ', ' shelf') OR contains(text, 'shelf_') THEN 'shelf'
        WHEN contains(text, 'desk') OR contains(text, 'table') THEN 'desk'
        WHEN contains(text, 'factory_door') OR contains(' ' || replace(text, '|', ' ') || ' ', ' door') OR contains(text, '_door') OR contains(text, 'door_') THEN 'door'
        WHEN contains(text, 'window') THEN 'window'
        WHEN contains(text, 'clutteringc') OR contains(text, 'box') OR contains(text, 'crate') THEN 'box'
        WHEN contains(text, 'officechair') OR contains(text, 'chair') OR contains(text, 'sofa') THEN 'chair'
        WHEN contains(text, 'cerberus_anymal') OR contains(text, 'naoh25v40') THEN 'robot'
        WHEN contains(text, 'trashbin') OR contains(' ' || replace(text, '|', ' ') || ' ', ' bin') OR contains(text, '_bin') THEN 'bin'
        WHEN contains(text, 'monitor') OR contains(text, 'keyboard') OR contains(text, 'laptop') THEN 'laptop' END AS kind FROM t)
    SELECT p_partkey, CASE WHEN kind IN ('robot_arm', 'box', 'bin', 'desk') THEN kind END AS semantic FROM c"""
)
def keyword_semantic_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = semantic_class(F.col("p_brand"), [F.col("p_brand"), F.col("p_name"), F.col("p_type")], F.lit(None).cast("string"), ["Brand#11"], ["robot_arm", "box", "bin", "desk"])
    return table(spark, sf_dir, "part").select("p_partkey", kind.alias("semantic"))


@query("SELECT p_brand IN ('Brand#11', 'Brand#22') AS is_dynamic, p_type, count(*)::BIGINT AS n, (count(*) FILTER (WHERE p_size <= 0 OR p_size > 40))::BIGINT AS n_skipped FROM part GROUP BY 1, 2")
def static_dynamic_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    skipped = (F.col("p_size") <= 0) | (F.col("p_size") > 40)
    return manifests.split_counts(table(spark, sf_dir, "part"), [F.col("p_brand").isin("Brand#11", "Brand#22").alias("is_dynamic"), "p_type"], skipped)


@query("SELECT r_name, count(*)::BIGINT AS n, string_agg(n_name, ',' ORDER BY n_nationkey) AS members FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def group_collect_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return manifests.members_sorted(rows, "r_name", "n_nationkey", "n_name")


@query(
    """SELECT s_suppkey, CASE WHEN n_regionkey = 1 THEN 'forced' ELSE n_name END AS material, n_regionkey = 1 AND n_name <> 'forced' AS warned
    FROM supplier JOIN nation ON s_nationkey = n_nationkey"""
)
def forced_override_warning(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    forced = F.when(F.col("n_regionkey") == 1, F.lit("forced"))
    return manifests.with_forced(rows.withColumn("material", F.col("n_name")), "material", forced).select("s_suppkey", "material", "warned")


@query(
    """SELECT f.frame_id, n_nationkey AS rx_id, n_name FROM (SELECT r_regionkey AS frame_id FROM region ORDER BY 1 LIMIT 3) f CROSS JOIN nation ORDER BY 1, 2 LIMIT 60"""
)
def cross_frames_receivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    scenes = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("frame_id"))
    receivers = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("rx_id"), "n_name")
    return frames.cross_frames(scenes, receivers, 3, 60)


@query(
    """SELECT c_nationkey, count(*)::BIGINT AS n_orders, (count(*) FILTER (WHERE o_totalprice < 0))::BIGINT AS n_bad,
        (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))::BIGINT AS n_unmatched
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey"""
)
def lookup_join_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    key = F.col("o_custkey") == F.col("c_custkey")
    unmatched = orders.join(customer, key, "left_anti").agg(F.count(F.lit(1)).alias("n_unmatched"))
    each = orders.join(customer, key).groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n_orders"), F.count_if(F.col("o_totalprice") < 0).alias("n_bad"))
    return each.crossJoin(F.broadcast(unmatched))


@query(
    """SELECT 'joined' AS side, c_mktsegment, count(*)::BIGINT AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment
    UNION ALL SELECT 'without', c_mktsegment, count(*)::BIGINT FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) GROUP BY c_mktsegment"""
)
def join_zero_or_many_side_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    poses = table(spark, sf_dir, "customer").select(F.lit("m").alias("model"), F.col("c_custkey").alias("link"), "c_mktsegment")
    visuals = table(spark, sf_dir, "orders").select(F.lit("m").alias("model"), F.col("o_custkey").alias("link"))
    many, none = frames.posed_visuals(poses, visuals)
    count = lambda df, side: df.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n")).select(F.lit(side).alias("side"), "c_mktsegment", "n")
    return count(many, "joined").unionAll(count(none, "without"))


@query(
    """SELECT 'missing' AS kind, doc_id FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)
    UNION ALL SELECT 'unexpected', doc_id FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)"""
)
def missing_unexpected_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.differences(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT md5(text) AS text_md5, count(*)::BIGINT AS n, min(doc_id)::BIGINT AS first_doc FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.md5("text").alias("text_md5"), "doc_id")
    twice = quality.duplicates(docs, ["text_md5"])
    return docs.join(twice, "text_md5").groupBy("text_md5", "n").agg(F.min("doc_id").alias("first_doc")).select("text_md5", "n", "first_doc")


_ISSUES = """
    SELECT 'error' AS severity, 'lineitem' AS manifest, l_orderkey || ':' || l_linenumber AS location, 'discount is above 0.09' AS message FROM lineitem WHERE l_discount > 0.09
    UNION ALL SELECT 'warning', 'lineitem', l_orderkey || ':' || l_linenumber, 'quantity is ' || l_quantity::INT FROM lineitem WHERE l_quantity >= 49
    UNION ALL SELECT 'info', 'lineitem', l_orderkey || ':' || l_linenumber, 'returned' FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_linenumber = 1"""


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [
        ("error", F.col("l_discount") > 0.09, "discount is above 0.09"),
        ("warning", F.col("l_quantity") >= 49, F.concat(F.lit("quantity is "), F.col("l_quantity").cast("int").cast("string"))),
        ("info", (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F") & (F.col("l_linenumber") == 1), "returned"),
    ]
    return quality.issues(table(spark, sf_dir, "lineitem"), "lineitem", F.concat_ws(":", "l_orderkey", "l_linenumber"), rules)


@query(_ISSUES)
def issue_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _issues(spark, sf_dir)


@query(
    f"""SELECT (count(*) FILTER (WHERE severity = 'error'))::BIGINT AS error_count, (count(*) FILTER (WHERE severity = 'warning'))::BIGINT AS warning_count,
    (count(*) FILTER (WHERE severity = 'info'))::BIGINT AS info_count, (count(*) FILTER (WHERE severity = 'error') > 0)::INT AS status FROM ({_ISSUES})"""
)
def issue_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.issue_counts(_issues(spark, sf_dir))


@query("SELECT l_orderkey, count(*)::BIGINT AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) <> 4")
def expected_count_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.wrong_counts(table(spark, sf_dir, "lineitem"), ["l_orderkey"], 4)


@query(
    """SELECT 'static' AS source, r_regionkey AS frame_id, s_suppkey AS id, s_name AS name, NULL::VARCHAR AS segment FROM region CROSS JOIN supplier
    UNION ALL SELECT 'dynamic', (c_custkey % 5)::INT, c_custkey, c_name, c_mktsegment FROM customer"""
)
def union_static_dynamic(spark: SparkSession, sf_dir: str) -> DataFrame:
    static = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    moving = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 5).cast("int").alias("frame_id"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    scenes = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("frame_id"))
    return frames.composed(static, moving, scenes)


@query(
    """SELECT l_shipdate::DATE AS day, p_type, count(*)::BIGINT AS n FROM lineitem JOIN part ON l_partkey = p_partkey
    WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1996-03-01' AND p_type IN (SELECT p_type FROM part WHERE p_size = 50) GROUP BY 1, 2"""
)
def in_list_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    wanted = part.where("p_size = 50").select("p_type").distinct()
    rows = table(spark, sf_dir, "lineitem").where("l_shipdate >= timestamp_ntz '1996-01-01' AND l_shipdate < timestamp_ntz '1996-03-01'")
    rows = rows.join(part.join(F.broadcast(wanted), "p_type", "left_semi"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy(F.to_date("l_shipdate").alias("day"), "p_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH u AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, len(string_split(url, '/')) AS depth FROM pages)
    SELECT host, page_id, url, depth::INT AS depth FROM u QUALIFY row_number() OVER (PARTITION BY host ORDER BY depth, url, page_id) = 1"""
)
def shallowest_path_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"))
    return manifests.shallowest(pages, "host", "url", "page_id")


@query(
    """WITH RECURSIVE t AS (
        SELECT r_name AS name, r_name AS path, 0 AS level, r_regionkey AS k, 'r' AS kind FROM region
        UNION ALL
        SELECT c.name, t.path || '::' || c.name, t.level + 1, c.k, c.kind FROM t JOIN (
            SELECT n_name AS name, n_nationkey AS k, 'n' AS kind, n_regionkey AS up, 'r' AS up_kind FROM nation
            UNION ALL SELECT s_name, s_suppkey, 's', s_nationkey, 'n' FROM supplier) c ON c.up = t.k AND c.up_kind = t.kind
    ) SELECT name, path, level FROM t"""
)
def recursive_scope_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation, supplier = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    rows = region.select(F.col("r_name").alias("name"), F.lit(None).cast("string").alias("parent"))
    rows = rows.unionAll(nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name"))
    rows = rows.unionAll(supplier.join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select("s_name", "n_name"))
    return manifests.scoped_paths(rows, "name", "parent")
