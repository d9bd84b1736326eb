"""Queries over link measurements: labels, summaries, samples, folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions.geometry import half_up
from fieldloom.operators import frames, labels, metrics, quality, sampling
from fieldloom.operators.scans import numbered
from fieldloom.plans.registry import Registry
from fieldloom.plans.tables import table

query = Registry()
QUERIES, SQL = query.queries, query.sql

FLAGS = ("y_change", "y_drop", "y_drop_1", "y_rise", "y_trigger")


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deltas of value per user, flags against a quarter of its standard deviation."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    eta = labels.spread_threshold(events, "value")
    out = labels.with_deltas(events, "user_id", ["ts", "event_id"], ["value"]).crossJoin(F.broadcast(eta))
    d = F.col("delta_value")
    tests: tuple[Column, ...] = (d != 0, d < 0, d < -1.0, d > F.col("eta"), (d < -1.0) | (d > F.col("eta")))
    return out.withColumns({n: labels.flag(t) for n, t in zip(FLAGS, tests, strict=True)})


_LABELLED = """
    WITH eta AS (SELECT 0.25 * coalesce(stddev_pop(value), 0) AS eta FROM events),
    lagged AS (SELECT user_id, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events),
    labelled AS (
        SELECT user_id, event_id, value, prev, value - prev AS d,
            (value - prev <> 0)::INT AS y_change, (value - prev < 0)::INT AS y_drop, (value - prev < -1)::INT AS y_drop_1,
            (value - prev > eta)::INT AS y_rise, (value - prev < -1 OR value - prev > eta)::INT AS y_trigger
        FROM lagged, eta WHERE prev IS NOT NULL
    )"""


@query(_LABELLED + " SELECT user_id, event_id, round(prev, 6) AS prev_value, round(d, 6) AS delta_value, y_change, y_drop, y_drop_1, y_rise, y_trigger FROM labelled")
def lag_delta_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir).select("user_id", "event_id", F.round("prev_value", 6).alias("prev_value"), F.round("delta_value", 6).alias("delta_value"), *FLAGS)


@query(
    _LABELLED
    + """, long AS (UNPIVOT (SELECT user_id, y_change, y_drop, y_drop_1, y_rise, y_trigger FROM labelled) ON y_change, y_drop, y_drop_1, y_rise, y_trigger INTO NAME label VALUE y)
    SELECT label, coalesce(user_id::VARCHAR, 'ALL') AS user_id, count(*)::BIGINT AS num_rows, sum(y)::BIGINT AS num_positive, round(sum(y) / count(*), 6) AS positive_ratio
    FROM long GROUP BY GROUPING SETS ((label), (label, user_id))"""
)
def label_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.balance(_labelled(spark, sf_dir), FLAGS, "user_id").withColumn("positive_ratio", F.round("positive_ratio", 6))


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type = 'error' ORDER BY event_id LIMIT 5")
def success_filter_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, others = labels.successful(table(spark, sf_dir, "events").withColumn("sanity_ok", F.col("event_type") != "error"), order=["event_id"])
    return others.select("event_id", "user_id", "event_type")


@query("SELECT user_id, count(*)::BIGINT AS num_ok, round(sum(value), 4) AS total FROM events WHERE event_type <> 'error' GROUP BY user_id")
def success_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = labels.successful(table(spark, sf_dir, "events").withColumn("sanity_ok", F.col("event_type") != "error"))
    return good.groupBy("user_id").agg(F.count(F.lit(1)).alias("num_ok"), F.round(F.sum("value"), 4).alias("total"))


@query(
    """SELECT user_id, count(*)::BIGINT AS num_rows, (count(*) FILTER (WHERE event_type <> 'error'))::BIGINT AS num_ok,
        round(min(value) FILTER (WHERE event_type <> 'error'), 6) AS min_value, round(avg(value) FILTER (WHERE event_type <> 'error'), 6) AS mean_value,
        round(max(value) FILTER (WHERE event_type <> 'error'), 6) AS max_value FROM events GROUP BY user_id"""
)
def receiver_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = labels.receiver_summary(table(spark, sf_dir, "events"), "user_id", ["value"], F.col("event_type") != "error")
    return out.withColumns({c: F.round(c, 6) for c in ("min_value", "mean_value", "max_value")})


@query(
    """WITH l AS (SELECT user_id, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events)
    SELECT user_id, count(*)::BIGINT AS n_bad, min(event_id)::BIGINT AS first_bad FROM l WHERE previous IS NOT NULL AND value <= previous GROUP BY user_id"""
)
def strict_monotonic_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = quality.not_increasing(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value")
    return bad.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_bad"), F.min("event_id").alias("first_bad"))


@query(
    """WITH t AS (
        SELECT conv_id AS model, turn AS position, role AS link,
            row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS sample_index, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n
        FROM conversations WHERE role <> 'system'
    ), a AS (SELECT model, bool_and(sample_index = n // 2) AND count(*) % 2 = 0 AS accepted FROM t GROUP BY model)
    SELECT model, position, link, sample_index, accepted FROM t JOIN a USING (model)"""
)
def sample_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").where("role <> 'system'").select(F.col("conv_id").alias("model"), F.col("turn").alias("position"), F.col("role").alias("link"))
    roles = turns.select("model").distinct().crossJoin(F.broadcast(spark.createDataFrame([("user",), ("assistant",)], "link string")))
    return frames.assembled(turns, roles).select("model", "position", "link", "sample_index", "accepted")


@query(
    """WITH c AS (SELECT min(n) AS common FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderpriority))
    SELECT i::INT AS frame_id, ((2 * i * (common - 1) + 199) // (2 * 199))::BIGINT AS source_sample_index FROM range(200) t(i), c"""
)
def uniform_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n_samples"))
    return sampling.uniform_samples(counts, 200)


@query(
    """SELECT vec_id, label FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY (vec_id * 2654435761 + 42 + label) % 4294967296, vec_id) <= 20"""
)
def hash_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = (F.col("vec_id") * 2654435761 + 42 + F.col("label")) % 4294967296
    return sampling.hash_subsample(table(spark, sf_dir, "embeddings").select("vec_id", "label"), ["label"], hashed, ["vec_id"], 20)


@query(
    """WITH RECURSIVE g AS (SELECT user_id, count(*)::BIGINT AS n, row_number() OVER (ORDER BY count(*) DESC, user_id) AS k FROM events GROUP BY user_id),
    r AS (
        SELECT 0::BIGINT AS k, [0, 0, 0, 0, 0]::BIGINT[] AS load, 0 AS fold, NULL::BIGINT AS user_id, NULL::BIGINT AS n
        UNION ALL
        SELECT g.k, list_transform([1, 2, 3, 4, 5], lambda i: CASE WHEN i = list_position(r.load, list_min(r.load)) THEN r.load[i] + g.n ELSE r.load[i] END),
            (list_position(r.load, list_min(r.load)) - 1)::INT, g.user_id, g.n
        FROM r JOIN g ON g.k = r.k + 1
    ) SELECT user_id, n, fold::INT AS fold FROM r WHERE k > 0"""
)
def group_kfold_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.group_folds(table(spark, sf_dir, "events").select("user_id"), "user_id", 5)


_FOLDED = "SELECT quality AS y, (l.doc_id % 5)::INT AS fold FROM labels l JOIN documents d ON d.doc_id = l.doc_id"


@query(
    f"""WITH f AS ({_FOLDED}), s AS (SELECT fold, sum(y) AS s, count(*) AS n FROM f GROUP BY fold),
    p AS (SELECT fold, (((SELECT sum(y) FROM f) - s) / ((SELECT count(*) FROM f) - n) >= 0.5)::INT AS y_pred FROM s),
    c AS (SELECT fold, count(*) FILTER (WHERE y = 1 AND y_pred = 1) AS tp, count(*) FILTER (WHERE y = 0 AND y_pred = 1) AS fp,
        count(*) FILTER (WHERE y = 1 AND y_pred = 0) AS fn, count(*) FILTER (WHERE y = 0 AND y_pred = 0) AS tn FROM f JOIN p USING (fold) GROUP BY fold),
    m AS (SELECT fold, (tp + tn) / (tp + fp + fn + tn) AS accuracy, (coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2 AS balanced_accuracy,
        coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall FROM c),
    e AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM m)
    SELECT 'majority_baseline' AS feature_set, {", ".join(f"round(avg({m}), 6) AS {m}_mean, round(stddev_pop({m}), 6) AS {m}_std" for m in metrics.METRICS)} FROM e"""
)
def majority_baseline_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id"), "doc_id").select(F.col("quality").alias("y"), (F.col("doc_id") % 5).cast("int").alias("fold"))
    each = metrics.confusion_metrics(metrics.majority_predictions(rows), ["fold"])
    out = metrics.over_folds(each.withColumn("feature_set", F.lit("majority_baseline")), ["feature_set"])
    return out.select("feature_set", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


@query("SELECT quality, count(*)::BIGINT AS n, round((SELECT count(*) FROM labels WHERE quality IS NOT NULL) / (2 * count(*)), 6) AS weight FROM labels WHERE quality IS NOT NULL GROUP BY quality")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.class_weights(table(spark, sf_dir, "labels"), "quality").withColumn("weight", F.round("weight", 6))


@query(
    """WITH s AS (SELECT event_type, ts, value, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS sample_index FROM events WHERE event_type IN ('click', 'view'))
    SELECT a.sample_index, a.event_id AS event_id_a, b.event_id AS event_id_b, a.ts = b.ts AS same_stamp
    FROM s a JOIN s b USING (sample_index) WHERE a.event_type = 'click' AND b.event_type = 'view'"""
)
def aligned_ordinal_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view"))
    rows = numbered(events.select("event_type", "event_id", "ts"), ["event_type"], ["ts", "event_id"], "sample_index")
    one = lambda kind: rows.where(F.col("event_type") == kind).drop("event_type")
    return frames.aligned(one("click"), one("view"), "sample_index", ["ts"]).select("sample_index", "event_id_a", "event_id_b", "same_stamp")


@query(
    """WITH t AS (SELECT DISTINCT round(value) AS at FROM events)
    SELECT e.event_id, t.at, round(e.value, 6) AS value FROM events e JOIN t ON abs(e.value - t.at) <= 0.01"""
)
def tolerance_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "value")
    marks = events.select(F.round("value").alias("at")).distinct()
    return frames.tolerance_lookup(events, marks, "value", "at", 0.01).select("event_id", "at", F.round("value", 6).alias("value"))


@query(
    """SELECT o_orderkey AS i, ((2 * o_orderkey * 51140 + 2) // (2 * 2))::BIGINT AS third, ((2 * o_orderkey * 999 + 199) // (2 * 199))::BIGINT AS of_200,
        (9007199254740993 + o_orderkey)::BIGINT AS large, o_orderkey // 25 AS second, o_orderkey % 25 AS sub_frame FROM orders"""
)
def integer_half_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("o_orderkey")
    large = half_up(F.lit(9007199254740993) + i, F.lit(1))
    return table(spark, sf_dir, "orders").select(i.alias("i"), half_up(i * 51140, F.lit(2)).alias("third"), half_up(i * 999, F.lit(199)).alias("of_200"), large.alias("large"), F.floor(i / 25).alias("second"), (i % 25).alias("sub_frame"))


@query(
    """SELECT event_type, user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*)::BIGINT AS n, (count(*) OVER (PARTITION BY event_type))::BIGINT AS n_users
    FROM events GROUP BY event_type, user_id"""
)
def distinct_value_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The users of each event type, a row each, so that no set is one value."""
    each = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n"))
    return each.join(each.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_users")), "event_type")


@query()
def balanced_logistic_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of documents from their length and language, against the majority baseline."""
    from fieldloom.operators.ablation import ablation

    docs = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("geom_chars"), F.size(F.split("text", "\n")).alias("geom_lines"), (F.col("lang") == "en").cast("int").alias("sem_en"))
    rows = table(spark, sf_dir, "labels").join(docs, "doc_id").withColumn("fold", (F.col("doc_id") % 5).cast("int"))
    out = ablation(rows, ["geometry_only", "geometry_semantic"], "quality")
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query()
def perceptron_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of documents from their length, lines and language by a perceptron, against the majority baseline."""
    from fieldloom.operators.ablation import ablation

    docs = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("geom_chars"), F.size(F.split("text", "\n")).alias("geom_lines"), (F.col("lang") == "en").cast("int").alias("sem_en"))
    rows = table(spark, sf_dir, "labels").join(docs, "doc_id").withColumn("fold", (F.col("doc_id") % 5).cast("int"))
    return ablation(rows, ["geometry_semantic"], "quality", models=["mlp"])


_ROLES = ("user", "assistant")


@query(
    """WITH t AS (
        SELECT conv_id AS model, turn AS position, role AS link,
            row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS sample_index, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n, count(*) OVER (PARTITION BY conv_id) AS size
        FROM conversations WHERE role <> 'system'
    ), g AS (SELECT *, min(CASE WHEN sample_index <> n // 2 THEN n END) OVER (PARTITION BY model) AS first_bad FROM t)
    SELECT model::VARCHAR AS model, sample_index::BIGINT AS sample_index, position, link FROM g
    WHERE n // 2 * 2 + 2 <= least(coalesce(first_bad, size), size)"""
)
def stream_sample_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completed samples before anything is wrong with their model, from a stream of turns."""
    from fieldloom.plans.streams import conversation_samples

    return conversation_samples(spark, sf_dir, _ROLES)


@query(
    """WITH l AS (SELECT user_id, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events)
    SELECT user_id::VARCHAR AS receiver, event_id AS frame, round(value - prev, 6) AS delta_value, (value <> prev)::INT AS y_change, (value < prev)::INT AS y_drop FROM l WHERE prev IS NOT NULL"""
)
def stream_lag_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.plans.streams import event_labels

    out = event_labels(spark, sf_dir)
    return out.select("receiver", "frame", F.round("delta_value", 6).alias("delta_value"), "y_change", "y_drop")
