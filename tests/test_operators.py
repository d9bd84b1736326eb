import math
import random

import numpy as np
import pytest
from fieldloom.functions import geometry as g
from fieldloom.functions import strings as s
from fieldloom.operators import ablation, features, frames, labels, manifests, metrics, quality, sampling
from fieldloom.streaming import stateful
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

# Nine measured rows: frame, receiver, paths, least and largest delay.
ROWS = [
    (0, "rx_a", 22, 1.0643356418427175e-08, 6.284866316264015e-08), (1, "rx_a", 24, 7.579527228074312e-09, 6.284866316264015e-08), (2, "rx_a", 27, 7.579527228074312e-09, 6.284866316264015e-08),
    (0, "rx_b", 19, 5.7e-09, 5.93e-08), (1, "rx_b", 26, 5.7e-09, 5.93e-08), (2, "rx_b", 18, 5.7e-09, 5.93e-08),
    (0, "rx_c", 18, 1.57e-08, 5.72e-08), (1, "rx_c", 18, 1.57e-08, 5.72e-08), (2, "rx_c", 18, 1.57e-08, 5.72e-08),
]


def test_labels_of_measured_rows(spark):
    df = spark.createDataFrame([(f, f * 25570, r, n, hi - lo, -60.0 - 0.7 * f) for f, r, n, lo, hi in ROWS], "frame_id int, source_sample_index int, rx_id string, num_paths int, delay_spread double, rx_power_dbm double")
    out = {(r.rx_id, r.frame_id): r for r in labels.labelled(df).collect()}
    assert len(out) == 6
    assert {k: v.delta_num_paths for k, v in out.items()} == {("rx_a", 1): 2, ("rx_a", 2): 3, ("rx_b", 1): 7, ("rx_b", 2): -8, ("rx_c", 1): 0, ("rx_c", 2): 0}
    assert sum(r.y_path_change for r in out.values()) == 4 and sum(r.y_path_drop for r in out.values()) == 1
    assert [k for k, v in out.items() if v.y_delay_spread_increase] == [("rx_a", 1)]
    assert all(r.y_rx_power_drop_0p5db == 1 and r.y_rx_power_drop_1db == 0 for r in out.values())
    assert out["rx_a", 1].y_adaptation_trigger_1db == 1 and out["rx_a", 2].y_adaptation_trigger_2db == 0
    ratio = {(r.label, r.rx_id): (r.num_rows, r.num_positive) for r in labels.balance(labels.labelled(df), labels.LABELS).collect()}
    assert len(ratio) == 8 * 4 and ratio["y_path_change", "ALL"] == (6, 4) and ratio["y_path_change", "rx_b"] == (2, 2)
    assert labels.labelled(df, eta=1.0).agg(F.sum("y_delay_spread_increase")).first()[0] == 0


def machine(log, links):
    """Rows of one model's log: whether it is a row of complete sets."""
    seen = set()
    for x in log:
        if x not in links or x in seen:
            return False
        seen.add(x)
        if seen == links:
            seen = set()
    return not seen


def test_assembly_is_the_machine(spark):
    rng, rows, want = random.Random(1), [], {}
    for m in range(150):
        links = [f"l{k}" for k in range(3)]
        log = [x for _ in range(rng.randrange(1, 5)) for x in rng.sample(links, 3)]
        if rng.random() < 0.5:
            i = rng.randrange(len(log))
            log[i : i + 1] = [] if rng.random() < 0.5 else [rng.choice([*links, "odd"])]
        if log:
            want[f"m{m}"] = machine(log, set(links))
            rows += [(f"m{m}", x, i) for i, x in enumerate(log)]
    poses = spark.createDataFrame(rows, "model string, link string, position long")
    links = poses.select("model").distinct().crossJoin(spark.createDataFrame([(f"l{k}",) for k in range(3)], "link string"))
    out = frames.assembled(poses, links)
    assert {r.model: r.accepted for r in out.select("model", "accepted").distinct().collect()} == want
    assert len(set(want.values())) == 2


def test_streams_equal_batches(spark, tmp_path):
    rng = random.Random(5)
    rows = [(f"m{m}", x, 10 * b + i) for m in range(6) for b in range(8) for i, x in enumerate(rng.sample(["a", "b", "c"], 3))]
    rows.append(("m5", "zzz", 1000))
    df = spark.createDataFrame(rows, "model string, link string, position long")
    for k in range(3):
        df.where(f"position between {27 * k} and {27 * k + 26} or ({k} = 2 and position > 80)").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    out = stateful.run_available(stateful.assemble_samples(stream, {"*": ["a", "b", "c"]}), str(tmp_path / "out")).collect()
    good = [r for r in out if r.accepted]
    assert len(good) == 6 * 24 and {r.sample_index for r in good} == set(range(8)) and [(r.model, r.link) for r in out if not r.accepted] == [("m5", "zzz")]


@given(st.lists(st.integers(0, 40), min_size=5, max_size=25), st.integers(2, 5))
@settings(max_examples=8, deadline=None)
def test_folds_are_the_greedy_loop(spark, sizes, k):
    rows = [(i,) for i, n in enumerate(sizes) for _ in range(n + 1)]
    got = {r.g: r.fold for r in sampling.group_folds(spark.createDataFrame(rows, "g int"), "g", k).collect()}
    load, want = [0] * k, {}
    for i, n in sorted(enumerate(sizes), key=lambda x: (-x[1], x[0])):
        f = load.index(min(load))
        want[i], load[f] = f, load[f] + n + 1
    assert got == want


def test_folds_of_many_equal_groups(spark):
    """Groups of few sizes over many parts, null among them, against the loop."""
    sizes = [[7, 3, 1, 1, 1, 2][i % 6] for i in range(3000)]
    df = spark.createDataFrame([(i or None, n) for i, n in enumerate(sizes)], "g int, c int")
    df = df.withColumn("x", F.explode(F.array_repeat(F.lit(0), F.col("c"))))
    got = {r.g: (r.n, r.fold) for r in sampling.group_folds(df, "g", 7).collect()}
    load, want = [0] * 7, {}
    for i, n in sorted(enumerate(sizes), key=lambda x: (-x[1], x[0])):
        f = load.index(min(load))
        want[i or None], load[f] = (n, f), load[f] + n
    assert got == want


def test_folds_and_samples_refuse(spark):
    df = spark.createDataFrame([(1,), (2,)], "g int")
    for k in (1, 3):
        with pytest.raises(ValueError):
            sampling.group_folds(df, "g", k)
    with pytest.raises(Exception, match="more samples"):
        sampling.uniform_samples(spark.createDataFrame([(3,)], "n_samples long"), 5).collect()
    got = [r.source_sample_index for r in sampling.uniform_samples(spark.createDataFrame([(51141,), (60000,)], "n_samples long"), 3).orderBy("frame_id").collect()]
    assert got == [0, 25570, 51140]


def one(spark, columns):
    return [float(v) for v in spark.range(1).select(*columns).first()]


def test_transforms_round_trip(spark):
    rng = np.random.default_rng(0)
    for pose in [*rng.uniform(-1.4, 1.4, (4, 6)), np.array([1, 2, 3, 0.3, math.pi / 2, 0.0])]:
        m = g.pose_affine(list(pose))
        assert np.allclose(one(spark, g.affine_pose(m)), pose, atol=1e-6)
    r = np.array(one(spark, g.pose_affine([0, 0, 0, 0.1, 0.2, 0.3]))).reshape(3, 4)[:, :3]
    assert np.allclose(r @ r.T, np.eye(3)) and np.isclose(np.linalg.det(r), 1)
    half = math.sin(0.15), math.cos(0.15)
    assert np.allclose(one(spark, g.quaternion_affine((0, 0, 2 * half[0], 2 * half[1]), (1, 2, 3))), one(spark, g.pose_affine([1, 2, 3, 0, 0, 0.3])))
    assert spark.range(1).select(g.quaternion_affine((0, 0, 0, 0), (0, 0, 0))[0]).first()[0] is None


def test_segment_distance_is_the_least(spark):
    rng = np.random.default_rng(1)
    for _ in range(5):
        p, a, b = rng.uniform(-1, 1, (3, 3))
        steps = a + np.linspace(0, 1, 2001)[:, None] * (b - a)
        assert abs(one(spark, [g.segment_distance(p, a, b)])[0] - np.linalg.norm(steps - p, axis=1).min()) < 1e-5
    assert one(spark, [g.segment_distance((1, 0, 0), (0, 0, 0), (0, 0, 0))]) == [1.0]


def test_texts(spark):
    f = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert f(s.slugify(F.lit("  Ébène__Table (2)!"))) == "ébène_table_2" and f(s.slugify(F.lit("!!"))) == "item" and f(s.safe_slug(F.lit(""))) == "value"
    assert f(s.safe_filename(F.lit("_a b/C-1.ply_"))) == "a_b_C-1.ply" and f(s.safe_filename(F.lit("//"))) == "unnamed"
    assert f(s.quoted_value(F.lit('key: "a "b" c"'))) == 'a "b" c' and f(s.quoted_value(F.lit('one "'))) is None
    assert f(s.scoped_parts(F.lit("a::b")))["name"] == "b" and all(f(s.scoped_parts(F.lit(x))) is None for x in ("a", "a::", "::b", "a::b::c"))
    assert f(s.numeric_list(F.lit(" 1 2.5\t-3e1 "), 3)) == [1, 2.5, -30] and f(s.numeric_list(F.lit("1 2"), 3)) is None and f(s.numeric_list(F.lit("1 2 x"), 3)) is None
    assert f(s.numeric_list(F.lit("1, 2,3"), 3, ",")) == [1, 2, 3]
    assert f(s.elapsed(F.lit(3725.9))) == "1:02:05" and f(s.frame_name(F.lit(7))) == "frame_007" and f(s.receiver_label(F.lit("rx_panda_base"))) == "panda"
    assert f(s.lenient_double(F.lit("nan"))) is None and f(s.lenient_double(F.lit(" 2 "))) == 2.0 and f(s.lenient_double(F.lit("x"))) is None
    with pytest.raises(Exception, match="no finite number"):
        f(s.strict_double(F.lit("x"), "col"))
    assert f(s.rerooted(F.lit("/old/place/scene_out/a/b.ply"), "/new", "scene_out")) == "/new/scene_out/a/b.ply"


def test_general_numbers_keep_the_sign_of_zero(spark):
    nan, inf = float("nan"), float("inf")
    values = [0.0, -0.0, -0.25, 1 / 3, 1e15, nan, inf, -inf, None]
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v double").coalesce(1)
    told = [r.t for r in rows.select("i", s.general_text(F.col("v")).alias("t")).orderBy("i").collect()]
    assert told == ["0", "-0", "-0.25", "0.333333", "1e+15", "nan", "inf", "-inf", None]
    assert [r.t for r in rows.where("i = 8 OR i = 1").select(s.general_text(F.col("v") / 1000, 15).alias("t")).collect()] == ["-0", None]


def test_features(spark):
    rows = [("f", 1.0, 0.0, 0.0, 2.0, 3, 4, True, "metal"), ("f", 0.0, 1.0, 0.0, None, None, None, False, None)]
    df = spark.createDataFrame(rows, "frame string, x double, y double, z double, volume double, vertex_count long, face_count long, moving boolean, material string")
    objects = features.with_distances(df, [F.col(a) for a in "xyz"], (0, 0, 0), (2, 0, 0))
    keys = features.subset_keys(every=F.lit("all"), moving=F.when(F.col("moving"), "dynamic"), material=F.col("material"))
    long = features.subset_statistics(objects, ["frame"], keys)
    by = {r.subset: r for r in long.collect()}
    assert set(by) == {"all", "dynamic", "metal"} and by["all"]["count"] == 2 and by["all"].volume_sum == 2.0 and by["metal"].rx_dist_min == 1.0 and by["metal"].centroid_x_std == 0.0
    wide = features.widened(long, ["frame"], ["all", "glass"])
    assert len(wide.columns) == 1 + 2 * 18 and wide.columns[1:] == sorted(wide.columns[1:]) and wide.first().glass_rx_dist_mean == 0.0
    vertices = df.select("frame", "x", "y", "z")
    links = spark.createDataFrame([("f", 0, 0.0, 0.0, 0.0, 2.0, 0.0, 0.0)], "frame string, link_id int, tx_x double, tx_y double, tx_z double, rx_x double, rx_y double, rx_z double")
    r = features.occupancy(vertices, links, "frame").first()
    assert (r.near_link_0p25m, r.near_link_1p00m, r.min_link_distance, r.corridor_ratio_0p50m) == (1, 2, 0.0, 0.5)
    assert features.smallest_mean(df, ["frame"], "x", ["y"], 5).first().mean_x_k5 == 0.5


def test_metrics_and_ablation(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 2))
    y = (x[:, 0] + 0.3 * rng.standard_normal(400) > 0.8).astype(int)
    df = spark.createDataFrame([(int(i % 5), int(t), float(a), float(b), "rx_a") for i, (t, (a, b)) in enumerate(zip(y, x, strict=True))], "fold int, y int, geom_a double, mat_b double, rx_id string")
    out = {r.feature_set: r for r in ablation.ablation(df, ["geometry_only", "geometry_material"], "y", rx_filter=["rx_a"]).collect()}
    assert out["majority_baseline"].recall_mean == 0.0 and out["majority_baseline"].balanced_accuracy_mean == 0.5
    assert out["geometry_only"].balanced_accuracy_mean > 0.85 and out["geometry_material"].num_rows == 400
    with pytest.raises(ValueError):
        ablation.ablation(df.withColumn("y", F.lit(1)), ["geometry_only"], "y")
    with pytest.raises(ValueError):
        ablation.columns_of(df, "compact_geometry")
    assert [len(v) for v in ablation.COMPACT_SETS.values()] == [9, 21, 20, 42]
    counts, scale = np.array([[400 - y.sum(), y.sum()]], float), np.array([[[0.0, 0.0], [1.0, 1.0]]])
    rows = df.select(F.lit(0).alias("fold"), "y", F.array("geom_a", "mat_b").alias("x"))
    w = ablation.balanced_logistic(rows, [-1], counts, scale)[0]
    z = np.hstack([x, np.ones((400, 1))])
    weight = np.where(y == 1, 400 / (2 * y.sum()), 400 / (2 * (400 - y.sum())))
    slope = z.T @ (weight * (1 / (1 + np.exp(-z @ w)) - y)) / 400 + np.array([0.1, 0.1, 0]) * w
    assert np.abs(slope).max() < 1e-5
    assert (ablation.balanced_logistic(rows, [-1], np.array([[0.0, 400.0]]), scale)[0] == [0, 0, 60]).all()
    c = metrics.confusion_metrics(spark.createDataFrame([("k", 1, 1), ("k", 0, 1), ("k", 1, 0)], "k string, y int, y_pred int"), ["k"]).first()
    assert (c.accuracy, c.precision, c.recall, c.balanced_accuracy) == (1 / 3, 0.5, 0.5, 0.25)
    assert metrics.constant_target(df.withColumn("y", F.lit(1)), "y") and not metrics.constant_target(df, "y")


def test_checks_and_joins(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (2, 4)], "k int, v int")
    assert [tuple(r) for r in quality.duplicates(df, ["k"]).collect()] == [(2, 2)]
    falling = quality.not_increasing(df.withColumn("m", F.lit(0)), ["m"], ["k", "v"], "v").collect()
    assert [(r.k, r.v, r.previous) for r in falling] == [(2, 4, 5)]
    assert {tuple(r) for r in quality.differences(df, spark.createDataFrame([(2,), (3,)], "k int"), "k").collect()} == {("missing", 1), ("unexpected", 3)}
    with pytest.raises(ValueError):
        quality.required(df, ["k", "w"])
    with pytest.raises(ValueError):
        quality.not_empty(df.limit(0), "it")
    good, bad = labels.successful(spark.createDataFrame([(1, True), (2, False), (3, None)], "k int, sanity_ok boolean"))
    assert good.count() == 1 and bad.count() == 2
    times = spark.createDataFrame([(i / 7,) for i in range(60)], "t double")
    keyed = spark.createDataFrame([(i / 9,) for i in range(80)], "at double")
    got = sorted((r.t, r.at) for r in frames.tolerance_lookup(times, keyed, "t", "at", 0.02).collect())
    assert got == sorted((t, a) for (t,) in times.collect() for (a,) in keyed.collect() if abs(t - a) <= 0.02)
    recs = spark.createDataFrame([(0, "arm", "a", 1.5), (0, "arm", "b", 2.5), (0, "leg", "a", 3.5)], "frame_id int, model string, link string, record double")
    assert frames.frame_structs(recs).first().models["arm"].links == {"a": 1.5, "b": 2.5}
    schema = "name string, parent string"
    paths = manifests.scoped_paths(spark.createDataFrame([("w", None), ("m", "w"), ("l", "m"), ("orphan", "gone")], schema), "name", "parent")
    assert {tuple(r) for r in paths.collect()} == {("w", "w", 0), ("m", "w::m", 1), ("l", "w::m::l", 2)}
    deep = manifests.scoped_paths(spark.createDataFrame([("n0", None), *((f"n{i}", f"n{i - 1}") for i in range(1, 41))], schema), "name", "parent")
    assert {tuple(r) for r in deep.collect()} == {(f"n{i}", "::".join(f"n{k}" for k in range(i + 1)), i) for i in range(41)}
    with pytest.raises(ValueError):
        manifests.scoped_paths(spark.createDataFrame([("a", "b"), ("b", "a")], schema), "name", "parent")


def test_rules_keep_every_row(spark):
    from fieldloom.operators import rules as tables

    rules = spark.createDataFrame([(2, "contains", "a", "wood"), (1, "startswith", "AB", "metal"), (0, "exact", "zz", "glass"), (3, "contains", "b", "other")], "rule_idx int, match_type string, pattern string, result string")
    df = spark.createDataFrame([(1, "abc"), (1, "xa"), (None, "xa"), (None, "q"), (2, None), (2, "zz"), (3, "b")], "k int, t string")
    want = sorted([(1, "abc", "metal"), (1, "xa", "wood"), (None, "xa", "wood"), (None, "q", "composite"), (2, None, "composite"), (2, "zz", "glass"), (3, "b", "other")], key=repr)
    for most in (tables.MOST_CHARS, 20):
        assert sorted(map(tuple, tables.match_table(df, F.col("t"), rules, most_chars=most).collect()), key=repr) == want
    assert tables.match_table(df, F.col("t"), rules.limit(0)).where("result <> 'composite'").count() == 0


def test_ablation_over_models_and_empty_tables(spark):
    from fieldloom.operators import ablation, classifiers

    rows = spark.createDataFrame([(i % 3, float(i % 2), i % 7 / 7, "r1" if i % 2 else "r2", i % 2) for i in range(60)], "fold int, geom_a double, geom_b double, rx_id string, y int")
    out = ablation.ablation(rows, ["geometry_only"], "y", models=["balanced_logistic", "random_forest", "rbf_svm", "mlp"]).collect()
    assert {r.model for r in out} == {"majority", "balanced_logistic", "random_forest", "rbf_svm", "mlp"} and all(r.accuracy_mean > 0.9 for r in out if r.model != "majority")
    assert classifiers.predictions(rows.limit(0), ["geom_a"], "random_forest").count() == 0
    for empty in (rows.limit(0), rows):
        with pytest.raises(ValueError):
            ablation.ablation(empty, ["geometry_only"], "y", rx_filter=["nobody"])


def test_small_helpers(spark):
    df = spark.createDataFrame([(1, ["b", "a", "b", "c", "a"])], "k int, v array<string>")
    assert df.select(manifests.order_kept(F.col("v"))).first()[0] == ["b", "a", "c"]
    rows = spark.createDataFrame([("a", None), ("b", "x"), ("x", "x")], "m string, f string")
    assert [tuple(r) for r in manifests.with_forced(rows, "m", F.col("f")).select("m", "warned").collect()] == [("a", False), ("x", True), ("x", False)]
