import json

import numpy as np
import pytest
from fieldloom.operators import classifiers, manifests, metrics
from fieldloom.sources import actors, config, meshes, sinks
from pyspark.sql import functions as F

SETTINGS = {
    "experiment_name": "e", "num_frames": 3, "dynamic_models": ["arm"], "frequency_ghz": 28, "tx": {"id": "tx", "position": [0, 0, 2.4]},
    "rx_list": [{"id": "rx_a", "position": [1, 2, 3]}], "materials_of_interest": ["metal"], "semantic_classes_of_interest": ["desk"],
}


def test_settings(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps(SETTINGS, indent=1))
    e = config.Experiment.of(config.read_settings(spark, str(tmp_path / "s.json")))
    assert e.frequency_hz == 28e9 and tuple(e.links(spark).first()) == ("rx_a", 0, 0, 2.4, 1, 2, 3)
    for key, value in (("num_frames", True), ("num_frames", 0), ("dynamic_models", ["a", "a"]), ("tx", {"id": " "}), ("rx_list", []), ("frequency_ghz", float("nan"))):
        with pytest.raises(config.SettingsError):
            config.Experiment.of({**SETTINGS, key: value})
    (tmp_path / "bad.json").write_text("[1]")
    with pytest.raises(config.SettingsError):
        config.read_settings(spark, str(tmp_path / "bad.json"))
    # Permittivity of skin.
    skin = {"model": "custom", "thickness": 0.003, "relative_permittivity": 16.73, "conductivity": 20.1, "frequency_hz": 28e9}
    doc = {"metadata": {"carrier_frequency_hz": 28e9}, "materials": {"glass": {"model": "itu", "itu_type": "glass", "thickness": 0.1}, "skin": skin}}
    assert config.RadioMaterials.of(doc).table(spark).count() == 2
    for wrong in ({**skin, "frequency_hz": 1e9}, {**skin, "thickness": 0}, {**skin, "model": "x"}):
        with pytest.raises(config.SettingsError):
            config.RadioMaterials.of({**doc, "materials": {"skin": wrong}})
    assert config.output_name("y", "raw", ("rx_panda_base", "rx_b")) == "ablation_y_raw_panda_b.csv" and config.output_name("y", "wide", (), ("logistic", "mlp")).endswith("all_rx_models_logistic_mlp.csv")


ACTOR = """<sdf><world><actor name='walker'><skin><filename>walk.dae</filename><scale>0.9</scale></skin><animation name='walk'><filename>walk.dae</filename></animation>
<script><loop>true</loop><trajectory id='0' type='walk'><waypoint><time>0</time><pose>0 0 1 0 0 0</pose></waypoint><waypoint><time>1.99</time><pose>2 0 1 0 0 0.5</pose></waypoint></trajectory></script></actor></world></sdf>"""
DAE = """<COLLADA><library_animations><animation><source id='a-input'><float_array count='3'>0 0.5 1.25</float_array></source><source id='a-output'><float_array>9 9</float_array></source></animation></library_animations>
<library_controllers><controller id='c'><skin><source><Name_array count='2'>hip knee</Name_array></source></skin></controller></library_controllers></COLLADA>"""


def test_actors(spark, tmp_path):
    (tmp_path / "w.sdf").write_text(ACTOR)
    found = actors.read_actors(spark, str(tmp_path / "w.sdf"))
    assert found.first().scale == 0.9
    points = actors.waypoints(found)
    assert [(r.waypoint, r.time, r.pose[0]) for r in points.orderBy("waypoint").collect()] == [(0, 0.0, 0.0), (1, 1.99, 2.0)]
    assert actors.poses_at(points, spark.createDataFrame([(1.99,), (1.5,)], "at double")).count() == 1
    r = spark.range(1).select(actors.sub_frames(F.lit(1.25), 30).alias("s")).first().s
    assert (r.frame, r.fraction) == (37, 0.5)
    facts = actors.animation_facts(spark.createDataFrame([("walk.dae", DAE)], "path string, value string"))
    assert tuple(facts.first()) == ("walk.dae", ["hip", "knee"], 3, 0.0, 1.25, 1)
    assert actors.report(facts).first().markdown.splitlines()[1] == "- joints: 2"


def test_merge_results_paths_and_objects(spark):
    groups = spark.createDataFrame([("metal", ["a"])], "material_class string, members array<string>")
    assert manifests.with_group_results(groups, spark.createDataFrame([("metal", "m.ply")], "material_class string, mesh string")).first().mesh == "m.ply"
    with pytest.raises(Exception, match="no merge result"):
        manifests.with_group_results(groups, spark.createDataFrame([("wood", "m.ply")], "material_class string, mesh string")).collect()
    rows = spark.createDataFrame([("/a/out/m.ply",), ("/new/x.ply",), ("/gone.ply",)], "mesh_path string")
    listing = spark.createDataFrame([("/new/out/m.ply",), ("/new/x.ply",)], "path string")
    got = {r.mesh_path: r.resolved for r in manifests.resolved_paths(rows, "mesh_path", listing, "/new", "out").collect()}
    assert got == {"/a/out/m.ply": "/new/out/m.ply", "/new/x.ply": "/new/x.ply", "/gone.ply": None}
    turned = {r.mesh_path: r.correction for r in manifests.corrected(rows, ["/gone.ply"]).collect()}
    assert np.allclose(turned["/gone.ply"], [[1, 0, 0, 0], [0, 0, 1, 0], [0, -1, 0, 0], [0, 0, 0, 1]], atol=1e-12) and np.allclose(turned["/new/x.ply"], np.eye(4))
    member = "struct<model_name:string,link_name:string,visual_name:string,id:string,geometry_type:string,size:array<double>,radius:double,length:double,to_world:array<array<double>>>"
    schema = f"frame_id int, source string, id string, model_name string, link_name string, visual_name string, material_label string, static_record struct<material_class:string,members:array<{member}>>, mesh_vertex_count long, mesh_face_count long, bounds_min array<double>, bounds_max array<double>"
    world = [[1.0, 0.0, 0.0, 5.0], [0.0, 1.0, 0.0, 6.0], [0.0, 0.0, 1.0, 7.0], [0.0, 0.0, 0.0, 1.0]]
    box = ("desk", "l", "v", "d", "box", [1.0, 2.0, 3.0], None, None, world)
    data = [(0, "static", "g", None, None, None, None, ("wood", [box]), None, None, None, None), (0, "dynamic", "p", "arm", "l", "v", "metal", None, 8, 12, [0.0, 0.0, 0.0], [2.0, 2.0, 1.0]), (0, "dynamic", "q", "other", "l", "v", "metal", None, 8, 12, [0.0] * 3, [1.0] * 3)]
    out = {r.id: r for r in manifests.object_rows(spark.createDataFrame(data, schema), ["arm"]).collect()}
    assert set(out) == {"d", "p"} and (out["d"].centroid_x, out["d"].volume) == (5.0, 6.0) and (out["p"].centroid_z, out["p"].volume) == (0.5, 4.0)


def test_ply_text_is_read_back(spark):
    triangles = spark.createDataFrame([("m", 1, [[0.0, 0.0, 0.0], [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]]), ("m", 0, [[0.0, 0.0, 5.0], [1.0, 0.0, 5.0], [0.0, 1.0, 5.0]])], "mesh string, triangle_idx int, vertices array<array<double>>")
    xyz = meshes.ply_vertices(sinks.ply_text(triangles).first().ply.encode())
    assert xyz.shape == (6, 3) and xyz[0].tolist() == [0, 0, 5]


@pytest.mark.parametrize("model", classifiers.MODELS)
def test_spark_ml_models(spark, model):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((240, 2))
    y = (np.abs(x).sum(axis=1) > 1.4).astype(int) if model != "mlp" else (x[:, 0] > 0).astype(int)
    df = spark.createDataFrame([(int(i % 2), int(t), float(a), float(b)) for i, (t, (a, b)) in enumerate(zip(y, x, strict=True))], "fold int, y int, a double, b double")
    out = classifiers.predictions(df, ["a", "b"], model, trees=20)
    assert out.count() == 240
    assert metrics.confusion_metrics(out.withColumn("k", F.lit(1)), ["k"]).first().balanced_accuracy > 0.75
