import math

from fieldloom.operators import manifests, quality, radio
from fieldloom.sources import pose_log, sinks
from test_sources import pose


def test_link_power(spark):
    rows = [(0, "a", 30.0, 1e-8, 0.3, 0.4, True), (0, "a", 30.0, 3e-8, 0.0, 0.5, None), (0, "a", 30.0, 9e-8, 1.0, 1.0, False), (0, "a", 30.0, -1.0, 1.0, 1.0, None), (0, "b", 30.0, None, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "frame_id int, rx_id string, tx_power_dbm double, tau double, re double, im double, valid boolean")
    out = {r.rx_id: r for r in radio.link_power(df).collect()}
    assert out["a"].num_paths == 2 and math.isclose(out["a"].delay_spread, 2e-8) and math.isclose(out["a"].rx_power_dbm, 30 + 10 * math.log10(0.5))
    assert out["b"].num_paths == 0 and out["b"].tau_min is None and math.isclose(out["b"].path_gain_db, -300)


def test_solvers(spark):
    links = spark.createDataFrame([(0, "a", 1.0), (0, "b", 0.0)], "frame_id int, rx_id string, x double")
    rows = {r.rx_id: r for r in radio.solved(links, lambda k: {"y": 1 / k["x"]}, "y double", 2).collect()}
    assert rows["a"].y == 1.0 and rows["a"].sanity_ok and not rows["b"].sanity_ok and rows["b"].error_message.startswith("ZeroDivisionError")
    known = spark.createDataFrame([(0, "a", 5, True)], "frame_id int, rx_id string, num_paths int, sanity_ok boolean")
    got = {r.rx_id: (r.num_paths, r.sanity_ok, r.error_message) for r in radio.recorded(links, known).collect()}
    assert got == {"a": (5, True, None), "b": (None, False, "no recorded row")}


def test_lookups(spark):
    rows = spark.createDataFrame([(0, 5), (1, 9), (2, 7)], "frame_id int, sample int")
    index = spark.createDataFrame([(0, 5, "p0"), (1, 8, "p1")], "frame_id int, sample int, path string")
    good, wrong = radio.checked_lookup(rows, index, "frame_id", "sample")
    assert [(r.frame_id, r.path) for r in good.collect()] == [(0, "p0")]
    assert {tuple(r) for r in wrong.collect()} == {("2", "not in the index"), ("1", "another sample")}
    a, b = (spark.createDataFrame(list(enumerate(x)), "i int, v string") for x in ("abc", "axcd"))
    assert {tuple(r) for r in quality.different_positions(a, b, [], "i", "v").collect()} == {(1, "b", "x"), (3, None, "d")}
    listing = spark.createDataFrame([("/r/models/cup/model.sdf",), ("/r/models/deep/er/cup/model.sdf",), ("/r/models/cup/m/c.dae",), ("/x/y.ply",)], "path string")
    visuals = spark.createDataFrame([("model://cup/m/c.dae",), ("model://cup/none.dae",), ("file:///x/y.ply",), ("/x/y.ply",), ("model://gone/a",), (None,)], "uri string")
    out = {r.uri: (r.resolved_path, r.n_folders) for r in manifests.resolved_uris(visuals, listing, "models").collect()}
    assert out == {"model://cup/m/c.dae": ("/r/models/cup/m/c.dae", 2), "model://cup/none.dae": (None, 2), "file:///x/y.ply": ("/x/y.ply", None), "/x/y.ply": ("/x/y.ply", None), "model://gone/a": (None, None), None: (None, None)}


def test_pictures_and_files(spark, tmp_path):
    entries = spark.createDataFrame([(0, "b", "m/b.ply", "glass"), (0, "a", "m/a.obj", "wood")], "frame_id int, id string, mesh_path string, material_class string")
    whole, bare = (sinks.visual_scene_xml(entries, g).first() for g in (False, True))
    assert whole.n_shapes == 2 and "dielectric" in whole.xml and "<sensor" in whole.xml and "<sensor" not in bare.xml and bare.xml.count("<shape") == 2
    assert "map_Kd t.png" in sinks.wall_mtl(spark.createDataFrame([("w", "t.png")], "wall string, texture string")).first().mtl
    sinks.write_json(entries, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    sinks.write_csv(entries, str(tmp_path / "c"), ["id", "frame_id"])
    assert spark.read.option("header", "true").csv(str(tmp_path / "c")).columns == ["id", "frame_id"]


def test_pose_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / f"in/{k}.txt").write_text(pose("arm", f"l{k}") * 2)
    from fieldloom.streaming.stateful import run_available

    rows = run_available(pose_log.stream_pose_log(spark, str(tmp_path / "in")).select("model", "link", "error"), str(tmp_path / "out"))
    assert sorted(map(tuple, rows.collect())) == [("arm", "l0", None)] * 2 + [("arm", "l1", None)] * 2
