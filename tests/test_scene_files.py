import os
import random

import pytest
from fieldloom.sources import sinks
from pyspark.sql import functions as F

MATERIALS = "material_class string, itu_type string, relative_permittivity double, conductivity double, thickness double, scattering_coefficient double, xpd_coefficient double"


def test_relative_paths_equal_the_usual_ones(spark):
    rng = random.Random(2)
    path = lambda n: "/" + "/".join(rng.choice("abc") for _ in range(rng.randrange(1, n)))
    rows = [(path(6), path(5) + rng.choice(["", "/"])) for _ in range(300)] + [("a/b", "a"), ("a", "a/b/c"), ("/a", "/"), ("x/y", "/a"), ("/x", "b"), ("/a/b", "/a/b")]
    out = spark.createDataFrame(rows, "path string, folder string").withColumn("r", sinks.relative_path(F.col("path"), F.col("folder"))).collect()
    for r in out:
        assert r.r == (os.path.relpath(r.path, r.folder) if r.path.startswith("/") == r.folder.startswith("/") else r.path), r


def test_documents_are_portable_and_counted(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.ply").write_text("mesh")
    entries = spark.createDataFrame([(f, n, str(tmp_path / f"{n}.ply"), "glass") for f in (0, 1) for n in "ab"], "frame_id int, id string, mesh_path string, material_class string")
    folder = str(tmp_path / "out")
    materials = spark.createDataFrame([("glass", "glass", None, None, 0.1, 0.0, 0.0)], MATERIALS)
    scenes = sinks.scene_xml(sinks.relative_entries(entries, folder), materials)
    sinks.write_scenes(scenes, folder)
    for f in (0, 1):
        (name,) = [x for x in os.listdir(f"{folder}/frame_id={f}") if x.endswith(".txt")]
        text = open(f"{folder}/frame_id={f}/{name}").read()
        paths = [x.split('"')[0] for x in text.split('name="filename" value="')[1:]]
        assert paths == ["../../a.ply", "../../b.ply"] and all(os.path.exists(f"{folder}/frame_id={f}/{p}") for p in paths)
    with pytest.raises(ValueError, match="frame 1 has 2 of 3 shapes"):
        sinks.write_scenes(scenes.withColumn("n_shapes", F.col("n_shapes") + F.col("frame_id")), str(tmp_path / "wrong"))


def test_the_camera_is_a_parameter(spark):
    entries = spark.createDataFrame([(0, "b", "m/b.ply", "glass")], "frame_id int, id string, mesh_path string, material_class string")
    camera = sinks.Camera("1, 2, 3", fov=45, width=640, height=480, samples=16)
    xml = sinks.visual_scene_xml(entries, camera=camera).first().xml
    for part in ('origin="1, 2, 3"', 'name="fov" value="45"', 'name="width" value="640"', 'name="height" value="480"', 'name="sample_count" value="16"'):
        assert part in xml
    assert 'value="1280"' in sinks.visual_scene_xml(entries).first().xml
