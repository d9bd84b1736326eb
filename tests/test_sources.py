import json
import re
import struct

import pytest
from fieldloom.operators import frames, manifests
from fieldloom.sources import meshes, pose_log, scenes, sinks
from pyspark.sql import functions as F


def pose(model, link, sec=1, nsec=5, q="w: 1", child=None):
    return f"""pose {{
  header {{
    stamp {{
      sec: {sec}
      nsec: {nsec}
    }}
    data {{
      key: "frame_id"
      value: "{model}"
    }}
    data {{
      key: "child_frame_id"
      value: "{child or model + "::" + link}"
    }}
  }}
  name: "{model}::{link}"
  position {{
    x: 0.25
  }}
  orientation {{
    {q}
  }}
}}
"""


def test_pose_log(spark, tmp_path):
    text = "".join(pose("arm", f"l{i % 3}", sec=i // 3) for i in range(12)) + pose("leg", "a") + pose("bad", "x", q="") + pose("bad", "y", child="z::z") + pose("bad", "w", q="w: nan")
    (tmp_path / "log.txt").write_text(text)
    rows = pose_log.read_pose_log(spark, str(tmp_path)).orderBy("position").collect()
    assert len(rows) == 16 and [r.link for r in rows[:4]] == ["l0", "l1", "l2", "l0"]
    assert rows[0].at == [0.25, 0.0, 0.0] and rows[0].orientation == [0, 0, 0, 1] and rows[5].sec == 1 and rows[0].header["frame_id"] == "arm"
    assert [r.error for r in rows] == [None] * 13 + ["orientation has no length", "header and name differ", "a number isn't finite"]
    good = pose_log.read_pose_log(spark, str(tmp_path)).where("error IS NULL")
    links = spark.createDataFrame([("arm", f"l{i}") for i in range(3)] + [("leg", "a"), ("leg", "b")], "model string, link string")
    samples = frames.assembled(good, links)
    assert {(r.model, r.accepted) for r in samples.select("model", "accepted").distinct().collect()} == {("arm", True), ("leg", False)}
    assert samples.where("model = 'arm'").agg(F.max("sample_index")).first()[0] == 3
    assert frames.inconsistent_samples(samples, ["sec", "nsec"]).count() == 0


def ply(kind, rows, extra=False):
    head = f"ply\nformat {kind} 1.0\ncomment c\nelement vertex {len(rows)}\n" + ("property uchar q\n" if extra else "") + "property float x\nproperty double y\nproperty float z\nelement face 0\nproperty list uchar int vertex_indices\nend_header\n"
    if kind == "ascii":
        return (head + "".join(("7 " if extra else "") + " ".join(map(str, r)) + "\n" for r in rows)).encode()
    order = "<" if "little" in kind else ">"
    return head.encode() + b"".join((b"\x07" if extra else b"") + struct.pack(order + "fdf", *r) for r in rows)


ROWS = [(0.5, 1.25, -2.0), (3.0, 4.0, 5.0)]


@pytest.mark.parametrize("kind", ["ascii", "binary_little_endian", "binary_big_endian"])
@pytest.mark.parametrize("extra", [False, True])
def test_ply(kind, extra):
    assert meshes.ply_vertices(ply(kind, ROWS, extra)).tolist() == [list(r) for r in ROWS]
    with pytest.raises(ValueError):
        meshes.ply_vertices(ply(kind, ROWS)[:-9].replace(b"vertex 2", b"vertex 9"))


@pytest.mark.parametrize("data", [b"obj", b"ply\nformat ascii 1.0\nelement vertex 1\nproperty float x\nend_header\n1\n", b"ply\nformat odd 1.0\nelement vertex 0\nproperty float x\nproperty float y\nproperty float z\nend_header\n", b"ply\nformat ascii 1.0\nelement vertex 1\nproperty list uchar int x\nend_header\n1 1\n"])
def test_bad_ply(data):
    with pytest.raises(ValueError):
        meshes.ply_vertices(data)


def test_mesh_files(spark, tmp_path):
    (tmp_path / "a.ply").write_bytes(ply("ascii", ROWS))
    (tmp_path / "b.obj").write_text("# c\nv 1 2 3 9\nvn 0 0 1\nvt 0 0\nv 1 2\nv 4 5 6\nf 1 2 3\n")
    rows = meshes.read_meshes(spark, str(tmp_path)).orderBy("mesh_path", "vertex_idx").collect()
    assert [(r.x, r.y, r.z) for r in rows] == [*ROWS, (1, 2, 3), (4, 5, 6)] and [r.vertex_idx for r in rows if r.mesh_path.endswith("obj")] == [0, 1]
    path = next(r.mesh_path for r in rows if r.mesh_path.endswith("obj"))
    placed = lambda *paths: meshes.entry_vertices(spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "frame_id int, mesh_path string"), meshes.read_meshes(spark, str(tmp_path)))
    assert sorted((r.frame_id, r.x) for r in placed(path, path).collect()) == [(0, 1.0), (0, 4.0), (1, 1.0), (1, 4.0)]
    for bad, why in (("a.stl", "unsupported mesh a.stl"), ("b.ply", "no vertices in b.ply")):
        with pytest.raises(Exception, match=why):
            placed(path, bad).collect()
    (tmp_path / "c.obj").write_text("v 1 2\n")
    with pytest.raises(Exception, match="no vertices in"):
        meshes.read_obj(spark, str(tmp_path)).collect()


WORLD = """<sdf><world name='w'>
<model name='table'><static>true</static><pose>1 0 0 0 0 0</pose><link name='top'><visual name='v'><geometry><box><size>1 2 3</size></box></geometry></visual><visual name='none'><geometry><plane/></geometry></visual></link>
<model name='inner'><link name='leg'><visual name='w'><pose>0 0 1 0 0 0</pose><geometry><cylinder><radius>0.1</radius><length>2</length></cylinder></geometry></visual></link></model></model>
<include><name>cup1</name><uri>model://cup</uri><pose>0 1 0 0 0 0</pose></include><include><name>gone</name><uri>model://lost</uri></include><include><uri>model://cup</uri></include>
</world></sdf>"""
CUP = "<sdf><model name='cup'><link name='body'><visual name='m'><geometry><mesh><uri>model://cup/meshes/c.dae</uri></mesh></geometry></visual></link></model></sdf>"


def test_world_to_registry(spark, tmp_path):
    (tmp_path / "models/cup").mkdir(parents=True)
    (tmp_path / "world.sdf").write_text(WORLD)
    (tmp_path / "models/cup/model.sdf").write_text(CUP)
    models = scenes.read_models(spark, str(tmp_path / "world.sdf"))
    found, lost = scenes.read_includes(spark, str(tmp_path / "world.sdf"), scenes.read_models(spark, str(tmp_path / "models/*/model.sdf"), static_default=True))
    assert lost.select("uri").collect()[0][0] == "model://lost"
    manifest = models.drop("file", "place").unionByName(found)
    assert {(r.model, r.static) for r in manifest.collect()} == {("table", True), ("cup1", True)}
    flat = manifests.flattened(manifest, "static")
    assert {(r.model_name, r.link_name, r.geometry_type, r.skip_reason) for r in flat.collect()} == {("table", "top", "box", None), ("table", "inner::leg", "cylinder", None), ("cup1", "body", "mesh", None)}
    registry = manifests.static_registry(flat, [manifests.Rule("contains", "CUP", "glass"), manifests.Rule("contains", "leg", "__skip__")]).collect()
    by = {r.id: r for r in registry}
    assert set(by) == {"table__top__v", "cup1__body__m"} and by["cup1__body__m"].material_class == "glass" and by["table__top__v"].to_world[0] == [1, 0, 0, 1]
    assert manifests.validation_issues(manifest, "static").count() == 0


DEEP = """<sdf><world name='w'><model name='a'><link name='own'><pose>9 0 0 0 0 0</pose></link>
<model name='b'><pose>1 0 0 0 0 1.5707963267948966</pose><link name='x'><pose>0 2 0 0 0 0</pose></link>
<model name='c'><pose>1 0 0 0 0 0</pose><link name='y'><pose>0 0 3 0 0 0</pose></link></model></model></model>
<include><name>cart1</name><uri>model://cart</uri></include></world></sdf>"""


def test_nested_poses_are_composed_and_the_model_says_whether_it_is_static(spark, tmp_path):
    (tmp_path / "models/cart").mkdir(parents=True)
    (tmp_path / "world.sdf").write_text(DEEP)
    (tmp_path / "models/cart/model.sdf").write_text("<sdf><model name='cart'><static>false</static><link name='l'/></model></sdf>")
    (row,) = scenes.read_models(spark, str(tmp_path / "world.sdf")).collect()
    poses = {x.link: [float(v) for v in x.link_pose.split()] for x in row.links}
    assert set(poses) == {"own", "b::x", "b::c::y"} and poses["own"] == [9, 0, 0, 0, 0, 0]
    near = lambda a, b: max(abs(x - y) for x, y in zip(a, b, strict=True)) < 1e-12
    assert near(poses["b::x"], [-1, 0, 0, 0, 0, 1.5707963267948966]) and near(poses["b::c::y"], [1, 1, 3, 0, 0, 1.5707963267948966])
    found, lost = scenes.read_includes(spark, str(tmp_path / "world.sdf"), scenes.read_models(spark, str(tmp_path / "models/*/model.sdf"), static_default=True))
    assert [(r.model, r.static) for r in found.collect()] == [("cart1", False)] and lost.count() == 0
    assert scenes.pose_chain("0 0 0 0 1.5707963267948966 0", "0 0 0 0.5 0 0").split()[3] == "0.5"


def test_manifest_defects(spark, tmp_path):
    visual = {"visual_name": "v", "visual_pose": "0 0 0 0 0 0", "geometry_type": "box", "size": "1 1 1"}
    doc = [
        {"model": "a", "model_pose": "0 0 0", "static": True, "links": [{"link": "l", "link_pose": "0 0 0 0 0 0", "visuals": []}]},
        {"model": "a", "model_pose": "0 0 0 0 0 0", "static": False, "links": [{"link": "l", "link_pose": "0 0 0 0 0 0", "visuals": [
            {**visual, "size": "1 0 1"}, {**visual, "geometry_type": "cone"}, {**visual, "geometry_type": "sphere"}, {**visual, "geometry_type": "mesh", "uri": "model://gone/x.dae"}, {"visual_name": "w", "geometry_type": "box"}]}]},
    ]
    (tmp_path / "m.json").write_text(json.dumps(doc))
    manifest = scenes.read_manifest(spark, str(tmp_path / "m.json")).drop("_corrupt_record")
    index = spark.createDataFrame([("here",)], "name string")
    got = sorted((r.severity, r.message) for r in manifests.validation_issues(manifest, "m", index).collect())
    assert got == sorted([
        ("error", "model_pose has not six numbers"), ("error", "Duplicate model 'a'"), ("info", "Link has no visuals"), ("error", "size values must be positive"), ("warning", "Unsupported geometry_type 'cone'"),
        ("error", "radius must be positive"), ("warning", "scale is missing; 1 1 1 is assumed"), ("error", "Unknown model in model://gone/x.dae"), ("error", "Missing required field 'visual_pose'"), ("error", "box visual has no size")])
    (tmp_path / "bad.json").write_text("{nope")
    assert scenes.read_manifest(spark, str(tmp_path / "bad.json")).cache().where("_corrupt_record IS NOT NULL").count() == 1
    assert manifests.nonrenderable_links(manifest).collect()[0].links == ["l"]


def test_tables_and_output(spark, tmp_path):
    (tmp_path / "i.csv").write_text("frame_id,source_sample_index,path\n0,5,a\n1,9,b\n")
    schema = "frame_id int, source_sample_index int, path string"
    assert scenes.read_index(spark, str(tmp_path / "i.csv"), schema, ["frame_id"], 2).count() == 2
    for key, n in ((["frame_id"], 3), (["frame_id"], 1)):
        with pytest.raises(ValueError):
            scenes.read_index(spark, str(tmp_path / "i.csv"), schema, key, n)
    lines = spark.createDataFrame([("r", 0, "paths_found : 17"), ("r", 1, "ERROR: one"), ("r", 2, "ERROR: two"), ("r", 3, 'RESULT_JSON {"a": 1}')], "run string, line_no int, value string")
    assert tuple(scenes.tool_output(lines).first()) == ("r", 17, "ERROR: one", '{"a": 1}')
    listing = scenes.file_listing(spark, str(tmp_path), "*.csv")
    assert listing.count() == 1 and scenes.missing_paths(spark.createDataFrame([("nowhere",)], "path string"), "path", listing).count() == 1


def test_scene_xml_and_wall(spark, tmp_path):
    entries = spark.createDataFrame([(0, "B", "m/b.ply", "glass"), (0, "a", "m/a.obj", "skin"), (1, "c", "m/c.ply", "glass")], "frame_id int, id string, mesh_path string, material_class string")
    # Permittivity and conductivity of skin.
    materials = spark.createDataFrame([("glass", "glass", None, None, 0.1, 0.0, 0.0), ("skin", None, 16.73, 20.1043, 0.003, 0.0, 0.0)], "material_class string, itu_type string, relative_permittivity double, conductivity double, thickness double, scattering_coefficient double, xpd_coefficient double")
    out = {r.frame_id: r for r in sinks.scene_xml(entries, materials).collect()}
    assert out[0].n_shapes == 2 and out[0].xml.count("<bsdf") == 2 and 'value="20.1043"' in out[0].xml and out[1].xml.count("<bsdf") == 1
    assert out[0].xml.index('id="mat-glass"') < out[0].xml.index('id="mat-skin"') < out[0].xml.index("<shape")
    sinks.write_scenes(sinks.scene_xml(entries, materials), str(tmp_path / "out"))
    models = spark.read.format("xml").option("rowTag", "shape").load(str(tmp_path / "out"))
    assert models.count() == 3
    with pytest.raises(Exception, match="no radio material"):
        sinks.scene_xml(entries.withColumn("material_class", F.lit("composite")), materials).collect()
    obj = sinks.wall_obj(spark.createDataFrame([("w", 2.0, 0.1, 3.0, False)], "wall string, width double, thickness double, height double, reverse_u boolean")).first().obj
    points = [tuple(map(float, x.split()[1:])) for x in obj.splitlines() if x.startswith("v ")]
    faces = [[int(c.split("/")[0]) - 1 for c in x.split()[1:]] for x in obj.splitlines() if x.startswith("f ")]
    assert len(points) == 8 and len(faces) == 12
    for f in faces:  # all faces look outwards
        (ax, ay, az), (bx, by, bz), (cx, cy, cz) = (points[i] for i in f)
        u, v = (bx - ax, by - ay, bz - az), (cx - ax, cy - ay, cz - az)
        normal = (u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])
        assert sum(n * p for n, p in zip(normal, (ax + bx + cx, ay + by + cy, az + bz + cz), strict=True)) > 0


def test_a_manifest_is_validated_in_one_pass_of_compiled_code(spark):
    kinds = dict.fromkeys(manifests.VISUAL.names)
    visual = {**kinds, "visual_name": "v", "visual_pose": "0 0 0 0 0 0", "geometry_type": "box", "size": "1 NaN 2"}
    links = [("l", "0 0 0 0 0 0", [visual, {**visual, "size": "1 0 2"}, None]), ("bare", "0 0", []), ("none", None, None), None]
    rows = [("m", "0 0 0 0 0", True, None, None, links), ("m", "0 0 0 0 0 0", None, None, None, []), (None, None, True, None, None, None)]
    found = manifests.validation_issues(spark.createDataFrame(rows, manifests.MANIFEST), "x")
    assert sorted((r.location, r.severity, r.message) for r in found.collect()) == sorted(
        [("entries[m]", "error", "model_pose has not six numbers"), ("entries[m]", "error", "Missing required field 'static'"), ("entries[m]", "error", "Duplicate model 'm'")]
        + [("entries[?]", "error", f"Missing required field '{c}'") for c in ("model", "model_pose", "links")]
        + [("entries[m].links[0].visuals[1]", "error", "size values must be positive")]
        + [("entries[m].links[0].visuals[2]", "error", f"Missing required field '{c}'") for c in ("visual_name", "visual_pose", "geometry_type")]
        + [("entries[m].links[1]", "error", "link_pose has not six numbers"), ("entries[m].links[1]", "info", "Link has no visuals")]
        + [("entries[m].links[2]", "error", f"Missing required field '{c}'") for c in ("link_pose", "visuals")]
        + [("entries[m].links[3]", "error", f"Missing required field '{c}'") for c in ("link", "link_pose", "visuals")]
    )
    lines = spark.range(9).groupBy(F.col("id").cast("string").alias("model")).agg(F.collect_list(F.struct(F.lit("l").alias("link"), F.lit("0").alias("link_pose"), F.array().cast(f"array<{manifests.VISUAL.simpleString()}>").alias("visuals"))).alias("links"))
    found = manifests.validation_issues(lines.select("model", F.lit("0").alias("model_pose"), F.lit(True).alias("static"), "links"), "x")
    assert len(re.findall(r"functions=\[collect_list", found._jdf.queryExecution().toString().partition("Physical Plan")[2])) == 1
    # the JVM compiles no method of over 8000 bytes
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = manifests.validation_issues(lines.select("model", F.lit("0").alias("model_pose"), F.lit(True).alias("static"), "links"), "x")
        code = found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen"))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert 0 < max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", code))) <= 8000
