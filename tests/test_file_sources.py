import json
import random
import re

import numpy as np
import pytest
from fieldloom.operators import radio
from fieldloom.sources import files, mesh_parts, meshes, pose_source
from pyspark.sql import functions as F
from test_sources import ply, pose


def points(n, seed=1):
    rng = random.Random(seed)
    return [(float(np.float32(rng.uniform(-9, 9))), rng.uniform(-9, 9), float(np.float32(rng.uniform(-9, 9)))) for _ in range(n)]


@pytest.mark.parametrize("kind", ["ascii", "binary_little_endian", "binary_big_endian"])
def test_a_mesh_in_many_parts_equals_the_whole(spark, tmp_path, kind):
    rows = points(1000)
    a, b = str(tmp_path / "a.ply"), str(tmp_path / "b.ply")
    for path, data in ((a, ply(kind, rows, True)), (b, ply(kind, rows[:1], True))):
        with open(path, "wb") as f:
            f.write(data)
    df = mesh_parts.read_ply_parts(spark, [a, f"file://{b}", a], part_bytes=17 * 260)
    assert df.rdd.getNumPartitions() == (2 if kind == "ascii" else 5)
    own = df.where(F.col("mesh_path") == a).orderBy("vertex_idx").collect()
    assert [(r.x, r.y, r.z) for r in own] == [tuple(r) for r in meshes.ply_vertices(ply(kind, rows, True)).tolist()] and [r.vertex_idx for r in own] == list(range(1000))
    assert df.count() == 1001
    some = mesh_parts.read_ply_parts(spark, [a], ["q", "y"], 17 * 100)
    assert some.dtypes == [("mesh_path", "string"), ("vertex_idx", "bigint"), ("q", "int"), ("y", "double")]
    assert {r.q for r in some.collect()} == {7} and sorted(r.y for r in some.collect()) == sorted(r[1] for r in rows)


def test_meshes_that_are_wrong(spark, tmp_path):
    good = ply("binary_little_endian", points(3))
    cases = {
        "no PLY header": b"plz" + good[3:],
        "too few vertices": good[:-1],
        "unknown PLY format": good.replace(b"binary_little_endian", b"binary_odd"),
        "isn't a number": good.replace(b"property double y", b"property list uchar int y"),
        "vertices don't come first": good.replace(b"element vertex 3", b"element corner 3"),
        "no vertices": ply("binary_little_endian", []),
    }
    for why, data in cases.items():
        path = tmp_path / "bad.ply"
        path.write_bytes(data)
        with pytest.raises(Exception, match=why):
            mesh_parts.read_ply_parts(spark, [str(path)]).collect()
    (tmp_path / "ok.ply").write_bytes(good)
    with pytest.raises(Exception, match="vertices have no w"):
        mesh_parts.read_ply_parts(spark, [str(tmp_path / "ok.ply")], ["w"]).collect()
    assert mesh_parts.read_ply_parts(spark, []).collect() == []


def test_meshes_are_written_and_read(spark, tmp_path):
    df = spark.createDataFrame([(i, x, y) for i, (x, y, _) in enumerate(points(500))], "id long, x double, y double").repartition(3)
    paths = [r.mesh_path for r in mesh_parts.write_ply_parts(df, str(tmp_path / "out")).collect()]
    back = mesh_parts.read_ply_parts(spark, paths, ["id", "x", "y"], 1000)
    assert len(paths) == 3 and sorted(tuple(r)[2:] for r in back.collect()) == sorted(map(tuple, df.collect()))
    assert mesh_parts.write_ply_parts(df.limit(0), str(tmp_path / "none")).collect() == []


DEEP = 'pose {\n  name: "m::deep"\n  extra {\n    a { b { c: "} pose { \\" {" } }\n  }\n  position { x: 1 y: 2 }\n  orientation {\n w: 1\n }\n}\n'


def some_log(seed, broken=True):
    rng = random.Random(seed)
    parts = ["# a heading\n\n"] if seed % 2 else []
    for i in range(60):
        kind = rng.randrange(8 if broken else 6)
        parts.append(DEEP if kind == 0 else pose("arm", f"l{i}", sec=i) if kind < 6 else pose("arm", f"cut{i}")[: -rng.randrange(3, 60)] + "\n" if kind == 6 else 'pose {\n name: "unended }\n}\n')
    return "".join(parts)


@pytest.mark.parametrize("seed", range(6))
def test_every_cut_gives_the_same_blocks_once(tmp_path, seed, monkeypatch):
    text = some_log(seed)
    path = tmp_path / "log.txt"
    path.write_text(text)
    size = len(text.encode())
    whole = list(pose_source.blocks_between(str(path), 0, size, True))
    assert "".join(b.decode() for _, b, _ in whole).count("name:") == text.count("name:")
    assert all(text.encode()[a : a + len(b)] == b and b.startswith(b"pose {") for a, b, _ in whole)
    assert sum(ok for _, _, ok in whole) < len(whole)
    rng = random.Random(seed)
    for most in (1, 7, 100, 5000):
        monkeypatch.setattr(pose_source, "STEP", rng.choice([5, 64, 1 << 16]))
        cuts = sorted({0, size, *(rng.sample(range(size), 40) if most == 1 else range(0, size, most))})[:: 1 if most > 1 else rng.choice([1, 3])]
        cuts = sorted({0, size, *cuts})
        found = [x for a, b in zip(cuts, cuts[1:], strict=False) for x in pose_source.blocks_between(str(path), a, b, b == size)]
        assert found == whole


def test_rows_of_blocks_in_ranges_and_nested(spark, tmp_path):
    (tmp_path / "a.txt").write_text(some_log(2, broken=False) + pose("bad", "x", q="") + pose("bad", "y", child="z::z") + pose("bad", "w", q="w: nan") + pose("odd", "v").replace("odd::v", "odd"))
    (tmp_path / "b.txt").write_text(DEEP + pose("leg", "a")[:-3])
    (tmp_path / "c.txt").write_text("")
    found = {most: pose_source.read_pose_blocks(spark, files.files_below(str(tmp_path)), most).orderBy("file", "start").collect() for most in (1 << 20, 100)}
    assert repr(found[100]) == repr(found[1 << 20])
    rows = found[100]
    assert [r.error for r in rows if r.model == "bad" or r.model is None] == ["orientation has no length", "header and name differ", "a number isn't finite", "name isn't model::link"]
    assert [(r.model, r.link, r.error) for r in rows[-2:]] == [("m", "deep", None), ("leg", "a", "braces don't match")]
    deep = rows[-2]
    assert (deep.at, deep.orientation, deep.header, deep.sec) == ([1.0, 2.0, 0.0], [0.0, 0.0, 0.0, 1.0], {}, 0)
    arm = next(r for r in rows if r.model == "arm")
    assert arm.header["child_frame_id"] == f"arm::{arm.link}" and arm.sec == int(arm.link[1:]) and arm.nsec == 5
    assert pose_source.read_pose_blocks(spark, []).collect() == []


def test_the_stream_goes_on_from_its_offsets(spark, tmp_path):
    log, out = tmp_path / "in" / "log.txt", tmp_path / "out"
    log.parent.mkdir()
    text = "".join(pose("arm", f"l{i}", sec=i) for i in range(9))

    def run():
        rows = pose_source.stream_pose_blocks(spark, str(log.parent), part_bytes=90).select("link", "error")
        rows.writeStream.format("parquet").option("path", str(out / "rows")).option("checkpointLocation", str(out / "state")).trigger(availableNow=True).start().awaitTermination()
        return sorted(map(tuple, spark.read.schema("link string, error string").parquet(str(out / "rows")).collect()))

    for k, cut in enumerate((len(text) // 3, len(text) // 3 + 5, 2 * len(text) // 3, len(text))):
        log.write_text(text[:cut])  # the file grows, also in the middle of a block
        whole = [i for i in range(9) if sum(len(pose("arm", f"l{j}", sec=j)) for j in range(i + 1)) - 1 <= cut]
        if k == 2:
            (log.parent / "other.txt").write_text(pose("leg", "z"))
        assert run() == sorted([(f"l{i}", None) for i in whole] + ([("z", None)] if k >= 2 else []))
    assert len(re.findall("pose", text)) == 9


def test_a_solver_run_that_stops_keeps_what_is_done(spark, tmp_path):
    links = spark.createDataFrame([(i, f"r{i % 3}", float(i)) for i in range(60)], "frame_id int, rx_id string, x double")
    calls, folder = tmp_path / "calls", str(tmp_path / "rows")
    calls.mkdir()

    def solver(bad, dead=()):
        def solve(link):
            if link["frame_id"] in dead:
                import os

                os._exit(1)  # the worker dies, and with it the job
            (calls / str(link["frame_id"])).open("a").write("x")
            if link["frame_id"] in bad:
                raise ValueError("no path")
            return {"y": link["x"] * 2}

        return solve

    def parts(n=6):
        rows = links.select("frame_id", F.pmod(F.xxhash64("frame_id", "rx_id"), F.lit(n)).alias("p")).collect()
        return {p: {r.frame_id for r in rows if r.p == p} for p in range(n)}

    of = parts()
    bad, dead = min(of[2]), min(of[4])
    with pytest.raises(radio.UnsolvedLinks, match="ValueError: no path"):
        radio.solve_in_parts(links, solver({bad}), "y double", folder, parts=6)
    done = of[0] | of[1] | of[2]
    assert {int(p.name) for p in calls.iterdir()} == done  # the part with the error is kept whole, later ones weren't begun
    with pytest.raises(Exception, match="(?i)worker|exited|crash"):
        radio.solve_in_parts(links, solver(set(), {dead}), "y double", folder, parts=6)
    before = {p.name: p.read_text() for p in calls.iterdir()}
    assert before[str(bad)] == "xx" and all(before[str(i)] == "x" for i in done - {bad})
    out = radio.solve_in_parts(links, solver({bad + 1}), "y double", folder, parts=6, go_on=True).collect()
    assert len(out) == 60 and sorted((r.frame_id, r.rx_id) for r in out) == [(i, f"r{i % 3}") for i in range(60)]
    assert all(r.sanity_ok and r.y == 2.0 * r.frame_id for r in out if r.frame_id != bad + 1 or r.frame_id in done)
    again = radio.solve_in_parts(links, solver(set()), "y double", folder, parts=6).collect()
    assert all(r.sanity_ok and r.error_message is None for r in again)
    third = {p.name: p.read_text() for p in calls.iterdir()}
    assert all(third[k] == before[k] for k in before if int(k) in done)  # what was solved isn't solved again
    assert radio.solve_in_parts(links.limit(0), solver(set()), "y double", str(tmp_path / "none")).collect() == []


def test_many_small_parts_are_few_tasks(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.txt").write_text(some_log(k))
    folder = str(tmp_path / "in")
    stream = pose_source.PoseStream({"path": folder, "part_bytes": "50"})
    reader = pose_source.PoseReader({"paths": json.dumps(files.files_below(folder)), "part_bytes": "50"})
    rows = lambda tasks, of: sorted((repr(r) for t in tasks for batch in of.read(t) for r in batch.to_pylist()))
    few = stream.partitions({}, stream.latestOffset()), reader.partitions()
    assert all(len(tasks) <= pose_source.TASKS for tasks in few)
    told = rows(few[0], stream), rows(few[1], reader)
    monkeypatch.setattr(pose_source, "PART_BYTES", 50)  # a part for each task
    many = stream.partitions({}, stream.latestOffset()), reader.partitions()
    assert all(len(tasks) > pose_source.TASKS for tasks in many)
    assert all([p for t in a for p in t.parts] == [p for t in b for p in t.parts] for a, b in zip(few, many, strict=True))
    assert told == (rows(many[0], stream), rows(many[1], reader))


def test_odd_blocks_are_told(tmp_path):
    told = pose_source.parsed('pose {\n name: "m::l"\n header {\n data {\n key: "k"\n value: "a"\n value: "b"\n }\n data {\n key {\n x: "1"\n }\n }\n }\n position {\n x: "2"\n y {\n }\n }\n}')
    assert told == ("m", "l", 0, 0, {"k": "b", "{'x': ['1']}": ""}, [2.0, None, 0.0], [0.0] * 4, "a number isn't finite")
    assert pose_source.parsed("pose {\n name {\n }\n}")[:2] == (None, None) and pose_source.parsed("")[-1] == "name isn't model::link"
    path = tmp_path / "log.txt"
    deep = "pose {\n" + "a {\n" * 20 + "}\n" * 20 + "}\n"
    path.write_text(deep + 'pose {\n a: "}\n}\n' + deep)
    found = list(pose_source.blocks_between(str(path), 0, path.stat().st_size, True))
    assert [(b.decode().strip(), ok) for _, b, ok in found] == [(deep.strip(), True), ('pose {\n a: "}', True), (deep.strip(), True)]
