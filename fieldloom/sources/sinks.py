"""Scene documents, meshes and tables as files."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.strings import slugify


def write_csv(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    """With a header and fixed columns; null is empty text."""
    df.select(*(columns or df.columns)).write.option("header", "true").option("nullValue", "").option("emptyValue", "").csv(path)


def number_text(x: Column) -> Column:
    """A number without a trailing point and zeros, six decimals at most."""
    return F.regexp_replace(F.format_string("%.6f", x.cast("double")), r"\.?0+$", "")


def material_xml(name: Column, itu_type: Column, permittivity: Column, conductivity: Column, thickness: Column, scattering: Column, xpd: Column) -> Column:
    """The element of one radio material: a named ITU one, or one of given permittivity and conductivity."""
    line = lambda kind, key, value: F.concat(F.lit(f'        <{kind} name="{key}" value="'), value, F.lit('" />\n'))
    head = lambda kind: F.concat(F.lit(f'    <bsdf type="{kind}" id="'), name, F.lit('">\n'))
    itu = F.concat(head("itu-radio-material"), line("string", "type", itu_type))
    own = F.concat(head("radio-material"), line("float", "relative_permittivity", number_text(permittivity)), line("float", "conductivity", number_text(conductivity)))
    tail = [line("float", k, number_text(v)) for k, v in (("thickness", thickness), ("scattering_coefficient", scattering), ("xpd_coefficient", xpd))]
    return F.concat(F.when(itu_type.isNotNull(), itu).otherwise(own), *tail, F.lit("    </bsdf>\n"))


def shape_xml(entry_id: Column, mesh: Column, material: Column) -> Column:
    return F.concat(F.lit('    <shape type="'), F.lower(F.regexp_extract(mesh, r"\.([A-Za-z0-9]+)$", 1)), F.lit('" id="'), entry_id, F.lit('">\n        <string name="filename" value="'), mesh, F.lit('" />\n        <ref id="'), material, F.lit('" />\n    </shape>\n'))


def scene_xml(entries: DataFrame, materials: DataFrame) -> DataFrame:
    """(frame_id, xml, n_shapes): each frame's used materials by name, then its shapes by id.

    entries: frame_id, id, mesh_path, material_class; materials: material_class, itu_type, relative_permittivity,
    conductivity, thickness, scattering_coefficient, xpd_coefficient. A material class that isn't mapped is an error.
    """
    spec = materials.select("material_class", F.lit(True).alias("__known"), material_xml(F.concat(F.lit("mat-"), slugify(F.col("material_class"))), *[F.col(c) for c in ("itu_type", "relative_permittivity", "conductivity", "thickness", "scattering_coefficient", "xpd_coefficient")]).alias("__bsdf"))
    rows = entries.join(spec, "material_class", "left")
    bsdf = F.when(F.col("__known"), F.col("__bsdf")).otherwise(F.raise_error(F.concat(F.lit("no radio material for "), F.col("material_class"))).cast("string"))
    rows = rows.select("frame_id", "id", "material_class", bsdf.alias("bsdf"), shape_xml(slugify(F.col("id")), F.col("mesh_path"), F.concat(F.lit("mat-"), slugify(F.col("material_class")))).alias("shape"))
    used = F.array_sort(F.collect_set(F.struct("material_class", "bsdf")))
    shapes = F.array_sort(F.collect_list(F.struct("id", "shape")))
    text = lambda c, f: F.array_join(F.transform(c, lambda x: x[f]), "")
    out = rows.groupBy("frame_id").agg(used.alias("used"), shapes.alias("shapes"))
    return out.select("frame_id", F.concat(F.lit('<scene version="3.0.0">\n'), text("used", "bsdf"), text("shapes", "shape"), F.lit("</scene>\n")).alias("xml"), F.size("shapes").alias("n_shapes"))


def relative_path(path: Column, folder: Column) -> Column:
    """`path` as seen from `folder`, both absolute or both relative, without `.`, `..` and double slashes in them; else
    as it is."""
    a, b = F.split(path, "/"), F.split(F.rtrim(folder, F.lit("/")), "/")
    least = F.least(F.size(a), F.size(b))
    same = F.coalesce(F.array_min(F.filter(F.sequence(F.lit(0), least - 1), lambda i: F.get(a, i) != F.get(b, i))), least)
    parts = F.concat(F.array_repeat(F.lit(".."), F.size(b) - same), F.slice(a, same + 1, F.greatest(F.size(a) - same, F.lit(0))))
    found = F.when(F.size(parts) == 0, F.lit(".")).otherwise(F.array_join(parts, "/"))
    return F.when(F.startswith(path, F.lit("/")) == F.startswith(folder, F.lit("/")), found).otherwise(path)


def relative_entries(entries: DataFrame, folder: str, mesh: str = "mesh_path") -> DataFrame:
    """The entries with mesh paths as seen from each frame's document, which `write_scenes` puts in
    `folder`/frame_id=..., so that the folder can be moved with its meshes."""
    own = F.concat(F.lit(folder.rstrip("/") + "/frame_id="), F.col("frame_id").cast("string"))
    return entries.withColumn(mesh, relative_path(F.col(mesh), own))


def write_scenes(scenes: DataFrame, folder: str) -> None:
    """One text file per frame, in folders frame_id=...; read again, each must have as many shapes as its row says."""
    scenes.select("frame_id", "xml").repartition("frame_id").write.partitionBy("frame_id").option("lineSep", "\n").text(folder)
    shapes = (F.length("value") - F.length(F.replace("value", F.lit("<shape "), F.lit("")))) / len("<shape ")
    back = scenes.sparkSession.read.text(folder, wholetext=True).groupBy(F.col("frame_id").cast("string").alias("frame_id")).agg(F.sum(shapes).cast("long").alias("__found"))
    wanted = scenes.select(F.col("frame_id").cast("string").alias("frame_id"), "n_shapes")
    wrong = wanted.join(back, "frame_id", "left").where(~F.col("n_shapes").eqNullSafe(F.col("__found"))).limit(3).collect()
    if wrong:
        raise ValueError("; ".join(f"frame {r.frame_id} has {r['__found']} of {r.n_shapes} shapes" for r in wrong))


def wall_obj(walls: DataFrame) -> DataFrame:
    """(wall, obj): a box of twelve triangles with texture coordinates for each wall (wall, width, thickness,
    height, reverse_u). The corners of opposite faces share the texture's space, so it runs on around the wall."""
    half = [F.col(c) / 2 for c in ("width", "thickness", "height")]
    corners = [(sx, sy, sz) for sx in (-1, 1) for sy in (-1, 1) for sz in (-1, 1)]
    six = lambda *v: F.format_string(" ".join(["%.6f"] * len(v)), *v)
    point = [F.concat(F.lit("v "), six(*[F.lit(float(s)) * h for s, h in zip(c, half, strict=True)])) for c in corners]
    u = lambda s: F.when(F.col("reverse_u"), F.lit((1.0 - s) / 2)).otherwise(F.lit((1.0 + s) / 2))
    coordinate = [F.concat(F.lit("vt "), six(u(c[0]), F.lit((1.0 + c[2]) / 2))) for c in corners]
    faces = []
    for axis in range(3):
        for side in (-1, 1):
            quad = sorted((i for i, c in enumerate(corners) if c[axis] == side), key=lambda i: corners[i])
            a, b, d, c = quad
            ring = (a, b, c, d) if side * (-1) ** axis < 0 else (a, d, c, b)
            faces += [(ring[0], ring[1], ring[2]), (ring[0], ring[2], ring[3])]
    lines = [F.lit("f " + " ".join(f"{i + 1}/{i + 1}" for i in f)) for f in faces]
    return walls.select("wall", F.concat(F.array_join(F.array(*point, *coordinate, *lines), "\n"), F.lit("\n")).alias("obj"))


def ply_text(triangles: DataFrame) -> DataFrame:
    """(mesh, ply): ASCII PLY of triangles (mesh, triangle_idx, vertices array of three points), three vertices each."""
    point = lambda p: F.format_string("%.6f %.6f %.6f", F.get(p, F.lit(0)), F.get(p, F.lit(1)), F.get(p, F.lit(2)))
    rows = triangles.groupBy("mesh").agg(F.array_sort(F.collect_list(F.struct("triangle_idx", "vertices"))).alias("t"))
    n = F.size("t").cast("string")
    head = F.concat(F.lit("ply\nformat ascii 1.0\nelement vertex "), (F.size("t") * 3).cast("string"), F.lit("\nproperty float x\nproperty float y\nproperty float z\nelement face "), n, F.lit("\nproperty list uchar int vertex_indices\nend_header\n"))
    vertices = F.array_join(F.flatten(F.transform("t", lambda t: F.transform(t["vertices"], point))), "\n")
    faces = F.array_join(F.transform(F.sequence(F.lit(0), F.size("t") - 1), lambda i: F.format_string("3 %d %d %d", 3 * i, 3 * i + 1, 3 * i + 2)), "\n")
    return rows.select("mesh", F.concat(head, vertices, F.lit("\n"), faces, F.lit("\n")).alias("ply"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", "false").json(path)


def wall_mtl(walls: DataFrame) -> DataFrame:
    """(wall, mtl): the material of each wall (wall, texture)."""
    return walls.select("wall", F.concat(F.lit("newmtl "), slugify(F.col("wall")), F.lit("\nKa 1.000000 1.000000 1.000000\nKd 1.000000 1.000000 1.000000\nmap_Kd "), "texture", F.lit("\n")).alias("mtl"))


#: Colours by which materials are told apart in a picture, in turn.
PALETTE = ("0.8 0.2 0.2", "0.2 0.6 0.2", "0.2 0.3 0.8", "0.8 0.7 0.2", "0.6 0.3 0.7", "0.3 0.7 0.7", "0.5 0.5 0.5")
@dataclass(frozen=True)
class Camera:
    """From where a scene is looked at, and how its picture is made."""

    origin: str = "8, 8, 6"
    target: str = "0, 0, 1"
    up: str = "0, 0, 1"
    fov: float = 60
    width: int = 1280
    height: int = 720
    samples: int = 64

    def xml(self) -> str:
        return f"""    <integrator type="path" />
    <sensor type="perspective">
        <float name="fov" value="{self.fov:g}" />
        <transform name="to_world"><lookat origin="{self.origin}" target="{self.target}" up="{self.up}" /></transform>
        <sampler type="independent"><integer name="sample_count" value="{self.samples}" /></sampler>
        <film type="hdrfilm"><integer name="width" value="{self.width}" /><integer name="height" value="{self.height}" /></film>
    </sensor>
    <emitter type="constant" />
"""


def visual_scene_xml(entries: DataFrame, geometry_only: bool = False, camera: Camera | None = None) -> DataFrame:
    """(frame_id, xml, n_shapes): a scene to look at. Materials have colours in turn, by name, glass is dielectric;
    unless `geometry_only` there are a camera and a light. entries as for `scene_xml`."""
    rows = entries.select("frame_id", "id", "material_class", shape_xml(slugify(F.col("id")), F.col("mesh_path"), F.concat(F.lit("mat-"), slugify(F.col("material_class")))).alias("shape"))
    out = rows.groupBy("frame_id").agg(F.array_sort(F.collect_set("material_class")).alias("used"), F.array_sort(F.collect_list(F.struct("id", "shape"))).alias("shapes"))
    colours = F.array(*map(F.lit, PALETTE))

    def bsdf(name: Column, i: Column) -> Column:
        head = F.concat(F.lit('" id="mat-'), slugify(name), F.lit('">'))
        glass = F.concat(F.lit('    <bsdf type="dielectric'), head, F.lit("</bsdf>\n"))
        plain = F.concat(F.lit('    <bsdf type="diffuse'), head, F.lit('<rgb name="reflectance" value="'), F.get(colours, i % len(PALETTE)), F.lit('" /></bsdf>\n'))
        return F.when(name == "glass", glass).otherwise(plain)

    parts = [F.lit('<scene version="3.0.0">\n'), F.lit("" if geometry_only else (camera or Camera()).xml()), F.array_join(F.transform("used", bsdf), ""), F.array_join(F.transform("shapes", lambda x: x["shape"]), ""), F.lit("</scene>\n")]
    return out.select("frame_id", F.concat(*parts).alias("xml"), F.size("shapes").alias("n_shapes"))
