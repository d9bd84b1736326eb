"""Nested scene manifests: flattening, validation, registries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.functions.classify import SKIP, Rule, first_match
from fieldloom.functions.geometry import compose, nested, point, pose_affine, scale_affine
from fieldloom.functions.strings import numeric_list, slugify
from fieldloom.operators.quality import issues, union_issues
from fieldloom.operators.rounds import settled

VISUAL = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("visual_name", "visual_pose", "geometry_type", "uri", "scale", "size")] + [T.StructField(n, T.DoubleType()) for n in ("radius", "length")]
)
LINK = T.StructType([T.StructField("link", T.StringType()), T.StructField("link_pose", T.StringType()), T.StructField("visuals", T.ArrayType(VISUAL))])
MANIFEST = T.StructType(
    [T.StructField("model", T.StringType()), T.StructField("model_pose", T.StringType()), T.StructField("static", T.BooleanType())]
    + [T.StructField(n, T.StringType()) for n in ("source_type", "source_uri")]
    + [T.StructField("links", T.ArrayType(LINK))]
)
GEOMETRIES = ("mesh", "box", "cylinder", "sphere")
MESH_FORMATS = ("ply", "obj", "stl", "dae", "glb", "gltf")


def flattened(manifest: DataFrame, name: str) -> DataFrame:
    """A row per visual with its places in the document, and skip_reason, the first reason not to use it (null:
    none). Links without visuals are in no row."""
    links = manifest.select(F.lit(name).alias("source_manifest"), F.col("model").alias("model_name"), "model_pose", "static", F.posexplode("links").alias("link_index", "l"))
    rows = links.select("source_manifest", "model_name", "static", "link_index", F.col("l.link").alias("link_name"), "model_pose", F.col("l.link_pose").alias("link_pose"), F.posexplode("l.visuals").alias("visual_index", "v"))
    flat = rows.select(
        "source_manifest", "model_name", "static", "link_index", "link_name", "visual_index", F.col("v.visual_name").alias("visual_name"), F.col("v.geometry_type").alias("geometry_type"),
        numeric_list(F.col("model_pose"), 6).alias("model_pose"), numeric_list(F.col("link_pose"), 6).alias("link_pose"), numeric_list(F.col("v.visual_pose"), 6).alias("visual_pose"),
        F.col("v.uri").alias("uri"), numeric_list(F.coalesce("v.scale", F.lit("1 1 1")), 3).alias("scale"), numeric_list(F.col("v.size"), 3).alias("size"), F.col("v.radius").alias("radius"), F.col("v.length").alias("length"),
    )
    return flat.withColumn("skip_reason", skip_reason())


def _positive(x: str) -> Column:
    return F.coalesce(F.col(x) > 0, F.lit(False))


def skip_reason() -> Column:
    kind = F.col("geometry_type")
    reasons = [
        (F.col("model_name").isNull(), "model has no name"),
        (F.col("model_pose").isNull(), "model pose is invalid"),
        (F.col("link_name").isNull(), "link has no name"),
        (F.col("link_pose").isNull(), "link pose is invalid"),
        (F.col("visual_name").isNull(), "visual has no name"),
        (F.col("visual_pose").isNull(), "visual pose is invalid"),
        (~F.coalesce(kind.isin(*GEOMETRIES), F.lit(False)), "geometry type is not supported"),
        ((kind == "mesh") & F.col("uri").isNull(), "mesh has no uri"),
        ((kind == "mesh") & F.col("scale").isNull(), "scale is invalid"),
        ((kind == "box") & ~F.coalesce(F.forall("size", lambda v: v > 0), F.lit(False)), "size is invalid"),
        (kind.isin("cylinder", "sphere") & ~_positive("radius"), "radius is not positive"),
        ((kind == "cylinder") & ~_positive("length"), "length is not positive"),
    ]
    return F.coalesce(*[F.when(bad, F.lit(text)) for bad, text in reasons])


def nonrenderable_links(manifest: DataFrame) -> DataFrame:
    """(model_name, links): links without visuals."""
    links = manifest.select(F.col("model").alias("model_name"), F.explode("links").alias("l")).where(F.coalesce(F.size("l.visuals"), F.lit(0)) <= 0)
    return links.groupBy("model_name").agg(F.array_sort(F.collect_list("l.link")).alias("links"))


def model_summary(manifest: DataFrame) -> DataFrame:
    """(model_name, n_links, n_renderable_links, n_visuals, non_renderable_links): links by name; a model without links
    is in no row."""
    n = F.greatest(F.coalesce(F.size("l.visuals"), F.lit(0)), F.lit(0))
    links = manifest.select(F.col("model").alias("model_name"), F.explode("links").alias("l")).select("model_name", "l.link", n.alias("n"))
    bare = F.array_sort(F.collect_list(F.when(F.col("n") == 0, F.col("link"))))
    return links.groupBy("model_name").agg(F.count(F.lit(1)).alias("n_links"), F.count_if(F.col("n") > 0).alias("n_renderable_links"), F.sum("n").alias("n_visuals"), bare.alias("non_renderable_links"))


def validation_issues(manifest: DataFrame, name: str, model_index: DataFrame | None = None) -> DataFrame:
    """(severity, manifest, location, message) of everything that is wrong in a manifest. model_index: the model
    names that `model://` uris may have."""
    bad_pose = lambda c: F.col(c).isNotNull() & numeric_list(F.col(c), 6).isNull()
    missing = lambda c: ("error", F.col(c).isNull(), f"Missing required field '{c}'")
    entry = F.concat(F.lit("entries["), F.coalesce("model", F.lit("?")), F.lit("]"))
    # a row for each visual, and one for a link without visuals and a model without links; numbers are read once for each
    models = manifest.select("model", "model_pose", "static", F.col("links").isNull().alias("no_links"), bad_pose("model_pose").alias("bad_model_pose"), F.posexplode_outer("links").alias("link_at", "l"))
    links = models.select("*", "l.link", "l.link_pose", F.size("l.visuals").alias("n_visuals"), bad_pose("l.link_pose").alias("bad_link_pose"), F.posexplode_outer("l.visuals").alias("visual_at", "v"))
    first = lambda c: F.coalesce(F.col(c), F.lit(0)) == 0
    of = {"of_model": first("link_at") & first("visual_at"), "of_link": F.col("link_at").isNotNull() & first("visual_at"), "of_visual": F.col("visual_at").isNotNull()}
    visuals = links.select("*", "v.*", *[c.alias(n) for n, c in of.items()])
    visuals = visuals.withColumns({"bad_visual_pose": bad_pose("visual_pose"), "bad_scale": F.col("scale").isNotNull() & numeric_list(F.col("scale"), 3).isNull(), "sized": numeric_list(F.col("size"), 3)})
    kind = F.col("geometry_type")
    of_models = [missing("model"), missing("model_pose"), missing("static"), ("error", F.col("no_links"), "Missing required field 'links'"), ("error", F.col("bad_model_pose"), "model_pose has not six numbers")]
    of_links = [missing("link"), missing("link_pose"), ("error", F.col("n_visuals").isNull(), "Missing required field 'visuals'"), ("error", F.col("bad_link_pose"), "link_pose has not six numbers"), ("info", F.col("n_visuals") == 0, "Link has no visuals")]
    of_visuals = [
        missing("visual_name"), missing("visual_pose"), missing("geometry_type"),
        ("error", F.col("bad_visual_pose"), "visual_pose has not six numbers"),
        ("warning", kind.isNotNull() & ~kind.isin(*GEOMETRIES), F.concat(F.lit("Unsupported geometry_type '"), kind, F.lit("'"))),
        ("error", (kind == "mesh") & F.col("uri").isNull(), "mesh visual has no uri"),
        ("warning", (kind == "mesh") & F.col("uri").isNotNull() & F.col("scale").isNull(), "scale is missing; 1 1 1 is assumed"),
        ("warning", (kind == "mesh") & F.col("bad_scale"), "scale has not three numbers"),
        ("error", (kind == "box") & F.col("size").isNull(), "box visual has no size"),
        ("error", (kind == "box") & F.col("size").isNotNull() & F.col("sized").isNull(), "size has not three numbers"),
        ("error", (kind == "box") & (F.array_min("sized") <= 0), "size values must be positive"),
        ("error", kind.isin("cylinder", "sphere") & ~_positive("radius"), "radius must be positive"),
        ("error", (kind == "cylinder") & ~_positive("length"), "length must be positive"),
    ]
    rules = [(severity, F.col(level) & bad, text) for level, some in zip(of, (of_models, of_links, of_visuals), strict=True) for severity, bad, text in some]
    number = lambda c: F.col(c).cast("string")
    of_link = F.concat(entry, F.lit(".links["), number("link_at"), F.lit("]"))
    of_visual = F.concat(of_link, F.lit(".visuals["), number("visual_at"), F.lit("]"))
    rule = F.col("__rule")
    place = F.when(rule < len(of_models), entry).when(rule < len(of_models) + len(of_links), of_link).otherwise(of_visual)
    twice = manifest.groupBy("model").agg(F.count(F.lit(1)).alias("n"))
    twice = issues(twice, name, entry, [("error", (F.col("n") > 1) & F.col("model").isNotNull(), F.concat(F.lit("Duplicate model '"), F.col("model"), F.lit("'")))])
    parts = [issues(visuals, name, place, rules), twice]
    if model_index is not None:
        named = visuals.where((kind == "mesh") & F.col("uri").startswith("model://")).withColumn("name", F.regexp_extract("uri", "^model://([^/]+)", 1))
        parts.append(issues(named.join(model_index.select("name").distinct(), "name", "left_anti"), name, of_visual, [("error", F.lit(True), F.concat(F.lit("Unknown model in "), F.col("uri")))]))
    return union_issues(*parts)


def static_registry(registry: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Usable static visuals with id, material, world transform (4 by 4) and status; materials to skip are out."""
    text = F.concat_ws(" | ", "model_name", "link_name", "visual_name")
    usable = registry.where(F.coalesce("static", F.lit(False)) & F.col("skip_reason").isNull())
    poses = [pose_affine([F.get(F.col(c), F.lit(k)) for k in range(6)]) for c in ("model_pose", "link_pose", "visual_pose")]
    world = compose(compose(compose(poses[0], poses[1]), poses[2]), scale_affine(point(F.col("scale"))))
    form = F.lower(F.regexp_extract(F.coalesce("uri", F.lit("")), r"\.([A-Za-z0-9]+)$", 1))
    status = F.when(F.col("geometry_type") != "mesh", "ready").when(form.isin(*MESH_FORMATS), "ready").otherwise("unsupported_mesh_extension")
    out = usable.withColumns({"id": F.concat_ws("__", *[slugify(F.col(c)) for c in ("model_name", "link_name", "visual_name")]), "material_class": first_match(text, rules), "to_world": nested(world), "status": status})
    return out.where(F.col("material_class") != SKIP)


def merge_groups(registry: DataFrame) -> DataFrame:
    """Ready entries by material, members by id."""
    return registry.where(F.col("status") == "ready").groupBy("material_class").agg(F.array_sort(F.collect_list("id")).alias("members"), F.count(F.lit(1)).alias("n"))


def provenance(entries: DataFrame) -> DataFrame:
    """What is kept of each member of a merged mesh: its names, state and place, and of its geometry what its type has."""
    kind = F.col("geometry_type")
    of = {"mesh_path": ("mesh",), "size": ("box",), "radius": ("sphere", "cylinder"), "length": ("cylinder",)}
    names = ("id", "model_name", "link_name", "visual_name", "geometry_type", "material_class", "status", "to_world")
    return entries.select(*names, *[F.when(kind.isin(*kinds), F.col(c)).alias(c) for c, kinds in of.items()])


def scoped_paths(df: DataFrame, name: str, parent: str) -> DataFrame:
    """(name, path, level): each model with its scopes joined by `::`, from roots (null parent) down, however deep.
    Every round joins each chain with that of its uppermost scope, so chains double; a chain that is a loop is an error,
    and models below a scope that isn't there are left out."""
    found = df.select(F.col(name).alias("name"), F.col(parent).alias("up"), F.col(name).alias("path"), F.lit(0).alias("level"))
    left = df.count().bit_length() + 1
    while not found.where("up IS NOT NULL").isEmpty():
        if not left:
            raise ValueError("scopes that contain each other")
        above = found.select(F.col("name").alias("above"), F.col("up").alias("next"), F.col("path").alias("lead"), F.col("level").alias("depth"))
        longer = found.join(above, F.col("up") == F.col("above")).select("name", F.col("next").alias("up"), F.concat_ws("::", "lead", "path").alias("path"), (F.col("level") + F.col("depth") + 1).alias("level"))
        found, left = settled(found.where("up IS NULL").unionAll(longer)), left - 1
    return found.drop("up")


def order_kept(values: Column) -> Column:
    """The different elements of an array, each at its first place."""
    return F.array_distinct(values)


def skip_counts(flat: DataFrame) -> DataFrame:
    """(skip_reason, n) of `flattened`, usable rows under null."""
    return flat.groupBy("skip_reason").agg(F.count(F.lit(1)).alias("n"))


def with_forced(rows: DataFrame, column: str, forced: Column) -> DataFrame:
    """`forced` instead of the column where it isn't null; warned: it replaced another value."""
    return rows.withColumns({"warned": F.coalesce(forced != F.col(column), F.lit(False)), column: F.coalesce(forced, F.col(column))})


def split_counts(rows: DataFrame, keys: Sequence[Column | str], skipped: Column) -> DataFrame:
    """Rows of each key, and how many of them are skipped."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(skipped).alias("n_skipped"))


def members_sorted(rows: DataFrame, key: str, order: str, member: str) -> DataFrame:
    """(key, n, members): each key's members in order, as text joined by commas."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(member)))), lambda x: x[member])
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.array_join(listed, ",").alias("members"))


def shallowest(rows: DataFrame, key: str, path: str, ties: str) -> DataFrame:
    """Of each key the row whose path has the fewest folders, ties by path and `ties`."""
    return rows.groupBy(key).agg(F.min(F.struct(F.size(F.split(path, "/")).alias("depth"), F.col(path), F.col(ties))).alias("m")).select(key, f"m.{ties}", f"m.{path}", "m.depth")


def with_group_results(groups: DataFrame, results: DataFrame) -> DataFrame:
    """Each requested group with its merged mesh; a group without a result is an error. results: material_class and
    whatever the merge gave."""
    found = groups.join(results.withColumn("__found", F.lit(True)), "material_class", "left")
    checked = F.when(F.col("__found"), F.col("material_class")).otherwise(F.raise_error(F.concat(F.lit("no merge result for "), F.col("material_class"))).cast("string"))
    return found.withColumn("material_class", checked).drop("__found")


def corrected(entries: DataFrame, paths: Sequence[str]) -> DataFrame:
    """Adds correction, the 4 by 4 transform inside an asset: those named turn by a right angle about x, from their
    own up axis to the world's."""
    turn = nested(pose_affine((0.0, 0.0, 0.0, -1.5707963267948966, 0.0, 0.0)))
    same = nested(pose_affine((0.0, 0.0, 0.0, 0.0, 0.0, 0.0)))
    return entries.withColumn("correction", F.when(F.col("mesh_path").isin(*paths), turn).otherwise(same))


def resolved_paths(rows: DataFrame, column: str, listing: DataFrame, root: str, marker: str) -> DataFrame:
    """Adds resolved: the path as it is, or moved below `root` from its last `marker` folder on, whichever is in the
    listing (path); null where neither is."""
    from fieldloom.functions.strings import rerooted

    known = listing.select("path").distinct()
    out = rows.withColumn("__moved", rerooted(F.col(column), root, marker))
    out = out.join(known.select(F.col("path").alias("__own")), F.col(column) == F.col("__own"), "left")
    out = out.join(known.select(F.col("path").alias("__other")), F.col("__moved") == F.col("__other"), "left")
    return out.withColumn("resolved", F.coalesce("__own", "__other")).drop("__own", "__other", "__moved")


def object_rows(composed: DataFrame, dynamic_models: Sequence[str]) -> DataFrame:
    """A row per object of composed entries: the members of static groups, placed by their transform, and the
    dynamic entries of the given models, placed by the middle of their box. Volumes: of a member its primitive's, of
    a moving object its box's."""
    from fieldloom.functions.geometry import box_centre, box_volume, primitive_volume, translation

    static = composed.where("source = 'static'").select("frame_id", F.explode("static_record.members").alias("m"), F.col("static_record.material_class").alias("material_class"))
    at, size = translation(F.col("m.to_world")), [F.get("m.size", F.lit(k)) for k in range(3)]
    static = static.select(
        "frame_id", F.lit(False).alias("is_dynamic"), "m.model_name", "m.link_name", "m.visual_name", "m.id", "material_class", *[F.get(at, F.lit(k)).alias(f"centroid_{a}") for k, a in enumerate("xyz")],
        primitive_volume(F.col("m.geometry_type"), size, F.col("m.radius"), F.col("m.length")).alias("volume"), F.lit(None).cast("long").alias("vertex_count"), F.lit(None).cast("long").alias("face_count"),
    )
    low, high = ([F.get(c, F.lit(k)) for k in range(3)] for c in ("bounds_min", "bounds_max"))
    moving = composed.where((F.col("source") == "dynamic") & F.col("model_name").isin(*dynamic_models)).select(
        "frame_id", F.lit(True).alias("is_dynamic"), "model_name", "link_name", "visual_name", "id", F.col("material_label").alias("material_class"), *[c.alias(f"centroid_{a}") for c, a in zip(box_centre(low, high), "xyz", strict=True)],
        box_volume(low, high).alias("volume"), F.col("mesh_vertex_count").alias("vertex_count"), F.col("mesh_face_count").alias("face_count"),
    )
    return static.unionByName(moving)


def resolved_uris(registry: DataFrame, listing: DataFrame, models: str) -> DataFrame:
    """Adds resolved_path to visuals: of `model://name/rest` the file below the shallowest folder `name` under
    `models`, of `file://` and plain paths themselves, if the listing (path) has them; and n_folders, how many
    folders the name could mean."""
    folder = F.regexp_extract("path", f"^(.*/{models}(?:/.*)?/([^/]+))/model\\.(?:sdf|config)$", 1)
    index = listing.select(folder.alias("folder"), F.regexp_extract("path", "([^/]+)/model\\.(?:sdf|config)$", 1).alias("name")).where("folder <> ''").distinct()
    best = index.groupBy("name").agg(F.min_by("folder", F.struct(F.size(F.split("folder", "/")), "folder")).alias("folder"), F.count(F.lit(1)).alias("n_folders"))
    out = registry.withColumn("__name", F.regexp_extract(F.coalesce("uri", F.lit("")), "^model://([^/]+)", 1)).join(best.withColumnRenamed("name", "__name"), "__name", "left")
    plain = F.when(F.col("uri").startswith("file://"), F.substr("uri", F.lit(8))).when(~F.contains("uri", F.lit("://")), F.col("uri"))
    wanted = F.when(F.col("__name") != "", F.concat("folder", F.regexp_replace("uri", "^model://[^/]+", ""))).otherwise(plain)
    known = listing.select(F.col("path").alias("resolved_path")).distinct()
    out = out.withColumn("__wanted", wanted).join(known, F.col("__wanted") == F.col("resolved_path"), "left")
    return out.drop("__name", "__wanted", "folder")
