"""Reading designs: files, flat images, layer trees, and their normal form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut

#: Columns of a layered design's rows.
LAYERS = (
    "design_id long, ordinal int, canvas_w int, canvas_h int, name string, layer_type string, x int, y int, width int, height int, "
    "visible boolean, opacity_u8 int, text_content string, has_image boolean, parent_ordinal int"
)
MIN_SIDE = 10
EXTENSIONS = ("psd", "png", "jpg", "jpeg", "webp")


def judge_files(files: DataFrame, path: str = "path") -> DataFrame:
    """extension, source_type and reason (null: accepted) of each path."""
    ext = F.lower(F.regexp_extract(F.col(path), r"\.([^./]+)$", 1))
    ext = F.coalesce(ext, F.lit(""))
    reason = F.when(F.col(path).isNull(), "no path").when(ext == "", "no extension").when(~ext.isin(*EXTENSIONS), "unsupported extension")
    kind = F.when(ext == "psd", "layered").when(ext.isin(*EXTENSIONS[1:]), "flat_image")
    return files.withColumns({"extension": ext, "source_type": kind, "reason": reason})


def scan_design_files(spark: SparkSession, path: str) -> DataFrame:
    """Files under a path, judged; contents are not read."""
    return judge_files(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).drop("content"))


def scan_flat_images(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """One layer for each readable image, and the accepted files that can't be read."""
    accepted = scan_design_files(spark, path).where("reason IS NULL AND source_type = 'flat_image'").select("path")
    image = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(path).select("image.origin", "image.width", "image.height", "image.nChannels")
    image = image.withColumn("path", F.regexp_replace("origin", "^file:/+", "file:/"))
    layers = image.select(
        "path",
        F.lit(0).alias("ordinal"),
        F.col("width").alias("canvas_w"),
        F.col("height").alias("canvas_h"),
        F.lit("source_image_0").alias("element_id"),
        F.lit("Source Image").alias("name"),
        F.lit("pixel").alias("layer_type"),
        F.lit(0).alias("x"),
        F.lit(0).alias("y"),
        "width",
        "height",
        F.lit(9).alias("priority"),
        F.lit(0).alias("z_index"),
        F.lit("flat_image").alias("source_type"),
        (F.col("nChannels") == 4).alias("has_alpha"),
    )
    files = accepted.withColumn("path", F.regexp_replace("path", "^file:/+", "file:/"))
    return layers, files.join(layers, "path", "left_anti").withColumn("reason", F.lit("unreadable"))


def read_layers(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """Layer rows of stored designs, in a columnar or text format that Spark reads; missing columns are null."""
    return spark.read.schema(LAYERS).format(format).load(path)


def layers_of_documents(documents: DataFrame) -> DataFrame:
    """Layer rows of one-row-a-design documents (design_id, canvas_w, canvas_h, layers); the list's order is the ordinal."""
    return documents.select("design_id", "canvas_w", "canvas_h", F.posexplode("layers").alias("ordinal", "layer")).select("design_id", "ordinal", "canvas_w", "canvas_h", "layer.*")


#: Fields of a layer in a nested document, beside its children.
NODE = "name string, layer_type string, x int, y int, width int, height int, visible boolean, opacity_u8 int, text_content string, has_image boolean"


def layers_of_trees(documents: DataFrame, tree: str = "layers") -> DataFrame:
    """Layer rows of documents whose groups hold their children: (design_id, canvas_w, canvas_h, ``tree``).

    ``tree`` is a list of layers as JSON text or VARIANT; a layer has the fields of NODE and
    may have ``children``, a list again, to any depth.  The tree is opened level by level,
    each layer keeping the path of places that leads to it.  Ordinals are places in the
    walk that visits a group before its children and those before the next layer, which is
    the order of the paths; parent_ordinal is the group's.  Fields that are absent, or are
    of another type, are null; a document that is no list has no rows.
    """
    node = F.col(tree) if documents.schema[tree].dataType.simpleString() == "variant" else F.try_parse_json(tree)
    level = documents.select("design_id", "canvas_w", "canvas_h", F.array().cast("array<int>").alias("_up"), F.try_variant_get(node, "$", "array<variant>").alias("_nodes"))
    levels = []
    while True:
        opened = level.select("design_id", "canvas_w", "canvas_h", "_up", F.posexplode("_nodes").alias("_at", "_node"))
        opened = opened.select("design_id", "canvas_w", "canvas_h", F.array_append("_up", F.col("_at")).alias("_path"), "_node")
        opened = cut(opened)  # each level is opened once, however deep the tree
        if opened.isEmpty():
            break
        levels.append(opened)
        level = opened.select("design_id", "canvas_w", "canvas_h", F.col("_path").alias("_up"), F.try_variant_get("_node", "$.children", "array<variant>").alias("_nodes")).where("size(_nodes) > 0")
    rows = opened
    for part in levels:
        rows = rows.unionByName(part)
    names = [f.strip().split(" ") for f in NODE.split(",")]
    flat = rows.select("design_id", "canvas_w", "canvas_h", "_path", *[F.try_variant_get("_node", f"$.{n}", kind).alias(n) for n, kind in names])
    flat = flat.withColumn("ordinal", F.row_number().over(Window.partitionBy("design_id").orderBy("_path")) - 1)
    parents = flat.select("design_id", F.col("_path").alias("_above"), F.col("ordinal").alias("parent_ordinal"))
    own = flat.withColumn("_above", F.slice("_path", 1, F.size("_path") - 1))
    return own.join(parents, ["design_id", "_above"], "left").select("design_id", "ordinal", "canvas_w", "canvas_h", *[n for n, _ in names], "parent_ordinal")


def unusable_layers(layers: DataFrame) -> DataFrame:
    """Layers under MIN_SIDE pixels wide or high."""
    return layers.where(f"width < {MIN_SIDE} OR height < {MIN_SIDE}")


def flatten_layer_tree(layers: DataFrame, z_order: str = "list") -> DataFrame:
    """Layers that are drawn, in document order, with element_id, kept ordinal k, count n and z_index.

    z_index is n - k (``list``: the first layer is drawn last) or k (``document``: layers are
    drawn as they are listed).

    Invisible layers, and those under 10 pixels wide or high, go with all that is below
    them; children stay only under groups that stay.  One pass over the array of each design
    that has children.
    """
    usable = F.coalesce("visible", F.lit(True)) & (F.col("width") >= MIN_SIDE) & (F.col("height") >= MIN_SIDE)
    names = [c for c in layers.columns if c not in ("design_id", "ordinal")]
    tree = layers.where(usable).groupBy("design_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", *names))).alias("tree"))
    none = F.expr("cast(array() as array<int>)")

    def step(acc, t):
        stays = t["parent_ordinal"].isNull() | F.array_contains(acc["groups"], t["parent_ordinal"])
        grown = lambda name, when: F.when(when, F.array_append(acc[name], t["ordinal"])).otherwise(acc[name])
        return F.struct(grown("groups", stays & (t["layer_type"] == "group")).alias("groups"), grown("kept", stays).alias("kept"))

    kept = F.aggregate("tree", F.struct(none.alias("groups"), none.alias("kept")), step)["kept"]
    tree = tree.withColumn("kept", F.when(F.exists("tree", lambda t: t["parent_ordinal"].isNotNull()), kept))
    tree = tree.withColumn("tree", F.when(F.col("kept").isNull(), F.col("tree")).otherwise(F.filter("tree", lambda t: F.array_contains(F.col("kept"), t["ordinal"]))))
    flat = tree.select("design_id", F.size("tree").alias("n"), F.posexplode("tree").alias("k", "t")).select("design_id", "n", "k", "t.*")
    return flat.withColumns({"element_id": element_id(), "z_index": {"list": F.col("n") - F.col("k"), "document": F.col("k")}[z_order]})


def flatten_large_trees(layers: DataFrame, z_order: str = "list") -> DataFrame:
    """As ``flatten_layer_tree``, for designs of any size and depth: no array holds a design.

    Each nested layer points at its parent, and pointers are doubled: a round joins a layer
    with what it points at, so a chain of d groups takes log2(d) rounds, whose joins are
    spread by design and layer.  A layer stays if all on its way up are groups that stay;
    one that points at no layer, or that is its own ancestor, goes.
    """
    usable = F.coalesce("visible", F.lit(True)) & (F.col("width") >= MIN_SIDE) & (F.col("height") >= MIN_SIDE)
    ok = cut(layers.where(usable).select("design_id", "ordinal", F.col("parent_ordinal").alias("up"), (F.col("layer_type") == "group").alias("_group")))
    kept = [ok.where("up IS NULL").select("design_id", "ordinal")]
    groups = ok.where("_group").select("design_id", F.col("ordinal").alias("up"), F.col("up").alias("_next"))
    open_rows = cut(ok.where("up IS NOT NULL").select("design_id", "ordinal", "up"))
    for _ in range(open_rows.count().bit_length() + 1):  # longer than any chain: what is open then is its own ancestor
        if open_rows.isEmpty():
            break
        moved = cut(open_rows.join(groups, ["design_id", "up"]).select("design_id", "ordinal", F.col("_next").alias("up")))  # no such group: gone
        kept.append(moved.where("up IS NULL").select("design_id", "ordinal"))
        open_rows = moved.where("up IS NOT NULL")
        ahead = groups.withColumnsRenamed({"_next": "_mid"}).join(groups.select("design_id", F.col("up").alias("_mid"), "_next", F.lit(True).alias("_is")), ["design_id", "_mid"], "left")
        # A group whose parent is no group that stays leads nowhere; one without a parent is a root.
        groups = cut(ahead.where("_mid IS NULL OR _is").select("design_id", "up", "_next"))
    stay = kept[0]
    for part in kept[1:]:
        stay = stay.unionByName(part)
    rows = layers.join(stay, ["design_id", "ordinal"], "left_semi")
    in_design = Window.partitionBy("design_id")
    flat = rows.withColumns({"k": F.row_number().over(in_design.orderBy("ordinal")) - 1, "n": F.count("*").over(in_design).cast("int")})
    return flat.withColumns({"element_id": element_id(), "z_index": {"list": F.col("n") - F.col("k"), "document": F.col("k")}[z_order]})


def element_id():
    """Name, underscore, and eight digits of a digest of name and kept ordinal."""
    return F.concat("name", F.lit("_"), F.substring(F.md5(F.concat("name", F.lit("_"), F.col("k").cast("string")).cast("binary")), 1, 8))


def normalise_attributes(layers: DataFrame) -> DataFrame:
    """Opacity as a share, blend mode, first font run and effects with their defaults."""
    have = set(layers.columns)
    out = {"opacity": F.coalesce(F.col("opacity_u8") / F.lit(255.0), F.lit(1.0))}
    out["blend_mode"] = F.coalesce(F.col("blend_mode").cast("string"), F.lit("normal")) if "blend_mode" in have else F.lit("normal")
    if "font_runs" in have:
        run = F.get("font_runs", F.lit(0))
        out["font_info"] = F.struct(
            F.col("text_content").alias("text"),
            F.coalesce(run["font_size"], F.lit(12.0)).alias("font_size"),
            F.coalesce(run["font_name"], F.lit("Unknown")).alias("font_name"),
            F.coalesce(run["color"], F.array(*[F.lit(v) for v in (1.0, 0.0, 0.0, 0.0)])).alias("color"),
        )
    if "effect_list" in have:
        out["effects"] = F.map_from_entries(F.transform("effect_list", lambda e: F.struct(e["name"], F.struct(e["enabled"].alias("enabled"), F.coalesce(e["opacity"], F.lit(100.0)).alias("opacity")))))
    return layers.withColumns(out)


def manifest(plan: DataFrame, path: str | None = None, batch_id: str = "0") -> DataFrame:
    """One PNG name a target and design; written by batch and target when a path is given.

    Writing a target of a batch again replaces that part alone; others stay as they are.
    """
    out = plan.select("design_id", "target_name").distinct().withColumn("file", F.concat(F.replace("target_name", F.lit(" "), F.lit("_")), F.lit(".png")))
    if path:
        stored = out.withColumn("batch_id", F.lit(batch_id))
        stored.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id", "target_name").parquet(path)
    return out
