"""Fit plans of flat images and draw plans of layered designs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import expressions as E
from . import layout
from .layout import calculate_layout, few, validate_targets


def fit_plan(pairs: DataFrame) -> DataFrame:
    """Fit of each (src_w, src_h, target_w, target_h, mode); no shuffle."""
    return E.extend(pairs, E.FIT)


def background_plan(placements: DataFrame) -> DataFrame:
    """How the canvas of each design and target is filled by the first background, if any.

    Placements that carry the first background (as ``calculate_layout`` makes them) need no
    grouping: the first row of each design and target tells all.
    """
    if "bg_element_id" in placements.columns and "bg_image" in placements.columns:
        out = placements.where("result_pos = 0").select("design_id", "seq", "target_name", "target_w", "target_h", "bg_k", F.col("bg_element_id").alias("element_id"), "bg_w", "bg_h", "bg_image")
        return E.extend(out, E.BACKGROUND)
    first = F.min(F.when(F.expr(E.IS_BACKGROUND), F.struct("k", "element_id", F.col("width").alias("w"), F.col("height").alias("h"), "has_image")))
    out = placements.groupBy("design_id", "seq", "target_name", "target_w", "target_h").agg(first.alias("b"))
    out = out.select("*", F.col("b.k").alias("bg_k"), F.col("b.element_id").alias("element_id"), F.col("b.w").alias("bg_w"), F.col("b.h").alias("bg_h"), F.col("b.has_image").alias("bg_image")).drop("b")
    return E.extend(out, E.BACKGROUND)


def overlay_plan(placements: DataFrame) -> DataFrame:
    """The overlays drawn over the first background, stretched to the canvas, in list order."""
    return draw_plan(placements).where("kind = 'overlay'")


def overlay_steps(layers: DataFrame, targets: DataFrame) -> DataFrame:
    """As ``overlay_plan``, from layers and targets: content lies above, so it is never numbered."""
    return draw_steps(layers, targets, ("background", "overlay")).where("kind = 'overlay'")


def compose_plan(layers: DataFrame, targets: DataFrame, mode: str = "smart") -> DataFrame:
    """Steps of every design and target: one fitted image for a flat source, else the draw plan.

    Both kinds of steps have the columns of ``draw_plan``, so ``raster.render`` draws them in
    one job.  A flat source's step is of kind cover (cut to the target), contain (as large
    as the target), extend (edges extended to it) or blank.
    """
    layers = with_is_flat(layers)
    t = targets.select("seq", F.col("name").alias("target_name"), F.col("width").alias("target_w"), F.col("height").alias("target_h"))
    one = layers.where("is_flat").select("design_id", "k", "element_id", F.col("canvas_w").alias("src_w"), F.col("canvas_h").alias("src_h"), "opacity")
    fits = fit_plan(one.crossJoin(F.broadcast(t) if few(t) else t).withColumn("mode", F.lit(mode)))  # each design on each target is the result
    box = lambda cover, contain, blank: F.when(F.col("plan") == "blank", blank).when(F.col("plan") == "cover", cover).otherwise(contain).cast("int")
    place = {
        "x": box(-F.col("crop_x"), F.col("off_x"), F.lit(0)), "y": box(-F.col("crop_y"), F.col("off_y"), F.lit(0)),
        "w": box(F.col("cover_w"), F.col("contain_w"), F.col("target_w")), "h": box(F.col("cover_h"), F.col("contain_h"), F.col("target_h")),
    }
    fits = fits.select(
        "design_id", "seq", "target_name", F.lit(0).alias("step"), F.col("plan").alias("kind"), "k", "element_id", *[v.alias(c) for c, v in place.items()], "opacity",
        "target_w", "target_h", *[v.alias(f"image_{c}") for c, v in place.items()],
    )
    return draw_steps(layers.where("NOT is_flat"), targets).unionByName(fits)


def batch_relayout(layers: DataFrame, targets: DataFrame) -> DataFrame:
    """For every design and target name (the latest of a name counts): layers placed, visible and drawn."""
    return last_results(layers, targets).drop("target_w", "target_h")


def last_results(layers: DataFrame, targets: DataFrame) -> DataFrame:
    """``batch_results`` of the latest target of each name; every design has a result on every target, so older ones need not be made."""
    named = targets.groupBy("name").agg(F.max_by(F.struct("seq", "width", "height"), "seq").alias("_latest")).select("name", "_latest.*")
    return batch_results(layers, named)


def batch_results(layers: DataFrame, targets: DataFrame) -> DataFrame:
    """For every design and target: its size, and how many layers are placed, visible and drawn."""
    counts = ("n_placed", "n_visible", "n_drawn")
    key = ["design_id", "seq", "target_name", "target_w", "target_h"]
    if not few(targets):
        marked = with_kind(calculate_layout(layers, targets))
        return marked.groupBy(*key).agg(*[c.cast("int").alias(n) for c, n in zip([F.count("*"), F.count_if("visible"), F.count("kind")], counts)])
    rows = _designs_on(layers, targets)
    sizes = ["size(_layers)", f"size(filter(_layers, e -> {_VISIBLE}))", f"size(filter(_layers, e -> {_DRAWN}))"]
    return rows.select(*key, *[F.expr(c).alias(n) for c, n in zip(sizes, counts)])


def batch_with_rejects(designs: DataFrame, layers: DataFrame, targets: DataFrame, observed: Observation | None = None) -> DataFrame:
    """The whole batch in one job: results and rejects as rows of one table, told apart by ``status``.

    designs (design_id) are all that were asked for, layers what was read of them, targets
    (seq, name, width, height) any sizes.  Status ``result`` has the counts of
    ``batch_relayout``; ``design`` is a design without a layer, ``target`` a size that
    breaks a rule, each with its reason.  ``observed`` gets the number of rows of each
    status as the rows are written; a writer partitions by status, so one pass makes both.
    """
    judged = validate_targets(targets)
    results = batch_relayout(layers, judged.where("reason IS NULL").drop("reason")).withColumns({"status": F.lit("result"), "reason": F.lit(None).cast("string")})
    read = layers.select("design_id").distinct()
    empty = designs.select("design_id").distinct().join(read, "design_id", "left_anti").select("design_id", F.lit("design").alias("status"), F.lit("no layers").alias("reason"))
    bad = judged.where("reason IS NOT NULL").select("seq", F.col("name").alias("target_name"), F.lit("target").alias("status"), "reason")
    out = results.unionByName(empty, allowMissingColumns=True).unionByName(bad, allowMissingColumns=True)
    out = out.select("status", "design_id", "seq", "target_name", "n_placed", "n_visible", "n_drawn", "reason")
    if observed is None:
        return out
    return out.observe(observed, *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("result", "design", "target")])


def write_batch(batch: DataFrame, path: str, batch_id: str) -> None:
    """Write a batch by id and status; writing an id again replaces that batch alone."""
    out = batch.withColumn("batch_id", F.lit(batch_id))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id", "status").parquet(path)


def draw_plan(placements: DataFrame) -> DataFrame:
    """Draw steps of each design and target, one row a step, in drawing order.

    The first background comes first (none or one without an image: a white canvas, and
    no overlay is drawn); then overlays in list order, stretched; then visible content
    with an image and a size, by z_index.  Both windows are within a design and target,
    so placements that lie by design are not dealt anew.  x, y, w, h is the box on the
    canvas; image_x, image_y, image_w, image_h is where the step's whole image lies, which
    differs for a background: it is scaled to fill the canvas and cut.
    """
    order = Window.partitionBy("design_id", "seq").orderBy("z", "k")
    return _boxes(with_kind(placements).where("kind IS NOT NULL").withColumn("step", F.row_number().over(order) - 1))


def draw_steps(layers: DataFrame, targets: DataFrame, kinds: tuple[str, ...] = ("background", "overlay", "content")) -> DataFrame:
    """As ``draw_plan(calculate_layout(layers, targets))``, without a sort of the placements.

    What is drawn over what depends on the layers alone, so each design's layers are put in
    order once, as an array; on each target those that are not drawn are left out, and the
    rest are numbered.  ``kinds`` may leave out kinds that come last.
    """
    if not few(targets):
        return draw_plan(calculate_layout(layers, targets)).where(F.col("kind").isin(*kinds))
    rows = _designs_on(layers, targets, kinds)
    target = ["design_id", "seq", "target_name", "target_w", "target_h", "_rects", "bg_k", "bg_w", "bg_h", "bg_image"]
    steps = rows.select(*target, F.posexplode(F.expr(f"filter(_layers, e -> {_DRAWN})")).alias("step", "e")).select(*target, "step", "e.l.*", F.col("e.zone").alias("zone"))
    return _boxes(layout.place(steps.withColumn("section", F.expr(_SECTION.replace("e.zone", "zone")))))


_SECTION = "CASE WHEN e.zone IS NULL THEN 0 WHEN e.zone = '' THEN 2 ELSE 1 END"


def _of_entry() -> tuple[str, str]:
    """Is an entry e of a design's array visible, and is it drawn: the expressions of ``PLACE`` on the entry's fields."""
    found: dict[str, str] = {"section": f"({_SECTION})", "zw": "try_element_at(_rects, e.zone).zw", "zh": "try_element_at(_rects, e.zone).zh"}
    found |= {c: f"e.l.{c}" for c in ("width", "height", "canvas_w", "canvas_h", "min_scale", "max_scale", "maintain_aspect", "priority")}
    put = lambda text: re.sub(r"\b(" + "|".join(found) + r")\b", lambda m: found[m[0]], text.replace("trunc_int(", "int("))
    for step in E.PLACE[:3]:
        found |= {k: f"({put(v)})" for k, v in step.items()}
    visible = put(E.PLACE[3]["visible_out"])
    return visible, f"e.l.kind IS NOT NULL AND (e.l.kind <> 'content' OR (({visible}) AND {found['new_w']} > 0 AND {found['new_h']} > 0))"


_VISIBLE, _DRAWN = _of_entry()


def _designs_on(layers: DataFrame, targets: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """Every design on every target (broadcast) with _layers, its layers (of some kinds, or all) in drawing order.

    An entry has the layer l and, by the target's template, its zone (null: background,
    empty: none).  Rows multiply behind the grouping, and nothing is sorted after that.
    """
    layers, targets, names = layout.prepared(layers, targets)
    background = F.expr(E.IS_BACKGROUND)
    rows = _with_order(layout.ranked_layers(layers, names), F.when(~background & F.col("has_image"), "content"))
    if kinds is not None:
        rows = rows.where(F.col("kind").isin(*kinds))
    rows = rows.withColumn("_zones", F.expr("transform(_ranks, r -> CASE r.section WHEN 1 THEN r.zone WHEN 2 THEN '' END)"))
    inner = [c for c in ("kind", "element_id", "opacity", "x", "y", "width", "height", "canvas_w", "canvas_h", "priority", "min_scale", "max_scale", "maintain_aspect", "_zones") if c in rows.columns]
    first = [F.first(c).alias(c) for c in ("bg_k", "bg_w", "bg_h", "bg_image")]  # the same in all rows of a design
    rows = rows.groupBy("design_id").agg(F.array_sort(F.collect_list(F.struct("z", "k", *inner))).alias("_layers"), *first)
    t = layout.with_rects(targets).withColumn("_t", F.array_position(F.array(*map(F.lit, names)), F.col("template")).cast("int") - 1)
    return rows.crossJoin(F.broadcast(t)).withColumn("_layers", F.expr("transform(_layers, l -> named_struct('l', l, 'zone', get(l._zones, _t)))"))  # every design on every target is the result


def _boxes(drawn: DataFrame) -> DataFrame:
    """Steps with their boxes, and where their whole images lie."""
    whole = F.col("kind") != "content"
    box = {"x": F.lit(0), "y": F.lit(0), "w": F.col("target_w"), "h": F.col("target_h")}
    drawn = E.extend(drawn, E.BACKGROUND)
    boxes = {c: F.when(whole, v).otherwise(F.col(f"new_{c}")) for c, v in box.items()}
    own = {"x": -F.col("crop_x"), "y": -F.col("crop_y"), "w": F.col("scaled_w"), "h": F.col("scaled_h")}
    images = [F.when(F.col("kind") == "background", v).otherwise(boxes[c]).cast("int").alias(f"image_{c}") for c, v in own.items()]
    return drawn.select("design_id", "seq", "target_name", "step", "kind", "k", "element_id", *[v.alias(c) for c, v in boxes.items()], "opacity", "target_w", "target_h", *images)


def with_kind(placements: DataFrame) -> DataFrame:
    """Placements with what is drawn of each: kind (null: nothing), drawing order z, and the first background (bg_k, bg_w, bg_h, bg_image)."""
    background = F.expr(E.IS_BACKGROUND)
    if not {"bg_k", "bg_image"} <= set(placements.columns):
        first = F.min(F.when(background, F.struct("k", F.col("width").alias("w"), F.col("height").alias("h"), F.col("has_image").alias("image")))).over(Window.partitionBy("design_id", "seq"))
        placements = placements.withColumn("_first", first).withColumns({f"bg_{c}": F.col(f"_first.{c}") for c in ("k", "w", "h", "image")}).drop("_first")
    return _with_order(placements, F.when(~background & F.col("visible") & F.col("has_image") & (F.col("new_w") > 0) & (F.col("new_h") > 0), "content"))


def _with_order(rows: DataFrame, content: Column) -> DataFrame:
    """kind and drawing order z of rows with the first background; ``content``: that kind, where it applies."""
    background = F.expr(E.IS_BACKGROUND)
    kind = content.when(background & F.col("bg_image") & (F.col("k") == F.col("bg_k")), "background").when(background & F.col("bg_image") & F.col("has_image") & (F.col("role") == "overlay"), "overlay")
    z = F.when(F.col("kind") == "background", -2).when(F.col("kind") == "overlay", -1).otherwise(F.col("z_index"))
    return rows.withColumn("kind", kind).withColumn("z", z)


def first_background(layers: DataFrame) -> DataFrame:
    """The first layer of each design that can be its background."""
    return layers.where(E.IS_BACKGROUND).groupBy("design_id").agg(F.min(F.struct("k", "element_id")).alias("b")).select("design_id", "b.k", "b.element_id")


def draw_order(layers: DataFrame) -> DataFrame:
    """Content of each design in drawing order: z_index, then list order."""
    order = Window.partitionBy("design_id").orderBy("z_index", "k")
    return layers.where(f"NOT {E.IS_BACKGROUND}").select("design_id", (F.row_number().over(order) - 1).alias("place"), "z_index", "k", "element_id")


def placed_layers(placements: DataFrame) -> DataFrame:
    """Layers with their visible placements; what was not placed is not drawn.

    A placement carries its layer's own columns, so no layer is looked up by its id.
    """
    return placements.where("visible").select("design_id", "element_id", "z_index", "has_image", "role", "seq", "new_x", "new_y", "new_w", "new_h")


def with_is_flat(layers: DataFrame) -> DataFrame:
    """is_flat: the design has one layer (n), and that is of source_type flat_image."""
    return layers.withColumn("is_flat", F.coalesce(F.expr("n = 1 AND source_type = 'flat_image'"), F.lit(False)))
