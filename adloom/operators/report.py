"""Summaries, rejects and previews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as E


def design_summary(layers: DataFrame) -> DataFrame:
    """Canvas, number of layers and the ordered list of elements of each design."""
    element = F.struct("k", "element_id", "name", "layer_type", "role", "priority", F.struct("x", "y", "width", "height").alias("bbox"), "has_image", F.expr(E.TEXT_PREVIEW).alias("text"))
    return layers.groupBy("design_id", "canvas_w", "canvas_h").agg(F.count("*").alias("n_layers"), F.sort_array(F.collect_list(element)).alias("elements"))


def preview_annotations(layers: DataFrame) -> DataFrame:
    """Box, colour and label of every layer that is no background."""
    return E.extend(layers.where("role <> 'background'"), E.GEOMETRY + E.ANNOTATE)


def preview_base(layers: DataFrame) -> DataFrame:
    """The first background with an image, or none (a grey canvas), for each design."""
    fits = (F.col("role") == "background") & F.col("has_image")
    first = F.min(F.when(fits, F.struct("k", "element_id", "width", "height")))
    out = layers.groupBy("design_id", "canvas_w", "canvas_h").agg(first.alias("b"))
    resized = F.col("b").isNotNull() & ((F.col("b.width") != F.col("canvas_w")) | (F.col("b.height") != F.col("canvas_h")))
    return out.select("design_id", "canvas_w", "canvas_h", F.col("b.element_id").alias("element_id"), resized.alias("resized"), F.when(F.col("b").isNull(), 240).alias("grey"))


def last_result_per_name(results: DataFrame) -> DataFrame:
    """The latest row of each design and target name, by seq, with all its columns."""
    key = ["design_id", "target_name"]
    rest = [c for c in results.columns if c not in key]
    latest = F.max_by(F.struct(*rest), F.struct("seq", *[c for c in rest if c != "seq"])).alias("_latest")
    return results.groupBy(*key).agg(latest).select(*key, "_latest.*")


def rejected_targets(targets: DataFrame) -> DataFrame:
    """Targets with the rule they break."""
    return targets.withColumn("reason", F.expr(E.TARGET_REASON)).where("reason IS NOT NULL")


def batch_counts(layers: DataFrame) -> DataFrame:
    """Layers and layers with an image of each design."""
    return layers.groupBy("design_id").agg(F.count("*").alias("n_layers"), F.count_if("has_image").alias("n_images"))


def warnings(placements: DataFrame) -> DataFrame:
    """For each design and target the visible layers that can't be drawn, in list order."""
    p = placements.where("section > 0 AND visible AND (NOT has_image OR new_w <= 0 OR new_h <= 0)")
    texts = p.groupBy("design_id", "target_name").agg(F.sort_array(F.collect_list(F.struct("k", F.concat(F.lit("not drawn: "), F.col("name")).alias("w")))).alias("w"))
    return texts.select("design_id", "target_name", F.array_join(F.transform("w", lambda s: s["w"]), "; ").alias("warnings"))
