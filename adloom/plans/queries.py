"""Registered queries of the re-layout engine, on layers derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import catalogs
from ..functions import expressions as E
from ..operators import classify as C
from ..operators import compose, layout, raster, report
from ..sources import design, fixtures
from ..sources.shared import cut


def flat_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers that are drawn, with ids, normal attributes, roles and priorities."""
    return C.classify(design.normalise_attributes(design.flatten_layer_tree(fixtures.layers_raw(spark, sf_dir))))


def valid_targets(spark: SparkSession) -> DataFrame:
    return layout.validate_targets(fixtures.targets(spark)).where("reason IS NULL").drop("reason")


def preset_targets(spark: SparkSession) -> DataFrame:
    return valid_targets(spark).where("seq <= 10")


def designs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.layers_raw(spark, sf_dir).select("design_id", "canvas_w", "canvas_h").distinct()


def placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.calculate_layout(flat_layers(spark, sf_dir), preset_targets(spark))


PLACED = ["design_id", "element_id", "k", "seq", "target_name", "section", "zone", "result_pos", "new_x", "new_y", "new_w", "new_h", "scale_factor", "visible"]


def _fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = designs(spark, sf_dir).select("design_id", F.col("canvas_w").alias("src_w"), F.col("canvas_h").alias("src_h"))
    t = valid_targets(spark).select("seq", F.col("width").alias("target_w"), F.col("height").alias("target_h"))
    mode = F.when(F.col("seq") == 11, "cover").when(F.col("seq") == 12, "contain").otherwise("smart")
    return compose.fit_plan(d.join(F.broadcast(t)).withColumn("mode", mode))  # at most 21 targets


def _ints(df: DataFrame, keep: list[str], ints: list[str], more: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*keep, *[F.col(c).cast("int").alias(c) for c in ints], *more)


def s1_scan_files(spark, sf_dir):
    return design.judge_files(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), "url")


def s2_route_format(spark, sf_dir):
    names = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.concat("p_name", F.lit("."), F.element_at(F.array(*map(F.lit, (*design.EXTENSIONS, "PSD", "gif", "Png"))), (F.col("p_partkey") % 8 + 1).cast("int"))).alias("file"))
    return design.judge_files(names, "file").select("p_partkey", "extension", "source_type", "reason")


def s4_read_layers(spark, sf_dir):
    """Layers of designs that come as one document each."""
    raw = fixtures.layers_raw(spark, sf_dir)
    inner = [c for c in raw.columns if c not in ("design_id", "ordinal", "canvas_w", "canvas_h")]
    listed = F.sort_array(F.collect_list(F.struct("ordinal", F.struct(*inner).alias("layer"))))
    documents = raw.groupBy("design_id", "canvas_w", "canvas_h").agg(F.transform(listed, lambda s: s["layer"]).alias("layers"))
    return design.layers_of_documents(documents).select("design_id", "ordinal", "canvas_w", "canvas_h", *inner)


def s4_nested_trees(spark, sf_dir):
    """Layers of designs that come as nested JSON: each group's text holds its children's."""
    return design.layers_of_trees(fixtures.nested(spark, sf_dir))


def s5_flatten_large(spark, sf_dir):
    return design.flatten_large_trees(fixtures.layers_raw(spark, sf_dir)).select("design_id", "ordinal", "k", "n", "element_id", "z_index")


def s5_flatten_tree(spark, sf_dir):
    return design.flatten_layer_tree(fixtures.layers_raw(spark, sf_dir)).select("design_id", "ordinal", "k", "n", "name", "layer_type", "x", "y", "width", "height")


def s6_unusable(spark, sf_dir):
    return design.unusable_layers(fixtures.layers_raw(spark, sf_dir)).select("design_id", "ordinal", "width", "height")


def s7_element_ids(spark, sf_dir):
    return design.flatten_layer_tree(fixtures.layers_raw(spark, sf_dir)).select("design_id", "k", "element_id")


def s8_z_index(spark, sf_dir):
    return design.flatten_layer_tree(fixtures.layers_raw(spark, sf_dir)).select("design_id", "ordinal", "z_index")


def s8_z_index_document(spark, sf_dir):
    return design.flatten_layer_tree(fixtures.layers_raw(spark, sf_dir), z_order="document").select("design_id", "ordinal", "z_index")


def s9_attributes(spark, sf_dir):
    return design.normalise_attributes(fixtures.layers_raw(spark, sf_dir)).select("design_id", "ordinal", F.round("opacity", 6).alias("opacity"), "blend_mode")


def s10_manifest(spark, sf_dir):
    return design.manifest(placements(spark, sf_dir).select("design_id", "target_name"))


def s11_rejects(spark, sf_dir):
    raw = fixtures.layers_raw(spark, sf_dir)
    empty = raw.select("design_id").distinct().join(design.flatten_layer_tree(raw).select("design_id").distinct(), "design_id", "left_anti")
    bad = report.rejected_targets(fixtures.targets(spark))
    return empty.select(F.lit("design").alias("stage"), F.col("design_id").cast("string").alias("key"), F.lit("no layers").alias("reason")).unionByName(bad.select(F.lit("target").alias("stage"), F.col("name").alias("key"), "reason"))


def p1_geometry(spark, sf_dir):
    return E.extend(fixtures.layers_raw(spark, sf_dir), E.GEOMETRY).select("design_id", "ordinal", "x2", "y2", "center_x", "center_y", "area")


def p2_scale(spark, sf_dir):
    """Boxes at 0.7 of their size, and at a factor of their own."""
    raw = fixtures.layers_raw(spark, sf_dir)
    own = layout.bbox_scale(raw.withColumn("factor", (F.col("ordinal") % 4 + 1) * F.lit(0.35)), "factor")
    fixed = layout.bbox_scale(raw, 0.7)
    names = ["design_id", "ordinal", "sx", "sy", "swidth", "sheight"]
    return fixed.select(F.lit("fixed").alias("factor"), *names).unionByName(own.select(F.lit("own").alias("factor"), *names))


def p3_validate_targets(spark, sf_dir):
    sizes = fixtures.targets(spark).select("seq", F.col("width").cast("string").alias("width"), F.col("height").cast("string").alias("height"))
    more = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("int").alias("seq"), F.when(F.col("p_partkey") % 7 == 0, F.col("p_name")).otherwise((F.col("p_partkey") * 37 % 6000).cast("string")).alias("width"), (F.col("p_partkey") * 11 % 5000 - 20).cast("string").alias("height"))
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select((-F.col("p_partkey")).cast("int").alias("seq"), F.concat((F.col("p_partkey") % 13).cast("string"), F.lit(".5")).alias("width"), F.concat((4090 + F.col("p_partkey") % 9).cast("string"), F.lit(".9")).alias("height"))
    judged = sizes.unionByName(more).unionByName(parts).withColumns({c: F.expr(f"try_cast({c} AS DOUBLE)") for c in ("width", "height")})
    return layout.validate_targets(judged).select("seq", F.expr("int(width)").alias("width"), F.expr("int(height)").alias("height"), "reason")


def p4_is_background(spark, sf_dir):
    return flat_layers(spark, sf_dir).select("design_id", "k", F.expr(E.IS_BACKGROUND).alias("is_background"))


def p5_name_role(spark, sf_dir):
    return fixtures.layers_raw(spark, sf_dir).select("design_id", "ordinal", F.expr(E.NAME_ROLE).alias("name_role"))


def p5_user_patterns(spark, sf_dir):
    """Parts named by patterns that a user supplies, cut out of names of parts."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    roles = F.array(*[F.lit(r) for r in catalogs.ROLE_PRIORITY])
    cut_out = F.expr("lower(substring(p_name, CAST(1 + p_partkey % 7 AS INT), CAST(2 + p_partkey % 11 AS INT)))")
    patterns = part.select(F.expr("(p_partkey * 7919) % 100003").alias("rank"), F.element_at(roles, (F.col("p_partkey") % 17 + 1).cast("int")).alias("role"), cut_out.alias("pattern"))
    named = part.select("p_partkey", F.concat(F.col("p_name"), F.lit(" "), (F.col("p_partkey") % 100).cast("string")).alias("name"))
    return C.classify_by_patterns(named, patterns.where("length(pattern) > 5 OR rank % 50 = 0")).select("p_partkey", "pattern_role")


def p6_priority_suffix(spark, sf_dir):
    return fixtures.layers_raw(spark, sf_dir).select("design_id", "ordinal", F.expr(E.SUFFIX).alias("suffix"))


def p7_group_first(spark, sf_dir):
    """Groups keep their role and take no suffix, whatever their names."""
    groups = C.classify(fixtures.layers_raw(spark, sf_dir)).where("layer_type = 'group'")
    return groups.select("design_id", "ordinal", "role", "priority", "suffix")


def p8_geometry_role(spark, sf_dir):
    return E.extend(fixtures.layers_raw(spark, sf_dir), E.CLASSIFY[:1]).select("design_id", "ordinal", F.expr(E.GEOMETRY_ROLE).alias("geometry_role"))


def p9_embedding_role(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    prompts = e.where("vec_id < 15").select(F.col("vec_id").cast("int").alias("prompt"), "embedding")
    return C.classify_by_embedding(e, prompts).select("vec_id", "role", F.round("prob", 4).alias("prob"))


def _many_prompts(spark, sf_dir):
    """Up to 1,000 prompts, a catalogue: vectors read backwards, with roles in turn."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id < 1000")
    roles = F.array(*[F.lit(r) for r in catalogs.PROMPT_ROLES])
    return e.select(F.col("vec_id").alias("prompt"), F.element_at(roles, (F.col("vec_id") % 15 + 1).cast("int")).alias("role"), F.reverse("embedding").alias("embedding"))


def p9_many_prompts(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return C.classify_by_embedding(e, _many_prompts(spark, sf_dir), scale=10.0, threshold=0.02, block=150).select("vec_id", "role", F.round("prob", 4).alias("prob"))


def w4_many_prompts(spark, sf_dir):
    """The greatest, least and total probability of each prompt among its layers."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    probs = C.prompt_probabilities(e, _many_prompts(spark, sf_dir), scale=10.0, block=150)
    return probs.groupBy("prompt").agg(F.count("*").alias("n"), F.round(F.max("prob"), 4).alias("most"), F.round(F.sum("prob"), 3).alias("total"))


def p10_classify(spark, sf_dir):
    return flat_layers(spark, sf_dir).select("design_id", "ordinal", "role", "priority")


def p10_classify_with_embedding(spark, sf_dir):
    """The cascade with vectors of some layers (vec_id = design_id * 8 + ordinal)."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    prompts = e.where("vec_id < 15").select(F.col("vec_id").cast("int").alias("prompt"), "embedding")
    vectors = e.select(F.expr("vec_id div 8").alias("design_id"), F.expr("CAST(vec_id % 8 AS INT)").alias("ordinal"), "embedding")
    layers = design.flatten_layer_tree(fixtures.layers_raw(spark, sf_dir))
    return C.classify_with_embedding(layers, vectors, prompts).select("design_id", "ordinal", "role", "priority", "embedding_role")


def p11_cap_priority(spark, sf_dir):
    layers = flat_layers(spark, sf_dir)
    return layers.select("design_id", "ordinal", F.coalesce("suffix", F.lit(5)).alias("own_priority"), F.expr(E.ROLE_CAP).alias("cap"), "priority")


def p12_text_preview(spark, sf_dir):
    return fixtures.layers_raw(spark, sf_dir).select("design_id", "ordinal", F.expr(E.TEXT_PREVIEW).alias("preview"))


def p13_annotations(spark, sf_dir):
    return report.preview_annotations(flat_layers(spark, sf_dir)).select("design_id", "k", "x", "y", "x2", "y2", "r", "g", "b", "outline", "label", "label_x", "label_y")


def p14_preview_base(spark, sf_dir):
    return report.preview_base(flat_layers(spark, sf_dir))


def j1_overrides(spark, sf_dir):
    done, _ = C.apply_overrides(flat_layers(spark, sf_dir), fixtures.corrections(spark, sf_dir))
    return done.select("design_id", "ordinal", "role", "priority")


def j1_rejected_overrides(spark, sf_dir):
    return C.apply_overrides(flat_layers(spark, sf_dir), fixtures.corrections(spark, sf_dir))[1].select("design_id", "ordinal", "seq", "new_role", "reason")


def j2_priority_overrides(spark, sf_dir):
    """Layers whose priority a correction changes, with both values."""
    before = flat_layers(spark, sf_dir).withColumn("old_priority", F.col("priority"))
    after, _ = C.apply_overrides(before, fixtures.corrections(spark, sf_dir))
    return after.where("priority <> old_priority").select("design_id", "ordinal", "old_priority", "priority")


def j3_resolve_targets(spark, sf_dir):
    p = catalogs.presets(spark)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    picks = orders.select("o_orderkey", (F.col("o_orderkey") % 12 + 1).cast("int").alias("seq")).join(F.broadcast(p.select("seq", "label")), "seq", "left").select(F.coalesce("label", F.lit("No Such Size (1x1)")).alias("label"))
    custom = orders.select(F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("Own "), F.col("o_orderkey").cast("string"))).alias("name"), (F.col("o_orderkey") % 3000 - 100).cast("double").alias("width"), ((F.col("o_orderkey") % 41) / F.lit(2.0)).alias("height"))
    return layout.resolve_targets(p, picks, custom).groupBy("name", "width", "height").agg(F.count("*").alias("n"))


def j4_pairs(spark, sf_dir):
    return layout.pairs(designs(spark, sf_dir), valid_targets(spark)).select("design_id", "seq", "name", "width", "height")


def j5_select_template(spark, sf_dir):
    sizes = designs(spark, sf_dir).select(F.col("design_id").alias("seq"), (F.col("canvas_w") + F.col("design_id") % 977).cast("int").alias("width"), (F.col("canvas_h") + F.col("design_id") % 613).cast("int").alias("height"))
    return layout.with_template(sizes).select("seq", "width", "height", "template")


def j6_candidate_zones(spark, sf_dir):
    ranked = layout.ranked_by_template(flat_layers(spark, sf_dir), list(catalogs.TEMPLATES))
    return ranked.where("zone IS NOT NULL").select("design_id", "k", "template", "zone")


def w1_assign_zones(spark, sf_dir):
    ranked = layout.ranked_by_template(flat_layers(spark, sf_dir), list(catalogs.TEMPLATES))
    return ranked.where("section = 1").select("design_id", "template", "zone", "rank", "k")


def w2_assign_general(spark, sf_dir):
    zones = catalogs.zones(spark).where("template = 'square'").select("zone_no", "zone", "roles")
    both = zones.withColumn("roles", F.concat("roles", F.array(F.lit("photo"), F.lit("cta"))))
    return layout.assign_zones_general(flat_layers(spark, sf_dir).where(f"NOT {E.IS_BACKGROUND}"), both)


def user_templates(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Templates whose zones share roles: those of the catalogue, each zone taking photo and cta too, in reverse order for wide ones."""
    roles = F.array_union(F.col("roles"), F.array(F.lit("photo"), F.lit("cta")))
    order = F.when(F.col("template").startswith("landscape"), 10 - F.col("zone_no")).otherwise(F.col("zone_no"))
    return catalogs.templates(spark), catalogs.zones(spark).withColumns({"roles": roles, "zone_no": order.cast("int")})


def w2_layout_user_templates(spark, sf_dir):
    """Placements by templates of a user, whose zones share roles."""
    placed = layout.calculate_layout(flat_layers(spark, sf_dir), preset_targets(spark), *user_templates(spark))
    return placed.select(*PLACED)


def w2_shared_roles(spark, sf_dir):
    """Roles that several zones take, with the layers that have them."""
    shared = layout.shared_roles(user_templates(spark)[1])
    n = flat_layers(spark, sf_dir).groupBy("role").agg(F.count("*").alias("n_layers"))
    return shared.join(n, "role").select("template", "role", F.array_join("zones", ",").alias("zones"), "n_layers")


def l3_place_options(spark, sf_dir):
    """Layers with bounds of their own, every third free to change its aspect."""
    layers = flat_layers(spark, sf_dir).withColumns({"min_scale": (F.col("ordinal") % 4) * 0.2, "max_scale": F.lit(0.4) + (F.col("design_id") % 3) * 0.5, "maintain_aspect": F.col("ordinal") % 3 != 0})
    return layout.calculate_layout(layers, preset_targets(spark)).where("section = 1").select(*PLACED)


def l5_many_targets(spark, sf_dir):
    """Placements on a size for each nation, joined as if they were too many to broadcast, summed up by target."""
    sizes = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("int").alias("seq"), F.col("n_name").alias("name"), F.expr("CAST(100 + n_nationkey * 137 % 1900 AS INT)").alias("width"), F.expr("CAST(100 + n_nationkey * 211 % 900 AS INT)").alias("height"))
    placed = layout.calculate_layout(flat_layers(spark, sf_dir), sizes, most_broadcast=10)
    sums = [F.sum(F.col(c).cast("long")).alias(c) for c in ("new_x", "new_y", "new_w", "new_h")]
    return placed.groupBy("seq", "template", "section", "zone").agg(F.count("*").alias("n"), *sums)


def j7_placement_lookup(spark, sf_dir):
    return compose.placed_layers(placements(spark, sf_dir))


def j8_unassigned(spark, sf_dir):
    ranked = layout.ranked_by_template(flat_layers(spark, sf_dir), list(catalogs.TEMPLATES))
    return ranked.where("section = 2").select("design_id", "template", "k", "result_pos")


def l2_zone_rects(spark, sf_dir):
    sizes = designs(spark, sf_dir).select(F.col("design_id").alias("seq"), (F.col("canvas_w") + F.col("design_id") % 977).cast("int").alias("width"), (F.col("canvas_h") + F.col("design_id") % 613).cast("int").alias("height"))
    return layout.zone_rects(layout.with_template(sizes))


def l1_place_background(spark, sf_dir):
    return placements(spark, sf_dir).where("section = 0").select(*PLACED)


def l3_place_in_zone(spark, sf_dir):
    return placements(spark, sf_dir).where("section = 1").select(*PLACED)


def l4_place_fallback(spark, sf_dir):
    return placements(spark, sf_dir).where("section = 2").select(*PLACED)


def l5_layout(spark, sf_dir):
    return placements(spark, sf_dir).select(*PLACED)


def u1_sections(spark, sf_dir):
    """The three branches of the placements, counted by target."""
    return placements(spark, sf_dir).groupBy("seq", "target_name", "section").agg(F.count("*").alias("n"), F.count_if("visible").alias("n_visible"))


def u2_all_targets(spark, sf_dir):
    """Presets and custom sizes together, judged."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    p = catalogs.presets(spark)
    custom = orders.select(F.concat(F.lit("Own "), F.col("o_orderkey").cast("string")).alias("name"), (F.col("o_orderkey") % 4200).cast("double").alias("width"), (F.col("o_custkey") % 29 / F.lit(2.0)).alias("height"))
    return layout.validate_targets(layout.resolve_targets(p, p.select("label"), custom)).select("name", "width", "height", "reason")


def w4_softmax(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    prompts = e.where("vec_id < 15").select(F.col("vec_id").cast("int").alias("prompt"), "embedding")
    return C.prompt_probabilities(e, prompts).select("vec_id", "prompt", F.round("prob", 4).alias("prob"))


def a1_summary(spark, sf_dir):
    s = report.design_summary(flat_layers(spark, sf_dir))
    return s.select("design_id", "canvas_w", "canvas_h", "n_layers", F.posexplode("elements").alias("pos", "e")).select("design_id", "canvas_w", "canvas_h", "n_layers", "pos", "e.element_id", "e.role", "e.priority", "e.bbox.x", "e.has_image", "e.text")


def a2_zone_occupancy(spark, sf_dir):
    return layout.zone_occupancy(layout.ranked_by_template(flat_layers(spark, sf_dir), list(catalogs.TEMPLATES)))


def a3_alpha_share(spark, sf_dir):
    return raster.alpha_share(fixtures.pixels(spark, sf_dir)).select("image_id", F.round("share", 6).alias("share"), "has_transparency")


def a4_last_result(spark, sf_dir):
    return report.last_result_per_name(layout.pairs(designs(spark, sf_dir), valid_targets(spark)).select("design_id", "seq", F.col("name").alias("target_name"))).select("design_id", "target_name", "seq")


def a4_last_result_rows(spark, sf_dir):
    """Whole results by name: of targets that share a name, the size and counts of the latest."""
    return compose.last_results(flat_layers(spark, sf_dir), valid_targets(spark)).select("design_id", "target_name", "seq", "target_w", "target_h", "n_drawn")


def a5_batch_counts(spark, sf_dir):
    return report.batch_counts(flat_layers(spark, sf_dir))


def a6_warnings(spark, sf_dir):
    return report.warnings(placements(spark, sf_dir))


def t1_content_order(spark, sf_dir):
    return layout.content_order(flat_layers(spark, sf_dir))


def t2_first_background(spark, sf_dir):
    return compose.first_background(flat_layers(spark, sf_dir))


def t3_draw_order(spark, sf_dir):
    return compose.draw_order(flat_layers(spark, sf_dir))


def t4_best_prompt(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    prompts = e.where("vec_id < 15").select(F.col("vec_id").cast("int").alias("prompt"), "embedding")
    return C.classify_by_embedding(e, prompts, threshold=0.0).select("vec_id", "role")


def t5_result_order(spark, sf_dir):
    ranked = layout.ranked_by_template(flat_layers(spark, sf_dir), list(catalogs.TEMPLATES))
    return ranked.select("design_id", "template", "result_pos", "section", "k")


def f1_fit_decision(spark, sf_dir):
    return _fit(spark, sf_dir).select("design_id", "seq", "mode", "use_cover")


def f2_cover(spark, sf_dir):
    return _ints(_fit(spark, sf_dir), ["design_id", "seq"], ["cover_w", "cover_h", "crop_x", "crop_y"], ("cover_scale",))


def f3_contain(spark, sf_dir):
    return _ints(_fit(spark, sf_dir), ["design_id", "seq"], ["contain_w", "contain_h", "off_x", "off_y"], ("extends",))


def f5_regions(spark, sf_dir):
    return _ints(_fit(spark, sf_dir), ["design_id", "seq"], ["dst_x1", "dst_y1", "dst_x2", "dst_y2", "src_x1", "src_y1", "src_x2", "src_y2"])


def f6_strips(spark, sf_dir):
    return _ints(_fit(spark, sf_dir), ["design_id", "seq"], ["strip_top", "strip_bottom", "strip_left", "strip_right"], ("corner_tl", "corner_tr", "corner_bl", "corner_br"))


def f7_fit_plan(spark, sf_dir):
    return _fit(spark, sf_dir).select("design_id", "seq", "plan", F.col("generated").cast("long").alias("generated"))


def c1_flat_source(spark, sf_dir):
    layers = flat_layers(spark, sf_dir).withColumn("source_type", F.when(F.col("design_id") % 2 == 0, "flat_image").otherwise("layered"))
    return compose.with_is_flat(layers).select("design_id", "is_flat").distinct()


def c2_background_plan(spark, sf_dir):
    plan = compose.background_plan(placements(spark, sf_dir))
    return _ints(plan, ["design_id", "seq", "mode", "element_id"], ["scaled_w", "scaled_h", "crop_x", "crop_y"], (F.col("filled").cast("long").alias("filled"),))


def c3_overlay_plan(spark, sf_dir):
    return compose.overlay_steps(flat_layers(spark, sf_dir), preset_targets(spark)).select("design_id", "seq", "step", "k", "element_id", "x", "y", "w", "h")


def c4_draw_plan(spark, sf_dir):
    return compose.draw_steps(flat_layers(spark, sf_dir), preset_targets(spark)).select("design_id", "seq", "target_name", "step", "kind", "k", "element_id", "x", "y", "w", "h", F.round("opacity", 6).alias("opacity"))


def c5_compose_plan(spark, sf_dir):
    """Draw plans and, for flat sources (here: lone layers of even designs), fit plans."""
    layers = flat_layers(spark, sf_dir).withColumn("source_type", F.when(F.col("design_id") % 2 == 0, "flat_image").otherwise("layered"))
    plan = compose.compose_plan(layers, preset_targets(spark))
    return plan.select("design_id", "seq", "target_name", "step", "kind", "k", "element_id", "x", "y", "w", "h", F.round("opacity", 6).alias("opacity"))


def b1_batch_relayout(spark, sf_dir):
    return compose.batch_relayout(flat_layers(spark, sf_dir), valid_targets(spark))


def b1_batch_with_rejects(spark, sf_dir):
    """Every design and every size, good or bad: results, empty designs and bad sizes in one table."""
    return compose.batch_with_rejects(designs(spark, sf_dir), flat_layers(spark, sf_dir), fixtures.targets(spark))


def r1_gamma(spark, sf_dir):
    return raster.gamma_encode(raster.gamma_decode(fixtures.pixels(spark, sf_dir)))


def _images(spark, sf_dir):
    return fixtures.pixels(spark, sf_dir), fixtures.frames(spark, sf_dir)


def r2_resample(spark, sf_dir):
    p, g = _images(spark, sf_dir)
    return raster.resample(p, g.select("image_id", "src_w", "src_h", F.col("to_w").alias("width"), F.col("to_h").alias("height")))


def r3_crop(spark, sf_dir):
    p, g = _images(spark, sf_dir)
    return raster.crop(p, g.select("image_id", "src_w", "src_h", "x0", "y0", F.col("cut_w").alias("width"), F.col("cut_h").alias("height")))


def r4_extend_edges(spark, sf_dir):
    return raster.extend_edges(*_images(spark, sf_dir))


def r5_blur(spark, sf_dir):
    p, g = _images(spark, sf_dir)
    return raster.blur_outside(raster.extend_edges(p, g), g)


def r6_feather_blend(spark, sf_dir):
    p, g = _images(spark, sf_dir)
    moved = p.join(g.select("image_id", "dx", "dy"), "image_id").select("image_id", (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x"), *"rgba")
    return raster.feather_blend(raster.extend_edges(p, g), moved, g)


def r7_feather_mask(spark, sf_dir):
    sizes = spark.read.parquet(f"{sf_dir}/part.parquet").select((F.col("p_partkey") % 23 + 1).cast("int").alias("w"), (F.col("p_partkey") % 19 + 1).cast("int").alias("h")).distinct()
    return raster.feather_mask(sizes, 6)


def r7_feather_masks(spark, sf_dir):
    """The mask of every part's own size, summed up by row."""
    sizes = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", (F.col("p_partkey") % 23 + 1).cast("int").alias("w"), (F.col("p_partkey") % 19 + 1).cast("int").alias("h"))
    parts = sizes.groupBy("p_partkey", "w", "h").agg(F.count("*").alias("n"))  # rows of one key count together, before they are opened
    total, whole = "aggregate(values, CAST(0 AS BIGINT), (s, v) -> s + v)", "size(filter(values, v -> v = 255))"
    return raster.feather_rows(parts, 6).select("p_partkey", "y", F.expr(f"n * {total}").alias("total"), F.expr(f"n * {whole}").alias("n_whole"))


def r8_opacity(spark, sf_dir):
    p = fixtures.pixels(spark, sf_dir).withColumn("opacity", (F.col("image_id") % 5 + 1) / F.lit(4.0))
    return raster.apply_opacity(p).drop("opacity")


def r9_paste(spark, sf_dir):
    """Two copies of each image on itself, in the order of their steps."""
    p, g = _images(spark, sf_dir)
    first = p.select("image_id", F.lit(0).alias("step"), F.lit("content").alias("kind"), "y", "x", F.col("b").alias("r"), "g", F.col("r").alias("b"), "a").join(g.select("image_id", "x0", "y0"), "image_id")
    first = first.withColumns({"x": F.col("x") + F.col("x0"), "y": F.col("y") - F.col("y0")})
    second = p.withColumns({"step": F.lit(1), "kind": F.lit("content"), "x": F.col("x") + 3, "y": F.col("y") - 2, "a": (F.col("a") * (F.col("x") + 1) / 8).cast("int")})
    return raster.paste_steps(p, first.drop("x0", "y0").unionByName(second))


def r10_over(spark, sf_dir):
    p = fixtures.pixels(spark, sf_dir)
    half = p.withColumns({"r": F.col("g"), "a": (F.col("a") * (F.col("x") + 1) / 8).cast("int")})
    return raster.over(p, half)


def r11_to_rgb(spark, sf_dir):
    return raster.to_rgb(fixtures.pixels(spark, sf_dir))


def r12_draw_boxes(spark, sf_dir):
    p = fixtures.pixels(spark, sf_dir)
    i = p.select("image_id").distinct().withColumn("ordinal", F.explode(F.array(F.lit(0), F.lit(1))))
    boxes = i.select("image_id", "ordinal", *[F.expr(e).alias(n) for n, e in {"x1": "int(image_id % 3 + ordinal)", "y1": "int(image_id % 2)", "x2": "int(6 + ordinal)", "y2": "int(5 + image_id % 3)", "cr": "255 - 100 * ordinal", "cg": "100", "cb": "int(image_id % 200)"}.items()])
    return raster.draw_boxes(p, boxes)


def r13_blank(spark, sf_dir):
    return raster.blank_canvas(fixtures.frames(spark, sf_dir))


def r14_render(spark, sf_dir):
    """Designs drawn on small canvases by their draw plans, with the images of those layers that have one (vec_id = design_id * 8 + ordinal)."""
    images = fixtures.pixels(spark, sf_dir).select("*", F.expr("image_id div 8").alias("design_id"), F.expr("CAST(image_id % 8 AS INT)").alias("ordinal")).drop("image_id")
    layers = flat_layers(spark, sf_dir)
    stored = images.select("design_id", "ordinal").distinct()
    layers = cut(layers.drop("has_image").join(stored.withColumn("has_image", F.lit(True)), ["design_id", "ordinal"]))
    plan = compose.draw_steps(layers, fixtures.thumbnails(spark))
    own = layers.select("design_id", "ordinal", "element_id")
    sizes = own.select("design_id", "element_id", F.lit(8).alias("src_w"), F.lit(8).alias("src_h"))
    return raster.render(plan, images.join(own, ["design_id", "ordinal"]).drop("ordinal"), sizes)


def r14_render_flat(spark, sf_dir):
    """Flat images of sizes of their own, composed for small canvases and drawn."""
    p, g = _images(spark, sf_dir)
    images = cut(raster.crop(p, g.select("image_id", "src_w", "src_h", F.lit(0).alias("x0"), F.lit(0).alias("y0"), F.col("flat_w").alias("width"), F.col("flat_h").alias("height"))))
    one = {"k": F.lit(0), "ordinal": F.lit(0), "n": F.lit(1), "name": F.lit("Source Image"), "layer_type": F.lit("pixel"), "role": F.lit("photo"), "priority": F.lit(5), "x": F.lit(0), "y": F.lit(0), "visible": F.lit(True), "has_image": F.lit(True), "z_index": F.lit(0), "opacity": F.lit(1.0), "source_type": F.lit("flat_image"), "element_id": F.lit("source_image_0")}
    layers = g.select(F.col("image_id").alias("design_id"), F.col("flat_w").alias("canvas_w"), F.col("flat_h").alias("canvas_h"), F.col("flat_w").alias("width"), F.col("flat_h").alias("height")).withColumns(one)
    plan = compose.compose_plan(layers, fixtures.thumbnails(spark))
    sizes = layers.select("design_id", "element_id", F.col("canvas_w").alias("src_w"), F.col("canvas_h").alias("src_h"))
    return raster.render(plan, images.select(F.col("image_id").alias("design_id"), F.lit("source_image_0").alias("element_id"), "y", "x", *"rgba"), sizes)


def queries() -> dict:
    names = [n for n in globals() if n[:1] in "spjlauwtfcbr" and n[1:2].isdigit()]
    return {n: globals()[n] for n in names}
