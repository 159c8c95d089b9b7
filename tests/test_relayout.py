"""Boundaries and reference figures of the engine's operators."""

import random

import pytest
from pyspark.sql import functions as F

from adloom import catalogs
from adloom.functions import expressions as E
from adloom.operators import classify, compose, layout, raster
from adloom.sources import design


@pytest.mark.parametrize(
    ("source", "target", "plan", "cover", "contain", "offset"),
    [
        ((886, 500), (1080, 1920), "extend", (3402, 1920), (1080, 609), (0, 524)),
        ((886, 500), (1200, 630), "cover", (1200, 677), (1116, 630), (42, 0)),
        ((886, 500), (1280, 720), "cover", (1280, 722), (1275, 720), (2, 0)),
        ((886, 500), (1500, 500), "extend", (1500, 846), (886, 500), (307, 0)),
        ((886, 500), (2000, 1000), "cover", (2000, 1128), (1772, 1000), (114, 0)),
        ((500, 500), (1080, 1350), "cover", (1350, 1350), (1080, 1080), (0, 108)),
        ((500, 500), (500, 400), "cover", (500, 500), (400, 400), (50, 0)),
        ((100, 800), (400, 100), "extend", (400, 3200), (12, 100), (194, 0)),
        ((0, 0), (100, 100), "blank", None, None, None),
    ],
)
def test_fit(spark, source, target, plan, cover, contain, offset):
    df = spark.createDataFrame([(*source, *target, "smart")], "src_w int, src_h int, target_w int, target_h int, mode string")
    r = compose.fit_plan(df).first()
    assert r["plan"] == plan
    if cover:
        assert (r["cover_w"], r["cover_h"]) == cover
        assert (r["contain_w"], r["contain_h"]) == contain
        assert (r["off_x"], r["off_y"]) == offset


def test_validate_targets(spark):
    rows = [(1, 10, 10), (2, 4096, 4096), (3, 0, 5), (4, -1, 5), (5, 5000, 50), (6, 9, 50)]
    got = {r["seq"]: r["reason"] for r in layout.validate_targets(spark.createDataFrame(rows, "seq int, width int, height int")).collect()}
    assert got == {1: None, 2: None, 3: "not positive", 4: "not positive", 5: "too large", 6: "too small"}


def test_templates(spark):
    rows = [(1, 500, 1000, "portrait_tall"), (2, 499, 1000, "landscape"), (3, 2000, 1000, "landscape_wide"), (4, 4000, 1000, "landscape"), (5, 1000, 1000, "square"), (6, 650, 1000, "portrait")]
    df = spark.createDataFrame([(a, b, c) for a, b, c, _ in rows], "seq int, width int, height int")
    assert {r["seq"]: r["template"] for r in layout.with_template(df).collect()} == {a: t for a, _, _, t in rows}


def test_name_rules(spark):
    cases = {"Headline Main": "headline", "Sub Title": "headline", "subhead copy": "subheadline", "shop_now_btn": "cta", "vintage": "badge", "bg_pattern": "background", "texture": "body_text", "Layer 7": None}
    df = spark.createDataFrame([(k,) for k in cases], "name string").withColumn("role", F.expr(E.NAME_ROLE))
    assert {r["name"]: r["role"] for r in df.collect()} == cases


def test_tree_drops_whole_branches(spark):
    schema = "design_id long, ordinal int, name string, layer_type string, width int, height int, visible boolean, parent_ordinal int"
    rows = [
        (1, 0, "g", "group", 50, 50, True, None),
        (1, 1, "a", "pixel", 50, 50, True, 0),
        (1, 2, "h", "group", 50, 50, False, None),
        (1, 3, "b", "pixel", 50, 50, True, 2),
        (1, 4, "c", "pixel", 9, 50, True, None),
        (1, 5, "d", "pixel", 50, 50, True, 1),
        (1, 6, "e", "pixel", 10, 10, None, None),
    ]
    got = design.flatten_layer_tree(spark.createDataFrame(rows, schema)).orderBy("k").collect()
    assert [r["name"] for r in got] == ["g", "a", "e"]
    assert [r["z_index"] for r in got] == [3, 2, 1]


def test_general_walk_equals_rank(spark):
    rng = random.Random(3)
    roles = ["headline", "cta", "badge", "hero_image", "icon", "photo"]
    rows = [(d, k, rng.choice(roles), rng.randrange(1, 5), rng.randrange(10, 30), 10) for d in range(60) for k in range(rng.randrange(1, 12))]
    df = spark.createDataFrame(rows, "design_id long, k int, role string, priority int, width int, height int")
    zones = catalogs.zones(spark).where("template = 'square'").select("zone_no", "zone", "roles")
    walk = {tuple(r) for r in layout.assign_zones_general(df, zones).select("design_id", "k", "zone").collect()}
    rank = layout.ranked_by_template(df, ["square"]).where("section = 1").select("design_id", "k", "zone")
    assert walk == {tuple(r) for r in rank.collect()}


def test_resample_keeps_a_solid_image(spark):
    rows = [(1, y, x, 255, 255, 255, 255) for y in range(6) for x in range(4)]
    px = spark.createDataFrame(rows, "image_id long, y int, x int, r int, g int, b int, a int")
    size = lambda w, h: spark.createDataFrame([(1, 4, 6, w, h)], "image_id long, src_w int, src_h int, width int, height int")
    out = raster.resample(px, size(7, 3)).collect()
    assert len(out) == 21 and {(r["r"], r["g"], r["b"], r["a"]) for r in out} == {(255, 255, 255, 255)}
    assert sorted(raster.resample(px, size(0, 3)).collect()) == sorted(px.collect())


def test_flat_images(spark, tmp_path):
    import struct
    import zlib

    def png(w, h):
        part = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
        return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress((b"\0" + b"\x40" * 3 * w) * h)) + part(b"IEND", b"")

    (tmp_path / "a.png").write_bytes(png(30, 20))
    (tmp_path / "b.png").write_bytes(b"no image")
    (tmp_path / "c.txt").write_bytes(b"text")
    layers, rejects = design.scan_flat_images(spark, str(tmp_path))
    row = layers.collect()
    assert [(r["canvas_w"], r["canvas_h"], r["name"]) for r in row] == [(30, 20, "Source Image")]
    assert [r["path"].rsplit("/", 1)[1] for r in rejects.collect()] == ["b.png"]


def test_overrides_leave_other_layers_alone(spark):
    layers = spark.createDataFrame([(1, 0, "cta", 2), (1, 1, "logo", 5), (1, 2, "icon", 6)], "design_id long, ordinal int, role string, priority int")
    rows = [(1, 0, 1, "headline", None), (1, 1, 2, "none such", 40), (1, 1, 3, "badge", -3), (2, 0, 4, "logo", 1)]
    done, bad = classify.apply_overrides(layers, spark.createDataFrame(rows, "design_id long, ordinal int, seq long, new_role string, new_priority int"))
    assert {r["ordinal"]: (r["role"], r["priority"]) for r in done.collect()} == {0: ("headline", 2), 1: ("badge", 1), 2: ("icon", 6)}
    assert {(r["seq"], r["reason"]) for r in bad.collect()} == {(2, "no such role"), (4, "no such layer")}


def test_read_layers(spark, tmp_path):
    rows = [(1, 0, 100, 80, "logo", "pixel", 0, 0, 20, 30, True, 255, None, True, None), (1, 1, 100, 80, "cta", "type", 5, 5, 50, 20, None, None, "Buy", False, 0)]
    df = spark.createDataFrame(rows, design.LAYERS)
    for kind in ("parquet", "json", "orc"):
        df.write.format(kind).save(str(tmp_path / kind))
        assert sorted(design.read_layers(spark, str(tmp_path / kind), kind).collect()) == rows


def test_sides_are_truncated_before_they_are_judged(spark):
    rows = [(1, 0.5, 50.0), (2, 4096.9, 50.0), (3, 9.9, 50.0), (4, 10.2, 10.0), (5, -0.5, 50.0), (6, 4097.0, 50.0), (7, float("nan"), 50.0), (8, None, 50.0)]
    got = {r["seq"]: r["reason"] for r in layout.validate_targets(spark.createDataFrame(rows, "seq int, width double, height double")).collect()}
    assert got == {1: "not positive", 2: None, 3: "too small", 4: None, 5: "not positive", 6: "too large", 7: "not a number", 8: "not numeric"}


def test_scaling_by_any_factor(spark):
    df = spark.createDataFrame([(-7, 9, 11, 3)], "x int, y int, width int, height int")
    assert layout.bbox_scale(df, 0.5).select("sx", "sy", "swidth", "sheight").first() == (-3, 4, 5, 1)
    assert layout.bbox_scale(df.withColumn("f", F.lit(2.0)), "f").select("sx", "sy", "swidth", "sheight").first() == (-14, 18, 22, 6)


def test_z_order_of_the_document(spark):
    schema = "design_id long, ordinal int, name string, layer_type string, width int, height int, visible boolean, parent_ordinal int"
    df = spark.createDataFrame([(1, i, f"l{i}", "pixel", 50, 50, True, None) for i in range(3)], schema)
    of = lambda order: [r["z_index"] for r in design.flatten_layer_tree(df, z_order=order).orderBy("k").collect()]
    assert of("list") == [3, 2, 1] and of("document") == [0, 1, 2]
    with pytest.raises(KeyError):
        design.flatten_layer_tree(df, z_order="other")


def test_fonts_effects_and_blend_modes(spark):
    schema = "k int, opacity_u8 int, text_content string, blend_mode string, font_runs array<struct<font_size:double,font_name:string,color:array<double>>>, effect_list array<struct<name:string,enabled:boolean,opacity:double>>"
    rows = [(0, 51, "Hi", "multiply", [(30.0, "Sans", [1.0, 0.5, 0.0, 0.0])], [("shadow", True, 40.0), ("glow", False, None)]), (1, None, None, None, [(None, None, None)], []), (2, 255, "x", None, None, None)]
    got = {r["k"]: r for r in design.normalise_attributes(spark.createDataFrame(rows, schema)).collect()}
    assert got[0]["opacity"] == pytest.approx(0.2) and got[1]["opacity"] == 1.0
    assert [got[i]["blend_mode"] for i in range(3)] == ["multiply", "normal", "normal"]
    assert got[0]["font_info"] == ("Hi", 30.0, "Sans", [1.0, 0.5, 0.0, 0.0])
    assert got[1]["font_info"][1:] == got[2]["font_info"][1:] == (12.0, "Unknown", [1.0, 0.0, 0.0, 0.0])
    assert {k: tuple(v) for k, v in got[0]["effects"].items()} == {"shadow": (True, 40.0), "glow": (False, 100.0)} and got[1]["effects"] == {}


def test_manifest_is_written_by_target(spark, tmp_path):
    plan = spark.createDataFrame([(1, "A B"), (1, "A B"), (2, "C")], "design_id long, target_name string")
    design.manifest(plan, str(tmp_path / "out"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("design_id", "target_name", "file").collect())) == [(1, "A B", "A_B.png"), (2, "C", "C.png")]


def image(spark, image_id, w, h, colour=lambda y, x: (10 * y, 10 * x, 7, 255)):
    return spark.createDataFrame([(image_id, y, x, *colour(y, x)) for y in range(h) for x in range(w)], "image_id long, y int, x int, r int, g int, b int, a int")


def places_of(df):
    return {(r["image_id"], r["y"], r["x"]): tuple(r)[3:] for r in df.select("image_id", "y", "x", "r", "g", "b", "a").collect()}


def test_images_of_mixed_sizes_in_one_job(spark):
    p = image(spark, 1, 4, 3).unionByName(image(spark, 2, 2, 5))
    geo = "image_id long, src_w int, src_h int, width int, height int, dx int, dy int, x0 int, y0 int"
    g = spark.createDataFrame([(1, 4, 3, 6, 5, 1, -1, 2, 1), (2, 2, 5, 3, 3, -1, 0, -1, -2)], geo)
    old = places_of(p)
    size = {1: (4, 3, 6, 5), 2: (2, 5, 3, 3)}
    wide, cut = places_of(raster.extend_edges(p, g)), places_of(raster.crop(p, g))
    moved = {1: (1, -1, 2, 1), 2: (-1, 0, -1, -2)}
    for i, (sw, sh, w, h) in size.items():
        dx, dy, x0, y0 = moved[i]
        for y in range(h):
            for x in range(w):
                assert wide.pop((i, y, x)) == old[i, min(max(y - dy, 0), sh - 1), min(max(x - dx, 0), sw - 1)]
                assert cut.pop((i, y, x)) == old.get((i, y + y0, x + x0), (0, 0, 0, 0))
    assert not wide and not cut
    sizes = spark.createDataFrame([(1, 4, 3, 0, 9), (2, 2, 5, 4, 10)], "image_id long, src_w int, src_h int, width int, height int")
    scaled = places_of(raster.resample(p, sizes))
    assert {k: v for k, v in scaled.items() if k[0] == 1} == {k: v for k, v in old.items() if k[0] == 1} and sum(k[0] == 2 for k in scaled) == 40


def test_render_draws_in_order(spark):
    plan = spark.createDataFrame(
        [(1, 1, 3, 2, 0, "background", "b", 0, 0, 3, 2, 1.0), (1, 1, 3, 2, 1, "overlay", "o", 0, 0, 3, 2, 0.1), (1, 1, 3, 2, 2, "content", "c", 2, -1, 2, 2, 0.5), (2, 1, 2, 1, 0, "content", "none", 0, 0, 1, 1, 1.0)],
        "design_id long, seq int, target_w int, target_h int, step int, kind string, element_id string, image_x int, image_y int, image_w int, image_h int, opacity double",
    )
    flat = lambda name, w, h, *rgba: [(1, name, y, x, *rgba) for y in range(h) for x in range(w)]
    px = spark.createDataFrame(flat("b", 3, 2, 100, 100, 100, 255) + flat("o", 3, 2, 200, 0, 0, 0) + flat("c", 2, 2, 0, 0, 255, 255), "design_id long, element_id string, y int, x int, r int, g int, b int, a int")
    sizes = spark.createDataFrame([(1, "b", 3, 2), (1, "o", 3, 2), (1, "c", 2, 2)], "design_id long, element_id string, src_w int, src_h int")
    got = {(r["design_id"], r["y"], r["x"]): (r["r"], r["g"], r["b"]) for r in raster.render(plan, px, sizes).collect()}
    grey = got[1, 0, 0]
    assert len(got) == 8 and got[2, 0, 0] == got[2, 0, 1] == (255, 255, 255)
    assert len({got[1, y, x] for y in range(2) for x in range(3) if (y, x) != (0, 2)}) == 1 and all(abs(v - 100) < 4 for v in grey)
    assert got[1, 0, 2][2] > 150 and got[1, 0, 2][0] < 60  # half the content over the grey
