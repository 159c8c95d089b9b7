"""Layout and draw plans against a plain version, written from the rules and not from the library's expressions."""

import math
import random

from adloom.operators import compose, layout

# The rules' own numbers, written out once more.
SPANS = {"portrait_tall": (0.5, 0.65), "portrait": (0.65, 0.85), "square": (0.85, 1.15), "landscape": (1.15, 2.0), "landscape_wide": (2.0, 4.0)}
TOP, HEAD, HERO = ("badge", "logo"), ("headline", "subheadline"), ("hero_image", "illustration", "photo")
SPOTS = {
    "portrait_tall": [("top_badge", (0.1, 0.02, 0.8, 0.08), TOP), ("headline", (0.05, 0.12, 0.9, 0.25), HEAD), ("cta", (0.15, 0.38, 0.7, 0.08), ("cta",)), ("hero", (0.0, 0.48, 1.0, 0.52), HERO)],
    "portrait": [("top_badge", (0.1, 0.03, 0.8, 0.1), TOP), ("headline", (0.05, 0.15, 0.9, 0.2), HEAD), ("cta", (0.2, 0.36, 0.6, 0.08), ("cta",)), ("hero", (0.05, 0.46, 0.9, 0.5), HERO)],
    "square": [("top_badge", (0.05, 0.03, 0.4, 0.12), TOP), ("headline", (0.05, 0.18, 0.55, 0.25), HEAD), ("cta", (0.05, 0.45, 0.45, 0.1), ("cta",)), ("hero", (0.45, 0.1, 0.52, 0.85), HERO)],
    "landscape": [("left_content", (0.03, 0.05, 0.5, 0.9), ("badge", "headline", "subheadline", "cta")), ("hero", (0.5, 0.0, 0.5, 1.0), ("hero_image", "illustration", "photo", "logo"))],
    "landscape_wide": [("left", (0.02, 0.1, 0.35, 0.8), ("badge", "headline")), ("center", (0.35, 0.15, 0.3, 0.7), ("subheadline", "cta")), ("hero", (0.62, 0.0, 0.38, 1.0), ("hero_image", "illustration", "logo"))],
}
BACK = ("background", "background_pattern", "overlay")
ROLES = ["headline", "subheadline", "body_text", "cta", "badge", "label", "logo", "hero_image", "icon", "photo", "illustration", "decoration", *BACK, "group", "unknown"]


def plain_layout(layers, canvas, size, spans=SPANS, spots=SPOTS):
    """(k -> zone, x, y, w, h, scale, visible) of one design on one target, layer by layer."""
    tw, th = size
    template = next((t for t, (a, b) in spans.items() if a <= tw / th < b), "landscape")
    room, zone_of = {z[0]: 2 for z in spots[template]}, {}
    for e in sorted((e for e in layers if e["role"] not in BACK), key=lambda e: (e["priority"], -e["width"] * e["height"], e["k"])):
        for name, _, roles in spots[template]:
            if e["role"] in roles and room[name]:
                room[name] -= 1
                zone_of[e["k"]] = name
                break
    out = {}
    for e in layers:
        w, h = e["width"], e["height"]
        if e["role"] in BACK:
            out[e["k"]] = (None, 0, 0, tw, th, max(tw / w, th / h) if w > 0 and h > 0 else 1.0, True)
        elif e["k"] in zone_of:
            zx, zy, zw, zh = (int(f * s) for f, s in zip(next(z[1] for z in spots[template] if z[0] == zone_of[e["k"]]), (tw, th, tw, th)))
            sx, sy = zw / max(1, w), zh / max(1, h)
            scale = max(e["min_scale"], min(e["max_scale"], min(sx, sy) if e["maintain_aspect"] else (sx + sy) / 2))
            nw, nh = int(w * scale), int(h * scale)
            out[e["k"]] = (zone_of[e["k"]], zx + (zw - nw) // 2, zy + (zh - nh) // 2, nw, nh, scale, True)
        else:
            scale = min(tw / max(1, canvas[0]), th / max(1, canvas[1]))
            out[e["k"]] = (None, int(e["x"] * scale), int(e["y"] * scale), int(w * scale), int(h * scale), scale, e["priority"] <= 7)
    return out


def plain_draw(layers, placed, size):
    """(kind, k, box, image box) of the steps of one design and target, in order."""
    tw, th = size
    backs = [e for e in layers if e["role"] in BACK]
    out = []
    if backs and backs[0]["has_image"]:
        b = backs[0]
        scale = max(tw / max(b["width"], 1), th / max(b["height"], 1))
        w, h = max(1, int(b["width"] * scale)), max(1, int(b["height"] * scale))
        out.append(("background", b["k"], (0, 0, tw, th), (-((w - tw) // 2), -((h - th) // 2), w, h)))
        out += [("overlay", e["k"], (0, 0, tw, th), (0, 0, tw, th)) for e in backs[1:] if e["role"] == "overlay" and e["has_image"]]
    for e in sorted((e for e in layers if e["role"] not in BACK), key=lambda e: (e["z_index"], e["k"])):
        box = placed[e["k"]][1:5]
        if placed[e["k"]][6] and e["has_image"] and box[2] > 0 and box[3] > 0:
            out.append(("content", e["k"], box, box))
    return out


def random_designs(rng, n):
    rows = []
    for d in range(n):
        canvas = rng.choice([(1080, 1080), (1200, 628), (600, 600), (0, 50)])
        for k in range(rng.randrange(1, 15)):
            rows.append({
                "design_id": d, "k": k, "element_id": f"e{k}", "name": "n", "canvas_w": canvas[0], "canvas_h": canvas[1], "role": rng.choice(ROLES), "priority": rng.randrange(1, 10), "x": rng.randrange(-60, 900), "y": rng.randrange(-60, 900),
                "width": rng.choice([0, 1, rng.randrange(1, 2000)]), "height": rng.choice([-1, 1, rng.randrange(1, 2000)]), "visible": True, "has_image": rng.random() < 0.7, "z_index": rng.randrange(4), "opacity": 1.0,
                "min_scale": rng.choice([0.0, 0.3, 1.0]), "max_scale": rng.choice([0.2, 2.0]), "maintain_aspect": rng.random() < 0.5,
            })
    return rows


LAYER = "design_id long, k int, element_id string, name string, canvas_w int, canvas_h int, role string, priority int, x int, y int, width int, height int, visible boolean, has_image boolean, z_index int, opacity double, min_scale double, max_scale double, maintain_aspect boolean"
SIZES = [(1080, 1920), (1080, 1080), (1080, 1350), (1200, 630), (1500, 500), (2000, 1000), (160, 600), (4000, 800), (10, 10), (720, 300), (540, 1080)]


def by_design(rows):
    out = {}
    for r in rows:
        out.setdefault(r["design_id"], []).append(r)
    return out


def test_layout_and_draw_plans(spark):
    rows = random_designs(random.Random(12), 60)
    targets = spark.createDataFrame([(i, f"t{i}", w, h) for i, (w, h) in enumerate(SIZES)], "seq int, name string, width int, height int")
    layers = spark.createDataFrame([tuple(r.values()) for r in rows], LAYER)
    for placements in (layout.calculate_layout(layers, targets), layout.calculate_layout(layers, targets, most_broadcast=3)):  # by broadcast, and salted
        got = {(r["design_id"], r["seq"], r["k"]): (r["zone"], r["new_x"], r["new_y"], r["new_w"], r["new_h"], r["scale_factor"], r["visible"]) for r in placements.collect()}
        assert len(got) == len(rows) * len(SIZES)
        for d, own in by_design(rows).items():
            for i, size in enumerate(SIZES):
                for k, want in plain_layout(own, (own[0]["canvas_w"], own[0]["canvas_h"]), size).items():
                    have = got[d, i, k]
                    assert have[:5] == want[:5] and have[6] == want[6] and math.isclose(have[5], want[5]), (d, i, k, have, want)
    steps = {}
    for r in compose.draw_plan(layout.calculate_layout(layers, targets)).collect():
        steps.setdefault((r["design_id"], r["seq"]), []).append((r["step"], r["kind"], r["k"], tuple(r[c] for c in "xywh"), tuple(r[f"image_{c}"] for c in "xywh")))
    for d, own in by_design(rows).items():
        for i, size in enumerate(SIZES):
            want = plain_draw(own, plain_layout(own, (own[0]["canvas_w"], own[0]["canvas_h"]), size), size)
            assert [s[1:] for s in sorted(steps.get((d, i), []))] == want


def test_templates_of_a_user(spark):
    """Zones that share roles: the walk itself, layer by layer, and the fold over each design."""
    rng = random.Random(5)
    spans = {"landscape": (1.0, 9.0), "own": (0.2, 0.8), "square": (0.8, 1.0)}
    spots = {t: [(f"z{i}", (0.1 * i, 0.1, 0.3, 0.2 * (i + 1)), tuple(rng.sample(ROLES[:12], 5))) for i in range(n)] for t, n in (("landscape", 5), ("own", 3), ("square", 1))}
    rows = random_designs(rng, 50)
    layers = spark.createDataFrame([tuple(r.values()) for r in rows], LAYER)
    targets = spark.createDataFrame([(i, f"t{i}", w, h) for i, (w, h) in enumerate(SIZES)], "seq int, name string, width int, height int")
    templates = spark.createDataFrame([(t, a, b) for t, (a, b) in spans.items()], "template string, min_aspect double, max_aspect double")
    zones = spark.createDataFrame([(t, z, i, *f, list(r)) for t, zs in spots.items() for i, (z, f, r) in enumerate(zs)], "template string, zone string, zone_no int, fx double, fy double, fw double, fh double, roles array<string>")
    assert layout.shared_roles(zones).count() > 3
    placed = layout.calculate_layout(layers, targets, templates, zones)
    got = {(r["design_id"], r["seq"], r["k"]): (r["zone"], r["new_x"], r["new_y"], r["new_w"], r["new_h"]) for r in placed.collect()}
    assert len(got) == len(rows) * len(SIZES)
    for d, own in by_design(rows).items():
        for i, size in enumerate(SIZES):
            for k, want in plain_layout(own, (own[0]["canvas_w"], own[0]["canvas_h"]), size, spans, spots).items():
                assert got[d, i, k] == want[:5]
    content = layers.where("role NOT IN ('background', 'background_pattern', 'overlay')")
    fold = layout.assign_zones_general(content, zones.where("template = 'landscape'").select("zone", "zone_no", "roles"))
    ranked = layout.ranked_by_template(layers, ["landscape"], zones).where("section = 1").select("design_id", "k", "zone")
    assert sorted(map(tuple, fold.select("design_id", "k", "zone").collect())) == sorted(map(tuple, ranked.collect()))


def test_very_many_targets_are_spread(spark):
    """200,000 sizes of five templates: no task gets a template's whole share."""
    from pyspark.sql import functions as F

    rows = random_designs(random.Random(1), 12)
    layers = spark.createDataFrame([tuple(r.values()) for r in rows], LAYER)
    targets = spark.range(200_000).select(F.col("id").cast("int").alias("seq"), F.lit("t").alias("name"), (F.col("id") % 1900 + 100).cast("int").alias("width"), F.lit(800).alias("height"))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["count"] for r in layout.calculate_layout(layers, targets).groupBy(F.spark_partition_id().alias("task")).count().collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 200_000 * len(rows)
    assert len(sizes) >= 12 and max(sizes) < 3 * sorted(sizes)[len(sizes) // 2]
