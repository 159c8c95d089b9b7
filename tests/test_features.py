"""Operators that work beyond the sizes of the fixtures: trees, patterns, prompts, batches, steps, flat images."""

import json
import math
import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from adloom import catalogs
from adloom.functions import expressions as E
from adloom.operators import classify, compose, raster, report
from adloom.sources import design

TREE = "design_id long, ordinal int, name string, layer_type string, width int, height int, visible boolean, parent_ordinal int"


def plain_kept(rows):
    """Ordinals that stay: usable, and below usable groups only."""
    own = {r[1]: r for r in rows}

    def stays(r, seen):
        if r is None or r[1] in seen or not (r[6] in (True, None) and r[4] >= 10 and r[5] >= 10):
            return False
        if r[7] is None:
            return True
        up = own.get(r[7])
        return up is not None and up[3] == "group" and stays(up, {*seen, r[1]})

    return [r[1] for r in sorted(rows, key=lambda r: r[1]) if stays(r, set())]


def test_large_trees_equal_the_plain_walk(spark):
    rng = random.Random(7)
    rows = []
    for d in range(80):
        n = rng.randrange(1, 30)
        for i in range(n):
            parent = rng.choice([None, *range(max(0, i - 3), i), rng.randrange(n), 99]) if i else None
            rows.append((d, i, f"l{i}", rng.choice(["group", "group", "pixel"]), rng.choice([50, 50, 50, 9]), 50, rng.choice([True, True, None, False]), parent))
    got = {}
    for r in design.flatten_large_trees(spark.createDataFrame(rows, TREE)).collect():
        got.setdefault(r["design_id"], []).append((r["k"], r["ordinal"], r["n"], r["z_index"]))
    for d in range(80):
        want = plain_kept([r for r in rows if r[0] == d])
        assert sorted(got.get(d, [])) == [(k, o, len(want), len(want) - k) for k, o in enumerate(want)]
    forward = [r for r in rows if r[7] is None or r[7] < r[1]]
    names = ["design_id", "k", "ordinal", "n", "element_id", "z_index"]
    both = [sorted(map(tuple, f(spark.createDataFrame(forward, TREE), "document").select(*names).collect())) for f in (design.flatten_layer_tree, design.flatten_large_trees)]
    assert both[0] == both[1]


def test_a_chain_of_groups_and_a_wide_design(spark):
    chain = spark.range(4_000).select(F.lit(1).cast("long").alias("design_id"), F.col("id").cast("int").alias("ordinal"), F.lit("g").alias("name"), F.lit("group").alias("layer_type"), F.lit(50).alias("width"), F.lit(50).alias("height"), F.lit(True).alias("visible"), F.when(F.col("id") > 0, F.col("id") - 1).cast("int").alias("parent_ordinal"))
    wide = spark.range(50_000).select(F.lit(2).cast("long").alias("design_id"), F.col("id").cast("int").alias("ordinal"), F.lit("g").alias("name"), F.lit("group").alias("layer_type"), F.lit(50).alias("width"), F.lit(50).alias("height"), F.lit(True).alias("visible"), F.when(F.col("id") > 0, F.floor((F.col("id") - 1) / 100)).cast("int").alias("parent_ordinal"))
    broken = chain.withColumns({"design_id": F.lit(3).cast("long"), "visible": F.col("ordinal") != 3_000})
    n = {r["design_id"]: (r["count"], r["last"]) for r in design.flatten_large_trees(chain.unionByName(wide).unionByName(broken)).groupBy("design_id").agg(F.count("*").alias("count"), F.max("k").alias("last")).collect()}
    assert n == {1: (4_000, 3_999), 2: (50_000, 49_999), 3: (3_000, 2_999)}


def nested(rows, parent=None):
    return [{"name": r[0], "layer_type": r[1], "x": r[2], "children": nested(rows, r[4])} for r in rows if r[3] == parent]


def test_nested_documents(spark):
    deep = {"name": "leaf", "x": 1}
    for i in range(8):
        deep = {"name": f"g{i}", "layer_type": "group", "children": [{"name": "a"}, deep, {"name": "z"}]}
    trees = [(1, json.dumps([{"name": "one", "x": "no number", "width": 7, "visible": False}, {"name": "g", "children": [{"name": "in"}, {"name": "h", "children": [{}]}]}, {"name": "last", "children": []}])), (2, json.dumps([deep])), (3, "[]"), (4, None), (5, "no json"), (6, '{"name": "no list"}'), (7, '[1, "x", null, {"children": 5}]')]
    docs = spark.createDataFrame([(i, 10, 20, t) for i, t in trees], "design_id long, canvas_w int, canvas_h int, layers string")
    for source in (docs, docs.withColumn("layers", F.try_parse_json("layers"))):
        got = {}
        for r in design.layers_of_trees(source).orderBy("design_id", "ordinal").collect():
            got.setdefault(r["design_id"], []).append(r)
        assert [(r["ordinal"], r["name"], r["parent_ordinal"], r["x"], r["width"], r["visible"]) for r in got[1]] == [(0, "one", None, None, 7, False), (1, "g", None, None, None, None), (2, "in", 1, None, None, None), (3, "h", 1, None, None, None), (4, None, 3, None, None, None), (5, "last", None, None, None, None)]
        names = [r["name"] for r in got[2]]
        assert names == [n for i in reversed(range(8)) for n in (f"g{i}", "a")] + ["leaf"] + ["z"] * 8
        assert [r["parent_ordinal"] for r in got[2]][:17:2] == [None, *range(0, 15, 2)]
        assert set(got) == {1, 2, 7} and [r["name"] for r in got[7]] == [None] * 4
        assert {r["canvas_w"] for r in got[1]} == {10}


def test_patterns_of_the_catalogue_as_a_table(spark):
    listed = [(i, role, p) for i, (role, p) in enumerate((role, p) for role, ps in catalogs.NAME_PATTERNS for p in ps)]
    rng = random.Random(3)
    names = [None, "", "H1", "ico", "a-bg", "Sub_Title", "vintage"] + ["".join(rng.choices(["head", "line", "sub", "text", "h", "1", "bg", "ta", "g", " ", "_", "Logo", "BTN"], k=rng.randrange(1, 6))) for _ in range(400)]
    layers = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id int, name string")
    got = classify.classify_by_patterns(layers, spark.createDataFrame(listed, "rank int, role string, pattern string"))
    assert got.columns == ["id", "name", "pattern_role"] and got.count() == len(names)
    assert got.where(~F.col("pattern_role").eqNullSafe(F.expr(E.NAME_ROLE))).count() == 0


def test_very_many_patterns(spark):
    """100,000 patterns and 20,000 names, half of one name; short, empty, null and equal patterns."""
    patterns = spark.range(100_000).select(F.col("id").alias("rank"), F.concat(F.lit("role"), F.col("id") % 50).alias("role"), F.concat(F.lit("pat"), F.hex(F.col("id") * 7919 % 1_000_003), F.lit("x")).alias("pattern"))
    patterns = patterns.withColumn("pattern", F.lower("pattern"))
    odd = spark.createDataFrame([(-1, "first", "zz"), (5, "null", None), (200_000, "all", ""), (200_000, "b", ""), (-2, "q", "q"), (-3, "never", "nowhere")], "rank long, role string, pattern string")
    names = spark.range(20_000).select("id", F.when(F.col("id") % 2 == 0, "same pat0X name").when(F.col("id") % 7 == 0, F.lit(None)).when(F.col("id") % 11 == 0, "Zz pat0x").when(F.col("id") % 13 == 0, "q").otherwise(F.concat(F.lit("N PAT"), F.hex(F.col("id") * 7919 % 1_000_003), F.lit("X!"))).alias("name"))
    got = {r["id"]: r["pattern_role"] for r in classify.classify_by_patterns(names, patterns.unionByName(odd)).collect()}
    assert len(got) == 20_000
    for i, role in got.items():
        want = "role0" if i % 2 == 0 else None if i % 7 == 0 else "first" if i % 11 == 0 else "q" if i % 13 == 0 else f"role{i % 50}"
        assert role == want, i
    assert classify.classify_by_patterns(names.limit(0), odd).count() == 0
    assert {r[0] for r in classify.classify_by_patterns(names, odd.limit(0)).select("pattern_role").distinct().collect()} == {None}


def plain_softmax(vector, prompts, scale):
    logits = [scale * sum(a * b for a, b in zip(vector, p)) for _, _, p in prompts]
    top = max(logits)
    total = sum(math.exp(v - top) for v in logits)
    best = min(i for i, v in zip((p[0] for p in prompts), logits) if v == top)
    return best, 1 / total, {p[0]: math.exp(v - top) / total for p, v in zip(prompts, logits)}


@pytest.mark.parametrize("block", [2, 7, 40, 4096])
def test_prompts_of_any_number(spark, block):
    rng = random.Random(2)
    vector = lambda: [float(rng.randrange(-3, 4)) for _ in range(4)]
    prompts = [(i, f"r{i % 5}", vector()) for i in range(33)]
    rows = [(i, vector()) for i in range(40)] + [(40, None)]
    p = spark.createDataFrame(prompts, "prompt int, role string, embedding array<double>")
    layers = spark.createDataFrame(rows, "id int, embedding array<double>")
    got = {r["id"]: r for r in classify.classify_by_embedding(layers, p, scale=1.0, threshold=0.2, block=block).collect()}
    probs = {(r["id"], r["prompt"]): r["prob"] for r in classify.prompt_probabilities(layers, p, scale=1.0, block=block).collect()}
    assert len(got) == 41 and (got[40]["role"], got[40]["prob"]) == (None, None) and len(probs) == 40 * 33
    for i, v in rows[:40]:
        best, prob, each = plain_softmax(v, prompts, 1.0)
        assert got[i]["prob"] == pytest.approx(prob) and got[i]["role"] == (f"r{best % 5}" if prob >= 0.2 else None)
        assert all(probs[i, k] == pytest.approx(x) for k, x in each.items())


def test_the_sixteenth_prompt_counts(spark):
    axis = lambda i: [1.0 if j == i else 0.0 for j in range(20)]
    prompts = spark.createDataFrame([(i, axis(i)) for i in range(16)], "prompt int, embedding array<double>")
    layers = spark.createDataFrame([(i, axis(i)) for i in (3, 15, 19)], "id int, embedding array<double>")
    got = {r["id"]: r for r in classify.classify_by_embedding(layers, prompts).collect()}
    assert got[3]["role"] == catalogs.PROMPT_ROLES[3] and got[15]["role"] is None and got[15]["prob"] == pytest.approx(1.0)
    assert got[19]["prob"] == pytest.approx(1 / 16) and classify.prompt_probabilities(layers, prompts).count() == 48
    none = classify.classify_by_embedding(layers, prompts.limit(0)).collect()
    assert [(r["role"], r["prob"]) for r in none] == [(None, None)] * 3 and classify.prompt_probabilities(layers, prompts.limit(0)).count() == 0


LAYER = "design_id long, k int, element_id string, name string, canvas_w int, canvas_h int, role string, priority int, x int, y int, width int, height int, visible boolean, has_image boolean, z_index int, opacity double, n int, source_type string"


def test_batches_keep_rejects(spark, tmp_path):
    layer = lambda d, k, role: (d, k, f"e{k}", "n", 100, 80, role, 3, 0, 0, 20, 20, True, True, k, 1.0, 2, "layered")
    layers = spark.createDataFrame([layer(1, 0, "headline"), layer(1, 1, "background"), layer(3, 0, "cta")], LAYER)
    designs = spark.createDataFrame([(1,), (2,), (3,), (4,), (2,)], "design_id long")
    targets = spark.createDataFrame([(1, "A", 100.0, 100.0), (2, "B", 0.0, 50.0), (3, "A", 200.0, 100.0), (4, "C", 9000.0, 50.0), (5, "D", None, 50.0)], "seq int, name string, width double, height double")
    seen = Observation("batch")
    batch = compose.batch_with_rejects(designs, layers, targets.withColumns({c: F.col(c) for c in ("width", "height")}), seen)
    compose.write_batch(batch, str(tmp_path / "out"), "monday")
    back = spark.read.parquet(str(tmp_path / "out"))
    rows = {(r["status"], r["design_id"], r["target_name"], r["reason"], r["n_placed"]) for r in back.collect()}
    assert rows == {("result", 1, "A", None, 2), ("result", 3, "A", None, 1), ("design", 2, None, "no layers", None), ("design", 4, None, "no layers", None), ("target", None, "B", "not positive", None), ("target", None, "C", "too large", None), ("target", None, "D", "not numeric", None)}
    assert seen.get == {"n_result": 2, "n_design": 2, "n_target": 3}
    compose.write_batch(batch.where("status = 'result'").limit(1), str(tmp_path / "out"), "tuesday")
    compose.write_batch(compose.batch_with_rejects(designs.limit(1), layers.limit(1), targets), str(tmp_path / "out"), "tuesday")
    sizes = {(r["batch_id"], r["status"]): r["count"] for r in spark.read.parquet(str(tmp_path / "out")).groupBy("batch_id", "status").count().collect()}
    assert sizes[("monday", "result")] == 2 and sizes[("monday", "design")] == 2 and sizes[("tuesday", "target")] == 3


def test_a_target_written_again_leaves_the_others(spark, tmp_path):
    path, plan = str(tmp_path / "m"), spark.createDataFrame([(1, "A B"), (1, "C")], "design_id long, target_name string")
    design.manifest(plan, path, "b1")
    design.manifest(spark.createDataFrame([(2, "C")], plan.schema), path, "b1")
    design.manifest(spark.createDataFrame([(3, "C")], plan.schema), path, "b2")
    rows = {(r["batch_id"], r["design_id"], r["target_name"], r["file"]) for r in spark.read.parquet(path).collect()}
    assert rows == {("b1", 1, "A B", "A_B.png"), ("b1", 2, "C", "C.png"), ("b2", 3, "C", "C.png")}


def test_last_results_are_whole_rows(spark):
    rows = spark.createDataFrame([(1, "A", 1, "x", None), (1, "A", 3, None, 4), (1, "B", 2, "z", 5), (2, "A", 1, "w", 6)], "design_id long, target_name string, seq int, note string, n int")
    assert sorted(map(tuple, report.last_result_per_name(rows).select(*rows.columns).collect())) == [(1, "A", 3, None, 4), (1, "B", 2, "z", 5), (2, "A", 1, "w", 6)]


def plain_fold(steps):
    acc = (255, 255, 255, 255)
    for kind, r, g, b, a in steps:
        s = (r, g, b, a)
        if kind == "background":
            acc = s
        elif kind == "overlay":
            al = a * 255 + acc[3] * (255 - a)
            acc = (*(math.floor((v * a * 255 + o * acc[3] * (255 - a)) / al + 0.5) if al else 0 for v, o in zip(s[:3], acc)), math.floor(al / 255 + 0.5))
        else:
            acc = tuple((v * a + o * (255 - a) + 127) // 255 for v, o in zip(s, acc))
    return acc


def test_hidden_steps_are_dropped(spark):
    rng = random.Random(4)
    canvas = spark.createDataFrame([(1, y, x, 255, 255, 255, 255) for y in range(3) for x in range(4)], "image_id long, y int, x int, r int, g int, b int, a int")
    steps = [(1, s, rng.choice(["background", "overlay", "content", "content"]), rng.randrange(-1, 4), rng.randrange(5), *(rng.randrange(256) for _ in range(3)), rng.choice([0, 100, 255, 255])) for s in range(300)]
    layers = spark.createDataFrame(steps, "image_id long, step int, kind string, y int, x int, r int, g int, b int, a int")
    got = {(r["y"], r["x"]): tuple(r[c] for c in "rgba") for r in raster.paste_steps(canvas, layers).collect()}
    assert got == {(y, x): plain_fold([(s[2], *s[5:]) for s in steps if s[3:5] == (y, x)]) for y in range(3) for x in range(4)}
    opaque = spark.range(1000).select(F.lit(1).cast("long").alias("image_id"), F.col("id").cast("int").alias("step"), F.lit("content").alias("kind"), F.lit(0).alias("y"), F.lit(0).alias("x"), (F.col("id") % 256).cast("int").alias("r"), F.lit(2).alias("g"), F.lit(3).alias("b"), F.lit(255).alias("a"))
    done = raster.paste_steps(canvas.where("y = 0 AND x = 0"), opaque)
    assert tuple(done.first()) == (1, 0, 0, 999 % 256, 2, 3, 255)


@pytest.mark.parametrize("fill", ["repeat", "feather"])
def test_solid_flat_images_stay_solid(spark, fill):
    """One colour in, one colour out, on every preset (a twentieth of its size) and in all kinds of plans."""
    targets = spark.createDataFrame([(i, n, w // 20, h // 20) for i, (n, w, h) in enumerate(catalogs.PRESETS)] + [(20, "same", 9, 6), (21, "blank", 4, 3)], "seq int, name string, width int, height int")
    sizes = {1: (9, 6), 2: (40, 21), 3: (3, 30), 4: (1, 1), 5: (0, 0)}
    layers = spark.createDataFrame([(d, 0, "e", "Source Image", w, h, "photo", 5, 0, 0, w, h, True, True, 0, 1.0, 1, "flat_image") for d, (w, h) in sizes.items()], LAYER)
    plan = compose.compose_plan(layers, targets, "smart" if fill == "repeat" else "contain")
    kinds = {r["kind"] for r in plan.select("kind").distinct().collect()}
    assert kinds == {"cover" if fill == "repeat" else "contain", "extend", "blank"}
    pixels = spark.createDataFrame([(d, "e", y, x, 255, 0, 255, 255) for d, (w, h) in sizes.items() for y in range(h) for x in range(w)], "design_id long, element_id string, y int, x int, r int, g int, b int, a int")
    images = spark.createDataFrame([(d, "e", w, h) for d, (w, h) in sizes.items()], "design_id long, element_id string, src_w int, src_h int")
    out = raster.render(plan, pixels, images, fill)
    n = {(r["design_id"], r["seq"]): r["count"] for r in out.groupBy("design_id", "seq").count().collect()}
    want = {r["seq"]: r["width"] * r["height"] for r in targets.collect()}
    assert n == {(d, s): c for d in sizes for s, c in want.items()}
    assert out.where("design_id = 5 AND NOT (r = 255 AND g = 255 AND b = 255)").count() == 0
    off = out.where("design_id < 5 AND NOT (r = 255 AND g = 0 AND b = 255)")
    if fill == "repeat":  # but for a cover that falls short by a pixel through rounding, whose rim is zero
        short = {(r["design_id"], r["seq"]) for r in plan.where("kind = 'cover' AND (image_w < target_w OR image_h < target_h)").collect()}
        assert {(r["design_id"], r["seq"]) for r in off.collect()} <= short
    else:  # the soft seam darkens what was added near the image, and nothing gets lighter or greener
        assert 0 < off.count() < out.count() / 2 and off.where("g > 0 OR r <> b").count() == 0
