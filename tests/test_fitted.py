"""Small flat sources drawn within a row, against the same plans drawn place by place."""

import random

import pytest
from pyspark.sql import functions as F
from test_features import LAYER
from test_growth import nodes, same
from test_tiles import image

from adloom.operators import compose, raster

PIXELS = "design_id long, element_id string, y int, x int, r int, g int, b int, a int"
SIZES = {1: (9, 6), 2: (40, 21), 3: (3, 30), 4: (1, 1), 5: (0, 0), 6: (80, 60), 7: (5, 4), 8: (7, 7), 9: (6, 2)}
TARGETS = [(1, "Wide", 16, 9), (2, "Tall", 7, 14), (3, "Square", 12, 12), (4, "same", 9, 6), (5, "line", 30, 1), (6, "large", 70, 61)]


def given(spark, sizes=SIZES, mode="smart"):
    """Plan, pixels and sizes: 7 has no pixels, 8 lacks some, 9 isn't among the images."""
    layers = spark.createDataFrame([(d, 0, "e", "Source Image", w, h, "photo", 5, 0, 0, w, h, True, True, 0, 1.0, 1, "flat_image") for d, (w, h) in sizes.items()], LAYER)
    plan = compose.compose_plan(layers, spark.createDataFrame(TARGETS, "seq int, name string, width int, height int"), mode)
    rng = random.Random(17)
    px = [(d, "e", y, x, *v) for d, (w, h) in sizes.items() if d != 7 for (y, x), v in image(w, h, d, opaque=d == 2).items() if d != 8 or rng.random() < 0.6]
    return plan, spark.createDataFrame(px, PIXELS), spark.createDataFrame([(d, "e", *v) for d, v in sizes.items() if d != 9], "design_id long, element_id string, src_w int, src_h int")


@pytest.mark.parametrize(("mode", "fill"), [("smart", "repeat"), ("cover", "repeat"), ("contain", "repeat"), ("contain", "feather")])
def test_small_sources_equal_drawing_by_place(spark, monkeypatch, mode, fill):
    plan, px, images = given(spark, mode=mode)
    got = raster.render(plan, px, images, fill).localCheckpoint()
    assert got.count() == len(SIZES) * sum(w * h for _, _, w, h in TARGETS)
    monkeypatch.setattr(raster, "_SMALL", "false")
    assert same(got, raster.render(plan, px, images, fill))


def test_boxes_anywhere(spark, monkeypatch):
    """Fitted images beside, over and off the canvas, and one that isn't alone on it."""
    rng = random.Random(5)
    steps = [(d, 1, 13, 11, 0, rng.choice(["extend", "cover", "contain"]), "e", rng.randrange(-9, 16), rng.randrange(-9, 14), rng.randrange(1, 20), rng.randrange(1, 20), 1.0) for d in range(40)]
    steps += [(0, 1, 13, 11, 1, "content", "e", 2, 3, 4, 4, 0.5)]
    plan = spark.createDataFrame(steps, "design_id long, seq int, target_w int, target_h int, step int, kind string, element_id string, image_x int, image_y int, image_w int, image_h int, opacity double")
    px = spark.createDataFrame([(d, "e", y, x, *v) for d in range(40) for (y, x), v in image(5, 4, d).items()], PIXELS)
    images = spark.range(40).select(F.col("id").alias("design_id"), F.lit("e").alias("element_id"), F.lit(5).alias("src_w"), F.lit(4).alias("src_h"))
    got = raster.render(plan, px, images).localCheckpoint()
    assert got.count() == 40 * 13 * 11
    monkeypatch.setattr(raster, "_SMALL", "false")
    assert same(got, raster.render(plan, px, images))


def test_nothing_is_shuffled_by_place(spark):
    """Rows multiply to places at the end: no sort, window, grouping or exchange of them."""
    plan, px, images = given(spark, {1: (9, 6), 2: (8, 7), 3: (3, 5)})
    plan = nodes(raster.render(plan.where("seq < 6"), px, images))
    after = plan[: next(i for i, n in enumerate(plan) if n.startswith("Generate"))]
    assert not any(n.startswith(("Window", "Sort", "Exchange", "HashAgg", "ObjectHash", "BroadcastHashJoin")) for n in after)
