"""Rows multiply after the last sort: plans of layouts, draws and masks on many designs."""

import random

import pytest
from pyspark.sql import functions as F
from test_plain import LAYER, SIZES, random_designs

from adloom.operators import compose, layout, raster


@pytest.fixture(scope="module")
def given(spark):
    layers = spark.createDataFrame([tuple(r.values()) for r in random_designs(random.Random(31), 80)], LAYER)
    return layers, spark.createDataFrame([(i, f"t{i % 9}", w, h) for i, (w, h) in enumerate(SIZES)], "seq int, name string, width int, height int")


def same(a, b):
    names = sorted(b.columns)
    return sorted(map(str, a.select(*names).collect())) == sorted(map(str, b.select(*names).collect()))


def nodes(df):
    return [line.strip(" :+-*()0123456789") for line in df._jdf.queryExecution().sparkPlan().toString().splitlines()]


def test_ranks_in_columns_equal_ranks_in_rows(given):
    layers, _ = given
    names = ["square", "landscape", "portrait"]
    names_of = ["design_id", "k", "template", "zone", "rank", "section", "result_pos"]
    assert same(layout.ranked_by_template(layers, names).select(*names_of), layout._ranked_by_rows(layers, names, None).select(*names_of))
    plan = nodes(layout.ranked_by_template(layers, names))
    after = plan[: max(i for i, n in enumerate(plan) if n.startswith("Generate"))]  # plans are printed from the result down
    assert not any(n.startswith(("Window", "Sort", "Exchange")) for n in after)


def test_steps_by_design_equal_steps_by_placement(given):
    layers, targets = given
    placed = layout.calculate_layout(layers, targets)
    bare = placed.drop(*[c for c in placed.columns if c.startswith("bg_")])
    assert same(compose.draw_steps(layers, targets), compose.draw_plan(bare))
    assert same(compose.overlay_steps(layers, targets), compose.overlay_plan(bare))
    assert same(compose.background_plan(placed), compose.background_plan(bare))
    plan = nodes(compose.draw_steps(layers, targets))
    after = plan[: next(i for i, n in enumerate(plan) if "NestedLoopJoin" in n or n.startswith("CartesianProduct"))]
    assert not any(n.startswith(("Window", "Sort", "HashAgg", "ObjectHash")) for n in after)


def test_results_of_the_latest_target_of_a_name(given):
    layers, targets = given
    every = compose.with_kind(layout.calculate_layout(layers, targets)).groupBy("design_id", "seq", "target_name", "target_w", "target_h").agg(F.count("*").cast("int").alias("n_placed"), F.count_if("visible").cast("int").alias("n_visible"), F.count("kind").cast("int").alias("n_drawn"))
    assert same(compose.batch_results(layers, targets), every)
    assert same(compose.last_results(layers, targets), every.where("seq > 1"))  # t0 and t1 come again


def test_masks_of_rows_that_share_a_key(spark):
    sizes = spark.createDataFrame([(1, 5, 4), (2, 1, 1), (3, 30, 17)], "id int, w int, h int")
    rows = raster.feather_rows(sizes, 6)
    assert rows.count() == 4 + 1 + 17
    assert same(rows.select("id", "y", F.posexplode("values").alias("x", "value")), raster.feather_mask(sizes, 6).select("id", "y", "x", "value"))
    want = {(y, x): 255 if min(x, 29 - x, y, 16 - y) >= 6 else int(255.0 * min(x, 29 - x, y, 16 - y) / 6) for y in range(17) for x in range(30)}
    assert {(r["y"], r["x"]): r["value"] for r in raster.feather_mask(sizes, 6).where("id = 3").collect()} == want
