"""Resampling by lines, blur by tiles and blends against plain versions written from the rules alone."""

import math
import random

from pyspark.sql import functions as F

from adloom.operators import raster

SCHEMA = "image_id long, y int, x int, r int, g int, b int, a int"


def image(w, h, seed, opaque=False):
    rng = random.Random(seed)
    return {(y, x): [rng.randrange(256) for _ in range(3)] + [255 if opaque else rng.choice((0, 77, 255))] for y in range(h) for x in range(w)}


def frame(spark, images):
    return spark.createDataFrame([(i, y, x, *v) for i, px in images.items() for (y, x), v in px.items()], SCHEMA)


def places_of(df):
    out = {}
    for r in df.collect():
        assert (r["y"], r["x"]) not in out.setdefault(r["image_id"], {})
        out[r["image_id"]][r["y"], r["x"]] = [r["r"], r["g"], r["b"], r["a"]]
    return out


def half_up(v):
    """Rounded at six digits, then to a whole number, halves away from zero."""
    return int(math.floor(round(v, 6) + 0.5))


def plain_blur(px, w, h, radius):
    reach = math.ceil(3 * radius)
    raw = [math.exp(-d * d / (2 * radius * radius)) for d in range(-reach, reach + 1)]
    weights = [v / sum(raw) for v in raw]
    hold = lambda v, n: min(max(v, 0), n - 1)
    zero = [0, 0, 0, 0]
    across = {(y, x): [sum(wt * px.get((y, hold(x + d - reach, w)), zero)[c] for d, wt in enumerate(weights)) for c in range(4)] for y in range(h) for x in range(w)}
    return {(y, x): [half_up(sum(wt * across[hold(y + d - reach, h), x][c] for d, wt in enumerate(weights))) for c in range(4)] for y in range(h) for x in range(w)}


def plain_line(values, dst):
    """A line of (r, g, b, a) at another length."""
    src = len(values)
    scale = src / dst
    wide = max(scale, 1.0)
    out = []
    for i in range(dst):
        centre = (i + 0.5) * scale
        span = range(max(0, int(centre - 3 * wide)), min(src, math.ceil(centre + 3 * wide)))
        weight = {}
        for j in span:
            u = (j + 0.5 - centre) / wide
            weight[j] = 1.0 if u == 0 else 0.0 if abs(u) >= 3 else 3 * math.sin(math.pi * u) * math.sin(math.pi * u / 3) / (math.pi * u) ** 2
        total = sum(weight.values())
        out.append([sum(wt * values[j][c] for j, wt in weight.items()) / total for c in range(4)])
    return out


def plain_resample(px, w, h, to_w, to_h):
    decode = lambda v: int(255 * math.pow(v / 255, 2.2))
    encode = lambda v: int(255 * math.pow(v / 255, 1 / 2.2))
    hold = lambda v: min(255, max(0, half_up(v)))
    rows = [plain_line([[decode(v) * px[y, x][3] / 255 for v in px[y, x][:3]] + [px[y, x][3]] for x in range(w)], to_w) for y in range(h)]
    columns = [plain_line([rows[y][x] for y in range(h)], to_h) for x in range(to_w)]
    return {(y, x): [encode(hold(v * 255 / columns[x][y][3])) if columns[x][y][3] > 0 else 0 for v in columns[x][y][:3]] + [hold(columns[x][y][3])] for y in range(to_h) for x in range(to_w)}


def near(got, want, off=0):
    assert got.keys() == want.keys()
    return all(abs(a - b) <= off for at in want for a, b in zip(got[at], want[at]))


def test_blur_crosses_tiles(spark):
    sizes = {1: (raster.TILE * 2 + 5, 9), 2: (3, raster.TILE + 1), 3: (1, 1), 4: (raster.TILE, raster.TILE), 5: (12, 7)}
    images = {i: image(w, h, i) for i, (w, h) in sizes.items()}
    del images[5][3, 4], images[5][0, 0]  # places without a pixel count as zero
    table = spark.createDataFrame([(i, w, h) for i, (w, h) in sizes.items()], "image_id long, width int, height int")
    got = places_of(raster.blur(frame(spark, images), table, 3))
    for i, (w, h) in sizes.items():
        assert near(got[i], plain_blur(images[i], w, h, 3))


def test_blur_of_nothing(spark):
    table = spark.createDataFrame([(1, 3, 3)], "image_id long, width int, height int")
    assert raster.blur(spark.createDataFrame([], SCHEMA), table, 3).count() == 0


def test_filters_shuffle_once_an_axis(spark):
    px = frame(spark, {1: image(4, 4, 1)})
    one = F.broadcast(spark.createDataFrame([(1, 4, 4, 4, 4)], "image_id long, src_w int, src_h int, width int, height int"))
    for df, most in ((raster.blur(px, one, 3), 1), (raster.resample(px, one), 2)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") <= most + plan.count("LeftSemi")


def test_resample_by_lines(spark):
    sizes = {1: (9, 5, 4, 11), 2: (1, 1, 3, 2), 3: (40, 3, 1, 1), 4: (6, 6, 6, 6)}
    images = {i: image(w, h, i, opaque=i % 2 == 0) for i, (w, h, _, _) in sizes.items()}
    table = spark.createDataFrame([(i, *v) for i, v in sizes.items()], "image_id long, src_w int, src_h int, width int, height int")
    got = places_of(raster.resample(frame(spark, images), table))
    for i, v in sizes.items():
        want = plain_resample(images[i], *v)
        assert got[i].keys() == want.keys()
        assert all(got[i][at][3] == want[at][3] for at in want)
        assert sum(got[i][at] != want[at] for at in want) <= len(want) // 50  # a half that falls otherwise


def test_blend_over_a_soft_seam(spark):
    """Boxes inside, at and over the borders, and empty ones."""
    w, h = 30, 21
    boxes = {1: (5, 4, 20, 15), 2: (0, 0, w, h), 3: (-3, 2, 8, h + 4), 4: (6, 6, 6, 9), 5: (29, 20, 30, 21)}
    fill, own = {i: image(w, h, i) for i in boxes}, {i: image(w, h, i + 50) for i in boxes}
    table = spark.createDataFrame([(i, w, h, *v) for i, v in boxes.items()], "image_id long, width int, height int, x1 int, y1 int, x2 int, y2 int")
    got = places_of(raster.feather_blend(frame(spark, fill), frame(spark, own), table, 8))
    weights = raster.gaussian_weights(8)
    hold = lambda v, n: min(max(v, 0), n - 1)
    for i, (x1, y1, x2, y2) in boxes.items():
        for (y, x), value in got[i].items():
            mx = my = 0.0
            for d, wt in weights:
                mx += wt if x1 <= hold(x + d, w) < x2 else 0.0
                my += wt if y1 <= hold(y + d, h) < y2 else 0.0
            inside = x1 <= x < x2 and y1 <= y < y2
            want = [min(255, max(0, int((own[i][y, x][c] if inside else 0) * (mx * my) + fill[i][y, x][c] * (1.0 - mx * my)))) for c in range(3)]
            assert value == [*want, fill[i][y, x][3]], (i, y, x)


def test_only_the_wanted_part_is_made(spark):
    """A part of a resampled image equals the same part of the whole, and steps keep only what the canvas shows."""
    px = frame(spark, {1: image(9, 5, 3), 2: image(4, 4, 8)})
    table = spark.createDataFrame([(1, 9, 5, 40, 30, 7, 12, 29, 30), (2, 4, 4, 3, 9, 0, 3, 2, 4)], "image_id long, src_w int, src_h int, width int, height int, x_from int, x_to int, y_from int, y_to int")
    whole = raster.resample(px, table.select("image_id", "src_w", "src_h", "width", "height")).join(table, "image_id").where("x >= x_from AND x < x_to AND y >= y_from AND y < y_to").select("image_id", "y", "x", *"rgba")
    got = raster.resample(px, table).collect()
    assert len(got) == 5 + 6 and sorted(map(tuple, got)) == sorted(map(tuple, whole.collect()))
    steps = spark.createDataFrame(
        [("content", -5, 2, 3000, 4000), ("content", 16, 0, 4, 4), ("content", -9, 0, 9, 4), ("background", -30, 0, 20, 9), ("extend", 2, 3, 4, 2), ("cover", -700, 0, 1416, 9)],
        "kind string, x int, y int, w int, h int",
    ).withColumns({"target_w": F.lit(16), "target_h": F.lit(9)})
    kept = [tuple(r) for r in raster.on_canvas(steps).select("kind", "x_from", "x_to", "y_from", "y_to").collect()]
    assert kept == [("content", 5, 21, 0, 7), ("background", 19, 20, 0, 9), ("extend", 0, 4, 0, 2), ("cover", 700, 716, 0, 9)]
