"""Raster operators on pixel tables (image_id, y, x, r, g, b, a), one row a pixel.

Sizes, rectangles and offsets come from a geometry table with one row an image, so images
of any sizes go through one job; it is joined by image (Spark broadcasts it if it is
small).  Filters work within lines (resampling) or tiles with a border (blur), by array
functions, so there is no row a tap and no table of weights.  Pixels are gathered by image
only where image and canvas are no larger than a tile, so a large one spreads over tasks.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import catalogs
from ..sources.shared import cut
from .fitted import GEOMETRY, drawn

CHANNELS = ("r", "g", "b")

#: Side of the tiles that a blur is computed on.
TILE = 64


def _curve(c: Column, power: float) -> Column:
    """trunc(255 * (v / 255) ** power), by a table of 256 values."""
    values = [int(255 * math.pow(v / 255, power)) for v in range(256)]
    return F.get(F.expr(f"array({', '.join(map(str, values))})"), c)


def gamma_decode(pixels: DataFrame) -> DataFrame:
    return pixels.withColumns({c: _curve(F.col(c), catalogs.GAMMA) for c in CHANNELS})


def gamma_encode(pixels: DataFrame) -> DataFrame:
    return pixels.withColumns({c: _curve(F.col(c), 1 / catalogs.GAMMA) for c in CHANNELS})


def _gathered(rows: DataFrame, keys: list[str], place: Column, n: str) -> DataFrame:
    """One row a group with s, its pixels by their place 0..n-1; places without a pixel are zero."""
    out = rows.select(*keys, F.struct(place.cast("int").alias("p"), *[F.col(c).cast("double").alias(c) for c in "rgba"]).alias("e"))
    out = out.groupBy(*keys).agg(F.sort_array(F.collect_list("e")).alias("s"))
    zero = "named_struct('p', p, " + ", ".join(f"'{c}', CAST(0 AS DOUBLE)" for c in "rgba") + ")"
    absent = f"transform(array_except(sequence(0, {n} - 1), transform(s, e -> e.p)), p -> {zero})"
    return out.withColumn("s", F.expr(f"CASE WHEN size(s) = {n} THEN s ELSE sort_array(concat(s, {absent})) END"))


def lanczos_spans(src: str, dst: str, taps: int = 3, first: str = "0", end: str | None = None) -> str:
    """An array of (low, w, total) for each place first..end-1 of a line of dst pixels made from src: what it takes from place low on."""
    scale = f"({src} / CAST({dst} AS DOUBLE))"
    wide = f"greatest({scale}, CAST(1 AS DOUBLE))"
    value = (
        f"CASE WHEN u = 0 THEN CAST(1 AS DOUBLE) WHEN abs(u) >= {taps} THEN CAST(0 AS DOUBLE) "
        f"ELSE {taps} * sin(pi() * u) * sin(pi() * u / {taps}) / (pi() * u * pi() * u) END"
    )
    low, high = f"greatest(0, CAST(c - {taps} * {wide} AS INT))", f"least({src}, CAST(ceil(c + {taps} * {wide}) AS INT)) - 1"
    centres = f"transform(sequence({first}, {end or dst} - 1), i -> (i + CAST(0.5 AS DOUBLE)) * {scale})"
    parts = f"transform({centres}, c -> named_struct('low', {low}, 'w', transform(transform(sequence({low}, {high}), j -> (j + CAST(0.5 AS DOUBLE) - c) / {wide}), u -> {value})))"
    return f"transform({parts}, t -> named_struct('low', t.low, 'w', t.w, 'total', aggregate(t.w, CAST(0 AS DOUBLE), (acc, v) -> acc + v)))"


def resample(pixels: DataFrame, sizes: DataFrame) -> DataFrame:
    """Size change in linear light with alpha-weighted colours, by (image_id, src_w, src_h, width, height); no side or less: unchanged.

    One axis after the other, each by gathering the lines along it: a row a pixel is
    shuffled, whatever the number of taps, and a task holds a line at a time.  Sums are
    rounded at six digits and then to whole numbers, so their order doesn't matter.
    Sizes may name the part of the result that is wanted, x_from..x_to-1 by y_from..y_to-1
    (at least a place): only that is made.
    """
    part = ["x_from", "x_to", "y_from", "y_to"]
    whole = {"x_from": F.lit(0), "x_to": F.col("width"), "y_from": F.lit(0), "y_to": F.col("height")}
    sizes = sizes.withColumns({c: v for c, v in whole.items() if c not in sizes.columns}).select("image_id", "src_w", "src_h", "width", "height", *part)
    same = pixels.join(sizes.where("width <= 0 OR height <= 0").select("image_id"), "image_id", "left_semi")
    linear = gamma_decode(pixels.join(sizes.where("width > 0 AND height > 0 AND src_w > 0 AND src_h > 0"), "image_id")).withColumns({c: F.col(c) * F.col("a") / 255.0 for c in CHANNELS})
    for axis, src, dst, other, rest in (("x", "src_w", "width", "y", ["src_h", "height", "y_from", "y_to"]), ("y", "src_h", "height", "x", [])):
        first, end = f"{axis}_from", f"{axis}_to"
        lines = _gathered(linear, ["image_id", other, src, dst, first, end, *rest], F.col(axis), src)
        lines = lines.withColumns({f"_{c}": F.expr(f"transform(s, e -> e.{c})") for c in "rgba"})
        sums = ", ".join(f"'{c}', aggregate(zip_with(slice(_{c}, t.low + 1, size(t.w)), t.w, (v, w) -> v * w), CAST(0 AS DOUBLE), (acc, v) -> acc + v) / t.total" for c in "rgba")
        out = F.expr(f"transform({lanczos_spans(src, dst, first=first, end=end)}, t -> named_struct({sums}))")
        linear = lines.select("image_id", other, first, *rest, F.posexplode(out).alias("_at", "e")).select("image_id", other, (F.col("_at") + F.col(first)).alias(axis), *rest, "e.*")
    held = lambda c: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.round(F.round(c, 6)))).cast("int")  # noqa: E731  # by an alpha of nearly 0, a colour can pass any integer
    alpha = held(F.col("a"))
    out = linear.withColumns({c: F.when(F.col("a") > 0, held(F.col(c) * 255.0 / F.col("a"))).otherwise(F.lit(0)) for c in CHANNELS}).withColumn("a", alpha)
    return gamma_encode(out).select("image_id", "y", "x", "r", "g", "b", "a").unionByName(same.select("image_id", "y", "x", "r", "g", "b", "a"))


def places(sizes: DataFrame) -> DataFrame:
    """sizes with a row for each place (y, x) of width x height: rows first, then columns."""
    rows = sizes.where("width > 0 AND height > 0").withColumn("y", F.explode(F.expr("sequence(0, height - 1)")))
    return rows.withColumn("x", F.explode(F.expr("sequence(0, width - 1)")))


def blank_canvas(sizes: DataFrame, rgba: tuple[int, int, int, int] = (255, 255, 255, 255)) -> DataFrame:
    """A canvas of one colour for each (image_id, width, height)."""
    return places(sizes.select("image_id", "width", "height")).select("image_id", "y", "x", *[F.lit(v).alias(c) for c, v in zip("rgba", rgba)])


def crop(pixels: DataFrame, rects: DataFrame) -> DataFrame:
    """The rectangle (image_id, src_w, src_h, x0, y0, width, height) of each image; places outside the image are zero."""
    rects = rects.select("image_id", "src_w", "src_h", "x0", "y0", "width", "height")
    inside = pixels.join(rects, "image_id").withColumns({"x": F.col("x") - F.col("x0"), "y": F.col("y") - F.col("y0")}).where("x >= 0 AND y >= 0 AND x < width AND y < height")
    beyond = places(rects).where("x + x0 < 0 OR y + y0 < 0 OR x + x0 >= src_w OR y + y0 >= src_h")
    return inside.select("image_id", "y", "x", *"rgba").unionByName(beyond.select("image_id", "y", "x", *[F.lit(0).alias(c) for c in "rgba"]))


def extend_edges(pixels: DataFrame, frames: DataFrame) -> DataFrame:
    """The image at (dx, dy) on a canvas (image_id, src_w, src_h, width, height, dx, dy); outside, the nearest edge pixel.

    An edge pixel goes to all places it is the nearest of, so nothing is joined but the frames.
    """
    rows = pixels.join(frames.select("image_id", "src_w", "src_h", "width", "height", "dx", "dy"), "image_id")
    for axis, src, size, d in (("y", "src_h", "height", "dy"), ("x", "src_w", "width", "dx")):
        first = F.when(F.col(axis) == 0, 0).otherwise(F.greatest(F.lit(0), F.col(axis) + F.col(d)))
        last = F.when(F.col(axis) == F.col(src) - 1, F.col(size) - 1).otherwise(F.least(F.col(size) - 1, F.col(axis) + F.col(d)))
        rows = rows.withColumns({"_a": first, "_b": last}).where("_a <= _b").withColumn(axis, F.explode(F.sequence("_a", "_b")))
    return rows.select("image_id", "y", "x", *"rgba")


def gaussian_weights(radius: float) -> list[tuple[int, float]]:
    reach = int(math.ceil(3 * radius))
    raw = [(d, math.exp(-d * d / (2 * radius * radius))) for d in range(-reach, reach + 1)]
    total = sum(w for _, w in raw)
    return [(d, w / total) for d, w in raw]


def blur(pixels: DataFrame, sizes: DataFrame, radius: float) -> DataFrame:
    """Gaussian blur of images (image_id, width, height), one axis after the other, with the border repeated.

    A pixel goes to each tile whose places it reaches, so one shuffle brings tiles with
    their borders together and both axes are summed within a tile; places without a pixel
    count as zero.  Sums are rounded at six digits and then to whole numbers, so their
    order doesn't matter.
    """
    weights = [w for _, w in gaussian_weights(radius)]
    reach = len(weights) // 2
    rows = pixels.join(sizes.select("image_id", "width", "height"), "image_id")
    for axis, size in (("y", "height"), ("x", "width")):
        first = F.when(F.col(axis) == 0, -reach).otherwise(F.col(axis))
        last = F.when(F.col(axis) == F.col(size) - 1, F.col(size) - 1 + reach).otherwise(F.col(axis))
        rows = rows.withColumn(f"_{axis}", F.explode(F.sequence(first, last)))  # the border repeated
        tiles = f"sequence(greatest(0, CAST(floor((_{axis} - {reach}) / {TILE}) AS INT)), least(CAST(floor(({size} - 1) / {TILE}) AS INT), CAST(floor((_{axis} + {reach}) / {TILE}) AS INT)))"
        rows = rows.withColumn(f"t{axis}", F.explode(F.expr(tiles)))
    across, down = f"least({TILE}, width - tx * {TILE})", f"least({TILE}, height - ty * {TILE})"
    wide, high = f"({across} + {2 * reach})", f"({down} + {2 * reach})"
    rows = _gathered(rows, ["image_id", "ty", "tx", "width", "height"], F.expr(f"(_y - ty * {TILE} + {reach}) * {wide} + _x - tx * {TILE} + {reach}"), f"({wide} * {high})")
    total = lambda at: " + ".join(f"CAST({w!r} AS DOUBLE) * {at.format(k=k)}" for k, w in enumerate(weights))
    along_x, along_y = total("get(line, x + {k})"), total("get(get(_{{c}}, y + {k}), x)")
    rows = rows.withColumns({f"_{c}": F.expr(f"transform(transform(sequence(0, {high} - 1), j -> transform(slice(s, j * {wide} + 1, {wide}), e -> e.{c})), line -> transform(sequence(0, {across} - 1), x -> {along_x}))") for c in "rgba"})
    sums = {c: F.expr(f"flatten(transform(sequence(0, {down} - 1), y -> transform(sequence(0, {across} - 1), x -> CAST(round(round({along_y.replace('{c}', c)}, 6)) AS INT))))") for c in "rgba"}
    out = rows.select("image_id", "ty", "tx", F.expr(across).alias("n"), F.posexplode(F.arrays_zip(*[v.alias(c) for c, v in sums.items()])).alias("p", "e"))
    return out.select("image_id", F.expr(f"ty * {TILE} + p div n").cast("int").alias("y"), F.expr(f"tx * {TILE} + p % n").cast("int").alias("x"), *[F.col(f"e.{c}").alias(c) for c in "rgba"])


def blur_outside(pixels: DataFrame, boxes: DataFrame, radius: float = 3) -> DataFrame:
    """Blurred, with the box of (image_id, width, height, x1, y1, x2, y2) left sharp."""
    soft = blur(pixels, boxes, radius).join(boxes.select("image_id", "x1", "y1", "x2", "y2"), "image_id").where(f"NOT ({_INSIDE})")
    sharp = pixels.join(boxes.select("image_id", "x1", "y1", "x2", "y2"), "image_id").where(_INSIDE)
    return sharp.select("image_id", "y", "x", *"rgba").unionByName(soft.select("image_id", "y", "x", *"rgba"))


_INSIDE = "x >= x1 AND x < x2 AND y >= y1 AND y < y2"


def box_mask(axis: str, size: str, feather: float) -> Column:
    """Share of the blurred box along an axis at a place: the taps that fall on the box, the border repeated.

    The taps on the box are neighbours, so their sum is looked up by the first and the last of them.
    """
    weights = [w for _, w in gaussian_weights(feather)]
    n, reach = len(weights), len(weights) // 2
    sums = [list(itertools.accumulate(weights[i:], initial=0.0)) for i in range(n + 1)]  # sums[i][k]: k taps from the i-th on
    table = F.expr("array(" + ", ".join("array(" + ", ".join(f"{v!r}D" for v in row) + ")" for row in sums) + ")")
    held = lambda c: F.greatest(F.lit(0), F.least(F.lit(n), c))
    low, high, at = F.col(f"{axis}1"), F.col(f"{axis}2"), F.col(axis)
    first = F.when(low <= 0, 0).when(low >= F.col(size), n).otherwise(held(low - at + reach))
    last = F.when(high >= F.col(size), n).when(high <= 0, 0).otherwise(held(high - at + reach))
    return F.get(F.get(table, first), F.greatest(F.lit(0), last - first))


def feather_blend(fill: DataFrame, original: DataFrame, boxes: DataFrame, feather: float = 8) -> DataFrame:
    """original * mask + fill * (1 - mask); the mask is the blurred box of (image_id, width, height, x1, y1, x2, y2), original is 0 outside it."""
    both = fill.join(boxes.select("image_id", "width", "height", "x1", "y1", "x2", "y2"), "image_id")
    both = both.join(original.select("image_id", "y", "x", *[F.col(c).alias(f"_{c}") for c in CHANNELS]), ["image_id", "y", "x"], "left")
    both = both.withColumns({"mx": box_mask("x", "width", feather), "my": box_mask("y", "height", feather)})
    mask = F.col("mx") * F.col("my")
    mixed = lambda c: (F.when(F.expr(_INSIDE), F.coalesce(F.col(f"_{c}"), F.lit(0))).otherwise(0) * mask + F.col(c) * (F.lit(1.0) - mask)).cast("int")
    return both.select("image_id", "y", "x", *[F.least(F.lit(255), F.greatest(F.lit(0), mixed(c))).alias(c) for c in CHANNELS], "a")


def feather_rows(sizes: DataFrame, feather: int = 30) -> DataFrame:
    """A row for each mask (w x h, with what else the row has) and y, with values: least over the edges of int(255 * d / feather), else 255."""
    f = F.least(F.lit(feather), F.floor(F.col("w") / 2), F.floor(F.col("h") / 2))
    rows = sizes.withColumn("_f", f).withColumn("y", F.explode(F.expr("sequence(0, h - 1)")))
    rows = rows.withColumn("_dy", F.least(F.col("y"), F.col("h") - 1 - F.col("y")))
    value = "CASE WHEN _f <= 0 OR d >= _f THEN 255 ELSE CAST(CAST(255 AS DOUBLE) * (d / CAST(_f AS DOUBLE)) AS INT) END"
    return rows.select(*sizes.columns, "y", F.expr(f"transform(transform(sequence(0, w - 1), x -> least(x, w - 1 - x, _dy)), d -> {value})").alias("values"))


def feather_mask(sizes: DataFrame, feather: int = 30) -> DataFrame:
    """value of each place of a w x h mask (with what else the row has), as in ``feather_rows``."""
    return feather_rows(sizes, feather).select(*sizes.columns, "y", F.posexplode("values").alias("x", "value"))


def apply_opacity(pixels: DataFrame, opacity: str = "opacity") -> DataFrame:
    return pixels.withColumn("a", F.when(F.col(opacity) < 1, (F.col("a") * F.col(opacity)).cast("int")).otherwise(F.col("a")))


#: One place of a canvas (acc) with one pixel (s) of a source on it, by the kind of the step.
_MIX = "CAST(floor((s.{c} * s.a + acc.{c} * (255 - s.a) + 127) / 255) AS INT)"
_ALPHA = "(s.a * 255 + acc.a * (255 - s.a))"
_OVER = f"CASE WHEN {_ALPHA} > 0 THEN CAST(floor((s.{{c}} * s.a * 255 + acc.{{c}} * acc.a * (255 - s.a)) / {_ALPHA} + CAST(0.5 AS DOUBLE)) AS INT) ELSE 0 END"
_FOLD = (
    "named_struct("
    + ", ".join(f"'{c}', CASE s.kind WHEN 'background' THEN s.{c} WHEN 'overlay' THEN {_OVER.format(c=c)} ELSE {_MIX.format(c=c)} END" for c in CHANNELS)
    + f", 'a', CASE s.kind WHEN 'background' THEN s.a WHEN 'overlay' THEN CAST(floor({_ALPHA} / 255 + CAST(0.5 AS DOUBLE)) AS INT) ELSE {_MIX.format(c='a')} END)"
)


def paste_steps(canvas: DataFrame, layers: DataFrame) -> DataFrame:
    """Draw layers (image_id, step, kind, y, x, r, g, b, a) on a canvas in the order of their steps.

    A background replaces, an overlay goes over (source-over), content is mixed in by its
    alpha, channel by channel.  One grouping by place serves any number of steps: what an
    opaque step hides is dropped before the fold (a window over the same partitions), so a
    place holds an entry for each translucent step above the last opaque one only.  What
    lies outside the canvas is not drawn.
    """
    base = canvas.select("image_id", "y", "x", F.lit(-1).alias("step"), F.lit("background").alias("kind"), *"rgba")
    place = ["image_id", "y", "x"]
    rows = base.unionByName(layers.select(*base.columns))
    opaque = F.when((F.col("kind") == "background") | (F.col("a") == 255), F.col("step"))
    there = Window.partitionBy(*place)
    rows = rows.withColumns({"_hides": F.max(opaque).over(there), "_first": F.min("step").over(there)}).where("_first = -1 AND step >= _hides")
    rows = rows.groupBy(*place).agg(F.array_sort(F.collect_list(F.struct("step", "kind", *"rgba"))).alias("s"))
    start = "named_struct(" + ", ".join(f"'{c}', s[0].{c}" for c in "rgba") + ")"
    rows = rows.withColumn("out", F.expr(f"aggregate(slice(s, 2, size(s)), {start}, (acc, s) -> {_FOLD})"))
    return rows.select("image_id", "y", "x", *[F.col(f"out.{c}").alias(c) for c in "rgba"])


def paste(canvas: DataFrame, source: DataFrame, moves: DataFrame) -> DataFrame:
    """Mix the source at (dx, dy) of (image_id, dx, dy) into the canvas by the source's alpha, channel by channel."""
    moved = source.join(moves.select("image_id", "dx", "dy"), "image_id").withColumns({"x": F.col("x") + F.col("dx"), "y": F.col("y") + F.col("dy")})
    return paste_steps(canvas, moved.withColumns({"step": F.lit(0), "kind": F.lit("content")}))


def fit_images(scaled: DataFrame, steps: DataFrame, fill: str = "repeat") -> DataFrame:
    """Fitted images of flat sources on their targets: (image_id, y, x, r, g, b, a).

    scaled: their pixels at the size of the plan; steps (image_id, kind, w, h, x, y,
    target_w, target_h).  Images are dealt by kind: ``cover`` and ``contain`` are cut to
    the target (what the image does not reach is zero), ``extend`` has its edges repeated
    and what was added blurred (fill ``repeat``) or blended with the image over a soft seam
    (``feather``), ``blank`` has no pixels.
    """
    frame = steps.select("image_id", "kind", F.col("w").alias("src_w"), F.col("h").alias("src_h"), F.col("target_w").alias("width"), F.col("target_h").alias("height"), F.col("x").alias("dx"), F.col("y").alias("dy"))
    cuts = frame.where("kind IN ('cover', 'contain')").withColumns({"x0": -F.col("dx"), "y0": -F.col("dy")})
    frames = frame.where("kind = 'extend'").withColumns({"x1": F.greatest(F.lit(0), "dx"), "y1": F.greatest(F.lit(0), "dy"), "x2": F.least(F.col("width"), F.col("dx") + F.col("src_w")), "y2": F.least(F.col("height"), F.col("dy") + F.col("src_h"))})
    wide = extend_edges(scaled, frames)
    if fill == "repeat":
        wide = blur_outside(cut(wide), frames)
    else:
        moved = scaled.join(frames.select("image_id", "dx", "dy"), "image_id").select("image_id", (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x"), *"rgba")
        wide = feather_blend(wide, moved, frames)
    return crop(scaled, cuts).unionByName(wide)


FLAT = ("cover", "contain", "extend", "blank")


def _shown(steps: DataFrame) -> DataFrame:
    """Steps with the part of their image that the canvas shows: x_from..x_to-1 by y_from..y_to-1 (of a fitted image or background, at least its edge)."""
    fitted = ~F.col("kind").isin("content", "overlay")
    for c, size, target in (("x", "w", "target_w"), ("y", "h", "target_h")):
        low, high = F.greatest(F.lit(0), -F.col(c)), F.least(F.col(size), F.col(target) - F.col(c))
        low = F.when(fitted, F.least(low, F.col(size) - 1)).otherwise(low)
        steps = steps.withColumns({f"{c}_from": low.cast("int"), f"{c}_to": F.when(fitted, F.greatest(low + 1, high)).otherwise(high).cast("int")})
    return steps


_ON_CANVAS = "w <= 0 OR h <= 0 OR (x_from < x_to AND y_from < y_to)"


def on_canvas(steps: DataFrame) -> DataFrame:
    """Steps with the part of their image that the canvas shows: x_from..x_to-1 by y_from..y_to-1.

    Of a background or fitted image off the canvas, the nearest edge stays, for edges are
    extended; other steps off the canvas go.
    """
    return _shown(steps).where(_ON_CANVAS)


#: No side of the image or of its canvas is over a tile's.
_SMALL = " AND ".join(["w > 0 AND h > 0", *[f"{side} BETWEEN 1 AND {TILE}" for side in ("src_w", "src_h", "target_w", "target_h")]])


def render(plan: DataFrame, pixels: DataFrame, images: DataFrame, fill: str = "repeat") -> DataFrame:
    """Plans on white canvases, without alpha: (design_id, seq, y, x, r, g, b).

    plan: steps of ``compose.compose_plan`` or ``compose.draw_plan``.  pixels: (design_id,
    element_id, y, x, r, g, b, a); images: their sizes (design_id, element_id, src_w,
    src_h).  Each step's image is resampled to its size, but only where it lies on the
    canvas (of one that is fitted, at least its edge); a background is cropped to the
    canvas, its edges extended where it falls short; a flat source is fitted by its kind;
    content takes its opacity.  Steps without an image are not drawn.

    A small flat source is drawn whole, since it is all that its canvas shows; other
    canvases are put together place by place.
    """
    box = [F.col(f"image_{c}").alias(c) for c in "xywh"]
    plan = plan.select("design_id", "seq", "target_w", "target_h", "step", "kind", "element_id", *box, "opacity").join(images, ["design_id", "element_id"], "left")
    alone = F.count("*").over(Window.partitionBy("design_id", "seq")) == 1
    kinds = ("cover", "contain", "extend") if fill == "repeat" else ("cover", "contain")
    whole = alone & F.col("kind").isin(*kinds) & F.expr(_SMALL)
    plan = cut(_shown(plan).withColumn("_whole", F.coalesce(whole, F.lit(False))))  # read for sizes, places and canvases
    lone, others = plan.where("_whole"), plan.where("NOT _whole")
    if lone.isEmpty():
        return _render_places(others, pixels, fill)
    small = fit_small(lone, pixels)
    return small if others.isEmpty() else small.unionByName(_render_places(others, pixels, fill))


def fit_small(steps: DataFrame, pixels: DataFrame) -> DataFrame:
    """Fitted images of small flat sources, one step a canvas, as in ``fit_images`` (fill ``repeat``): (design_id, seq, y, x, r, g, b).

    The pixels of a source are gathered once, whatever the number of its canvases, and
    nothing is shuffled after a step has met them: steps of one geometry are resampled,
    placed and blurred together, a batch at a time.  A source without pixels leaves its box white.
    """
    images = steps.select("design_id", "element_id", "src_w", "src_h").distinct()
    packed = "shiftleft(a, 24) | shiftleft(r, 16) | shiftleft(g, 8) | b"
    rows = pixels.join(images, ["design_id", "element_id"]).where("x >= 0 AND y >= 0 AND x < src_w AND y < src_h")
    rows = rows.groupBy("design_id", "element_id", "src_w", "src_h").agg(F.sort_array(F.collect_list(F.struct(F.expr("y * src_w + x").alias("p"), F.expr(packed).alias("v")))).alias("s"))
    absent = "transform(array_except(sequence(0, src_w * src_h - 1), s.p), p -> named_struct('p', p, 'v', 0))"
    rows = rows.select("design_id", "element_id", F.expr(f"CASE WHEN size(s) = src_w * src_h THEN s.v ELSE sort_array(concat(s, {absent})).v END").alias("packed"))
    rows = steps.withColumn("fit", (F.col("kind") == "extend").cast("int")).join(rows, ["design_id", "element_id"], "left").select("design_id", "seq", *GEOMETRY, "packed")
    weights = tuple(w for _, w in gaussian_weights(3))
    schema = T.StructType([*[T.StructField(c, steps.schema[c].dataType) for c in ("design_id", "seq", "target_w")], T.StructField("places", T.ArrayType(T.IntegerType()))])
    out = rows.mapInArrow(lambda batches: drawn(batches, weights), schema).select("design_id", "seq", "target_w", F.posexplode("places").alias("p", "v"))
    places = {"y": "CAST(p div target_w AS INT)", "x": "p % target_w", "r": "shiftright(v, 16)", "g": "shiftright(v, 8) & 255", "b": "v & 255"}
    return out.select("design_id", "seq", *[F.expr(e).alias(c) for c, e in places.items()])


def _render_places(plan: DataFrame, pixels: DataFrame, fill: str) -> DataFrame:
    """``render`` of steps with their sizes and parts, by one grouping by place."""
    canvas_id = F.struct("design_id", "seq")
    steps = plan.where(f"kind <> 'blank' AND ({_ON_CANVAS})").where("src_w IS NOT NULL").withColumn("image_id", F.struct("design_id", "seq", "step"))
    sizes = steps.select("image_id", "src_w", "src_h", F.col("w").alias("width"), F.col("h").alias("height"), *[f"{c}_{end}" for c in "xy" for end in ("from", "to")])
    own = pixels.join(steps.select("design_id", "element_id", "image_id"), ["design_id", "element_id"]).select("image_id", F.col("y"), F.col("x"), *"rgba")
    scaled = cut(resample(own, sizes))  # read once a kind
    backs = steps.where("kind = 'background'").select("image_id", F.col("w").alias("src_w"), F.col("h").alias("src_h"), F.col("target_w").alias("width"), F.col("target_h").alias("height"), F.col("x").alias("dx"), F.col("y").alias("dy"))
    others = steps.where("kind IN ('content', 'overlay')").select("image_id", "kind", "opacity", F.col("x").alias("dx"), F.col("y").alias("dy"))
    moved = scaled.join(others, "image_id").withColumns({"x": F.col("x") + F.col("dx"), "y": F.col("y") + F.col("dy")})
    moved = apply_opacity(moved.withColumn("opacity", F.when(F.col("kind") == "content", F.col("opacity")).otherwise(1.0)))
    whole = extend_edges(scaled, backs).unionByName(fit_images(scaled, steps.where(F.col("kind").isin(*FLAT)), fill)).withColumn("kind", F.lit("background"))
    layers = whole.unionByName(moved.select(*whole.columns)).withColumns({"step": F.col("image_id.step"), "image_id": F.struct("image_id.design_id", "image_id.seq")})
    canvas = blank_canvas(plan.select(canvas_id.alias("image_id"), F.col("target_w").alias("width"), F.col("target_h").alias("height")).distinct())
    return to_rgb(paste_steps(canvas, layers)).select("image_id.design_id", "image_id.seq", "y", "x", *CHANNELS)


def over(canvas: DataFrame, source: DataFrame) -> DataFrame:
    """Source-over of an overlay of the same size."""
    moved = source.select("image_id", "y", "x", *[F.col(c).alias(f"_{c}") for c in "rgba"])
    both = canvas.join(moved, ["image_id", "y", "x"], "left").fillna(0, ["_r", "_g", "_b", "_a"])
    alpha = F.col("_a") * 255 + F.col("a") * (255 - F.col("_a"))  # times 255
    out = lambda c: F.when(alpha > 0, F.floor((F.col(f"_{c}") * F.col("_a") * 255 + F.col(c) * F.col("a") * (255 - F.col("_a"))) / alpha + 0.5)).otherwise(0).cast("int")
    return both.select("image_id", "y", "x", *[out(c).alias(c) for c in CHANNELS], F.floor(alpha / 255 + 0.5).cast("int").alias("a"))


def to_rgb(pixels: DataFrame) -> DataFrame:
    """Alpha is dropped, not blended."""
    return pixels.drop("a")


def draw_boxes(pixels: DataFrame, boxes: DataFrame, line: int = 2) -> DataFrame:
    """Outlines of boxes (image_id, ordinal, x1, y1, x2, y2, cr, cg, cb); the last box wins.

    Only outline pixels are made from the boxes, so the join is on places.
    """
    b = boxes.withColumn("y", F.explode(F.expr("sequence(y1, y2)"))).withColumn("x", F.explode(F.expr("sequence(x1, x2)")))
    edge = F.least(F.col("x") - F.col("x1"), F.col("x2") - F.col("x"), F.col("y") - F.col("y1"), F.col("y2") - F.col("y")) < line
    top = b.where(edge).groupBy("image_id", "y", "x").agg(F.max(F.struct("ordinal", "cr", "cg", "cb")).alias("top"))
    out = pixels.join(top, ["image_id", "y", "x"], "left")
    return out.select("image_id", "y", "x", *[F.coalesce(F.col(f"top.c{c}"), F.col(c)).alias(c) for c in CHANNELS], "a")


def alpha_share(pixels: DataFrame) -> DataFrame:
    """Share of pixels that are not opaque; over 0.05 counts as transparency."""
    share = F.avg((F.col("a") < 255).cast("int"))
    return pixels.groupBy("image_id").agg(share.alias("share"), (share > 0.05).alias("has_transparency"))
