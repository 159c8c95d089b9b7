"""SQL expressions of the operators, in layers: each may use the columns before it.

``trunc_int(x)`` truncates toward zero; halves are floored; fractions are doubles.
Each list is applied with :func:`extend`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalogs import BACKGROUND_ROLES, COLOURS, DEFAULT_COLOUR, MAX_SIDE, MIN_SIDE, NAME_PATTERNS, ROLE_PRIORITY

Step = dict[str, str]


def extend(df: DataFrame, steps: list[Step]) -> DataFrame:
    """Add the columns of each layer."""
    for step in steps:
        df = df.withColumns({k: F.expr(v.replace("trunc_int(", "int(")) for k, v in step.items()})
    return df


def dbl(x: float) -> str:
    return f"CAST({x} AS DOUBLE)"


GEOMETRY = [
    {"x2": "x + width", "y2": "y + height", "area": "CAST(width AS BIGINT) * height"},
    {"center_x": "CAST(floor((x + x2) / 2) AS INT)", "center_y": "CAST(floor((y + y2) / 2) AS INT)"},
]


def scaled(factor: str = dbl(0.7)) -> list[Step]:
    """Each side of a box times a factor (an SQL expression), toward zero."""
    return [{f"s{c}": f"CAST(trunc_int({c} * {factor}) AS INT)" for c in ("x", "y", "width", "height")}]


IS_BACKGROUND = f"role IN {BACKGROUND_ROLES}"
NAME_ROLE = "CASE " + " ".join(f"WHEN contains(lower(name), '{p}') THEN '{role}'" for role, ps in NAME_PATTERNS for p in ps) + " END"
SUFFIX = (
    "CASE WHEN contains(lower(name), '_1') OR contains(lower(name), '_p1') THEN 1 WHEN contains(lower(name), '_2') OR contains(lower(name), '_p2') THEN 2 "
    "WHEN contains(lower(name), '_9') OR contains(lower(name), '_low') THEN 9 END"
)
GEOMETRY_ROLE = (
    "CASE WHEN layer_type = 'type' AND length(text_content) > 0 THEN CASE "
    f"WHEN y < canvas_h * {dbl(0.3)} AND (ratio > {dbl(0.05)} OR length(text_content) < 30) THEN 'headline' "
    "WHEN length(text_content) < 50 THEN 'subheadline' ELSE 'body_text' END "
    f"WHEN layer_type IN ('pixel', 'smartobject') THEN CASE WHEN ratio > {dbl(0.5)} THEN 'background' WHEN ratio > {dbl(0.15)} THEN 'hero_image' WHEN ratio < {dbl(0.02)} THEN 'icon' ELSE 'illustration' END "
    f"WHEN layer_type = 'shape' THEN CASE WHEN ratio < {dbl(0.05)} THEN 'decoration' ELSE 'background' END ELSE 'unknown' END"
)
ROLE_CAP = "CASE role " + " ".join(f"WHEN '{r}' THEN {p}" for r, p in ROLE_PRIORITY.items()) + " ELSE 7 END"
CLASSIFY = [
    {"ratio": "CASE WHEN CAST(canvas_w AS BIGINT) * canvas_h > 0 THEN CAST(CAST(width AS BIGINT) * height AS DOUBLE) / CAST(CAST(canvas_w AS BIGINT) * canvas_h AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"},
    {"name_role": f"CASE WHEN layer_type = 'group' THEN NULL ELSE {NAME_ROLE} END"},
    {"suffix": f"CASE WHEN layer_type <> 'group' AND name_role IS NULL THEN {SUFFIX} END", "geometry_role": GEOMETRY_ROLE},
    {"role": "CASE WHEN layer_type = 'group' THEN 'group' ELSE coalesce(name_role, geometry_role) END"},
    {"priority": f"least(coalesce(suffix, 5), {ROLE_CAP})"},
]
#: The same with embedding_role, which counts for layers with an image that no name rule fits.
CLASSIFY_WITH_EMBEDDING = [
    *CLASSIFY[:3],
    {"role": "CASE WHEN layer_type = 'group' THEN 'group' ELSE coalesce(name_role, CASE WHEN has_image THEN embedding_role END, geometry_role) END"},
    CLASSIFY[4],
]
#: Sides are truncated to whole numbers first, so 0.5 is not positive and 4096.9 is not too large.
TARGET_REASON = (
    "CASE WHEN TRY_CAST(width AS DOUBLE) IS NULL OR TRY_CAST(height AS DOUBLE) IS NULL THEN 'not numeric' "
    "WHEN isnan(TRY_CAST(width AS DOUBLE)) OR isnan(TRY_CAST(height AS DOUBLE)) THEN 'not a number' WHEN width < 1 OR height < 1 THEN 'not positive' "
    f"WHEN width >= {MAX_SIDE} + 1 OR height >= {MAX_SIDE} + 1 THEN 'too large' WHEN width < {MIN_SIDE} OR height < {MIN_SIDE} THEN 'too small' END"
)
ZONE_RECT = [{"zx": "trunc_int(fx * target_w)", "zy": "trunc_int(fy * target_h)", "zw": "trunc_int(fw * target_w)", "zh": "trunc_int(fh * target_h)"}]
#: Placement of a layer (section 0 background, 1 in a zone, 2 neither) on a target.
PLACE = [
    {
        "raw_scale": "CASE section WHEN 0 THEN CASE WHEN width <= 0 OR height <= 0 THEN CAST(1 AS DOUBLE) ELSE greatest(target_w / CAST(width AS DOUBLE), target_h / CAST(height AS DOUBLE)) END "
        "WHEN 1 THEN CASE WHEN maintain_aspect THEN least(zw / CAST(greatest(1, width) AS DOUBLE), zh / CAST(greatest(1, height) AS DOUBLE)) "
        "ELSE (zw / CAST(greatest(1, width) AS DOUBLE) + zh / CAST(greatest(1, height) AS DOUBLE)) / CAST(2 AS DOUBLE) END "
        "ELSE least(target_w / CAST(greatest(1, canvas_w) AS DOUBLE), target_h / CAST(greatest(1, canvas_h) AS DOUBLE)) END"
    },
    {"scale_factor": "CASE section WHEN 1 THEN greatest(min_scale, least(max_scale, raw_scale)) ELSE raw_scale END"},
    {
        "new_w": "CASE section WHEN 0 THEN target_w ELSE trunc_int(width * scale_factor) END",
        "new_h": "CASE section WHEN 0 THEN target_h ELSE trunc_int(height * scale_factor) END",
    },
    {
        "new_x": "CASE section WHEN 0 THEN 0 WHEN 1 THEN zx + floor((zw - new_w) / 2) ELSE trunc_int(x * scale_factor) END",
        "new_y": "CASE section WHEN 0 THEN 0 WHEN 1 THEN zy + floor((zh - new_h) / 2) ELSE trunc_int(y * scale_factor) END",
        "visible_out": "section < 2 OR priority <= 7",
    },
]
#: Fit of a flat image (src_w, src_h) to a target (target_w, target_h) in a mode.
FIT = [
    {"blank": "src_w <= 0 OR src_h <= 0 OR target_w <= 0 OR target_h <= 0", "sw": "CAST(greatest(src_w, 1) AS DOUBLE)", "sh": "CAST(greatest(src_h, 1) AS DOUBLE)"},
    {"cover_scale": "greatest(target_w / sw, target_h / sh)", "contain_scale": "least(target_w / sw, target_h / sh)"},
    {"raw_w": "trunc_int(src_w * cover_scale)", "raw_h": "trunc_int(src_h * cover_scale)"},
    {
        "crop_share": "greatest(CASE WHEN raw_w > 0 THEN greatest(0, raw_w - target_w) / CAST(raw_w AS DOUBLE) ELSE CAST(0 AS DOUBLE) END, CASE WHEN raw_h > 0 THEN greatest(0, raw_h - target_h) / CAST(raw_h AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)",
        "cover_w": "greatest(1, raw_w)",
        "cover_h": "greatest(1, raw_h)",
        "contain_w": "greatest(1, trunc_int(src_w * contain_scale))",
        "contain_h": "greatest(1, trunc_int(src_h * contain_scale))",
    },
    {
        "use_cover": f"CASE mode WHEN 'cover' THEN true WHEN 'contain' THEN false ELSE crop_share <= {dbl(0.2)} END",
        "crop_x": "floor((cover_w - target_w) / 2)",
        "crop_y": "floor((cover_h - target_h) / 2)",
        "off_x": "floor((target_w - contain_w) / 2)",
        "off_y": f"CASE WHEN target_h - contain_h > 0 AND target_h > target_w THEN trunc_int((target_h - contain_h) * {dbl(0.4)}) ELSE floor((target_h - contain_h) / 2) END",
    },
    {"extends": "NOT blank AND NOT use_cover AND NOT (contain_w = target_w AND contain_h = target_h)"},
    {
        "dst_x1": "greatest(0, off_x)", "dst_y1": "greatest(0, off_y)", "dst_x2": "least(target_w, off_x + contain_w)", "dst_y2": "least(target_h, off_y + contain_h)",
        "src_x1": "greatest(0, -off_x)", "src_y1": "greatest(0, -off_y)",
    },
    {"src_x2": "src_x1 + (dst_x2 - dst_x1)", "src_y2": "src_y1 + (dst_y2 - dst_y1)", "strip_top": "dst_y1", "strip_bottom": "target_h - dst_y2", "strip_left": "dst_x1", "strip_right": "target_w - dst_x2"},
    {
        "corner_tl": "strip_top > 0 AND strip_left > 0", "corner_tr": "strip_top > 0 AND strip_right > 0", "corner_bl": "strip_bottom > 0 AND strip_left > 0", "corner_br": "strip_bottom > 0 AND strip_right > 0",
        "generated": "CAST(target_w AS BIGINT) * target_h - (dst_x2 - dst_x1) * (dst_y2 - dst_y1)",
        "plan": "CASE WHEN blank THEN 'blank' WHEN use_cover THEN 'cover' WHEN extends THEN 'extend' ELSE 'contain' END",
    },
]
#: Canvas of a layered design from its first background (bg_k, bg_w, bg_h, bg_image; null: none).
BACKGROUND = [
    {
        "mode": "CASE WHEN bg_k IS NULL OR NOT bg_image THEN 'white' WHEN target_w > bg_w OR target_h > bg_h THEN 'extend' ELSE 'cover' END",
        "scale": "greatest(target_w / CAST(greatest(bg_w, 1) AS DOUBLE), target_h / CAST(greatest(bg_h, 1) AS DOUBLE))",
    },
    {"scaled_w": "CASE WHEN mode <> 'white' THEN greatest(1, trunc_int(bg_w * scale)) END", "scaled_h": "CASE WHEN mode <> 'white' THEN greatest(1, trunc_int(bg_h * scale)) END"},
    {"crop_x": "floor((scaled_w - target_w) / 2)", "crop_y": "floor((scaled_h - target_h) / 2)"},
    {
        "filled": "CASE WHEN mode = 'extend' THEN CAST(target_w AS BIGINT) * target_h - (least(target_w, floor((target_w - scaled_w) / 2) + scaled_w) - greatest(0, floor((target_w - scaled_w) / 2))) "
        "* (least(target_h, floor((target_h - scaled_h) / 2) + scaled_h) - greatest(0, floor((target_h - scaled_h) / 2))) ELSE 0 END"
    },
]
_colour = lambda i: "CASE role " + " ".join(f"WHEN '{r}' THEN {c[i]}" for r, c in COLOURS.items()) + f" ELSE {DEFAULT_COLOUR[i]} END"
ANNOTATE = [
    {"r": _colour(0), "g": _colour(1), "b": _colour(2), "outline": "2", "label": "concat(substr(role, 1, 8), ': ', substr(name, 1, 15))", "label_x": "x + 2", "label_y": "y + 2"},
]
TEXT_PREVIEW = "CASE WHEN length(text_content) > 50 THEN concat(substr(text_content, 1, 50), '...') ELSE text_content END"
