"""Small fixed catalogues: roles, name patterns, templates, zones, presets, colours, limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Role -> priority (1 best).
ROLE_PRIORITY = {
    "headline": 1, "subheadline": 3, "body_text": 5, "cta": 2, "badge": 4, "label": 4, "logo": 2, "hero_image": 3, "icon": 6,
    "photo": 5, "illustration": 5, "decoration": 8, "background": 9, "background_pattern": 9, "overlay": 9, "group": 7, "unknown": 7,
}
# Roles of the background.
BACKGROUND_ROLES = ("background", "background_pattern", "overlay")
# Patterns in a lower-cased layer name; the first in this order wins.
NAME_PATTERNS = [
    ("headline", ["headline", "title", "heading", "h1", "h2", "main_text", "header_text"]),
    ("subheadline", ["subhead", "subtitle", "sub_title", "h3", "h4", "secondary"]),
    ("body_text", ["body", "paragraph", "text", "content", "description", "desc"]),
    ("cta", ["cta", "button", "btn", "action", "click", "learn_more", "buy_now", "shop_now"]),
    ("badge", ["badge", "tag", "label", "alert", "warning", "notice", "ribbon"]),
    ("label", ["label", "caption", "note", "small_text"]),
    ("logo", ["logo", "brand", "wordmark", "trademark"]),
    ("hero_image", ["hero", "main_image", "featured", "mascot", "character", "key_visual"]),
    ("icon", ["icon", "ico", "symbol", "glyph"]),
    ("photo", ["photo", "photograph", "picture", "image", "img"]),
    ("illustration", ["illust", "illustration", "artwork", "drawing", "graphic"]),
    ("decoration", ["decor", "decoration", "ornament", "sparkle", "effect", "particle"]),
    ("background", ["bg", "background", "backdrop", "base"]),
    ("background_pattern", ["bg_pattern", "pattern", "texture", "tile"]),
    ("overlay", ["overlay", "gradient_overlay", "color_overlay", "mask"]),
    ("group", ["group", "folder", "section"]),
]
# Roles of the embedding prompts, in prompt order.
PROMPT_ROLES = ["headline", "subheadline", "body_text", "cta", "badge", "logo", "hero_image", "icon", "photo", "illustration", "decoration", "background", "background_pattern", "label", "overlay"]
# Template -> least and limiting width/height, and its zones (x, y, w, h as fractions; roles).
TEMPLATES = {
    "portrait_tall": (0.5, 0.65, [("top_badge", 0.1, 0.02, 0.8, 0.08, ["badge", "logo"]), ("headline", 0.05, 0.12, 0.9, 0.25, ["headline", "subheadline"]), ("cta", 0.15, 0.38, 0.7, 0.08, ["cta"]), ("hero", 0.0, 0.48, 1.0, 0.52, ["hero_image", "illustration", "photo"])]),
    "portrait": (0.65, 0.85, [("top_badge", 0.1, 0.03, 0.8, 0.1, ["badge", "logo"]), ("headline", 0.05, 0.15, 0.9, 0.2, ["headline", "subheadline"]), ("cta", 0.2, 0.36, 0.6, 0.08, ["cta"]), ("hero", 0.05, 0.46, 0.9, 0.5, ["hero_image", "illustration", "photo"])]),
    "square": (0.85, 1.15, [("top_badge", 0.05, 0.03, 0.4, 0.12, ["badge", "logo"]), ("headline", 0.05, 0.18, 0.55, 0.25, ["headline", "subheadline"]), ("cta", 0.05, 0.45, 0.45, 0.1, ["cta"]), ("hero", 0.45, 0.1, 0.52, 0.85, ["hero_image", "illustration", "photo"])]),
    "landscape": (1.15, 2.0, [("left_content", 0.03, 0.05, 0.5, 0.9, ["badge", "headline", "subheadline", "cta"]), ("hero", 0.5, 0.0, 0.5, 1.0, ["hero_image", "illustration", "photo", "logo"])]),
    "landscape_wide": (2.0, 4.0, [("left", 0.02, 0.1, 0.35, 0.8, ["badge", "headline"]), ("center", 0.35, 0.15, 0.3, 0.7, ["subheadline", "cta"]), ("hero", 0.62, 0.0, 0.38, 1.0, ["hero_image", "illustration", "logo"])]),
}
DEFAULT_TEMPLATE = "landscape"
# Preset sizes.
PRESETS = [
    ("Instagram Story", 1080, 1920), ("Instagram Square", 1080, 1080), ("Instagram Portrait", 1080, 1350), ("Facebook Cover", 1200, 630), ("Facebook Post", 1200, 1200),
    ("LinkedIn Post", 1200, 627), ("YouTube Thumbnail", 1280, 720), ("Pinterest Pin", 1000, 1500), ("Twitter Header", 1500, 500), ("Billboard", 2000, 1000),
]
# Preview colour of a role.
COLOURS = {
    "headline": (255, 100, 100), "subheadline": (255, 150, 100), "cta": (100, 255, 100), "badge": (255, 255, 100), "logo": (100, 100, 255),
    "hero_image": (255, 100, 255), "background": (150, 150, 150), "decoration": (200, 200, 200),
}
DEFAULT_COLOUR = (180, 180, 180)
# Limits.
MAX_SIDE, MIN_SIDE, MAX_CROP, GAMMA, CONFIDENCE, PER_ZONE = 4096, 10, 0.2, 2.2, 0.7, 2


def zones(spark: SparkSession) -> DataFrame:
    """One row a zone: template, zone, zone_no, fractions and its roles."""
    rows = [(t, z[0], i, *z[1:5], z[5]) for t, (_, _, zs) in TEMPLATES.items() for i, z in enumerate(zs)]
    return spark.createDataFrame(rows, "template string, zone string, zone_no int, fx double, fy double, fw double, fh double, roles array<string>")


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, a, b) for t, (a, b, _) in TEMPLATES.items()], "template string, min_aspect double, max_aspect double")


def presets(spark: SparkSession) -> DataFrame:
    rows = [(i + 1, n, f"{n} ({w}x{h})", w, h) for i, (n, w, h) in enumerate(PRESETS)]
    return spark.createDataFrame(rows, "seq int, name string, label string, width int, height int")
