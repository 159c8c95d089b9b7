"""Layers, targets, corrections and pixels derived from the given tables, as SQL text.

Each text runs on the tables of the same names; FIXTURES.md describes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LAYERS_RAW = """
WITH canv(ck, canvas_w, canvas_h) AS (VALUES (0,1080,1080),(1,1200,628),(2,886,500),(3,1920,1080),(4,1080,1920),(5,600,600)),
vocab(nk, name) AS (VALUES (0,'Headline Main'),(1,'Sub Title'),(2,'subhead copy'),(3,'body copy'),(4,'cta_button'),(5,'sale badge'),(6,'small caption'),(7,'Brand Logo'),(8,'hero_product'),(9,'icon_star'),(10,'photo 3'),(11,'illust_cat'),(12,'sparkle'),(13,'bg_main'),(14,'tile_dots'),(15,'overlay_dark'),(16,'Layer 7'),(17,'layer_12'),(18,'layer_42'),(19,'Layer_low'),(20,'shape_9'),(21,'Vector_p2'),(22,'unnamed'),(23,'texture_01')),
kinds(tk, layer_type) AS (VALUES (0,'pixel'),(1,'type'),(2,'shape'),(3,'group'),(4,'smartobject')),
li AS (SELECT l.*, p_name, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax) - 1 AS INT) AS ordinal
       FROM lineitem l JOIN part ON p_partkey = l_partkey),
base AS (SELECT l_orderkey AS design_id, ordinal, canvas_w, canvas_h, name, layer_type,
  CAST((l_partkey * 7) % canvas_w - 40 AS INT) AS x, CAST((l_suppkey * 11 + l_partkey * 3) % canvas_h - 40 AS INT) AS y,
  CAST(5 + ((l_partkey * 13 + l_linenumber * 31) % canvas_w) / CAST(1 + l_partkey % 4 AS DOUBLE) AS DOUBLE) AS wd,
  CAST(5 + ((l_suppkey * 17 + l_partkey * 5 + l_linenumber * 29) % canvas_h) / CAST(1 + l_partkey % 5 AS DOUBLE) AS DOUBLE) AS hd,
  (l_partkey + l_suppkey) % 11 <> 0 AS visible,
  CAST(255 - l_linenumber * 10 AS INT) AS opacity_u8,
  CASE WHEN layer_type = 'type' AND l_partkey % 13 <> 0 THEN repeat(concat(p_name, ' '), CAST(l_linenumber AS INT)) END AS text_content,
  l_partkey % 3 = 0 AS nested
 FROM li JOIN canv ON ck = l_orderkey % 6 JOIN vocab ON nk = (l_partkey + l_linenumber) % 24 JOIN kinds ON tk = (l_suppkey + l_partkey) % 5)
SELECT design_id, ordinal, canvas_w, canvas_h, name, layer_type, x, y, CAST(floor(wd) AS INT) AS width, CAST(floor(hd) AS INT) AS height, visible, opacity_u8, text_content,
 layer_type <> 'group' AND (x + y) % 17 <> 0 AS has_image,
 CASE WHEN nested THEN max(CASE WHEN layer_type = 'group' THEN ordinal END) OVER (PARTITION BY design_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS parent_ordinal
FROM base
"""

TARGETS = """
SELECT CAST(seq AS INT) AS seq, name, width, height FROM (VALUES
 (1,'Instagram Story',1080,1920),(2,'Instagram Square',1080,1080),(3,'Instagram Portrait',1080,1350),
 (4,'Facebook Cover',1200,630),(5,'Facebook Post',1200,1200),(6,'LinkedIn Post',1200,627),
 (7,'YouTube Thumbnail',1280,720),(8,'Pinterest Pin',1000,1500),(9,'Twitter Header',1500,500),
 (10,'Billboard',2000,1000),(11,'Skyscraper',160,600),(12,'Ultra Wide',4000,800),
 (13,'Half Up',720,300),(14,'Tall Edge',540,1080),(15,'Min Ok',10,10),(16,'Max Ok',4096,4096),
 (17,'Billboard',2000,900),(18,'Zero',0,100),(19,'Negative',100,-50),(20,'Too Big',5000,100),(21,'Too Small',5,5)
) AS t(seq, name, width, height)
"""

CORRECTIONS = """
SELECT event_id % 4000 AS design_id, CAST(user_id % 2 AS INT) AS ordinal, event_id AS seq,
 CASE event_type WHEN 'click' THEN 'hero_image' WHEN 'error' THEN 'no_such_role' WHEN 'purchase' THEN 'decoration' WHEN 'signup' THEN 'headline' ELSE 'logo' END AS new_role,
 CAST(floor(value / CAST(10 AS DOUBLE)) AS INT) AS new_priority
FROM events
"""

PIXELS = """
WITH d(i) AS (VALUES (0),(1),(2),(3),(4),(5),(6),(7)),
g AS (SELECT ys.i AS y, xs.i AS x, ys.i * 8 + xs.i AS k FROM d ys CROSS JOIN d xs),
v AS (SELECT vec_id AS image_id, y, x, k,
  CAST(GET(embedding, k + 1) AS DOUBLE) AS v0, CAST(GET(embedding, (k + 16) % 64 + 1) AS DOUBLE) AS v1, CAST(GET(embedding, (k + 32) % 64 + 1) AS DOUBLE) AS v2
  FROM embeddings CROSS JOIN g)
SELECT image_id, y, x,
 CAST(floor((least(greatest(v0, CAST(-1 AS DOUBLE)), CAST(1 AS DOUBLE)) + CAST(1 AS DOUBLE)) * CAST(127 AS DOUBLE)) AS INT) AS r,
 CAST(floor((least(greatest(v1, CAST(-1 AS DOUBLE)), CAST(1 AS DOUBLE)) + CAST(1 AS DOUBLE)) * CAST(127 AS DOUBLE)) AS INT) AS g,
 CAST(floor((least(greatest(v2, CAST(-1 AS DOUBLE)), CAST(1 AS DOUBLE)) + CAST(1 AS DOUBLE)) * CAST(127 AS DOUBLE)) AS INT) AS b,
 CAST(CASE WHEN (image_id * 5 + k) % 64 < image_id % 8 THEN 128 ELSE 255 END AS INT) AS a
FROM v
"""

#: Sizes, rectangles and offsets of the images, each its own: a canvas with the image on it, a size to scale to, a rectangle to cut out.
FRAMES = """
SELECT vec_id AS image_id, CAST(8 AS INT) AS src_w, CAST(8 AS INT) AS src_h, CAST(10 + vec_id % 5 AS INT) AS width, CAST(9 + vec_id % 4 AS INT) AS height,
 CAST(vec_id % 3 AS INT) AS dx, CAST(vec_id % 2 AS INT) AS dy, CAST(vec_id % 3 AS INT) AS x1, CAST(vec_id % 2 AS INT) AS y1, CAST(vec_id % 3 + 8 AS INT) AS x2, CAST(vec_id % 2 + 8 AS INT) AS y2,
 CAST(vec_id % 7 AS INT) AS to_w, CAST(11 - vec_id % 4 AS INT) AS to_h, CAST(vec_id % 5 - 2 AS INT) AS x0, CAST(vec_id % 4 - 1 AS INT) AS y0, CAST(5 + vec_id % 4 AS INT) AS cut_w, CAST(4 + vec_id % 5 AS INT) AS cut_h,
 CAST(1 + vec_id % 8 AS INT) AS flat_w, CAST(1 + vec_id * 5 % 7 AS INT) AS flat_h
FROM embeddings
"""

#: Small targets, on which designs are drawn whole.
THUMBNAILS = "SELECT CAST(seq AS INT) AS seq, name, CAST(width AS INT) AS width, CAST(height AS INT) AS height FROM (VALUES (1, 'Wide', 16, 9), (2, 'Tall', 7, 14), (3, 'Square', 12, 12)) AS t(seq, name, width, height)"

_TABLES = {"frames": ("embeddings",), "thumbnails": (), "layers_raw": ("lineitem", "part"), "targets": (), "corrections": ("events",), "pixels": ("embeddings",)}


def derive(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the derived tables."""
    text = {"layers_raw": LAYERS_RAW, "targets": TARGETS, "corrections": CORRECTIONS, "pixels": PIXELS.replace("GET(", "element_at("), "frames": FRAMES, "thumbnails": THUMBNAILS}[name]
    frames = {}
    for t in _TABLES[name]:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t} ", f"JOIN {{{t}}} ")
        frames[t] = spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return spark.sql(text, **frames)


def layers_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, "layers_raw")


def targets(spark: SparkSession) -> DataFrame:
    return derive(spark, "", "targets")


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, "corrections")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, "pixels")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, "frames")


def thumbnails(spark: SparkSession) -> DataFrame:
    return derive(spark, "", "thumbnails")


def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(design_id, canvas_w, canvas_h, layers) with each design as nested JSON, from the last layer to the first, so that children are ready before their groups."""
    raw = layers_raw(spark, sf_dir)
    fields = ["name", "layer_type", "x", "y", "width", "height", "visible", "opacity_u8", "text_content", "has_image"]
    entry = F.struct("ordinal", "parent_ordinal", F.to_json(F.struct(*fields)).alias("text"))
    tree = raw.groupBy("design_id", "canvas_w", "canvas_h").agg(F.reverse(F.array_sort(F.collect_list(entry))).alias("t"))

    def step(held, t):
        own = F.concat(F.substring(t["text"], F.lit(1), F.length(t["text"]) - 1), F.lit(',"children":['), F.get(held, t["ordinal"] + 1), F.lit("]}"))
        at = F.coalesce(t["parent_ordinal"] + 1, F.lit(0))
        return F.transform(held, lambda s, i: F.when(i == at, F.concat(own, F.when(s == "", "").otherwise(","), s)).otherwise(s))

    held = F.aggregate("t", F.array_repeat(F.lit(""), F.size("t") + 1), step)
    return tree.select("design_id", "canvas_w", "canvas_h", F.concat(F.lit("["), F.get(held, F.lit(0)), F.lit("]")).alias("layers"))
