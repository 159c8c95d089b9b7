"""The same results in DuckDB's SQL."""

from __future__ import annotations

from .. import catalogs
from ..functions import expressions as E
from ..operators.raster import gaussian_weights
from ..sources import fixtures
from ..sources.design import EXTENSIONS


def steps(base: str, layers: list[E.Step]) -> str:
    for s in layers:
        base = f"SELECT *, {', '.join(f'{v} AS {k}' for k, v in s.items())} FROM ({base})"
    return base.replace("trunc_int(", "trunc(")


_TREE = f"""layers_raw AS ({fixtures.LAYERS_RAW}),
ok AS (SELECT *, visible AND width >= 10 AND height >= 10 AS ok FROM layers_raw),
kept AS (SELECT design_id, ordinal FROM ok WHERE ok AND parent_ordinal IS NULL UNION ALL
 SELECT c.design_id, c.ordinal FROM kept p JOIN ok c ON c.design_id = p.design_id AND c.parent_ordinal = p.ordinal
 JOIN ok g ON g.design_id = p.design_id AND g.ordinal = p.ordinal AND g.layer_type = 'group' WHERE c.ok),
numbered AS (SELECT ok.*, (row_number() OVER (PARTITION BY design_id ORDER BY ordinal) - 1)::INT AS k, (count(*) OVER (PARTITION BY design_id))::INT AS n FROM ok SEMI JOIN kept USING (design_id, ordinal)),
flat AS (SELECT *, name || '_' || substr(md5(name || '_' || k), 1, 8) AS element_id, n - k AS z_index, opacity_u8 / 255.0::DOUBLE AS opacity FROM numbered)"""
_CLASSIFIED = f"{_TREE}, classified AS ({steps('SELECT * FROM flat', E.CLASSIFY)})"
_TARGETS = f"targets AS ({fixtures.TARGETS}), judged AS (SELECT *, {E.TARGET_REASON} AS reason FROM targets), valid AS (SELECT seq, name, width, height FROM judged WHERE reason IS NULL), chosen AS (SELECT * FROM valid WHERE seq <= 10)"
_ZONES = "zones(template, zone, zone_no, fx, fy, fw, fh, roles) AS (VALUES " + ", ".join(
    f"('{t}', '{z[0]}', {i}, {', '.join(f'{v}::DOUBLE' for v in z[1:5])}, {z[5]})" for t, (_, _, zs) in catalogs.TEMPLATES.items() for i, z in enumerate(zs)
) + ")"
_ASPECTS = "aspects(template, lo, hi) AS (VALUES " + ", ".join(f"('{t}', {a}::DOUBLE, {b}::DOUBLE)" for t, (a, b, _) in catalogs.TEMPLATES.items()) + ")"
_SIZES = f"sizes AS (SELECT design_id AS seq, (canvas_w + design_id % 977)::INT AS width, (canvas_h + design_id % 613)::INT AS height FROM (SELECT DISTINCT design_id, canvas_w, canvas_h FROM ({fixtures.LAYERS_RAW})))"


def _templated(src: str) -> str:
    return f"SELECT s.*, coalesce(a.template, 'landscape') AS template FROM {src} s LEFT JOIN aspects a ON s.width / s.height::DOUBLE >= a.lo AND s.width / s.height::DOUBLE < a.hi"


def _rects(src: str) -> str:
    return steps(f"SELECT t.seq, t.template, zone, zone_no, fx, fy, fw, fh, width AS target_w, height AS target_h FROM ({_templated(src)}) t JOIN zones USING (template)", E.ZONE_RECT)


_RANKED = f"""{_CLASSIFIED}, {_ZONES}, {_ASPECTS},
listed AS (SELECT template, zone, unnest(roles) AS role FROM zones),
r0 AS (SELECT c.*, a.template, l.zone, width::BIGINT * height AS area FROM classified c CROSS JOIN aspects a LEFT JOIN listed l ON l.template = a.template AND l.role = c.role),
r1 AS (SELECT *, CASE WHEN zone IS NOT NULL THEN row_number() OVER (PARTITION BY design_id, template, zone ORDER BY priority, area DESC, k) END::INT AS rank FROM r0),
r2 AS (SELECT *, CASE WHEN {E.IS_BACKGROUND} THEN 0 WHEN rank <= 2 THEN 1 ELSE 2 END AS section FROM r1),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY design_id, template ORDER BY section, CASE section WHEN 0 THEN 0 ELSE priority END, CASE section WHEN 0 THEN 0 ELSE -area END, k) - 1)::INT AS result_pos FROM r2)"""
_PLACED = f"""{_RANKED}, {_TARGETS},
rects AS ({_rects('chosen')}),
p0 AS (SELECT r.* EXCLUDE (zone), CASE section WHEN 1 THEN r.zone END AS zone, t.seq, t.name AS target_name, t.width AS target_w, t.height AS target_h, 0.3::DOUBLE AS min_scale, 2::DOUBLE AS max_scale, true AS maintain_aspect
 FROM ranked r JOIN ({_templated('chosen')}) t USING (template)),
p1 AS (SELECT p0.*, zx, zy, zw, zh FROM p0 LEFT JOIN rects z ON z.seq = p0.seq AND z.zone = p0.zone),
placed AS (SELECT * EXCLUDE (visible, visible_out, new_x, new_y, new_w, new_h), visible_out AS visible, new_x::INT AS new_x, new_y::INT AS new_y, new_w::INT AS new_w, new_h::INT AS new_h FROM ({steps('SELECT * FROM p1', E.PLACE)}))"""
_PAIRS = f"""{_TARGETS}, designs AS (SELECT DISTINCT design_id, canvas_w, canvas_h FROM ({fixtures.LAYERS_RAW}))"""
_FIT = f"""{_PAIRS}, fit AS ({steps("SELECT design_id, canvas_w AS src_w, canvas_h AS src_h, seq, width AS target_w, height AS target_h, CASE seq WHEN 11 THEN 'cover' WHEN 12 THEN 'contain' ELSE 'smart' END AS mode FROM designs CROSS JOIN valid", E.FIT)})"""
_PIXELS = f"pixels AS MATERIALIZED ({fixtures.PIXELS.replace('GET(', 'list_extract(')}), frames AS MATERIALIZED ({fixtures.FRAMES})"
_PROBS = "v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), l AS (SELECT a.vec_id, p.vec_id AS prompt, 100 * list_inner_product(a.e, p.e) AS l FROM v a JOIN v p ON p.vec_id < 15), m AS (SELECT *, exp(l - max(l) OVER (PARTITION BY vec_id)) AS x FROM l), s AS (SELECT *, x / sum(x) OVER (PARTITION BY vec_id) AS prob FROM m)"
_SHARED = [[*z[5], "photo", "cta"] for z in catalogs.TEMPLATES["square"][2]]
_EXT = "regexp_extract(lower(@), '[.]([^./]+)$', 1)"
_KIND = "CASE WHEN extension = 'psd' THEN 'layered' WHEN extension IN ('png', 'jpg', 'jpeg', 'webp') THEN 'flat_image' END AS source_type, CASE WHEN extension = '' THEN 'no extension' WHEN extension NOT IN ('psd', 'png', 'jpg', 'jpeg', 'webp') THEN 'unsupported extension' END AS reason"


def _ints(cols: str) -> str:
    return ", ".join(f"{c}::INT AS {c}" for c in cols.split())


_PLACES = "places AS (SELECT f.*, y::INT AS y, x::INT AS x FROM frames f, range(height) a(y), range(width) b(x))"
_WIDE = f"{_PLACES}, wide AS MATERIALIZED (SELECT f.image_id, f.y, f.x, r, g, b, a, width, height, f.x1, f.y1, f.x2, f.y2 FROM places f JOIN pixels p ON p.image_id = f.image_id AND p.y = least(greatest(f.y - dy, 0), src_h - 1) AND p.x = least(greatest(f.x - dx, 0), src_w - 1))"
_INSIDE = "w.x >= w.x1 AND w.x < w.x2 AND w.y >= w.y1 AND w.y < w.y2"


def _lanczos(pairs: str) -> str:
    """(src_n, dst_n, d, s, w) of an axis for each (src_n, dst_n) of a query."""
    value = "CASE WHEN u = 0 THEN 1::DOUBLE WHEN abs(u) >= 3 THEN 0::DOUBLE ELSE 3 * sin(pi() * u) * sin(pi() * u / 3) / (pi() * u * pi() * u) END"
    return f"""SELECT src_n, dst_n, dst AS d, low + j - 1 AS s, l[j] / list_sum(l) AS w FROM (SELECT *, unnest(range(1, len(l) + 1)) AS j FROM (
 SELECT *, list_transform(list_transform(range(low, high), lambda q: (q + 0.5::DOUBLE - centre) / wide), lambda u: {value}) AS l FROM (
 SELECT *, greatest(0, trunc(centre - 3 * wide)::INT) AS low, least(src_n, ceil(centre + 3 * wide)::INT) AS high FROM (SELECT *, (dst + 0.5::DOUBLE) * scale AS centre, greatest(scale, 1::DOUBLE) AS wide FROM (
 SELECT src_n, dst_n, src_n / dst_n::DOUBLE AS scale, unnest(range(dst_n))::INT AS dst FROM (SELECT DISTINCT * FROM ({pairs})) WHERE dst_n > 0))))) WHERE l[j] <> 0"""


def _resampled(src: str, sizes: str) -> str:
    """CTEs up to ``scaled``: the pixels of src (image_id, ...) at the sizes (image_id, src_w, src_h, width, height)."""
    return f"""z AS MATERIALIZED ({sizes}), wx AS MATERIALIZED ({_lanczos('SELECT src_w AS src_n, width AS dst_n FROM z')}), wy AS MATERIALIZED ({_lanczos('SELECT src_h AS src_n, height AS dst_n FROM z')}),
 lin AS (SELECT image_id, y, x, src_w, src_h, width, height, {", ".join(f"({_lut(2.2)})[{c} + 1] * a / 255.0::DOUBLE AS {c}" for c in "rgb")}, a FROM {src} JOIN z USING (image_id) WHERE width > 0 AND height > 0),
 hx AS (SELECT image_id, y, d AS x, src_h, height, {", ".join(f"sum({c} * w) AS {c}" for c in "rgba")} FROM lin JOIN wx ON wx.src_n = src_w AND wx.dst_n = width AND x = s GROUP BY ALL),
 hy AS (SELECT image_id, d AS y, x, {", ".join(f"sum({c} * w) AS {c}" for c in "rgba")} FROM hx JOIN wy ON wy.src_n = src_h AND wy.dst_n = height AND y = s GROUP BY ALL),
 scaled AS (SELECT image_id, y, x, {", ".join(f"({_lut(1 / 2.2)})[CASE WHEN a > 0 THEN least(255, greatest(0, round(round({c} * 255.0::DOUBLE / a, 6))::INT)) ELSE 0 END + 1]::INT AS {c}" for c in "rgb")}, least(255, greatest(0, round(round(a, 6))::INT)) AS a FROM hy
  UNION ALL SELECT image_id, y, x, r, g, b, a FROM {src} SEMI JOIN (SELECT image_id FROM z WHERE width <= 0 OR height <= 0) USING (image_id))"""


def _folded(base: str, layers: str) -> str:
    """Layers (image_id, step, kind, y, x, r, g, b, a) drawn on a base in the order of their steps."""
    al = "(s.a * 255 + acc.a * (255 - s.a))"
    over = lambda c: f"CASE WHEN {al} > 0 THEN floor((s.{c} * s.a * 255 + acc.{c} * acc.a * (255 - s.a)) / {al} + 0.5::DOUBLE)::INT ELSE 0 END"
    mixed = lambda c: f"floor((s.{c} * s.a + acc.{c} * (255 - s.a) + 127) / 255)::INT"
    parts = ", ".join(f"{c}: CASE s.kind WHEN 'background' THEN s.{c} WHEN 'overlay' THEN {over(c)} ELSE {mixed(c)} END" for c in "rgb")
    fold = "{step: s.step, kind: s.kind, " + parts + f", a: CASE s.kind WHEN 'background' THEN s.a WHEN 'overlay' THEN floor({al} / 255 + 0.5::DOUBLE)::INT ELSE {mixed('a')} END" + "}"
    return f"""SELECT image_id, y, x, o.r AS r, o.g AS g, o.b AS b, o.a AS a FROM (SELECT image_id, y, x, list_reduce(list({{step: step, kind: kind, r: r, g: g, b: b, a: a}} ORDER BY step), lambda acc, s: {fold}) AS o, min(step) AS first FROM (
 SELECT image_id, -1 AS step, 'background' AS kind, y, x, r, g, b, a FROM {base} UNION ALL SELECT image_id, step, kind, y, x, r, g, b, a FROM ({layers})) GROUP BY image_id, y, x) WHERE first = -1"""


def _weights(radius: float) -> str:
    return "g(d, w) AS (VALUES " + ", ".join(f"({d}, {w!r}::DOUBLE)" for d, w in gaussian_weights(radius)) + ")"


def _blurred(size: str, axis: str, other: str, src: str, frames: str = "frames") -> str:
    sums = ", ".join(f"sum(p.{c} * t.w) AS {c}" for c in "rgba")
    taps = f"SELECT {size}, i, least(greatest(i + d, 0), {size} - 1) AS {axis}, sum(w) AS w FROM (SELECT {size}, unnest(range({size}))::INT AS i FROM (SELECT DISTINCT {size} FROM {frames})) CROSS JOIN g GROUP BY ALL"
    return f"SELECT p.image_id, p.width, p.height, p.{other}, t.i AS {axis}, {sums} FROM {src} p JOIN ({taps}) t ON t.{size} = p.{size} AND t.{axis} = p.{axis} GROUP BY ALL"


def _drawn(where: str = "") -> str:
    return f"""SELECT design_id, seq, target_name, (row_number() OVER (PARTITION BY design_id, seq ORDER BY z, k) - 1)::INT AS step, kind, k, element_id, x, y, w, h, round(opacity, 6) AS opacity FROM (
 SELECT design_id, seq, target_name, k, element_id, opacity, CASE WHEN NOT bg THEN 'content' WHEN k = fk THEN 'background' ELSE 'overlay' END AS kind, CASE WHEN NOT bg THEN z_index WHEN k = fk THEN -2 ELSE -1 END AS z,
  CASE WHEN bg THEN 0 ELSE new_x END AS x, CASE WHEN bg THEN 0 ELSE new_y END AS y, CASE WHEN bg THEN target_w ELSE new_w END AS w, CASE WHEN bg THEN target_h ELSE new_h END AS h FROM (
  SELECT *, {E.IS_BACKGROUND} AS bg, min(CASE WHEN {E.IS_BACKGROUND} THEN k END) OVER o AS fk, arg_min(has_image, k) FILTER ({E.IS_BACKGROUND}) OVER o AS fi FROM placed {where} WINDOW o AS (PARTITION BY design_id, seq))
 WHERE (NOT bg AND visible AND has_image AND new_w > 0 AND new_h > 0) OR (bg AND fi AND (k = fk OR (role = 'overlay' AND has_image))))"""


def _lut(power: float) -> str:
    return "[" + ", ".join(str(int(255 * (v / 255) ** power)) for v in range(256)) + "]"


def _side(axis: str, size: str) -> str:
    low, high, at = f"{axis}1", f"{axis}2", f"least(greatest({axis} + d, 0), {size} - 1)"
    return f"SELECT {size}, {low}, {high}, {axis}, sum(CASE WHEN {at} >= {low} AND {at} < {high} THEN w ELSE 0::DOUBLE END) AS m FROM (SELECT *, unnest(range({size}))::INT AS {axis} FROM (SELECT DISTINCT {size}, {low}, {high} FROM frames)) CROSS JOIN g GROUP BY ALL"


def _rendered() -> str:
    """Small canvases by their draw plans: layers with an image only, placed on the thumbnails."""
    thumbs = _PLACED.replace(f"targets AS ({fixtures.TARGETS})", f"targets AS ({fixtures.TARGETS}), thumbnails AS ({fixtures.THUMBNAILS})").replace("chosen AS (SELECT * FROM valid WHERE seq <= 10)", "chosen AS (SELECT * FROM thumbnails)")
    thumbs = thumbs.replace("r0 AS (SELECT c.*, a.template", "r0 AS (SELECT c.* REPLACE (true AS has_image), a.template").replace("FROM classified c CROSS JOIN aspects a", "FROM classified c SEMI JOIN stored USING (design_id, ordinal) CROSS JOIN aspects a")
    back = steps(f"SELECT design_id, seq, target_w, target_h, min(k) FILTER ({E.IS_BACKGROUND}) AS bg_k, arg_min(width, k) FILTER ({E.IS_BACKGROUND}) AS bg_w, arg_min(height, k) FILTER ({E.IS_BACKGROUND}) AS bg_h, arg_min(has_image, k) FILTER ({E.IS_BACKGROUND}) AS bg_image FROM placed GROUP BY ALL", E.BACKGROUND)
    return f"""WITH RECURSIVE {_PIXELS}, stored AS (SELECT DISTINCT image_id // 8 AS design_id, (image_id % 8)::INT AS ordinal FROM pixels), {thumbs},
 back AS MATERIALIZED ({back}), drawn AS MATERIALIZED ({_drawn()}),
 plan AS MATERIALIZED (SELECT d.design_id, d.seq, target_w, target_h, step, kind, c.opacity, c.design_id * 8 + c.ordinal AS vec, {", ".join(f"CASE WHEN kind = 'background' THEN {v} ELSE d.{n} END::INT AS {n}" for n, v in (("x", "-crop_x"), ("y", "-crop_y"), ("w", "scaled_w"), ("h", "scaled_h")))}
  FROM drawn d JOIN back USING (design_id, seq) JOIN classified c ON c.design_id = d.design_id AND c.element_id = d.element_id),
 own AS (SELECT {{d: design_id, s: seq, step: step}} AS image_id, p.y, p.x, r, g, b, a FROM plan JOIN pixels p ON p.image_id = vec),
 {_resampled('own', 'SELECT {d: design_id, s: seq, step: step} AS image_id, 8 AS src_w, 8 AS src_h, w AS width, h AS height FROM plan')},
 canvas AS (SELECT {{d: design_id, s: seq}} AS image_id, y::INT AS y, x::INT AS x, 255 AS r, 255 AS g, 255 AS b, 255 AS a FROM (SELECT DISTINCT design_id, seq, target_w, target_h FROM plan) f, range(target_h) a(y), range(target_w) b(x)),
 backs AS (SELECT p.*, y2::INT AS cy, x2::INT AS cx FROM plan p, range(target_h) a(y2), range(target_w) b(x2) WHERE kind = 'background'),
 layers AS (SELECT {{d: design_id, s: seq}} AS image_id, step, kind, cy AS y, cx AS x, r, g, b, a FROM backs JOIN scaled z ON z.image_id = {{d: design_id, s: seq, step: step}} AND z.y = least(greatest(cy - backs.y, 0), h - 1) AND z.x = least(greatest(cx - backs.x, 0), w - 1)
  UNION ALL SELECT {{d: design_id, s: seq}}, step, kind, z.y + p.y, z.x + p.x, r, g, b, CASE WHEN kind = 'content' AND opacity < 1 THEN trunc(a * opacity)::INT ELSE a END FROM plan p JOIN scaled z ON z.image_id = {{d: design_id, s: seq, step: step}} WHERE kind <> 'background')
 SELECT image_id.d AS design_id, image_id.s AS seq, y, x, r, g, b FROM ({_folded('canvas', 'SELECT * FROM layers')})"""


def _user_templates() -> str:
    """Placements by templates whose zones share roles: the walk itself, a step a layer."""
    old = _PLACED[_PLACED.index("listed AS (") : _PLACED.index("r2 AS (")]
    new = f"""spots AS (SELECT template, list(zone ORDER BY no) AS zs, list(list_concat(roles, ['photo', 'cta']) ORDER BY no) AS rs FROM (SELECT *, CASE WHEN template LIKE 'landscape%' THEN 10 - zone_no ELSE zone_no END AS no FROM zones) GROUP BY template),
ordered AS (SELECT design_id, template, k, role, row_number() OVER (PARTITION BY design_id, template ORDER BY priority, width::BIGINT * height DESC, k) AS i FROM classified CROSS JOIN aspects WHERE NOT {E.IS_BACKGROUND}),
walk AS (SELECT DISTINCT design_id, template, 0::BIGINT AS i, [0, 0, 0, 0] AS held, NULL::INT AS k, NULL::BIGINT AS z FROM ordered UNION ALL
 SELECT design_id, template, i, CASE WHEN z IS NULL THEN held ELSE list_transform([1, 2, 3, 4], lambda j: held[j] + (j = z)::INT) END, k, z FROM (
  SELECT o.design_id, o.template, o.i, o.k, w.held, list_filter(range(1, len(rs) + 1), lambda j: list_contains(rs[j], o.role) AND w.held[j] < 2)[1] AS z FROM walk w JOIN ordered o ON o.design_id = w.design_id AND o.template = w.template AND o.i = w.i + 1 JOIN spots s ON s.template = w.template)),
r1 AS (SELECT c.*, a.template, s.zs[w.z] AS zone, width::BIGINT * height AS area, CASE WHEN w.z IS NOT NULL THEN 1 END AS rank FROM classified c CROSS JOIN aspects a JOIN spots s ON s.template = a.template LEFT JOIN (SELECT * FROM walk WHERE z IS NOT NULL) w ON w.design_id = c.design_id AND w.template = a.template AND w.k = c.k),
"""
    return _PLACED.replace(old, new)


def _flat_rendered() -> str:
    """Flat images on small canvases: the fit's numbers, then a pixel for each place."""
    own = "{d: design_id, s: seq}"
    plan = steps("SELECT image_id AS design_id, flat_w AS src_w, flat_h AS src_h, seq, t.width AS target_w, t.height AS target_h, 'smart' AS mode FROM frames CROSS JOIN thumbnails t", E.FIT)
    rgb = ", ".join(f"CASE WHEN plan <> 'extend' OR inside THEN coalesce(q.{c}, 0) ELSE round(round(s.{c}, 6))::INT END AS {c}" for c in "rgb")
    return f"""WITH {_PIXELS}, thumbnails AS ({fixtures.THUMBNAILS}), fit AS MATERIALIZED (SELECT *, CASE plan WHEN 'cover' THEN cover_w ELSE contain_w END::INT AS w, CASE plan WHEN 'cover' THEN cover_h ELSE contain_h END::INT AS h,
  CASE plan WHEN 'cover' THEN -crop_x ELSE off_x END::INT AS px, CASE plan WHEN 'cover' THEN -crop_y ELSE off_y END::INT AS py FROM ({plan})),
 own AS (SELECT {own} AS image_id, p.y, p.x, r, g, b, a FROM fit f JOIN pixels p ON p.image_id = f.design_id AND p.x < f.src_w AND p.y < f.src_h),
 {_resampled('own', f'SELECT {own} AS image_id, src_w, src_h, w AS width, h AS height FROM fit')},
 places AS (SELECT {own} AS image_id, plan, px, py, w, h, target_w AS width, target_h AS height, y::INT AS y, x::INT AS x, x >= dst_x1 AND x < dst_x2 AND y >= dst_y1 AND y < dst_y2 AS inside FROM fit, range(target_h) a(y), range(target_w) b(x)),
 wide AS MATERIALIZED (SELECT p.*, r, g, b, a FROM places p LEFT JOIN scaled z ON z.image_id = p.image_id AND z.y = CASE plan WHEN 'extend' THEN least(greatest(p.y - py, 0), h - 1) ELSE p.y - py END AND z.x = CASE plan WHEN 'extend' THEN least(greatest(p.x - px, 0), w - 1) ELSE p.x - px END),
 soft AS MATERIALIZED (SELECT * FROM wide WHERE plan = 'extend'), {_weights(3)}, bx AS MATERIALIZED ({_blurred('width', 'x', 'y', 'soft', 'soft')}), bxy AS MATERIALIZED ({_blurred('height', 'y', 'x', 'bx', 'soft')})
 SELECT q.image_id.d AS design_id, q.image_id.s AS seq, q.y, q.x, {rgb} FROM wide q LEFT JOIN bxy s ON s.image_id = q.image_id AND s.y = q.y AND s.x = q.x"""


def _softmax(prompts: str, scale: float) -> str:
    """CTEs up to s: the probability of each prompt of a query (prompt, role, e) for each vector."""
    return f"""v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), p AS ({prompts}), l AS (SELECT v.vec_id, prompt, role, {scale}::DOUBLE * list_inner_product(v.e, p.e) AS l FROM v CROSS JOIN p),
 m AS (SELECT *, max(l) OVER (PARTITION BY vec_id) AS most FROM l), s AS (SELECT *, exp(l - most) / sum(exp(l - most)) OVER (PARTITION BY vec_id) AS prob FROM m)"""


_MANY = _softmax(f"SELECT vec_id AS prompt, {catalogs.PROMPT_ROLES}[vec_id % 15 + 1] AS role, list_reverse(embedding::DOUBLE[]) AS e FROM embeddings WHERE vec_id < 1000", 10.0)


def _new_oracles() -> dict[str, str]:
    placed = f"WITH RECURSIVE {_PLACED}"
    valid = placed.replace("chosen AS (SELECT * FROM valid WHERE seq <= 10)", "chosen AS (SELECT * FROM valid)")
    nations = placed.replace("chosen AS (SELECT * FROM valid WHERE seq <= 10)", "chosen AS (SELECT n_nationkey::INT AS seq, n_name AS name, (100 + n_nationkey * 137 % 1900)::INT AS width, (100 + n_nationkey * 211 % 900)::INT AS height FROM nation)")
    columns = "design_id, element_id, k, seq, target_name, section, zone, result_pos, new_x, new_y, new_w, new_h, scale_factor, visible"
    free = placed.replace("0.3::DOUBLE AS min_scale, 2::DOUBLE AS max_scale, true AS maintain_aspect", "(ordinal % 4) * 0.2::DOUBLE AS min_scale, 0.4::DOUBLE + (design_id % 3) * 0.5::DOUBLE AS max_scale, ordinal % 3 <> 0 AS maintain_aspect")
    drawn = f"SELECT design_id, seq, count(*)::INT AS n FROM ({_drawn()}) GROUP BY ALL"
    part_roles = f"{list(catalogs.ROLE_PRIORITY)}[p_partkey % 17 + 1]"
    return {
        "s4_nested_trees": f"""WITH RECURSIVE layers_raw AS MATERIALIZED ({fixtures.LAYERS_RAW}), walk AS (SELECT design_id, ordinal, [ordinal] AS path FROM layers_raw WHERE parent_ordinal IS NULL UNION ALL
 SELECT c.design_id, c.ordinal, list_append(w.path, c.ordinal) FROM walk w JOIN layers_raw c ON c.design_id = w.design_id AND c.parent_ordinal = w.ordinal),
 walked AS (SELECT *, (row_number() OVER (PARTITION BY design_id ORDER BY path) - 1)::INT AS o FROM walk)
SELECT r.design_id, w.o AS ordinal, canvas_w, canvas_h, name, layer_type, x, y, width, height, visible, opacity_u8, text_content, has_image, u.o AS parent_ordinal
FROM layers_raw r JOIN walked w ON w.design_id = r.design_id AND w.ordinal = r.ordinal LEFT JOIN walked u ON u.design_id = r.design_id AND u.ordinal = r.parent_ordinal""",
        "s5_flatten_large": f"WITH RECURSIVE {_TREE} SELECT design_id, ordinal, k, n, element_id, z_index FROM flat",
        "p5_user_patterns": f"""WITH p AS (SELECT (p_partkey * 7919) % 100003 AS rank, {part_roles} AS role, lower(substring(p_name, 1 + p_partkey % 7, 2 + p_partkey % 11)) AS pattern FROM part),
 n AS (SELECT p_partkey, lower(p_name || ' ' || (p_partkey % 100)) AS name FROM part)
SELECT p_partkey, min({{rank: rank, role: role}}).role AS pattern_role FROM n LEFT JOIN p ON (length(pattern) > 5 OR rank % 50 = 0) AND contains(name, pattern) GROUP BY p_partkey""",
        "p9_many_prompts": f"WITH {_MANY} SELECT vec_id, CASE WHEN max(prob) >= 0.02 THEN arg_min(role, prompt) FILTER (l = most) END AS role, round(max(prob), 4) AS prob FROM s GROUP BY vec_id",
        "w4_many_prompts": f"WITH {_MANY} SELECT prompt, count(*) AS n, round(max(prob), 4) AS most, round(sum(prob), 3) AS total FROM s GROUP BY prompt",
        "w2_layout_user_templates": f"WITH RECURSIVE {_user_templates()} SELECT {columns} FROM placed",
        "w2_shared_roles": f"""WITH RECURSIVE {_CLASSIFIED}, {_ZONES}, r AS (SELECT template, role, string_agg(zone, ',' ORDER BY zone) AS zones, count(*) AS c FROM (SELECT DISTINCT template, zone, unnest(list_concat(roles, ['photo', 'cta'])) AS role FROM zones) GROUP BY ALL)
SELECT template, role, zones, n_layers FROM r JOIN (SELECT role, count(*) AS n_layers FROM classified GROUP BY role) USING (role) WHERE c > 1""",
        "l3_place_options": f"{free} SELECT {columns} FROM placed WHERE section = 1",
        "l5_many_targets": f"{nations} SELECT seq, template, section, zone, count(*) AS n, sum(new_x)::BIGINT AS new_x, sum(new_y)::BIGINT AS new_y, sum(new_w)::BIGINT AS new_w, sum(new_h)::BIGINT AS new_h FROM placed GROUP BY ALL",
        "a4_last_result_rows": f"""{valid} SELECT design_id, p.target_name, p.seq, target_w, target_h, coalesce(n, 0)::INT AS n_drawn FROM (SELECT DISTINCT design_id, target_name, seq, target_w, target_h FROM placed) p
 SEMI JOIN (SELECT name AS target_name, max(seq) AS seq FROM valid GROUP BY name) l ON l.target_name = p.target_name AND l.seq = p.seq LEFT JOIN ({drawn}) d USING (design_id, seq)""",
        "b1_batch_with_rejects": f"""{valid.replace("FROM valid)", "FROM valid WHERE seq <> 10)")} SELECT 'result' AS status, p.design_id, p.seq, p.target_name, n_placed, n_visible, coalesce(n, 0)::INT AS n_drawn, NULL AS reason FROM (SELECT design_id, seq, target_name, count(*)::INT AS n_placed, count(*) FILTER (visible)::INT AS n_visible FROM placed GROUP BY ALL) p LEFT JOIN ({drawn}) d USING (design_id, seq)
 UNION ALL SELECT DISTINCT 'design', design_id, NULL, NULL, NULL, NULL, NULL, 'no layers' FROM layers_raw WHERE design_id NOT IN (SELECT design_id FROM flat) UNION ALL SELECT 'target', NULL, seq, name, NULL, NULL, NULL, reason FROM judged WHERE reason IS NOT NULL""",
        "r7_feather_masks": "WITH e AS (SELECT p_partkey, (p_partkey % 23 + 1)::INT AS w, (p_partkey % 19 + 1)::INT AS h FROM part), f AS (SELECT *, least(6, w // 2, h // 2) AS f FROM e), d AS (SELECT p_partkey, y::INT AS y, f, least(x, w - 1 - x, y, h - 1 - y) AS d FROM f, range(h) a(y), range(w) b(x)), v AS (SELECT p_partkey, y, CASE WHEN f <= 0 OR d >= f THEN 255 ELSE trunc(255::DOUBLE * (d / f::DOUBLE)) END::INT AS value FROM d) SELECT p_partkey, y, sum(value)::BIGINT AS total, count(*) FILTER (value = 255) AS n_whole FROM v GROUP BY ALL",
        "r14_render_flat": _flat_rendered(),
    }


def oracle_sql() -> dict[str, str]:
    tree = lambda q: f"WITH RECURSIVE {_TREE} {q}"
    role = lambda q: f"WITH RECURSIVE {_CLASSIFIED} {q}"
    rank = lambda q: f"WITH RECURSIVE {_RANKED} {q}"
    place = lambda q: f"WITH RECURSIVE {_PLACED} {q}"
    raw = lambda q: f"WITH layers_raw AS ({fixtures.LAYERS_RAW}) {q}"
    fit = lambda q: f"WITH {_FIT} {q}"
    px = lambda q: f"WITH {_PIXELS} {q}"
    labels = ", ".join(f"({i}, '{n}', '{n} ({w}x{h})', {w}, {h})" for i, (n, w, h) in enumerate(catalogs.PRESETS, 1))
    roles = ", ".join(f"'{r}'" for r in catalogs.ROLE_PRIORITY)
    first_latest = f"corr AS ({fixtures.CORRECTIONS}), latest AS (SELECT design_id, ordinal, arg_max(new_role, seq) FILTER (new_role IN ({roles})) AS nr, arg_max(new_priority, seq) FILTER (new_priority IS NOT NULL) AS np FROM corr GROUP BY ALL)"
    mix = lambda c: f"least(255, greatest(0, trunc((CASE WHEN {_INSIDE} THEN coalesce(p.{c}, 0) ELSE 0 END) * (mx.m * my.m) + w.{c} * (1.0::DOUBLE - (mx.m * my.m)))))::INT AS {c}"
    overlaid = lambda c: f"CASE WHEN al > 0 THEN floor((s{c} * sa * 255 + {c} * a * (255 - sa)) / al + 0.5::DOUBLE) ELSE 0 END::INT AS {c}"
    return _new_oracles() | {
        "s1_scan_files": f"SELECT page_id, url, extension, {_KIND} FROM (SELECT page_id, url, {_EXT.replace('@', 'url')} AS extension FROM pages)",
        "s2_route_format": f"SELECT p_partkey, extension, {_KIND} FROM (SELECT p_partkey, {_EXT.replace('@', 'file')} AS extension FROM (SELECT p_partkey, p_name || '.' || {[*EXTENSIONS, 'PSD', 'gif', 'Png']}[p_partkey % 8 + 1] AS file FROM part))",
        "s5_flatten_tree": tree("SELECT design_id, ordinal, k, n, name, layer_type, x, y, width, height FROM flat"),
        "s6_unusable": raw("SELECT design_id, ordinal, width, height FROM layers_raw WHERE NOT (width >= 10 AND height >= 10)"),
        "s7_element_ids": tree("SELECT design_id, k, element_id FROM flat"),
        "s8_z_index_document": tree("SELECT design_id, ordinal, k AS z_index FROM flat"),
        "s8_z_index": tree("SELECT design_id, ordinal, z_index FROM flat"),
        "s9_attributes": raw("SELECT design_id, ordinal, round(coalesce(opacity_u8 / 255.0::DOUBLE, 1), 6) AS opacity, 'normal' AS blend_mode FROM layers_raw"),
        "s10_manifest": place("SELECT DISTINCT design_id, target_name, replace(target_name, ' ', '_') || '.png' AS file FROM placed"),
        "s11_rejects": f"WITH RECURSIVE {_TREE}, {_TARGETS} SELECT DISTINCT 'design' AS stage, design_id::VARCHAR AS key, 'no layers' AS reason FROM layers_raw WHERE design_id NOT IN (SELECT design_id FROM flat) UNION ALL SELECT 'target', name, reason FROM judged WHERE reason IS NOT NULL",
        "p1_geometry": raw(f"SELECT design_id, ordinal, x2, y2, center_x, center_y, area FROM ({steps('SELECT * FROM layers_raw', E.GEOMETRY)})"),
        "p2_scale": raw(" UNION ALL ".join(f"SELECT '{n}' AS factor, design_id, ordinal, sx, sy, swidth, sheight FROM ({steps('SELECT * FROM layers_raw', E.scaled(f))})" for n, f in (("fixed", E.dbl(0.7)), ("own", "((ordinal % 4 + 1) * CAST(0.35 AS DOUBLE))")))),
        "p3_validate_targets": f"WITH {_TARGETS}, s AS (SELECT seq, width::VARCHAR AS w, height::VARCHAR AS h FROM targets UNION ALL SELECT p_partkey::INT, CASE WHEN p_partkey % 7 = 0 THEN p_name ELSE (p_partkey * 37 % 6000)::VARCHAR END, (p_partkey * 11 % 5000 - 20)::VARCHAR FROM part UNION ALL SELECT -p_partkey::INT, (p_partkey % 13) || '.5', (4090 + p_partkey % 9) || '.9' FROM part), n AS (SELECT seq, TRY_CAST(w AS DOUBLE) AS width, TRY_CAST(h AS DOUBLE) AS height FROM s) SELECT seq, trunc(width)::INT AS width, trunc(height)::INT AS height, {E.TARGET_REASON} AS reason FROM n",
        "p4_is_background": role(f"SELECT design_id, k, {E.IS_BACKGROUND} AS is_background FROM classified"),
        "p5_name_role": raw(f"SELECT design_id, ordinal, {E.NAME_ROLE} AS name_role FROM layers_raw"),
        "p6_priority_suffix": raw(f"SELECT design_id, ordinal, {E.SUFFIX} AS suffix FROM layers_raw"),
        "p8_geometry_role": raw(f"SELECT design_id, ordinal, {E.GEOMETRY_ROLE} AS geometry_role FROM ({steps('SELECT * FROM layers_raw', E.CLASSIFY[:1])})"),
        "p9_embedding_role": f"WITH {_PROBS} SELECT vec_id, CASE WHEN max(prob) >= 0.7 THEN {catalogs.PROMPT_ROLES}[arg_max(prompt, prob) + 1] END AS role, round(max(prob), 4) AS prob FROM s GROUP BY vec_id",
        "p10_classify_with_embedding": f"WITH RECURSIVE {_TREE}, {_PROBS}, e AS (SELECT vec_id, CASE WHEN max(prob) >= 0.7 THEN {catalogs.PROMPT_ROLES}[arg_max(prompt, prob) + 1] END AS embedding_role FROM s GROUP BY vec_id) SELECT design_id, ordinal, role, priority, embedding_role FROM ({steps('SELECT f.*, e.embedding_role FROM flat f LEFT JOIN e ON e.vec_id = f.design_id * 8 + f.ordinal AND f.ordinal < 8', E.CLASSIFY_WITH_EMBEDDING)})",
        "w4_softmax": f"WITH {_PROBS} SELECT vec_id, prompt::INT AS prompt, round(prob, 4) AS prob FROM s",
        "t4_best_prompt": f"WITH {_PROBS} SELECT vec_id, {catalogs.PROMPT_ROLES}[arg_max(prompt, prob) + 1] AS role FROM s GROUP BY vec_id",
        "s4_read_layers": raw("SELECT design_id, ordinal, canvas_w, canvas_h, name, layer_type, x, y, width, height, visible, opacity_u8, text_content, has_image, parent_ordinal FROM layers_raw"),
        "p7_group_first": raw(f"SELECT design_id, ordinal, role, priority, suffix FROM ({steps('SELECT * FROM layers_raw', E.CLASSIFY)}) WHERE layer_type = 'group'"),
        "p11_cap_priority": role(f"SELECT design_id, ordinal, coalesce(suffix, 5) AS own_priority, {E.ROLE_CAP} AS cap, priority FROM classified"),
        "j2_priority_overrides": f"WITH RECURSIVE {_CLASSIFIED}, {first_latest} SELECT c.design_id, c.ordinal, c.priority AS old_priority, greatest(1, least(9, np)) AS priority FROM classified c JOIN latest l ON l.design_id = c.design_id AND l.ordinal = c.ordinal WHERE np IS NOT NULL AND greatest(1, least(9, np)) <> c.priority",
        "j7_placement_lookup": place("SELECT c.design_id, c.element_id, c.z_index, c.has_image, c.role, p.seq, new_x, new_y, new_w, new_h FROM classified c JOIN placed p ON p.design_id = c.design_id AND p.element_id = c.element_id WHERE p.visible"),
        "u1_sections": place("SELECT seq, target_name, section, count(*) AS n, count(*) FILTER (visible) AS n_visible FROM placed GROUP BY ALL"),
        "u2_all_targets": f"WITH p(seq, name, label, width, height) AS (VALUES {labels}), t AS (SELECT name, width, height FROM p UNION ALL SELECT 'Own ' || o_orderkey, (o_orderkey % 4200)::INT, trunc((o_custkey % 29) / 2.0::DOUBLE)::INT FROM orders WHERE o_orderkey % 4200 > 0 AND o_custkey % 29 > 0) SELECT name, width, height, {E.TARGET_REASON} AS reason FROM t",
        "t1_content_order": role(f"SELECT design_id, k, priority, width::BIGINT * height AS area, row_number() OVER (PARTITION BY design_id ORDER BY priority, width::BIGINT * height DESC, k)::INT AS place FROM classified WHERE NOT {E.IS_BACKGROUND}"),
        "t3_draw_order": role(f"SELECT design_id, (row_number() OVER (PARTITION BY design_id ORDER BY z_index, k) - 1)::INT AS place, z_index, k, element_id FROM classified WHERE NOT {E.IS_BACKGROUND}"),
        "t5_result_order": rank("SELECT design_id, template, result_pos, section, k FROM ranked"),
        "w2_assign_general": f"""WITH RECURSIVE {_CLASSIFIED}, ordered AS (SELECT design_id, k, role, row_number() OVER (PARTITION BY design_id ORDER BY priority, width::BIGINT * height DESC, k) AS i FROM classified WHERE NOT {E.IS_BACKGROUND}),
 walk AS (SELECT DISTINCT design_id, 0::BIGINT AS i, [0, 0, 0, 0] AS held, NULL::INT AS k, NULL::BIGINT AS z FROM ordered UNION ALL
  SELECT design_id, i, CASE WHEN z IS NULL THEN held ELSE list_transform([1, 2, 3, 4], lambda j: held[j] + (j = z)::INT) END, k, z FROM (
   SELECT o.design_id, o.i, o.k, w.held, list_filter([1::BIGINT, 2, 3, 4], lambda j: list_contains({_SHARED}[j], o.role) AND w.held[j] < 2)[1] AS z FROM walk w JOIN ordered o ON o.design_id = w.design_id AND o.i = w.i + 1))
 SELECT design_id, k, {[z[0] for z in catalogs.TEMPLATES["square"][2]]}[z] AS zone FROM walk WHERE z IS NOT NULL""",
        "p10_classify": role("SELECT design_id, ordinal, role, priority FROM classified"),
        "p12_text_preview": raw(f"SELECT design_id, ordinal, {E.TEXT_PREVIEW} AS preview FROM layers_raw"),
        "p13_annotations": role(f"SELECT design_id, k, x, y, x2, y2, r, g, b, outline, label, label_x, label_y FROM ({steps('SELECT * FROM classified WHERE role <> $$background$$', E.GEOMETRY + E.ANNOTATE)})"),
        "p14_preview_base": role("SELECT design_id, canvas_w, canvas_h, (b).element_id AS element_id, b IS NOT NULL AND ((b).width <> canvas_w OR (b).height <> canvas_h) AS resized, CASE WHEN b IS NULL THEN 240 END AS grey FROM (SELECT design_id, canvas_w, canvas_h, min({k: k, element_id: element_id, width: width, height: height}) FILTER (role = 'background' AND has_image) AS b FROM classified GROUP BY ALL)"),
        "j1_overrides": f"WITH RECURSIVE {_CLASSIFIED}, {first_latest} SELECT c.design_id, c.ordinal, coalesce(nr, role) AS role, CASE WHEN np IS NULL THEN priority ELSE greatest(1, least(9, np)) END AS priority FROM classified c LEFT JOIN latest l ON l.design_id = c.design_id AND l.ordinal = c.ordinal",
        "j1_rejected_overrides": f"WITH RECURSIVE {_CLASSIFIED}, {first_latest} SELECT * FROM (SELECT r.design_id, r.ordinal, seq, new_role, CASE WHEN c.design_id IS NULL THEN 'no such layer' WHEN new_role NOT IN ({roles}) THEN 'no such role' END AS reason FROM corr r LEFT JOIN classified c ON c.design_id = r.design_id AND c.ordinal = r.ordinal) WHERE reason IS NOT NULL",
        "j3_resolve_targets": f"WITH p(seq, name, label, width, height) AS (VALUES {labels}) SELECT name, width, height, count(*) AS n FROM (SELECT name, width, height FROM orders JOIN p ON p.seq = o_orderkey % 12 + 1 UNION ALL SELECT CASE WHEN o_orderkey % 3 <> 0 THEN 'Own ' || o_orderkey ELSE 'Custom' END, (o_orderkey % 3000 - 100)::INT, trunc((o_orderkey % 41) / 2.0::DOUBLE)::INT FROM orders WHERE o_orderkey % 3000 > 100 AND o_orderkey % 41 > 0) GROUP BY ALL",
        "j4_pairs": f"WITH {_PAIRS} SELECT design_id, seq, name, width, height FROM designs CROSS JOIN valid",
        "j5_select_template": f"WITH {_SIZES}, {_ASPECTS} SELECT seq, width, height, template FROM ({_templated('sizes')})",
        "j6_candidate_zones": rank("SELECT design_id, k, template, zone FROM ranked WHERE zone IS NOT NULL"),
        "w1_assign_zones": rank("SELECT design_id, template, zone, rank, k FROM ranked WHERE section = 1"),
        "j8_unassigned": rank("SELECT design_id, template, k, result_pos FROM ranked WHERE section = 2"),
        "l2_zone_rects": f"WITH {_SIZES}, {_ZONES}, {_ASPECTS} SELECT seq, template, zone, zone_no, {_ints('zx zy zw zh')} FROM ({_rects('sizes')})",
        **{q: place(f"SELECT design_id, element_id, k, seq, target_name, section, zone, result_pos, new_x, new_y, new_w, new_h, scale_factor, visible FROM placed WHERE section = {i}") for q, i in (("l1_place_background", 0), ("l3_place_in_zone", 1), ("l4_place_fallback", 2))},
        "l5_layout": place("SELECT design_id, element_id, k, seq, target_name, section, zone, result_pos, new_x, new_y, new_w, new_h, scale_factor, visible FROM placed"),
        "a1_summary": role(f"SELECT design_id, canvas_w, canvas_h, n::BIGINT AS n_layers, k AS pos, element_id, role, priority, x, has_image, {E.TEXT_PREVIEW} AS text FROM classified"),
        "a2_zone_occupancy": rank("SELECT design_id, template, zone, count(*) AS n FROM ranked WHERE section = 1 GROUP BY ALL"),
        "a3_alpha_share": px("SELECT image_id, round(avg((a < 255)::INT), 6) AS share, avg((a < 255)::INT) > 0.05 AS has_transparency FROM pixels GROUP BY image_id"),
        "a4_last_result": f"WITH {_PAIRS} SELECT design_id, name AS target_name, max(seq) AS seq FROM designs CROSS JOIN valid GROUP BY ALL",
        "a5_batch_counts": tree("SELECT design_id, count(*) AS n_layers, count(*) FILTER (has_image) AS n_images FROM flat GROUP BY design_id"),
        "a6_warnings": place("SELECT design_id, target_name, string_agg('not drawn: ' || name, '; ' ORDER BY k) AS warnings FROM placed WHERE section > 0 AND visible AND (NOT has_image OR new_w <= 0 OR new_h <= 0) GROUP BY ALL"),
        "t2_first_background": role(f"SELECT design_id, min(k) AS k, arg_min(element_id, k) AS element_id FROM classified WHERE {E.IS_BACKGROUND} GROUP BY design_id"),
        "f1_fit_decision": fit("SELECT design_id, seq, mode, use_cover FROM fit"),
        "f2_cover": fit(f"SELECT design_id, seq, {_ints('cover_w cover_h crop_x crop_y')}, cover_scale FROM fit"),
        "f3_contain": fit(f"SELECT design_id, seq, {_ints('contain_w contain_h off_x off_y')}, extends FROM fit"),
        "f5_regions": fit(f"SELECT design_id, seq, {_ints('dst_x1 dst_y1 dst_x2 dst_y2 src_x1 src_y1 src_x2 src_y2')} FROM fit"),
        "f6_strips": fit(f"SELECT design_id, seq, {_ints('strip_top strip_bottom strip_left strip_right')}, corner_tl, corner_tr, corner_bl, corner_br FROM fit"),
        "f7_fit_plan": fit("SELECT design_id, seq, plan, generated::BIGINT AS generated FROM fit"),
        "c1_flat_source": tree("SELECT DISTINCT design_id, n = 1 AND design_id % 2 = 0 AS is_flat FROM flat"),
        "c2_background_plan": place(f"""SELECT design_id, seq, mode, element_id, {_ints('scaled_w scaled_h crop_x crop_y')}, filled::BIGINT AS filled FROM ({steps(f"SELECT design_id, seq, target_w, target_h, min(k) FILTER ({E.IS_BACKGROUND}) AS bg_k, arg_min(element_id, k) FILTER ({E.IS_BACKGROUND}) AS element_id, arg_min(width, k) FILTER ({E.IS_BACKGROUND}) AS bg_w, arg_min(height, k) FILTER ({E.IS_BACKGROUND}) AS bg_h, arg_min(has_image, k) FILTER ({E.IS_BACKGROUND}) AS bg_image FROM placed GROUP BY ALL", E.BACKGROUND)})"""),
        "c3_overlay_plan": place(f"SELECT design_id, seq, step, k, element_id, x, y, w, h FROM ({_drawn()}) WHERE kind = 'overlay'"),
        "c4_draw_plan": place(_drawn()),
        "c5_compose_plan": place(f"""{_drawn("WHERE NOT (n = 1 AND design_id % 2 = 0)")} UNION ALL SELECT design_id, seq, target_name, 0, plan, k, element_id,
 CASE plan WHEN 'blank' THEN 0 WHEN 'cover' THEN -crop_x ELSE off_x END::INT, CASE plan WHEN 'blank' THEN 0 WHEN 'cover' THEN -crop_y ELSE off_y END::INT,
 CASE plan WHEN 'blank' THEN target_w WHEN 'cover' THEN cover_w ELSE contain_w END::INT, CASE plan WHEN 'blank' THEN target_h WHEN 'cover' THEN cover_h ELSE contain_h END::INT, round(opacity, 6) FROM (
 {steps("SELECT design_id, seq, t.name AS target_name, k, element_id, opacity, canvas_w AS src_w, canvas_h AS src_h, t.width AS target_w, t.height AS target_h, 'smart' AS mode FROM classified CROSS JOIN chosen t WHERE n = 1 AND design_id % 2 = 0", E.FIT)})"""),
        "b1_batch_relayout": place(f"""SELECT p.design_id, p.seq, p.target_name, n_placed, n_visible, coalesce(n_drawn, 0)::INT AS n_drawn FROM (SELECT design_id, seq, target_name, count(*)::INT AS n_placed, count(*) FILTER (visible)::INT AS n_visible FROM placed GROUP BY ALL) p
 LEFT JOIN (SELECT design_id, seq, count(*) AS n_drawn FROM ({_drawn()}) GROUP BY ALL) d USING (design_id, seq)""").replace("FROM valid WHERE seq <= 10", "FROM valid WHERE seq <> 10"),
        "r1_gamma": px("SELECT image_id, y, x, " + ", ".join(f"({_lut(1 / 2.2)})[({_lut(2.2)})[{c} + 1] + 1]::INT AS {c}" for c in "rgb") + ", a FROM pixels"),
        "r2_resample": px(f", {_resampled('pixels', 'SELECT image_id, src_w, src_h, to_w AS width, to_h AS height FROM frames')} SELECT * FROM scaled"),
        "r14_render": _rendered(),
        "r3_crop": px(", cut AS (SELECT f.*, y::INT AS y, x::INT AS x FROM frames f, range(cut_h) a(y), range(cut_w) b(x)) SELECT f.image_id, f.y, f.x, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in "rgba") + " FROM cut f LEFT JOIN pixels p ON p.image_id = f.image_id AND p.y = f.y + y0 AND p.x = f.x + x0"),
        "r4_extend_edges": px(f", {_WIDE} SELECT image_id, y, x, r, g, b, a FROM wide"),
        "r5_blur": px(f", {_WIDE}, {_weights(3)}, bx AS MATERIALIZED ({_blurred('width', 'x', 'y', 'wide')}), bxy AS MATERIALIZED ({_blurred('height', 'y', 'x', 'bx')}) SELECT w.image_id, w.y, w.x, " + ", ".join(f"CASE WHEN {_INSIDE} THEN w.{c} ELSE round(round(s.{c}, 6))::INT END AS {c}" for c in "rgba") + " FROM wide w JOIN bxy s USING (image_id, y, x)"),
        "r6_feather_blend": px(f", {_WIDE}, {_weights(8)}, mx AS MATERIALIZED ({_side('x', 'width')}), my AS MATERIALIZED ({_side('y', 'height')}) SELECT image_id, y, x, r, g, b, a FROM (SELECT w.image_id, w.y, w.x, {mix('r')}, {mix('g')}, {mix('b')}, w.a FROM wide w JOIN mx USING (width, x1, x2, x) JOIN my USING (height, y1, y2, y) JOIN frames f ON f.image_id = w.image_id LEFT JOIN pixels p ON p.image_id = w.image_id AND p.y = w.y - f.dy AND p.x = w.x - f.dx)"),
        "r7_feather_mask": "WITH s AS (SELECT DISTINCT (p_partkey % 23 + 1)::INT AS w, (p_partkey % 19 + 1)::INT AS h FROM part), e AS (SELECT w, h, y::INT AS y, x::INT AS x, least(6, w // 2, h // 2) AS f FROM s, range(h) a(y), range(w) b(x)), d AS (SELECT *, least(x, w - 1 - x, y, h - 1 - y) AS d FROM e) SELECT w, h, y, x, CASE WHEN f <= 0 OR d >= f THEN 255 ELSE trunc(255::DOUBLE * (d / f::DOUBLE)) END::INT AS value FROM d",
        "r8_opacity": px("SELECT image_id, y, x, r, g, b, CASE WHEN (image_id % 5 + 1) / 4.0::DOUBLE < 1 THEN trunc(a * ((image_id % 5 + 1) / 4.0::DOUBLE))::INT ELSE a END AS a FROM pixels"),
        "r9_paste": px(f""" {_folded("pixels", "SELECT p.image_id, 0 AS step, 'content' AS kind, y - y0 AS y, x + x0 AS x, b AS r, g, r AS b, a FROM pixels p JOIN frames USING (image_id) UNION ALL SELECT image_id, 1, 'content', y - 2, x + 3, r, g, b, trunc(a * (x + 1) / 8)::INT FROM pixels")}"""),
        "r10_over": px(f", o AS (SELECT *, g AS sr, g AS sg, b AS sb, trunc(a * (x + 1) / 8)::INT AS sa FROM pixels), q AS (SELECT *, sa * 255 + a * (255 - sa) AS al FROM o) SELECT image_id, y, x, {overlaid('r')}, {overlaid('g')}, {overlaid('b')}, floor(al / 255 + 0.5::DOUBLE)::INT AS a FROM q"),
        "r11_to_rgb": px("SELECT image_id, y, x, r, g, b FROM pixels"),
        "r12_draw_boxes": px(""", i AS (SELECT DISTINCT image_id FROM pixels), bx AS (SELECT image_id, o AS ordinal, image_id % 3 + o AS x1, image_id % 2 AS y1, 6 + o AS x2, 5 + image_id % 3 AS y2, 255 - 100 * o AS cr, 100 AS cg, image_id % 200 AS cb FROM i CROSS JOIN (VALUES (0), (1)) v(o)),
 m AS (SELECT p.*, b.* EXCLUDE (image_id), row_number() OVER (PARTITION BY p.image_id, p.y, p.x ORDER BY ordinal DESC NULLS LAST) AS k FROM pixels p LEFT JOIN bx b ON b.image_id = p.image_id AND p.x BETWEEN x1 AND x2 AND p.y BETWEEN y1 AND y2 AND least(p.x - x1, x2 - p.x, p.y - y1, y2 - p.y) < 2)
 SELECT image_id, y, x, coalesce(cr, r)::INT AS r, coalesce(cg, g)::INT AS g, coalesce(cb, b)::INT AS b, a FROM m WHERE k = 1"""),
        "r13_blank": px(f", {_PLACES} SELECT image_id, y, x, 255 AS r, 255 AS g, 255 AS b, 255 AS a FROM places"),
    }
