"""Targets, zones and placements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import catalogs
from ..functions import expressions as E


#: Targets beyond which they are not broadcast.
MAX_BROADCAST = 10_000


def few(df: DataFrame, rows: int = MAX_BROADCAST) -> bool:
    """Has it at most so many rows?  Reads no more than that."""
    return df.limit(rows + 1).count() <= rows


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], salts: int, how: str = "inner") -> DataFrame:
    """An equi-join on few or skewed keys: rows of the left are dealt to ``salts`` copies of the right.

    The salt comes from the row's place in its task, so rows alike are spread as well.
    """
    own = F.pmod(F.xxhash64(F.monotonically_increasing_id(), *keys), F.lit(salts)).cast("int")
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn("_salt", own).join(copies, [*keys, "_salt"], how).drop("_salt")


def validate_targets(targets: DataFrame) -> DataFrame:
    """reason: the first rule that a target breaks, or null."""
    return targets.withColumn("reason", F.expr(E.TARGET_REASON))


def resolve_targets(presets: DataFrame, selected: DataFrame, custom: DataFrame) -> DataFrame:
    """Selected preset labels with their sizes and short names, and custom sizes over zero."""
    sizes = presets.select("label", "width", "height")
    chosen = selected.join(F.broadcast(sizes) if few(sizes) else sizes, "label")
    chosen = chosen.select(F.trim(F.substring_index("label", "(", 1)).alias("name"), "width", "height")
    own = custom.where("width > 0 AND height > 0").select(F.coalesce("name", F.lit("Custom")).alias("name"), F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"))
    return chosen.unionByName(own)


def with_template(targets: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """The template (template, min_aspect, max_aspect) whose range holds width / height; else the default.

    Ranges of the catalogue don't overlap; of a user's that do, the first by name counts.
    """
    aspect = F.col("width") / F.col("height").cast("double")
    t = catalogs.templates(targets.sparkSession) if templates is None else templates.select("template", "min_aspect", "max_aspect")
    if templates is None:
        t = F.broadcast(t)  # five rows
        out = targets.withColumn("aspect", aspect).join(t, (F.col("aspect") >= F.col("min_aspect")) & (F.col("aspect") < F.col("max_aspect")), "left").drop("min_aspect", "max_aspect")
    else:
        if not few(t):
            raise ValueError(f"over {MAX_BROADCAST} templates")
        ranges = F.broadcast(t.agg(F.sort_array(F.collect_list(F.struct("template", "min_aspect", "max_aspect"))).alias("_ranges")).withColumn("_one", F.lit(1)))  # MAX_BROADCAST entries
        fits = F.filter("_ranges", lambda r: (F.col("aspect") >= r["min_aspect"]) & (F.col("aspect") < r["max_aspect"]))
        out = targets.withColumns({"aspect": aspect, "_one": F.lit(1)}).join(ranges, "_one", "left").withColumn("template", F.get(fits, F.lit(0))["template"]).drop("_one", "_ranges")
    return out.withColumn("template", F.coalesce("template", F.lit(catalogs.DEFAULT_TEMPLATE)))


def zone_rects(targets: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    """Pixel rectangles of the zones on each target with a template."""
    z = F.broadcast(catalogs.zones(targets.sparkSession).drop("roles")) if zones is None else zones.select("template", "zone", "zone_no", "fx", "fy", "fw", "fh")
    t = targets.select("seq", "template", F.col("width").alias("target_w"), F.col("height").alias("target_h"))
    return E.extend(t.join(z, "template"), E.ZONE_RECT).select("seq", "template", "zone", "zone_no", *[F.col(c).cast("int").alias(c) for c in ("zx", "zy", "zw", "zh")])


def shared_roles(zones: DataFrame) -> DataFrame:
    """(template, role, zones) of the roles that several zones of a template take."""
    return zones.select("template", "zone", F.explode("roles").alias("role")).distinct().groupBy("template", "role").agg(F.sort_array(F.collect_list("zone")).alias("zones")).where("size(zones) > 1")


#: Zones and templates up to which ranks are columns of a layer's row.
MAX_COLUMNS = 200


def ranked_by_template(layers: DataFrame, names: list[str], zones: DataFrame | None = None) -> DataFrame:
    """For each layer and template: its zone, rank in it, section and place in the result.

    The greedy walk (best priority, then largest, then first) puts a layer into the first
    zone that takes its role and has room for it, two layers a zone.  Where a role is in
    one zone of a template at most, as in the catalogue, that is a rank of two or less.
    Of a user's zones (template, zone, zone_no, roles) that share roles, a zone gets the
    first two of the layers that no zone before it took; so zones are filled in turn.
    """
    if not in_columns(names, zones):
        return _ranked_by_rows(layers, names, zones)
    wide = ranked_layers(layers, names, zones)
    return wide.select(*[c for c in wide.columns if c != "_ranks"], F.inline("_ranks"))


def in_columns(names: list[str], zones: DataFrame | None) -> bool:
    """Are templates and zones few enough for ``ranked_layers``?"""
    return len(names) <= MAX_COLUMNS and (zones is None or few(zones, MAX_COLUMNS))


def _levels(zones: list[tuple[str, list[str]]]) -> list[int]:
    """The pass in which each zone can be filled: after all zones before it that share a role with it."""
    out: list[int] = []
    for i, (_, roles) in enumerate(zones):
        out.append(max((out[j] + 1 for j in range(i) if set(zones[j][1]) & set(roles)), default=0))
    return out


def ranked_layers(layers: DataFrame, names: list[str], zones: DataFrame | None = None) -> DataFrame:
    """Layers with _ranks, an array of (template, zone, rank, section, result_pos) by the order of ``names``, and the first background (bg_*).

    One row a layer: every count is a window over the same order within a design (the
    backgrounds, then the walk), so layers are sorted once, whatever the templates, and
    rows multiply after the sort only.  Zones whose roles meet are filled in passes.
    """
    if zones is None:
        found = [(t, i, z[0], list(z[5])) for t, (_, _, zs) in catalogs.TEMPLATES.items() for i, z in enumerate(zs)]
    else:
        found = [(r["template"], r["zone_no"], r["zone"], list(r["roles"])) for r in zones.select("template", "zone_no", "zone", "roles").distinct().collect()]  # MAX_COLUMNS at most
    spots = {t: [(z, roles) for _, _, z, roles in sorted(f for f in found if f[0] == t)] for t in names}
    levels = {t: _levels(spots[t]) for t in names}
    last = max((v for vs in levels.values() for v in vs), default=0)
    background = F.coalesce(F.expr(E.IS_BACKGROUND), F.lit(False))
    rows = layers.withColumn("area", F.expr("CAST(width AS BIGINT) * height")).withColumn("_back", background)
    rows = rows.withColumns({"_o1": F.when(F.col("_back"), 0).otherwise(F.col("priority")), "_o2": F.when(F.col("_back"), 0).otherwise(-F.col("area"))})
    walk = Window.partitionBy("design_id").orderBy(F.desc("_back"), "_o1", "_o2", "k")
    so_far, whole = walk.rowsBetween(Window.unboundedPreceding, Window.currentRow), walk.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    string, number = F.lit(None).cast("string"), F.lit(None).cast("int")
    rows = rows.withColumns({f"_{c}{j}": v for j in range(len(names)) for c, v in (("z", string), ("r", number))})
    for level in range(last + 1):
        counts, here = {}, {}
        for j, t in enumerate(names):
            for (zone, roles), own in zip(spots[t], levels[t]):
                if own == level and roles:
                    free = f"NOT _back AND role IN ({', '.join(repr(r) for r in sorted(roles))})" + (f" AND _z{j} IS NULL" if level else "")
                    counts.setdefault(free, f"_c{len(counts)}")
                    here.setdefault(j, []).append((zone, free))
        rows = rows.withColumns({c: F.count(F.when(F.expr(free), 1)).over(so_far).cast("int") for free, c in counts.items()})
        for j, zs in here.items():
            zone, rank = F.col(f"_z{j}"), F.col(f"_r{j}")
            for z, free in zs:
                # Where roles meet, a layer that a zone has no room for goes on to the next.
                took = F.expr(free) if not last else F.expr(free) & (F.col(counts[free]) <= catalogs.PER_ZONE)
                zone, rank = F.when(took, F.lit(z)).otherwise(zone), F.when(took, F.col(counts[free])).otherwise(rank)
            rows = rows.withColumns({f"_z{j}": zone, f"_r{j}": rank})
        rows = rows.drop(*counts.values())
    section = {j: F.when(F.col("_back"), 0).when(F.col(f"_r{j}") <= catalogs.PER_ZONE, 1).otherwise(2) for j in range(len(names))}
    rows = rows.withColumns({f"_s{j}": v for j, v in section.items()})
    zoned = {j: F.count(F.when(F.col(f"_s{j}") == 1, 1)) for j in section}
    first = F.struct("k", *[c for c in ("element_id", "has_image") if c in layers.columns], "width", "height")
    rows = rows.withColumns(
        {f"_n{j}": v.over(so_far) for j, v in zoned.items()}
        | {f"_t{j}": v.over(whole) for j, v in zoned.items()}
        | {"_at": F.row_number().over(walk), "_backs": F.count(F.when(F.col("_back"), 1)).over(whole), "_first": F.first(F.when(F.col("_back"), first)).over(whole)}
    )
    place = lambda j: F.when(F.col(f"_s{j}") == 0, F.col("_at")).when(F.col(f"_s{j}") == 1, F.col("_backs") + F.col(f"_n{j}")).otherwise(F.col("_at") + F.col(f"_t{j}") - F.col(f"_n{j}"))
    ranks = [F.struct(F.lit(t).alias("template"), F.col(f"_z{j}").alias("zone"), F.col(f"_r{j}").alias("rank"), F.col(f"_s{j}").alias("section"), (place(j) - 1).cast("int").alias("result_pos")) for j, t in enumerate(names)]
    bg = {"k": "bg_k", "element_id": "bg_element_id", "width": "bg_w", "height": "bg_h", "has_image": "bg_image"}
    own = [F.col(f"_first.{c}").alias(bg[c]) for c in bg if c in ("k", "width", "height") or c in layers.columns]
    return rows.select(*layers.columns, "area", *own, F.array(*ranks).alias("_ranks"))


def _ranked_by_rows(layers: DataFrame, names: list[str], zones: DataFrame | None) -> DataFrame:
    """``ranked_by_template`` for any number of templates and zones: a row for each layer and template, sorted a zone."""
    spark = layers.sparkSession
    rows = layers.withColumn("template", F.explode(F.array(*[F.lit(t) for t in names]))).withColumn("area", F.expr("CAST(width AS BIGINT) * height"))
    walk = ["priority", F.desc("area"), "k"]
    background = F.expr(E.IS_BACKGROUND)
    if zones is None or shared_roles(zones).isEmpty():
        roles = (catalogs.zones(spark) if zones is None else zones).select("template", "zone", F.explode("roles").alias("role")).distinct()
        rows = rows.join(F.broadcast(roles) if zones is None or few(roles) else roles, ["template", "role"], "left")
        rows = rows.withColumn("rank", F.when(F.col("zone").isNotNull(), F.row_number().over(Window.partitionBy("design_id", "template", "zone").orderBy(*walk))))
    else:
        most, (low, high) = F.array_sort(F.collect_list(F.struct("zone_no", "zone"))), zones.agg(F.min("zone_no"), F.max("zone_no")).first()
        spots = zones.select("template", "zone_no", "zone", F.explode("roles").alias("role")).distinct().groupBy("template", "role").agg(most.alias("_spots"))
        rows = rows.join(F.broadcast(spots) if few(spots) else spots, ["template", "role"], "left").withColumns({"zone": F.lit(None).cast("string"), "rank": F.lit(None).cast("int")})
        for z in range(low, high + 1):
            spot = F.filter("_spots", lambda s: s["zone_no"] == z)  # noqa: B023
            here = ~background & F.col("zone").isNull() & (F.size(spot) > 0)
            rows = rows.withColumn("_here", F.coalesce(here, F.lit(False)))
            rows = rows.withColumn("_place", F.row_number().over(Window.partitionBy("design_id", "template", "_here").orderBy(*walk)))
            taken = F.col("_here") & (F.col("_place") <= catalogs.PER_ZONE)
            rows = rows.withColumns({"rank": F.when(taken, F.col("_place")).otherwise(F.col("rank")), "zone": F.when(taken, F.get(spot, F.lit(0))["zone"]).otherwise(F.col("zone"))})
        rows = rows.drop("_spots", "_here", "_place")
    rows = rows.withColumn("section", F.when(background, 0).when(F.col("rank") <= catalogs.PER_ZONE, 1).otherwise(2))
    order = [F.col("section"), F.when(F.col("section") == 0, 0).otherwise(F.col("priority")), F.when(F.col("section") == 0, 0).otherwise(-F.col("area")), F.col("k")]
    return rows.withColumn("result_pos", F.row_number().over(Window.partitionBy("design_id", "template").orderBy(*order)) - 1)


#: Copies of each target where there are too many to broadcast.
SALTS = 64


def calculate_layout(layers: DataFrame, targets: DataFrame, templates: DataFrame | None = None, zones: DataFrame | None = None, most_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """Placement of every layer on every target (seq, name, width, height).

    Ranks are made once a template, not once a target, in one sort of the layers by design
    (no shuffle, if they lie by design).  A target comes with the rectangles of its zones, so one join places all.
    Few targets are broadcast; of many, each template's are dealt to ``SALTS`` tasks, for
    the templates alone are a handful of keys.  ``templates`` (template, min_aspect,
    max_aspect) and ``zones`` (template, zone, zone_no, fx, fy, fw, fh, roles) replace the
    catalogue's; targets that no range holds need a zone set of the default's name.
    """
    layers, targets, names = prepared(layers, targets, templates)
    ranked = ranked_by_template(layers, names, zones)
    t = with_rects(targets, zones)
    placed = ranked.join(F.broadcast(t), "template") if few(targets.select("seq"), most_broadcast) else salted_join(ranked, t, ["template"], SALTS)
    return place(placed)


def prepared(layers: DataFrame, targets: DataFrame, templates: DataFrame | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """Layers with default bounds, targets with their templates, and the templates' names."""
    defaults = {"min_scale": F.lit(0.3), "max_scale": F.lit(2.0), "maintain_aspect": F.lit(True)}
    layers = layers.withColumns({k: v for k, v in defaults.items() if k not in layers.columns})
    names = list(catalogs.TEMPLATES)
    if templates is not None:
        names = sorted({catalogs.DEFAULT_TEMPLATE, *(r["template"] for r in templates.select("template").distinct().collect())})  # MAX_BROADCAST at most
    return layers, with_template(targets, templates), names


def with_rects(targets: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    """Targets with _rects, the rectangles of their zones by name."""
    rect = F.struct("zone", F.struct("zx", "zy", "zw", "zh").alias("rect"))
    rects = zone_rects(targets, zones).groupBy("seq").agg(F.map_from_entries(F.collect_list(rect)).alias("_rects"))
    return targets.select("seq", F.col("name").alias("target_name"), F.col("width").alias("target_w"), F.col("height").alias("target_h"), "template").join(rects, "seq", "left")


def place(placed: DataFrame) -> DataFrame:
    """Boxes of ranked layers on their targets (with _rects)."""
    placed = placed.withColumn("zone", F.when(F.col("section") == 1, F.col("zone"))).withColumn("_rect", F.when(F.col("zone").isNotNull(), F.try_element_at("_rects", F.col("zone"))))
    placed = E.extend(placed.select("*", "_rect.*").drop("_rects", "_rect"), E.PLACE)
    return placed.withColumns({c: F.col(c).cast("int") for c in ("new_x", "new_y", "new_w", "new_h")}).drop("visible").withColumnRenamed("visible_out", "visible")


def assign_zones_general(layers: DataFrame, zones: DataFrame) -> DataFrame:
    """The greedy walk for templates whose zones share roles: a fold over each design's layers.

    zones(zone, zone_no, roles) of one template; returns design_id, k, zone.
    """
    spots = F.array_sort(F.collect_list(F.struct("zone_no", "zone", "roles")))
    zone_list = zones.agg(spots.alias("z")).first()["z"]  # one template's zones
    walk = layers.withColumn("area", F.expr("CAST(width AS BIGINT) * height"))
    rows = walk.groupBy("design_id").agg(F.array_sort(F.collect_list(F.struct("priority", (-F.col("area")).alias("less"), "k", "role"))).alias("walk"))
    literal = F.array(*[F.struct(F.lit(z["zone"]).alias("zone"), F.array(*[F.lit(r) for r in z["roles"]]).alias("roles")) for z in zone_list])
    start = F.struct(F.array(*[F.lit(0) for _ in zone_list]).alias("held"), F.expr("cast(array() as array<struct<k:int,zone:string>>)").alias("out"))

    def step(acc, e):
        free = F.filter(F.sequence(F.lit(0), F.lit(len(zone_list) - 1)), lambda i: F.array_contains(F.get(literal, i)["roles"], e["role"]) & (F.get(acc["held"], i) < catalogs.PER_ZONE))
        at = F.get(free, F.lit(0))
        return F.struct(
            F.transform(acc["held"], lambda n, i: n + (i == F.coalesce(at, F.lit(-1))).cast("int")).alias("held"),
            F.when(at.isNotNull(), F.array_append(acc["out"], F.struct(e["k"].alias("k"), F.get(literal, at)["zone"].alias("zone")))).otherwise(acc["out"]).alias("out"),
        )

    return rows.select("design_id", F.inline(F.aggregate("walk", start, step)["out"]))


def pairs(designs: DataFrame, targets: DataFrame) -> DataFrame:
    """Every design on every target: the product is the result."""
    return designs.crossJoin(F.broadcast(targets) if few(targets) else targets)


def content_order(layers: DataFrame) -> DataFrame:
    """Content of each design in the order in which zones are filled: priority, largest, first."""
    content = layers.where(f"NOT {E.IS_BACKGROUND}").withColumn("area", F.expr("CAST(width AS BIGINT) * height"))
    walk = Window.partitionBy("design_id").orderBy("priority", F.desc("area"), "k")
    return content.select("design_id", "k", "priority", "area", F.row_number().over(walk).alias("place"))


def zone_occupancy(ranked: DataFrame) -> DataFrame:
    """Layers in each zone of each design and template."""
    return ranked.where("section = 1").groupBy("design_id", "template", "zone").agg(F.count("*").alias("n"))


def bbox_scale(layers: DataFrame, factor: float | str) -> DataFrame:
    """sx, sy, swidth, sheight: the box times a factor (a number or an SQL expression), toward zero."""
    return E.extend(layers, E.scaled(factor if isinstance(factor, str) else E.dbl(factor)))
