"""Roles and priorities of layers, and corrections to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import catalogs
from ..functions import expressions as E
from ..sources.shared import cut
from .layout import SALTS, few, salted_join


def classify(layers: DataFrame) -> DataFrame:
    """role and priority: group, then name, then geometry; priority is capped by the role."""
    return E.extend(layers, E.CLASSIFY)


#: Prompts of a block: so many vectors are broadcast at once, whatever their number.
BLOCK = 4096
#: Blocks between two cuts of the plan, so that it doesn't grow with them.
PASSES = 8


def _prompt_blocks(prompts: DataFrame, block: int) -> tuple[DataFrame, int]:
    """(_block, _prompts) with the sorted prompts of each block as one array, and the number of blocks.

    prompts(prompt, embedding[, role]); without a role, the catalogue's of that number.
    """
    if "role" in prompts.columns:
        role = F.col("role")
    else:
        role = F.create_map(*[F.lit(x) for pair in enumerate(catalogs.PROMPT_ROLES) for x in pair])[F.col("prompt").cast("int")]
    entry = F.struct(F.col("prompt").alias("prompt"), role.alias("role"), F.transform("embedding", lambda v: v.cast("double")).alias("vector"))
    n = -(-prompts.count() // block)
    place = F.pmod(F.xxhash64("prompt"), F.lit(max(1, n))).cast("int")
    return prompts.groupBy(place.alias("_block")).agg(F.array_sort(F.collect_list(entry)).alias("_prompts")), n


def _with_block(rows: DataFrame, blocks: DataFrame, i: int, scale: float) -> DataFrame:
    """_logits of every row with the prompts of block i, which is broadcast (about BLOCK vectors)."""
    dot = lambda p: F.aggregate(F.zip_with("embedding", p["vector"], lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, v: s + v)
    joined = rows.withColumn("_block", F.lit(i)).join(F.broadcast(blocks.where(F.col("_block") == i)), "_block", "left")
    return joined.withColumn("_logits", F.coalesce(F.transform("_prompts", lambda p: dot(p) * F.lit(scale)), F.array().cast("array<double>"))).drop("_block")


def _softmax_state(layers: DataFrame, blocks: DataFrame, n: int, scale: float) -> DataFrame:
    """layers with _top (greatest logit), _total (sum of exp(logit - _top)) and _best (its prompt and role), merged block by block.

    No row is shuffled: a block changes a row's own state.
    """
    best = "struct<prompt:bigint,role:string>"
    out = layers.withColumns({"_top": F.lit(None).cast("double"), "_total": F.lit(0.0), "_best": F.lit(None).cast(best)})
    for i in range(n):
        out = _with_block(out, blocks, i, scale).withColumn("_high", F.array_max("_logits"))
        first = F.get("_prompts", (F.array_position("_logits", F.col("_high")) - 1).cast("int"))  # the least prompt of the greatest logit
        first = F.when(F.col("_high").isNotNull(), F.struct(first["prompt"].cast("long").alias("prompt"), first["role"].alias("role")))
        better = F.col("_high").isNotNull() & (F.col("_top").isNull() | (F.col("_high") > F.col("_top")) | ((F.col("_high") == F.col("_top")) & (first["prompt"] < F.col("_best.prompt"))))
        top = F.greatest("_top", "_high")
        share = lambda total, high: F.when(high.isNotNull(), total * F.exp(high - F.col("_new"))).otherwise(0.0)
        start = F.struct(F.lit(0.0).alias("sum"), F.col("_new").alias("top"))  # read once, not once a logit
        more = F.aggregate("_logits", start, lambda s, v: F.struct((s["sum"] + F.exp(v - s["top"])).alias("sum"), s["top"].alias("top")), lambda s: s["sum"])
        out = out.withColumn("_new", top).withColumn("_sum", more)
        out = out.withColumns({"_total": share(F.col("_total"), F.col("_top")) + F.col("_sum"), "_best": F.when(better, first).otherwise(F.col("_best")), "_top": F.col("_new")})
        out = out.drop("_prompts", "_logits", "_high", "_new", "_sum")
        if i % PASSES == PASSES - 1 and i < n - 1:
            out = cut(out)
    return out


def classify_by_embedding(layers: DataFrame, prompts: DataFrame, scale: float = 100.0, threshold: float = catalogs.CONFIDENCE, block: int = BLOCK) -> DataFrame:
    """Softmax over the prompts' dot products; the best prompt's role if probable enough, of equal ones the least prompt's.

    prompts(prompt, embedding[, role]) may be any number: they pass in blocks of about
    ``block``, and greatest logit, log-sum-exp and best prompt are merged across blocks.
    A layer without a vector has no role.
    """
    blocks, n = _prompt_blocks(prompts, block)
    out = _softmax_state(layers, blocks, n, scale).withColumn("prob", F.when(F.col("_total") > 0, F.lit(1.0) / F.col("_total")))
    return out.withColumn("role", F.when(F.col("prob") >= threshold, F.col("_best.role"))).drop("_top", "_total", "_best")


def classify_with_embedding(layers: DataFrame, vectors: DataFrame, prompts: DataFrame) -> DataFrame:
    """The whole cascade: group, name, embedding, geometry.

    vectors(design_id, ordinal, embedding) has one row a layer at most; the prompts'
    roles are found before the join, so vectors are not shuffled.
    """
    found = classify_by_embedding(vectors, prompts).select("design_id", "ordinal", F.col("role").alias("embedding_role"))
    return E.extend(layers.join(found, ["design_id", "ordinal"], "left"), E.CLASSIFY_WITH_EMBEDDING)


def prompt_probabilities(layers: DataFrame, prompts: DataFrame, scale: float = 100.0, block: int = BLOCK) -> DataFrame:
    """(all columns of layers but the vector, prompt, prob): the softmax over all prompts, of any number."""
    blocks, n = _prompt_blocks(prompts, block)
    state = cut(_softmax_state(layers, blocks, n, scale).drop("_best"))  # read once a block
    keep = [c for c in layers.columns if c != "embedding"]
    parts = []
    for i in range(max(1, n)):
        each = F.explode(F.zip_with("_prompts", "_logits", lambda p, v: F.struct(p["prompt"].alias("prompt"), v.alias("logit"))))
        rows = _with_block(state.where("_total > 0"), blocks, i, scale).select(*keep, "_top", "_total", each.alias("_p"))
        parts.append(rows.select(*keep, "_p.prompt", (F.exp(F.col("_p.logit") - F.col("_top")) / F.col("_total")).alias("prob")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: Letters of a gram.
GRAM = 3


def classify_by_patterns(layers: DataFrame, patterns: DataFrame) -> DataFrame:
    """pattern_role: the role of the first pattern (rank, role, pattern) that a layer's lower-cased name contains.

    Any number of patterns and names.  A name and a pattern meet only if the name has the
    pattern's rarest gram (three letters; of a shorter pattern, the whole of it), by an
    equi-join; containment is then verified, and the least rank wins (of equal ranks, the
    least role).  Each distinct name is looked up once.  A pattern with a gram that no name
    has is never joined; an empty pattern is in every name; a null name has no role.
    """
    names = layers.select(F.lower("name").alias("_name")).where("_name IS NOT NULL").distinct()
    grams = lambda c, n: F.expr(f"array_distinct(transform(sequence(1, greatest(1, length({c}) - {n - 1})), i -> substring({c}, i, {n})))")
    of_name = F.array_distinct(F.concat(*[grams("_name", n) for n in range(1, GRAM + 1)]))
    in_names = names.withColumn("gram", F.explode(of_name)).where("gram <> ''")
    known = patterns.select("rank", "role", "pattern").where("pattern IS NOT NULL")
    of_pattern = F.when(F.length("pattern") >= GRAM, grams("pattern", GRAM)).otherwise(F.array("pattern"))
    has = known.where("pattern <> ''").withColumn("gram", F.explode(of_pattern)).join(in_names.groupBy("gram").agg(F.count("*").alias("n")), "gram", "left")
    rarest = has.groupBy("rank", "role", "pattern").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("g")).where("g.n > 0")
    met = in_names.join(rarest.select("rank", "role", "pattern", F.col("g.gram").alias("gram")), "gram").where(F.col("_name").contains(F.col("pattern")))
    best = F.min(F.struct("rank", "role"))
    found = met.groupBy("_name").agg(best.alias("_best"))
    always = known.where("pattern = ''").agg(best.alias("_always")).withColumn("_one", F.lit(1))  # one row
    rows = layers.withColumns({"_name": F.lower("name"), "_one": F.lit(1)})
    rows = rows.join(F.broadcast(found), "_name", "left") if few(found) else salted_join(rows, found, ["_name"], SALTS, "left")
    rows = rows.join(F.broadcast(always), "_one", "left").withColumn("_always", F.when(F.col("_name").isNotNull(), F.col("_always")))
    return rows.withColumn("pattern_role", F.least("_best", "_always")["role"]).drop("_name", "_one", "_best", "_always")


def apply_overrides(layers: DataFrame, corrections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Layers with the latest valid new role and the latest new priority (held to 1..9), and rejects.

    A new role does not change the priority.  Rejected are corrections of layers that
    are not there, and of roles that are none.
    """
    roles = list(catalogs.ROLE_PRIORITY)
    key = ["design_id", "ordinal"]
    latest = corrections.groupBy(*key).agg(
        F.max_by("new_role", F.when(F.col("new_role").isin(*roles), F.col("seq"))).alias("_role"),
        F.max_by("new_priority", F.when(F.col("new_priority").isNotNull(), F.col("seq"))).alias("_priority"),
    )
    out = layers.join(latest, key, "left")
    role = F.when(F.col("_role").isin(*roles), F.col("_role"))
    out = out.withColumns({"role": F.coalesce(role, "role"), "priority": F.when(F.col("_priority").isNull(), F.col("priority")).otherwise(F.greatest(F.lit(1), F.least(F.lit(9), F.col("_priority"))))}).drop("_role", "_priority")
    present = layers.select(*key, F.lit(True).alias("_there")).distinct()
    judged = corrections.join(present, key, "left")
    reason = F.when(F.col("_there").isNull(), "no such layer").when(~F.col("new_role").isin(*roles), "no such role")
    return out, judged.withColumn("reason", reason).drop("_there").where("reason IS NOT NULL")
