"""Merkle manifest of a dataset: leaves placed by ranks in bitmaps, levels reduced by slot arrays.

A row's leaf is the digest of its five fields.  In each source, leaves ascend by doc_id,
and every three neighbours become a node until one, the subroot, is left; subroots, by
source, likewise become the root.  Steps:

1. The ids of a source are split into containers of 2^15 neighbouring ids.  Each is a
   compressed bitmap (sorted places if there are few, 4,096 bytes if there are many) with a
   popcount directory, and extra counts of ids that have several rows.  Sums over
   containers, by three levels of at most 2^17 children, give each its first coordinate.
2. A leaf's coordinate is a rank query: the container's first coordinate, the directory's
   count up to its block, and the bits before it in the block.  Rows are not sorted by id.
3. Leaves are keyed by ``coordinate div 3^7``; a group is a slot array of 3^7 places
   that one task fills by coordinate and reduces by seven levels (LEVELS).  Its node goes to the next
   round; rounds end when every source has one node.
4. Downwards, each group meets the siblings of its own node and hands on those of its
   leaves; the last step digests each leaf's siblings and folds them with the claimed leaf.

Groups are bounded: 2^15 ids, 2^17 containers, 3^7 slots.  Rows of one id are first
counted by leaf, and ranked by the first two bytes of their leaves, so an id with very many
rows is spread.

Defined results: nulls of any field are ``-``; null ids come before all others; rows of one
id ascend by leaf, rows alike in all fields take neighbouring places; a null text stays null
when it is tampered with; an empty table has no rows.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
RUN, LEVELS = 3, 7
#: Bits of an id that are its place in a container; ids up to which a container lists places.
PLACE_BITS, LISTED = 15, 2048
#: The container of null ids: before all others.
NO_ID = -(1 << (63 - PLACE_BITS)) - 1
#: Rows alike in all fields beyond which they are written out by several tasks.
COPIES = 1000
KEY = ["tree", "bucket", "place"]


def digest(parts: str) -> str:
    return sha256(parts.encode()).hexdigest()


def leaf(text: Column) -> Column:
    """The digest of a row's fields, with ``text`` in the place of its text (32 bytes)."""
    values = [text if c == "text" else F.col(c).cast("string") for c in FIELDS]
    parts = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


# ------------------------------------------------------------------ coordinates


def container(places: np.ndarray, counts: np.ndarray) -> dict:
    """A container of sorted, distinct places with their numbers of rows."""
    many = counts > 1
    if len(places) <= LISTED:
        bits, directory = places.astype("<u2").tobytes(), b""
    else:
        flags = np.zeros(1 << PLACE_BITS, np.uint8)
        flags[places] = 1
        blocks = flags.reshape(-1, 512).sum(axis=1, dtype=np.int64)
        bits, directory = np.packbits(flags, bitorder="little").tobytes(), (np.cumsum(blocks) - blocks).astype("<u2").tobytes()
    return {"bits": bits, "directory": directory, "extra_places": places[many].astype("<u2").tobytes(), "extra_rows": (np.cumsum(counts[many] - 1)).astype("<i8").tobytes()}


def rank(box: dict, places: np.ndarray) -> np.ndarray:
    """Rows of a container before each of the places."""
    if box["directory"]:
        bits = np.frombuffer(box["bits"], np.uint8).reshape(-1, 64)
        block, within = places >> 9, places & 511
        own = np.unpackbits(bits[block], axis=1, bitorder="little")  # a row of 512 flags a query
        before = np.cumsum(own, axis=1, dtype=np.int64)
        out = np.frombuffer(box["directory"], "<u2")[block].astype(np.int64) + np.where(within > 0, before[np.arange(len(places)), within - 1], 0)
    else:
        out = np.searchsorted(np.frombuffer(box["bits"], "<u2"), places).astype(np.int64)
    extra = np.concatenate([[0], np.frombuffer(box["extra_rows"], "<i8")])
    return out + extra[np.searchsorted(np.frombuffer(box["extra_places"], "<u2"), places)]


def bitmap_index(ids: DataFrame) -> DataFrame:
    """(tree, bucket, rows, bits, directory, extra_places, extra_rows, first, n): the containers of (tree, bucket, place, n).

    ``first`` is the coordinate of a container's first row, ``n`` the rows of its tree.
    """

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        places, counts = rows.column("place").to_numpy(), rows.column("n").to_numpy()
        by = np.argsort(places)
        box = container(places[by], counts[by])
        return pa.table({"tree": [key[0].as_py()], "bucket": [key[1].as_py()], "rows": [int(counts.sum())], **{k: pa.array([v], pa.binary()) for k, v in box.items()}})

    boxes = cut(ids.groupBy("tree", "bucket").applyInArrow(build, "tree string, bucket long, rows long, bits binary, directory binary, extra_places binary, extra_rows binary"))
    levels = boxes.select("tree", "bucket", "rows", F.shiftright("bucket", 16).alias("up"), F.shiftright("bucket", 32).alias("top"))
    before = lambda *part: F.sum("rows").over(Window.partitionBy(*part[:-1]).orderBy(part[-1])) - F.col("rows")
    a = levels.select("tree", "bucket", "up", "top", before("tree", "up", "bucket").alias("a"))
    b = levels.groupBy("tree", "top", "up").agg(F.sum("rows").alias("rows")).select("tree", "up", before("tree", "top", "up").alias("b"))
    c = levels.groupBy("tree", "top").agg(F.sum("rows").alias("rows")).select("tree", "top", before("tree", "top").alias("c"), F.sum("rows").over(Window.partitionBy("tree")).alias("n"))
    placed = a.join(b, ["tree", "up"]).join(c, ["tree", "top"]).select("tree", "bucket", (F.col("a") + F.col("b") + F.col("c")).alias("first"), "n")
    return boxes.join(placed, ["tree", "bucket"])


def coordinates(leaves: DataFrame) -> DataFrame:
    """(tree, slot, n, doc_id, leaf, claimed) of (tree, doc_id, leaf, claimed): the place of each row among the n of its tree."""
    keyed = leaves.withColumns({"bucket": F.coalesce(F.shiftright("doc_id", PLACE_BITS), F.lit(NO_ID)), "place": F.coalesce(F.col("doc_id").bitwiseAND((1 << PLACE_BITS) - 1), F.lit(0)).cast("int")})
    rows = keyed.groupBy(*KEY, "doc_id", "leaf", "claimed").agg(F.count("*").alias("copies")).withColumn("part", F.substring("leaf", 1, 2))
    within = Window.partitionBy(*KEY, "part").orderBy("leaf", "claimed")
    rows = cut(rows.withColumn("within", F.sum("copies").over(within) - F.col("copies")))
    cells = rows.groupBy(*KEY, "part").agg(F.sum("copies").alias("n"))
    ids = cells.groupBy(*KEY).agg(F.sum("n").alias("n"))

    def ask(key: tuple, asked: pa.Table, box: pa.Table) -> pa.Table:
        own = box.to_pylist()[0]
        first = rank(own, asked.column("place").to_numpy()) + own["first"]
        return pa.table({"tree": asked.column("tree"), "bucket": asked.column("bucket"), "place": asked.column("place"), "first": pa.array(first), "tree_n": pa.array(np.full(asked.num_rows, own["n"]))})

    ranked = ids.groupBy("tree", "bucket").cogroup(bitmap_index(ids).groupBy("tree", "bucket")).applyInArrow(ask, "tree string, bucket long, place int, first long, tree_n long")
    starts = cells.withColumn("part_first", F.sum("n").over(Window.partitionBy(*KEY).orderBy("part")) - F.col("n")).join(ranked, KEY)
    starts = starts.select(*KEY, "part", (F.col("first") + F.col("part_first")).alias("first"), "tree_n")
    placed = rows.join(starts, [*KEY, "part"]).select("tree", "doc_id", "leaf", "claimed", "copies", F.col("tree_n").alias("n"), (F.col("first") + F.col("within")).alias("slot"))
    each = lambda df: df.select("tree", F.expr("explode(sequence(slot, slot + copies - 1))").alias("slot"), "n", "doc_id", "leaf", "claimed")
    chunk = F.explode(F.expr(f"sequence(0L, (copies - 1) div {COPIES})"))
    many = placed.where(f"copies > {COPIES}").withColumn("chunk", chunk).withColumns({"slot": F.col("slot") + F.col("chunk") * COPIES, "copies": F.least(F.lit(COPIES).cast("long"), F.col("copies") - F.col("chunk") * COPIES)})
    return each(placed.where(f"copies <= {COPIES}")).unionByName(each(many.repartition("leaf", "chunk")))


# ------------------------------------------------------------------------ trees


def height(n: int) -> int:
    """Levels until n nodes are one."""
    h = 0
    while n > 1:
        n, h = -(-n // RUN), h + 1
    return h


def slot_array(slots: np.ndarray, digests: list[bytes]) -> list[str]:
    """The digests (hex) of a group in the order of their slots, which are neighbours."""
    out = [""] * len(digests)
    base = int(slots.min())
    for s, d in zip(slots.tolist(), digests):
        out[s - base] = d.hex()
    return out


def reduced(nodes: list[str], levels: int) -> list[list[str]]:
    """The levels over a slot array, itself first; the last has one node."""
    out = [nodes]
    for _ in range(levels):
        row = out[-1]
        out.append([digest("".join(row[i : i + RUN])) for i in range(0, len(row), RUN)])
    return out


def siblings(rows: list[list[str]], i: int) -> list[str]:
    """Left and right siblings of slot i, ``left|right`` for each level below the last."""
    out = []
    for row in rows[:-1]:
        start = i - i % RUN
        out.append("".join(row[start:i]) + "|" + "".join(row[i + 1 : start + RUN]))
        i //= RUN
    return out


def climb(nodes: DataFrame, most: int, levels: int) -> list[DataFrame]:
    """Rounds of (tree, slot, n, leaf): each reduces groups of 3^levels slots to a node, until all trees (of at most ``most`` nodes) have one."""
    span = RUN**levels

    def reduce(key: tuple, rows: pa.Table) -> pa.Table:
        n = rows.column("n")[0].as_py()
        top = reduced(slot_array(rows.column("slot").to_numpy(), rows.column("leaf").to_pylist()), min(levels, height(n)))[-1][0]
        return pa.table({"tree": [key[0].as_py()], "slot": [key[1].as_py()], "n": [-(-n // span)], "leaf": pa.array([bytes.fromhex(top)], pa.binary())})

    rounds = [nodes.select("tree", "slot", "n", "leaf")]
    while len(rounds) == 1 or most > 1:
        keyed = rounds[-1].withColumn("block", F.expr(f"slot div {span}"))
        rounds.append(cut(keyed.groupBy("tree", "block").applyInArrow(reduce, "tree string, slot long, n long, leaf binary")))
        most = -(-most // span)
    return rounds


PATHS = "tree string, slot long, path array<string>, subroot string"


def descend(rounds: list[DataFrame], paths: DataFrame, levels: int) -> DataFrame:
    """Siblings of the nodes of the first of ``rounds``, from those (PATHS) of the tops in the last, nearest first."""
    span = RUN**levels

    def spread(key: tuple, rows: pa.Table, above: pa.Table) -> pa.Table:
        slots = rows.column("slot").to_numpy()
        own = reduced(slot_array(slots, rows.column("leaf").to_pylist()), min(levels, height(rows.column("n")[0].as_py())))
        upper = above.to_pylist()[0]
        found = [siblings(own, int(s - slots.min())) + upper["path"] for s in slots]
        return pa.table({"tree": rows.column("tree"), "slot": rows.column("slot"), "path": pa.array(found, pa.list_(pa.string())), "subroot": pa.array([upper["subroot"]] * len(slots), pa.string())})

    for nodes in reversed(rounds[:-1]):
        left = nodes.withColumn("block", F.expr(f"slot div {span}")).groupBy("tree", "block")
        paths = cut(left.cogroup(paths.withColumnRenamed("slot", "block").groupBy("tree", "block")).applyInArrow(spread, PATHS))
    return paths


def ordered(trees: DataFrame) -> DataFrame:
    """(tree, slot): the rank of each distinct tree by its bytes, in ranges that tasks sort for themselves."""
    parts = cut(trees.distinct().repartitionByRange("tree").withColumn("part", F.spark_partition_id()))
    sizes = parts.groupBy("part").agg(F.count("*").alias("size"))  # a row a range
    first = sizes.withColumn("first", F.sum("size").over(Window.orderBy("part")) - F.col("size")).select("part", "first")
    own = F.row_number().over(Window.partitionBy("part").orderBy("tree")) - 1
    return parts.withColumn("own", own).join(first, "part").select("tree", (F.col("first") + F.col("own")).alias("slot"))


OUT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def manifest(documents: DataFrame, claimed: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row.

    ``claimed`` is the text that is checked against the manifest (as it is, if none): its
    leaf and the row's siblings give ``folded_root``.
    """
    span = RUN**levels
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", "n_chars", "text", (F.col("text") if claimed is None else claimed).alias("_claimed"))
    own = leaf(F.col("text"))
    other = F.when(F.col("_claimed").eqNullSafe(F.col("text")), F.lit(None)).otherwise(leaf(F.col("_claimed")))  # null: as it was
    tree = F.coalesce(F.concat(F.lit("+"), F.col("source")), F.lit(""))  # null first, then by bytes
    nodes = cut(coordinates(cut(rows.select(tree.alias("tree"), "doc_id", own.alias("leaf"), other.alias("claimed")))))
    most = nodes.agg(F.max("n")).first()[0]
    if most is None:
        return documents.sparkSession.createDataFrame([], OUT)
    rounds = climb(nodes, most, levels)
    tops = rounds[-1].select(F.col("tree").alias("source_tree"), "leaf")
    sources = tops.join(ordered(tops.select(F.col("source_tree").alias("tree"))).withColumnRenamed("tree", "source_tree"), "source_tree")
    n_sources = tops.count()
    sources = cut(sources.select("source_tree", F.lit("").alias("tree"), "slot", F.lit(n_sources).cast("long").alias("n"), "leaf"))
    above = climb(sources, n_sources, levels)
    root = bytes(above[-1].first()["leaf"]).hex()  # one row
    top_paths = descend(above, above[-1].selectExpr("tree", "slot", "CAST(array() AS array<string>) AS path", "'' AS subroot"), levels)
    starts = sources.join(top_paths.select("slot", "path"), "slot").select(F.col("source_tree").alias("tree"), F.lit(0).cast("long").alias("slot"), "path", F.lower(F.hex("leaf")).alias("subroot"))
    paths = descend(rounds[1:], starts, levels)

    def prove(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        slots, claims = left.column("slot").to_numpy(), left.column("claimed").to_pylist()
        own, upper = reduced(slot_array(slots, left.column("leaf").to_pylist()), min(levels, height(left.column("n")[0].as_py()))), right.to_pylist()[0]
        base, out = int(slots.min()), {"leaf": [], "proof_sha256": [], "folded_root": []}
        for s, claim in zip(slots.tolist(), claims):
            path = [p.partition("|") for p in siblings(own, s - base) + upper["path"]]
            folded = own[0][s - base] if claim is None else claim.hex()
            for before, _, after in path:
                folded = digest(before + folded + after)
            out["leaf"].append(own[0][s - base])
            out["proof_sha256"].append(digest("".join(before + after for before, _, after in path)))
            out["folded_root"].append(folded)
        n = len(claims)
        return pa.table({"doc_id": left.column("doc_id"), "leaf": out["leaf"], "subroot": [upper["subroot"]] * n, "root": [root] * n, "proof_sha256": out["proof_sha256"], "folded_root": out["folded_root"], "verified": [f == root for f in out["folded_root"]]})

    leaves = nodes.withColumn("block", F.expr(f"slot div {span}")).groupBy("tree", "block")
    return leaves.cogroup(paths.withColumnRenamed("slot", "block").groupBy("tree", "block")).applyInArrow(prove, OUT)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of ``documents``, checked against texts of which every second id's has lost its line ends."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    claimed = F.when(even, F.regexp_replace("text", "\n", "")).otherwise(F.col("text"))
    return manifest(table(spark, sf_dir, "documents"), claimed)


_FIELDS = lambda text: " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text))
_CRC = "list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, len(doc_id::VARCHAR) + 1), lambda i: ord((doc_id::VARCHAR)[i])::BIGINT)), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384)))"


def _tree(name: str, leaves: str) -> str:
    """CTEs of a forest: its nodes (tree, level, i, h, n), and runs of three as lists."""
    return f"""{name} AS (SELECT tree, 0 AS level, i, h, n FROM ({leaves}) UNION ALL
  SELECT tree, level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM {name} WHERE n > 1 GROUP BY tree, level, i // 3, n),
 {name}_runs AS MATERIALIZED (SELECT tree, level, i // 3 AS run, list(h ORDER BY i) AS hs FROM {name} WHERE n > 1 GROUP BY ALL)"""


def _fold(name: str, runs: str, start: str) -> str:
    """CTEs of each row's way up: tree, level, place i, folded digest f and siblings p."""
    return f"""{name} AS (SELECT * FROM ({start}) UNION ALL
  SELECT w.key, w.tree, w.level + 1, w.i // 3, sha256(array_to_string(hs[1:w.i % 3], '') || f || array_to_string(hs[w.i % 3 + 2:], '')), p || array_to_string(hs[1:w.i % 3], '') || array_to_string(hs[w.i % 3 + 2:], '') FROM {name} w JOIN {runs} r ON r.tree = w.tree AND r.level = w.level AND r.run = w.i // 3),
 {name}_top AS MATERIALIZED (SELECT key, arg_max(f, level) AS f, arg_max(p, level) AS p FROM {name} GROUP BY key)"""


ORACLE = f"""WITH RECURSIVE d AS MATERIALIZED (SELECT *, coalesce('+' || source, '') AS tree, sha256({_FIELDS('text')}) AS h, sha256({_FIELDS("CASE WHEN (" + _CRC + " & 1) = 1 THEN replace(text, chr(10), '') ELSE text END")}) AS c FROM documents),
 l AS MATERIALIZED (SELECT row_number() OVER () AS key, doc_id, tree, h, c, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM d),
 {_tree("low", "SELECT tree, i, h, n FROM l")},
 s AS MATERIALIZED (SELECT tree, h, row_number() OVER (ORDER BY encode(tree)) - 1 AS i, count(*) OVER () AS n FROM low WHERE n = 1),
 {_tree("high", "SELECT '' AS tree, i, h, n FROM s")},
 {_fold("up", "low_runs", "SELECT key, tree, 0 AS level, i, c AS f, '' AS p FROM l")},
 {_fold("over", "high_runs", "SELECT l.key, '' AS tree, 0 AS level, s.i, t.f, t.p FROM l JOIN up_top t USING (key) JOIN s ON s.tree = l.tree")}
SELECT doc_id, l.h AS leaf, s.h AS subroot, r.h AS root, sha256(t.p) AS proof_sha256, t.f AS folded_root, t.f = r.h AS verified
FROM l JOIN over_top t USING (key) JOIN s ON s.tree = l.tree CROSS JOIN (SELECT h FROM high WHERE n = 1) r"""
