r"""SimHash near-duplicates by vantage points over distinct fingerprints.

Fingerprint: A-Z lower-cased, words ``[^\x20\x09-\x0D]+``, shingles of three
words, XXH64 (seed 42) of each, majority bit by bit.  Equal fingerprints become
one row first, so groups of exact copies of any size cost nothing further.

Pairs at Hamming distance 2 or less are found by distances to vantage points: two
fingerprints that close differ by at most 2 in their distance to any point (triangle
inequality).  A vantage-point tree takes its points from the fingerprints themselves
and cuts their distances where the parts come out most even; its leaves are the
shards.  A fingerprint within reach of a cut goes to both sides, so each pair meets in
a shard.  Trees are grown from a bounded sample of a shard (``SAMPLE``; only the evenness
of the parts depends on it, never the result) and shards that are still crowded get
trees with points of their own, round by round.  Within a shard a tree over all its
members prunes the same way before the last comparisons.  The search is exact.

A crowded shard whose members lie within a few bits of each other can't be parted by
any point (``COPIES`` tells when).  Its members are linked by neighbourhoods: each
goes to all keys within half the radius, and those that meet at a key are linked.  Two
fingerprints are within the radius just if they meet somewhere, and a key has at most
as many visitors as it has neighbours (65 for radius 2), so no task grows with the
group.

Shards emit a spanning forest of their links; components follow by star
contraction.  Defined results: a null or wordless text has fingerprint zero and
links like any other; a component's id is its smallest doc_id (null only if all
are null); rows are kept one for one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .components import components

#: Distinct fingerprints that a shard should hold, about; the tree in it does the rest in memory.
SHARD = 8_192
#: Fingerprints of a crowded shard that its tree is grown from, and the least that a cut is judged by.
SAMPLE, JUDGED = 16_384, 128
#: Candidates for a vantage point, the largest part that a cut may leave, and the copies that a tree may make.
CANDIDATES, LARGEST, COPIES = 16, 0.8, 32
LEAF = 512
_ODD = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], np.uint64)
#: Bytes of trees that are sent to the tasks at once.
SENT = 64 << 20
#: Rows of a table of shards up to which it is broadcast, and the salts beyond.
FEW, SALTS = 100_000, 64


def fingerprint(text: str | None, size: int = 3, seed: int = 42) -> int:
    """The unsigned 64-bit SimHash of a text."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)))) if len(words) >= size else iter([b" ".join(words)])
    h = np.fromiter(map(xxh64_intdigest, shingles, repeat(seed)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 4096):
        bits = np.unpackbits(h[at : at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, size: int = 3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns to keep and fp, the SimHash of every whole text as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                few = batch.slice(at, 512)
                fps = np.array([fingerprint(t, size) for t in few.column(0).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*few.columns[1:], pa.array(fps)], names=[*keep, "fp"])

    kinds = "".join(f"{c} {documents.schema[c].dataType.simpleString()}, " for c in keep)
    return documents.select("text", *keep).mapInArrow(run, f"{kinds}fp long")


def _best_cut(own: np.ndarray, radius: int) -> tuple[np.uint64, int] | None:
    """The point of a sample, and the distance, that part it most evenly (None: none does)."""
    best = None
    for point in own[:: max(1, len(own) // CANDIDATES)]:
        d = np.sort(np.bitwise_count(own ^ point))
        middle = int(d[len(d) // 2])
        for cut_at in range(max(0, middle - radius), middle + 1):
            near, far = np.searchsorted(d, cut_at + radius, "right"), len(d) - np.searchsorted(d, cut_at, "right")
            if best is None or max(near, far) < best[0]:
                best = (max(near, far), point, cut_at)
    return None if best is None or best[0] > LARGEST * len(own) else best[1:]


def grow(sample: np.ndarray, n: int, radius: int) -> np.ndarray | None:
    """A vantage-point tree for n fingerprints, from a sample of them; None if no point parts them.

    One row a node: the point, the distance of the cut, the nodes within and beyond it
    (a negative cut: a leaf).
    """
    nodes, todo, leaves = [], [(np.sort(sample), 0)], 0
    nodes.append([0, -1, 0, 0])
    while todo:
        own, at = todo.pop()
        found = _best_cut(own, radius) if len(own) * n > SHARD * len(sample) and len(own) >= JUDGED else None
        if found is None:
            leaves += len(own)
            continue
        d = np.bitwise_count(own ^ found[0])
        nodes[at] = [int(found[0].view(np.int64)), found[1], len(nodes), len(nodes) + 1]
        todo += [(own[d <= found[1] + radius], len(nodes)), (own[d > found[1]], len(nodes) + 1)]
        nodes += [[0, -1, 0, 0], [0, -1, 0, 0]]
    return np.array(nodes, np.int64) if len(nodes) > 1 and leaves <= COPIES * len(sample) else None


def route(tree: np.ndarray, fps: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, places in fps) of all leaves that have or can reach some of fps."""
    todo = [(0, np.arange(len(fps)))]
    while todo:
        node, at = todo.pop()
        point, cut_at, within, beyond = tree[node].tolist()
        if cut_at < 0:
            yield node, at
            continue
        d = np.bitwise_count(fps[at] ^ np.int64(point).view(np.uint64))
        todo += [(x, y) for x, y in ((within, at[d <= cut_at + radius]), (beyond, at[d > cut_at])) if len(y)]


def _parted(sharded: DataFrame, trees: Broadcast, radius: int) -> DataFrame:
    """(shard, fp) with the shards that have a tree dealt to its leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = batch.column("shard").to_numpy(zero_copy_only=False)
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            order = np.argsort(shard, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
                if not len(own):
                    continue
                name = int(shard[own[0]])
                tree = trees.value.get(name)
                found = [(0, np.arange(len(own)))] if tree is None else list(route(tree, fp[own].view(np.uint64), radius))
                at = own[np.concatenate([y for _, y in found])]
                leaf = np.repeat(np.array([x for x, _ in found], np.uint64), [len(y) for _, y in found])
                mixed = np.int64(name).view(np.uint64) if tree is None else (np.int64(name).view(np.uint64) ^ leaf * _ODD[0]) * _ODD[1] ^ leaf
                yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(mixed, len(at)).astype(np.uint64).view(np.int64)), pa.array(fp[at])], names=["shard", "fp"])

    return sharded.select("shard", "fp").mapInArrow(run, "shard long, fp long")


def _by_shard(rows: DataFrame, of: DataFrame, how: str) -> DataFrame:
    """rows joined with one row a shard: broadcast if these are ``FEW`` at most, else dealt by shard and salt."""
    if of.limit(FEW + 1).count() <= FEW:
        return rows.join(F.broadcast(of), "shard", how)
    salted = of.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod("fp", F.lit(SALTS)).cast("int")).join(salted, ["shard", "salt"], how).drop("salt")


def _trees(sharded: DataFrame, radius: int) -> DataFrame:
    """(shard, tree) of the crowded shards; the tree is null where no point parts one."""
    crowded = cut(sharded.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > SHARD))
    picked = _by_shard(sharded, crowded, "inner").where(F.pmod(F.xxhash64("fp", F.lit("sample")), "n") < SAMPLE)

    def run(key, own):
        tree = grow(own["fp"].to_numpy().view(np.uint64), int(own["n"].iloc[0]), radius)
        import pandas as pd

        return pd.DataFrame({"shard": [key[0]], "tree": [None if tree is None else tree.tobytes()]})

    return cut(picked.groupBy("shard").applyInPandas(run, "shard long, tree binary"))


def shards(fps: DataFrame, radius: int) -> tuple[DataFrame, DataFrame | None]:
    """(shard, fp) of shards that hold about SHARD distinct fingerprints, and those that no point parts.

    Trees are sent to the tasks in passes of about ``SENT`` bytes, so neither the driver nor a
    task holds more of them at once, however many shards are crowded.
    """
    sharded = cut(fps.select(F.lit(0).cast("long").alias("shard"), "fp"))
    dense = None
    while True:
        trees = _trees(sharded, radius)
        grown, whole = trees.where("tree IS NOT NULL"), trees.where("tree IS NULL").select("shard")
        size, n_whole = trees.agg(F.coalesce(F.sum(F.octet_length("tree")), F.lit(0)), F.count("*") - F.count("tree")).first()
        if n_whole:
            own = _by_shard(sharded, whole, "left_semi")
            dense = own if dense is None else dense.unionByName(own)
            sharded = _by_shard(sharded, whole, "left_anti")
        if not size:
            return sharded, dense
        passes, done = -(-size // SENT), []
        for i in range(passes):
            mine = F.pmod(F.xxhash64("shard"), F.lit(passes)) == i
            held = {r["shard"]: np.frombuffer(r["tree"], np.int64).reshape(-1, 4) for r in grown.where(mine).toLocalIterator()}
            sent = sharded.sparkSession.sparkContext.broadcast(held)
            done.append(cut(_parted(sharded.where(mine), sent, radius)))
            sent.destroy()
        sharded = reduce(DataFrame.unionByName, done)


def close_pairs(fps: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of a shard at distance radius or less (some twice), by a vantage-point tree."""
    todo = [np.arange(len(fps))]
    while todo:
        at = todo.pop()
        own = fps[at]
        if len(at) > LEAF:
            d = np.bitwise_count(own ^ own[len(own) // 2])
            middle = int(np.median(d))
            near, far = d <= middle + radius, d > middle
            if max(near.sum(), far.sum()) < 0.95 * len(at):
                todo += [at[near], at[far]]
                continue
        for i in range(0, len(at), 512):
            a, b = np.nonzero(np.bitwise_count(own[i : i + 512, None] ^ own[None, i:]) <= radius)
            keep = a < b
            yield at[a[keep] + i], at[b[keep] + i]


def _forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    links = []
    for a, b in close_pairs(fps, radius):
        for x, y in zip(a.tolist(), b.tolist()):
            x, y = find(x), find(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
                links.append((x, y))
    return [(int(fps[x].view(np.int64)), int(fps[y].view(np.int64))) for x, y in links]


def neighbourhood_links(fps: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints within an even radius, by shared neighbours."""
    flips = [sum(1 << i for i in bits) for n in range(radius // 2 + 1) for bits in combinations(range(64), n)]
    signed = np.array(flips, np.uint64).view(np.int64).tolist()
    near = F.transform(F.array(*[F.lit(x) for x in signed]), lambda x: x.bitwiseXOR(F.col("fp")))
    visits = fps.select("fp", F.explode(near).alias("key"))
    met = visits.groupBy("key").agg(F.sort_array(F.collect_list("fp")).alias("own")).where(F.size("own") > 1)  # at most one a flip
    return met.select(F.col("own")[0].alias("a"), F.explode(F.slice("own", 2, F.size("own"))).alias("b"))


def near_links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect all that are within an even radius."""
    sharded, dense = shards(fps.select("fp").distinct(), radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_shard, rest_fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def links(shard: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            starts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(shard) else []
            found = [e for own in np.split(fp, starts[1:]) if len(own) > 1 for e in _forest(own, radius)]
            return pa.RecordBatch.from_arrays([pa.array([e[0] for e in found], pa.int64()), pa.array([e[1] for e in found], pa.int64())], names=["a", "b"])

        for batch in batches:
            shard = np.r_[rest_shard, batch.column("shard").to_numpy(zero_copy_only=False)]
            fp = np.r_[rest_fp, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)]
            if not len(shard):
                continue
            whole = int(np.searchsorted(shard, shard[-1]))  # the last shard may go on in the next batch
            yield links(shard[:whole], fp[:whole])
            rest_shard, rest_fp = shard[whole:], fp[whole:]
        yield links(rest_shard, rest_fp)

    dealt = sharded.select("shard", "fp").repartition("shard").sortWithinPartitions("shard", "fp")
    found = dealt.mapInArrow(run, "a long, b long")
    if dense is not None:
        found = found.unionByName(neighbourhood_links(dense.select("fp").distinct(), radius))
    return found.distinct()


def _roots(fps: DataFrame, radius: int, first: Column) -> DataFrame:
    """(fp, first, root) of every distinct fingerprint: its least row by ``first``, and its component."""
    roots = components(near_links(fps, radius))
    owners = fps.groupBy("fp").agg(F.min(first).alias("first"))
    return owners.join(roots, owners["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def near_duplicates(documents: DataFrame, radius: int = 2, size: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row of documents."""
    fps = cut(fingerprints(documents, size))
    owners = _roots(fps, radius, F.col("doc_id"))
    least = owners.groupBy("root").agg(F.min("first").alias("component_id"))
    return fps.join(owners.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def one_of_each(documents: DataFrame, radius: int = 2, size: int = 3) -> DataFrame:
    """One row of documents, all columns, of every component.

    Rows are judged, not ids: of a component the row with the least doc_id stays (rows
    without an id last), the least hash of all its columns among rows of one id, so the same
    row stays in every run.  Rows of one id with unlike texts are apart, so no text is lost
    for its id.
    """
    kinds = {f.name: f.dataType.simpleString() for f in documents.schema.fields}
    held = [F.to_json(F.struct(f"`{c}`")) if "<" in kinds[c] or kinds[c] == "variant" else F.col(f"`{c}`") for c in documents.columns]
    row = [x for c in held for x in (F.isnull(c), c)]
    keyed = documents.withColumns({"_k1": F.xxhash64(*row), "_k2": F.xxhash64(F.lit(1), *row)})
    fps = cut(fingerprints(keyed, size, ("doc_id", "_k1", "_k2")))
    owners = _roots(fps, radius, F.struct(F.isnull("doc_id").alias("none"), "doc_id", "_k1", "_k2"))
    stay = owners.groupBy("root").agg(F.min("first").alias("first")).select("first._k1", "first._k2")
    return keyed.join(stay, ["_k1", "_k2"], "left_semi").dropDuplicates(["_k1", "_k2"]).select(*documents.columns)


def hex_of(fp: Column) -> Column:
    """Sixteen lowercase hex digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")
