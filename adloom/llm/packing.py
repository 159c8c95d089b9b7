"""Best-fit packing of tokenised documents by exact-complement hashing.

Only the histogram of piece lengths (one count for each length up to the
capacity) decides the plan.  An index of sums holds the lengths that are still
available, for each sum the number of available pairs that make it, and so, by one
look-up a length, the triples.  Longest lengths first, the gap that a length leaves is
looked up in the index, and single, pair and triple combinations that fill it exactly
are consumed as often as the counts allow; what is left is packed best-fit decreasing,
in bulk.  Exact combinations can use up short pieces that later gaps need, so plans
that hold back triples, pairs or short first lengths are made too, best-fit decreasing
alone among them, and the one of fewest sequences is taken: never more than by best-fit
decreasing.  A plan is a short list of patterns (lengths of one sequence, how often).

Pieces get their places in it without any global sort: a piece's rank among the
pieces of its length is its rank within its partition plus the count in the
partitions before it, and the plan says which ranks of a length fill which slot.

Defined results: a null text is empty; an empty text is the one separator
token.  Only documents longer than the capacity are cut; all their pieces but
the first are full.  Rows are kept one for one.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

SEPARATOR = 0


@lru_cache(maxsize=2)
def _encoder(name: str):
    """ids(text) -> uint32 array for a vocabulary file.

    Where the rank file of the same vocabulary lies beside the tokenizer file, the
    faster library encodes by it (the ids are the same); special strings inside a
    text are special tokens, as by the tokenizer's default.  Its regular expression
    gives up on white-space runs of about a million characters; such a text is
    encoded by the tokenizer file's own library.
    """
    import json
    import os

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    ranks_path = path.removesuffix(".json") + ".tiktoken"
    tokenizer = lru_cache(maxsize=1)(lambda: Tokenizer.from_file(path))

    def plain(text: str) -> np.ndarray:
        return np.array(tokenizer().encode(text, add_special_tokens=False).ids, np.uint32)

    if not os.path.exists(ranks_path):
        return plain
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(path) as f:
        special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    own = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def ids(text: str) -> np.ndarray:
        try:
            return np.asarray(own.encode_to_numpy(text, allowed_special="all"), np.uint32)
        except ValueError:  # the regular expression gave up
            return plain(text)

    return ids


def tokenize_pieces(documents: DataFrame, tokenizer: str, capacity: int, with_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, [ids], and the
    partition and the rank within it among pieces of the same length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _encoder(tokenizer)
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                few = batch.slice(at, 512)
                rows, index = [], []
                for i, text in enumerate(few.column(1).to_pylist()):
                    ids = np.append(ids_of(text or ""), np.uint32(SEPARATOR)).astype("<u4")
                    start, end = 0, (len(ids) - 1) % capacity + 1
                    piece = 0
                    while start < len(ids):
                        own = ids[start:end]
                        index.append(i)
                        rows.append((piece, start, end - start, zlib.crc32(own.tobytes()), seen[end - start], own if with_ids else None))
                        seen[end - start] += 1
                        piece, start, end = piece + 1, end, end + capacity
                cols = list(zip(*rows)) or [[]] * 6
                columns = [few.column(0).take(pa.array(index, pa.int32())), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:5]), pa.array([part] * len(rows), pa.int32())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "nth", "part"]
                if with_ids:
                    columns.append(pa.array([x.astype(np.int32) for x in cols[5]], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, nth long, part int" + ", ids array<int>" * with_ids
    return documents.select("doc_id", "text").mapInArrow(run, schema)


class SumIndex:
    """Available lengths by count, and the available pairs of lengths by their sum."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.pairs = np.zeros(capacity + 1, np.int64)
        for a in np.flatnonzero(self.left):
            partners = np.flatnonzero(self.left[: min(a, capacity + 1 - a)])
            self.pairs[a + partners] += 1
            if self.left[a] > 1 and 2 * a <= capacity:
                self.pairs[2 * a] += 1

    def take(self, length: int, n: int = 1) -> None:
        """Use up n pieces of a length (n < 0: give them back)."""
        before, now = int(self.left[length]), int(self.left[length]) - n
        self.left[length] = now
        top = len(self.left) - 1
        if (before > 0) != (now > 0):
            partners = np.flatnonzero(self.left[: top + 1 - length])
            self.pairs[length + partners[partners != length]] += 1 if now > 0 else -1
        if (before > 1) != (now > 1) and 2 * length <= top:
            self.pairs[2 * length] += 1 if now > 1 else -1

    def pair(self, gap: int) -> list[int] | None:
        """Two available lengths that sum to gap, the most unlike first."""
        if gap < 2 or not self.pairs[gap]:
            return None
        big = np.arange(gap - 1, (gap - 1) // 2, -1)
        found = np.flatnonzero((self.left[big] > 0) & (self.left[gap - big] > (2 * big == gap)))
        return [int(big[found[0]]), int(gap - big[found[0]])]

    def triple(self, gap: int) -> list[int] | None:
        """Three available lengths that sum to gap, the greatest first."""
        first = np.arange(gap - 2, (gap - 1) // 3, -1)
        for a in first[(self.left[first] > 0) & (self.pairs[gap - first] > 0)].tolist():
            self.take(a)
            rest = self.pair(gap - a)
            self.take(a, -1)
            if rest:
                return [a, *rest]
        return None

    def combination(self, gap: int, most: int) -> list[int] | None:
        """Up to ``most`` available lengths that sum to gap, as few as can be."""
        if gap == 0:
            return []
        if most and self.left[gap]:
            return [gap]
        found = self.pair(gap) if most > 1 else None
        return found or (self.triple(gap) if most > 2 and gap > 2 else None)


def exact_patterns(index: SumIndex, most: int, least_first: int) -> list[tuple[int, list[int]]]:
    """Patterns that fill a sequence exactly, first lengths from the capacity down; they are used up.

    Each step uses up a length, so there are about as many as lengths, whatever the counts.
    """
    capacity = len(index.left) - 1
    plan = []
    for a in range(capacity, least_first - 1, -1):
        while index.left[a]:
            index.take(a)
            rest = index.combination(capacity - a, most)
            index.take(a, -1)
            if rest is None:
                break
            lengths = [a, *rest]
            times = min(int(index.left[x]) // lengths.count(x) for x in lengths)
            for x in lengths:
                index.take(x, times)
            plan.append((times, lengths))
    return plan


def best_fit(left: np.ndarray) -> list[tuple[int, list[int]]]:
    """Patterns of best-fit decreasing, like open sequences taken together; left is used up."""
    capacity = len(left) - 1
    groups: dict[int, list[tuple[int, list[int]]]] = {}  # by gap: open sequences alike
    for a in range(capacity, 0, -1):
        while left[a]:
            gap = min((g for g in groups if g >= a), default=None)
            if gap is None:
                each = capacity // a
                for times, n in ((int(left[a]) // each, each), (1, int(left[a]) % each)):
                    if times and n:
                        groups.setdefault(capacity - n * a, []).append((times, [a] * n))
                left[a] = 0
                break
            times, lengths = groups[gap].pop()
            n = min(int(left[a]), times)
            if n < times:
                groups[gap].append((times - n, lengths))
            if not groups[gap]:
                del groups[gap]
            groups.setdefault(gap - a, []).append((n, [*lengths, a]))
            left[a] -= n
    return [x for group in groups.values() for x in group]


def plan_packing(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Patterns (how often, lengths) that use up all counts in as few sequences as any plan tried."""
    best = None
    bound = -(-sum(x * n for x, n in counts.items()) // capacity)
    for most in (3, 2, 1, 0):
        for least_first in (1, capacity // 2 + 1) if most > 1 else (1,):
            index = SumIndex(counts, capacity)
            plan = exact_patterns(index, most, least_first) if most else []
            plan += best_fit(index.left)
            if best is None or sum(t for t, _ in plan) < sum(t for t, _ in best):
                best = plan
            if sum(t for t, _ in best) <= bound:
                return best
    return best


def _slots(plan: list[tuple[int, list[int]]], capacity: int) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first ranks, first sequences and offsets of its slots."""
    used = dict.fromkeys(range(1, capacity + 1), 0)
    out: dict[int, list] = {}
    sequence = 0
    for times, lengths in plan:
        offset = 0
        for x in lengths:
            out.setdefault(x, []).append((used[x], sequence, offset))
            used[x] += times
            offset += x
        sequence += times
    return {x: tuple(np.array(c, np.int64) for c in zip(*rows)) for x, rows in out.items()}


def pack(documents: DataFrame, tokenizer: str = "byte_bpe_50k.json", capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """Pieces with their sequence_id and offset in it."""
    pieces = cut(tokenize_pieces(documents, tokenizer, capacity, with_ids))
    sums = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in sums.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most one row a length
    slots = _slots(plan_packing(counts, capacity), capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = sums.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = pieces.join(first, ["length", "part"]).withColumn("nth", F.col("nth") + F.col("first")).drop("first", "part")
    names = [c for c in ranked.columns if c != "nth"]
    shared = pieces.sparkSession.sparkContext.broadcast(slots)  # bounded by the plan

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            nth = batch.column("nth").to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(nth), np.int64), np.zeros(len(nth), np.int64)
            for x in np.unique(length):
                at = np.flatnonzero(length == x)
                ranks, firsts, offsets = shared.value[int(x)]
                slot = np.searchsorted(ranks, nth[at], side="right") - 1
                sequence[at] = firsts[slot] + nth[at] - ranks[slot]
                offset[at] = offsets[slot]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    kinds = {f.name: f.dataType.simpleString() for f in ranked.schema.fields}
    schema = ", ".join(f"{c} {kinds[c]}" for c in names) + ", sequence_id long, offset long"
    return ranked.mapInArrow(run, schema)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    out = pack(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
