"""Suffix-array dedup of repeated 200-byte strings by prefix-free parsing.

Every byte covered by a 200-byte string that also starts anywhere else in the
corpus is found, exactly, without a global suffix array over the bytes:

1. *Parsing.*  A rolling hash of 64 bytes sets triggers: in every 200-byte
   string the place of its least hash.  Triggers depend on content alone, so
   equal strings have the same trigger at the same place, and each string starts
   a known number of bytes (its offset) before its trigger.  One row a trigger
   (about every 69 bytes) leaves the task: the hash of its 64 bytes and a hash of
   its surroundings, all bytes that strings with this trigger reach.
2. *Dictionary.*  Triggers are counted by their hash with partial sums.  Unique
   ones end here.  Where all surroundings are alike, all strings are repeats.
3. *Suffix arrays.*  Where surroundings differ, one representative of each is
   read with its bytes.  Two suffix arrays are built for the triggers of a hash:
   of the phrases that lead up to the trigger (read backwards) and of the parse
   that follows it.  With their longest common prefixes, the string at offset o
   repeats if another trigger lies in the same run of the first array for o bytes
   and of the second for 200 - o: corpus order, combined from both.
4. Hashes with very many different surroundings (more than ``HOT``) would make a
   large group; their strings are hashed (128 bits) and counted by Spark instead,
   which gives the same result with partial sums.

A text that occurs more than twice in a partition is parsed once there, so groups
of copies of any size stay small.  Defined results: a null text is empty; texts
under 200 bytes are kept whole; rows are kept one for one and equal rows count as
repeats of each other; matches never cross documents.  ``keep_text`` drops only
characters of which every byte is covered, so texts stay valid UTF-8.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

LENGTH = 200
GRAM = 64
OFFSETS = LENGTH - GRAM + 1
#: Different surroundings of one trigger beyond which their strings are counted by Spark.
HOT = 4_000
#: Tasks to which the surroundings of one hash are dealt when they are marked as hot.
SALTS = 64
#: Bytes that a task parses at once.
CHUNK = 1 << 19
_MIX = np.random.default_rng(7).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def triggers(data: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Triggers of the strings that start where valid: place, first and last start, hash."""
    h = _MIX[data]
    step = 1
    while step < GRAM:
        h = h[:-step] * _MIX[step] + h[step:]
        h ^= h >> np.uint64(31)
        step *= 2
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    step = 1
    while step * 2 <= OFFSETS:
        key = np.minimum(key[:-step], key[step:])
        step *= 2
    key = np.minimum(key[: len(key) - (OFFSETS - step)], key[OFFSETS - step :])
    starts = np.flatnonzero(valid[: len(key)])
    place = (key[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (np.diff(place) != 0) | (np.diff(starts) != 1)]) if len(starts) else np.zeros(0, np.int64)
    last = np.r_[new[1:] - 1, len(starts) - 1] if len(new) else new
    return place[new], starts[new], starts[last], h[place[new]]


def _chunks(texts: list[bytes]) -> Iterator[tuple[list[tuple[int, int, int]], bytes]]:
    """(text, first byte, place in the joined bytes) of parts, and the joined bytes.

    Long texts are cut into parts that share 199 bytes, so each start is in one part.
    """
    parts, joined, size = [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(0, len(text) - LENGTH + 1), CHUNK):
            own = text[at : at + CHUNK + LENGTH - 1]
            parts.append((i, at, size))
            joined.append(own)
            size += len(own)
            if size >= CHUNK:
                yield parts, b"".join(joined)
                parts, joined, size = [], [], 0
    if parts:
        yield parts, b"".join(joined)


def keyed(documents: DataFrame) -> DataFrame:
    """documents with text as bytes and a 128-bit key of the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return documents.withColumn("_text", text).withColumns({"_k1": F.xxhash64("_text"), "_k2": F.xxhash64(F.lit(1), "_text")})


def _trigger_rows(documents: DataFrame) -> DataFrame:
    """(k1, k2, x, lo, hi, h, c) of every trigger: its text, place, least and greatest offset, hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        seen: dict[tuple[int, int], int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                few = batch.slice(at, 1024)
                keys = list(zip(few.column(0).to_pylist(), few.column(1).to_pylist()))
                own = []
                for i, k in enumerate(keys):
                    seen[k] = seen.get(k, 0) + 1
                    if seen[k] <= 2:
                        own.append(i)
                texts = [t.encode() for t in few.column(2).take(pa.array(own, pa.int32())).to_pylist()]
                for parts, data in _chunks(texts):
                    starts = np.array([p[2] for p in parts])
                    ends = np.r_[starts[1:], len(data)]
                    valid = np.zeros(len(data), bool)
                    for a, b in zip(starts, ends):
                        valid[a : b - LENGTH + 1] = True
                    x, s0, s1, h = triggers(np.frombuffer(data, np.uint8), valid)
                    which = np.searchsorted(starts, s0, side="right") - 1
                    lo, hi = x - s1, x - s0
                    view = memoryview(data)
                    c = np.array([xxh3_64_intdigest(view[a : b + LENGTH], (p << 8) | q) for a, b, p, q in zip(s0.tolist(), s1.tolist(), lo.tolist(), hi.tolist())], np.uint64).view(np.int64)
                    text_of = np.array([p[0] for p in parts])[which]
                    shift = np.array([p[1] for p in parts])[which] - starts[which]
                    k = np.array([keys[i] for i in own], np.int64).reshape(-1, 2)[text_of]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array((x + shift).astype(np.int64)), pa.array(lo.astype(np.int16)), pa.array(hi.astype(np.int16)), pa.array(h.view(np.int64)), pa.array(c)],
                        names=["k1", "k2", "x", "lo", "hi", "h", "c"],
                    )

    return documents.select("_k1", "_k2", "_text").mapInArrow(run, "k1 long, k2 long, x long, lo short, hi short, h long, c long")


def _squeezed(documents: DataFrame, keep: list[str], once: bool = False) -> DataFrame:
    """Key, compressed text and columns to keep; with ``once`` a text at most once a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=1)
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                few = batch.slice(at, 1024)
                if once:
                    own = []
                    for i, k in enumerate(zip(few.column(0).to_pylist(), few.column(1).to_pylist())):
                        if k not in seen:
                            seen.add(k)
                            own.append(i)
                    few = few.take(pa.array(own, pa.int32()))
                texts = [t.encode() for t in few.column(2).to_pylist()]
                blobs = pa.array([codec.compress(t, asbytes=True) for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([few.column(0), few.column(1), blobs, pa.array([len(t) for t in texts], pa.int64()), *few.columns[3:]], names=["k1", "k2", "blob", "n_bytes", *keep])

    kinds = {f.name: f.dataType.simpleString() for f in documents.schema.fields}
    schema = "k1 long, k2 long, blob binary, n_bytes long" + "".join(f", `{c}` {kinds[c]}" for c in keep)
    return documents.select("_k1", "_k2", "_text", *[f"`{c}`" for c in keep]).mapInArrow(run, schema)


def _surroundings(blobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h, c, n, hot, lo, hi, left, right): bytes before and from each wanted trigger."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                few = batch.slice(at, 256)
                rows = []
                for blob, size, list_of in zip(*(few.column(i).to_pylist() for i in range(3))):
                    text = codec.decompress(blob, size, asbytes=True)
                    for w in list_of:
                        x, lo, hi = w["x"], w["lo"], w["hi"]
                        rows.append((w["h"], w["c"], w["n"], w["hot"], lo, hi, text[x - hi : x], text[x : x - lo + LENGTH]))
                cols = list(zip(*rows)) or [[]] * 8
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int16(), pa.int16(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["h", "c", "n", "hot", "lo", "hi", "left", "right"])

    lists = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("h", "c", "n", "hot", "x", "lo", "hi")).alias("wanted"))  # bounded by a text's triggers
    return blobs.join(lists, ["k1", "k2"]).select("blob", "n_bytes", "wanted").mapInArrow(run, "h long, c long, n long, hot boolean, lo short, hi short, left binary, right binary")


def _runs(group: np.ndarray, strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array (order) of strings within groups, and common bytes with the one before."""
    grid = np.zeros((len(strings), width + 8), np.uint8)
    grid[:, :8] = group.astype(">u8").view(np.uint8).reshape(-1, 8)
    for i, s in enumerate(strings):
        grid[i, 8 : 8 + len(s)] = np.frombuffer(s, np.uint8)
    order = np.argsort(grid.view(f"S{width + 8}").ravel(), kind="stable")
    grid = grid[order]
    differs = grid[1:] != grid[:-1]
    common = np.where(differs.any(axis=1), differs.argmax(axis=1), width + 8) - 8
    return order, np.r_[-1, common]


def repeated_offsets(group: np.ndarray, n: np.ndarray, lo: np.ndarray, hi: np.ndarray, left: list[bytes], right: list[bytes]) -> np.ndarray:
    """For each trigger (row) and offset (column): does its string occur again?

    ``left`` are the bytes before the triggers, ``right`` those from them on; rows
    of one group have the same trigger hash, and n counts equal surroundings.
    """
    rows = len(group)
    out = np.zeros((rows, OFFSETS), bool)
    order_l, common_l = _runs(group, [s[::-1] for s in left], OFFSETS)
    order_r, common_r = _runs(group, right, LENGTH)
    for o in range(OFFSETS):
        at = np.flatnonzero((lo <= o) & (o <= hi))
        if not len(at):
            continue
        run_l, run_r = np.empty(rows, np.int64), np.empty(rows, np.int64)
        run_l[order_l] = np.cumsum(common_l < o)
        run_r[order_r] = np.cumsum(common_r < LENGTH - o)
        _, back, count = np.unique(run_l[at] * (rows + 1) + run_r[at], return_inverse=True, return_counts=True)
        out[at, o] = (count[back] > 1) | (n[at] > 1)
    return out


def _by_suffix_arrays(surroundings: DataFrame) -> DataFrame:
    """(h, c, mask): repeated offsets, for hashes whose triggers fit one task."""

    def judged(table_: pa.Table) -> pa.RecordBatch:
        h, c = table_["h"].to_numpy(), table_["c"].to_numpy()
        first = np.unique(np.stack([h, c], 1), axis=0, return_index=True)[1] if len(h) else np.zeros(0, np.int64)
        table_ = table_.take(pa.array(np.sort(first)))
        h = table_["h"].to_numpy()
        group = np.unique(h, return_inverse=True)[1]
        found = repeated_offsets(group, *(table_[k].to_numpy() for k in ("n", "lo", "hi")), table_["left"].to_pylist(), table_["right"].to_pylist())
        some = np.flatnonzero(found.any(axis=1))
        masks = np.packbits(found[some], axis=1)
        return pa.RecordBatch.from_arrays([pa.array(h[some]), table_["c"].take(pa.array(some)).combine_chunks(), pa.array([m.tobytes() for m in masks], pa.binary())], names=["h", "c", "mask"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                kept.append(batch.slice(at, 4096))
                size += kept[-1].num_rows
                if size >= 16_384:
                    whole = pa.Table.from_batches(kept)
                    h = whole["h"].to_numpy()
                    end = int(np.searchsorted(h, h[-1]))  # the last group may go on
                    if end:
                        yield judged(whole.slice(0, end))
                        kept = whole.slice(end).combine_chunks().to_batches()
                        size = len(h) - end
        if size:
            yield judged(pa.Table.from_batches(kept))

    small = surroundings.where("not hot").drop("hot").repartition("h").sortWithinPartitions("h", "c")
    return small.mapInArrow(run, "h long, c long, mask binary")


def _by_counting(surroundings: DataFrame) -> DataFrame:
    """The same for hashes with very many different surroundings: strings counted by 128-bit hash."""

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = []
                for r in batch.slice(at, 512).to_pylist():
                    data = r["left"] + r["right"]
                    rows += [(r["h"], r["c"], r["n"], o, xxh3_128_digest(data[r["hi"] - o : r["hi"] - o + LENGTH])) for o in range(r["lo"], r["hi"] + 1)]
                cols = list(zip(*rows)) or [[]] * 5
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int16(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["h", "c", "n", "o", "s"])

    def masks(pairs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pairs:
            out = []
            for offsets in batch.column("offsets").to_pylist():
                bits = np.zeros(OFFSETS, bool)
                bits[offsets] = True
                out.append(np.packbits(bits).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("c"), pa.array(out, pa.binary())], names=["h", "c", "mask"])

    hot = surroundings.where("hot").dropDuplicates(["h", "c"]).select("h", "c", "n", "lo", "hi", "left", "right")
    each = hot.mapInArrow(strings, "h long, c long, n long, o short, s binary")
    often = each.groupBy("s").agg(F.sum("n").alias("k")).where("k > 1").select("s")
    return each.join(often, "s").groupBy("h", "c").agg(F.collect_list("o").alias("offsets")).mapInArrow(masks, "h long, c long, mask binary")


def repeats(documents: DataFrame) -> DataFrame:
    """(k1, k2, found): the triggers of each text with repeated strings.

    ``found`` holds (x, lo, hi, mask); a null mask means all offsets.
    """
    rows = _trigger_rows(documents)
    groups = rows.groupBy("h").agg(F.count("*").alias("times"), F.min("c").alias("least"), F.max("c").alias("most"))
    # Cut, so that both sides of the join are dealt anew and a hot hash can be split.
    groups = cut(groups.where("times > 1").select("h", (F.col("least") == F.col("most")).alias("alike")))
    again = cut(rows.join(groups, "h"))
    alike = again.where("alike").select("k1", "k2", "x", "lo", "hi", F.lit(None).cast("binary").alias("mask"))
    mixed = again.where("not alike")
    reps = mixed.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "x", "lo", "hi")).alias("r"))
    # Hashes with many surroundings are few, so a copy for each salt lets their rows be dealt by salt.
    many = reps.groupBy("h").agg(F.count("*").alias("m")).where(F.col("m") > HOT)
    many = many.select("h", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(True).alias("hot"))
    salted = reps.withColumn("salt", F.pmod("c", F.lit(SALTS)).cast("int"))
    wanted = salted.join(many, ["h", "salt"], "left").select("h", "c", "n", F.coalesce("hot", F.lit(False)).alias("hot"), "r.*")
    around = cut(_surroundings(_squeezed(documents, [], once=True), wanted))
    found = _by_suffix_arrays(around).unionByName(_by_counting(around))
    some = mixed.join(found, ["h", "c"]).select("k1", "k2", "x", "lo", "hi", "mask")
    return alike.unionByName(some).distinct().groupBy("k1", "k2").agg(F.collect_list(F.struct("x", "lo", "hi", "mask")).alias("found"))


def covered(n_bytes: int, found: list[dict] | None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of covered bytes."""
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    change = np.zeros(n_bytes + 1, np.int32)
    for f in found:
        if f["mask"] is None:
            change[f["x"] - f["hi"]] += 1
            change[f["x"] - f["lo"] + LENGTH] -= 1
        else:
            starts = f["x"] - np.flatnonzero(np.unpackbits(np.frombuffer(f["mask"], np.uint8))[:OFFSETS])
            np.add.at(change, starts, 1)
            np.add.at(change, starts + LENGTH, -1)
    inside = np.diff(np.r_[0, (np.cumsum(change) > 0).astype(np.int8)])
    return np.flatnonzero(inside == 1), np.flatnonzero(inside == -1)


def _apply(documents: DataFrame, keep: list[str], schema: str, result) -> DataFrame:
    """result(text bytes, run starts, run ends) for each row, after the columns to keep."""
    docs = keyed(documents)
    joined = _squeezed(docs, keep).join(cut(repeats(docs)), ["k1", "k2"], "left")  # cut: a hot text can be split
    names = [*keep, *(x.split()[0] for x in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                few = batch.slice(at, 256)
                out = []
                for blob, size, found in zip(*(few.column(k).to_pylist() for k in ("blob", "n_bytes", "found"))):
                    out.append(result(codec.decompress(blob, size, asbytes=True) if size else b"", *covered(size, found)))
                cols = zip(*out) if out else [[]] * (len(names) - len(keep))
                yield pa.RecordBatch.from_arrays([*(few.column(c) for c in keep), *map(pa.array, cols)], names=names)

    kinds = {f.name: f.dataType.simpleString() for f in documents.schema.fields}
    return joined.select("blob", "n_bytes", "found", *[f"`{c}`" for c in keep]).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), schema]))


def _kept(text: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    cuts = [0, *np.stack([starts, ends], 1).ravel().tolist(), len(text)]
    return b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2]))


def remove_repeats(documents: DataFrame, keep: list[str]) -> DataFrame:
    """The columns to keep and the digest of what remains of each text's bytes."""

    def result(text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple:
        return len(text), int((ends - starts).sum()), len(starts), hashlib.sha256(_kept(text, starts, ends)).hexdigest()

    return _apply(documents, keep, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", result)


def keep_text(documents: DataFrame, keep: list[str]) -> DataFrame:
    """The columns to keep, the text without its repeats, and the bytes removed."""

    def result(text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple:
        data = np.frombuffer(text, np.uint8)
        inner = (data & 0xC0) == 0x80  # bytes that go on with a character
        a, b = starts.copy(), ends.copy()
        for i in range(len(a)):  # shrink to whole characters
            while a[i] < b[i] and inner[a[i]]:
                a[i] += 1
            while b[i] > a[i] and b[i] < len(data) and inner[b[i]]:
                b[i] -= 1
        return _kept(text, a, b).decode(), int((b - a).sum())

    return _apply(documents, keep, "text string, n_removed long", result)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and spans removed from every document."""
    return remove_repeats(table(spark, sf_dir, "documents"), ["doc_id"])
