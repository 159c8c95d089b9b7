r"""Benchmark decontamination: size-partitioned MinHash containment search.

Finds short test items inside long documents.  Words are ``[^\x20\x09-\x0D]+``
with A-Z lower-cased; shingles are five words (a text of fewer words is one
shingle, one of none has no shingle).  An item leaks into a document if at least
0.8 of its distinct shingles are in the document.

A whole document's Jaccard similarity with a short item is near zero, so the
search is partitioned by size.  Items of fewer than ``SHORT`` shingles are looked
for exactly: a document is a candidate if it has enough of the item's shingle
hashes, wherever they stand.  Longer items of up to u shingles (u = 16, 32, 64, ...)
are looked for in windows of 2u shingles, u apart, so any stretch of u shingles
lies inside one window.  An item has more than u / 2 shingles there, so one that
is contained in a stretch of u shingles has a Jaccard similarity of 0.19 or more
with that window.  A document is a candidate for it if one of ``PERMUTATIONS``
minima agrees in some window (one row a band), which misses such an item with a
probability under 0.0001.  That bound does not hold for a longer item whose
shingles are strewn over a longer stretch of the document.  Candidates are
verified by exact containment of shingle strings over the whole document.

Minima are computed once for blocks of 16 shingles; larger windows take the least
of their blocks.  Distinct item texts are indexed on the driver and sent to the tasks
in blocks of about ``ITEMS_AT_ONCE`` texts and ``BYTES_AT_ONCE`` bytes; a larger benchmark
takes more passes over the documents, one after another, so what is held is bounded by
a block (and by one item's text).  Ids of items come back by a join on the hash of
their text.  Defined results: null and empty texts have no shingle and match nothing;
an item of fewer than five words matches only a text of the same words; rows are
kept apart, repeats of documents and items included.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

SHINGLE = 5
LEAST = 16
#: Items of fewer shingles are looked up by all their shingles.
SHORT = LEAST // 2 + 1
PERMUTATIONS = 48
ITEMS_AT_ONCE, BYTES_AT_ONCE = 20_000, 32 << 20
#: Distinct words that a task remembers the hashes of.
MEMORY = 500_000
_RANDOM = np.random.default_rng(11)
_FACTORS = _RANDOM.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = _RANDOM.integers(0, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def shingles_of(words: list[bytes]) -> set[bytes]:
    """Distinct shingles as strings."""
    if len(words) < SHINGLE:
        return {b" ".join(words)} if words else set()
    return set(map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)))))


class WordHashes:
    """64-bit hashes of words, remembered."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        from xxhash import xxh3_64_intdigest

        got = list(map(self.known.get, words))
        if None in got:
            if len(self.known) > MEMORY:
                self.known.clear()
            for w in dict.fromkeys(words):
                if w not in self.known:
                    self.known[w] = xxh3_64_intdigest(w)
            got = list(map(self.known.__getitem__, words))
        return np.array(got, np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def shingle_hashes(hashes: WordHashes, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of the texts in order, and how many each text has."""
    sizes = np.array([len(t) for t in texts], np.int64)
    flat = [w for t in texts for w in t]
    w = hashes(flat) if flat else np.zeros(0, np.uint64)
    counts = np.where(sizes >= SHINGLE, sizes - SHINGLE + 1, (sizes > 0).astype(np.int64))
    begin = np.repeat(np.cumsum(sizes) - sizes, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    size = np.repeat(np.minimum(sizes, SHINGLE), counts)
    out = np.zeros(len(begin), np.uint64)
    padded = np.r_[w, np.zeros(SHINGLE, np.uint64)]
    for i in range(SHINGLE):
        out += np.where(i < size, padded[begin + i] * _PLACES[i], np.uint64(0))
    return _mixed(out + size.astype(np.uint64)), counts


def minima(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The least value of every permutation in each stretch of h: [permutation, stretch]."""
    out = np.empty((PERMUTATIONS, len(starts)), np.uint64)
    if len(starts):
        for k, f in enumerate(_FACTORS):
            out[k] = np.minimum.reduceat(_turned(h, f), starts)
    return out


def _turned(h: np.ndarray, factor: np.uint64) -> np.ndarray:
    h = h * factor
    return h ^ (h >> np.uint64(32))


class Index:
    """Shingle hashes of the short items of a block and minima of the others, by size class."""

    def __init__(self, items: list[tuple[tuple[int, int], str]]):
        kept = [(i, words_of(t)) for i, t in items]
        kept = [(i, w) for i, w in kept if w]
        self.ids = [i for i, _ in kept]
        self.shingles = [shingles_of(w) for _, w in kept]
        h, counts = shingle_hashes(WordHashes(), [w for _, w in kept])
        self.distinct = np.array([len(s) for s in self.shingles], np.int64)
        is_short = self.distinct < SHORT
        of = np.repeat(np.arange(len(kept)), counts)
        own = is_short[of]
        pairs = np.unique(np.rec.fromarrays([h[own], of[own]], names="hash,item"))  # a shingle counts once an item
        self.short_items = pairs["item"]
        self.short, self.short_from = np.unique(pairs["hash"], return_index=True)
        self.short_till = np.r_[self.short_from[1:], len(pairs)]
        self.hashes = np.bincount(self.short_items, minlength=len(kept))
        self.short_first = np.zeros(1 << 22, bool)
        self.short_first[self.short >> np.uint64(42)] = True
        m = minima(h, np.cumsum(counts) - counts)
        sizes = np.array([max(LEAST, 1 << (len(s) - 1).bit_length()) for s in self.shingles], np.int64)
        self.classes = {}
        for u in np.unique(sizes[~is_short]):
            at = np.flatnonzero((sizes == u) & ~is_short)
            values = m[:, at] + np.arange(PERMUTATIONS, dtype=np.uint64)[:, None]  # a value of one permutation is no other's, nearly
            order = np.argsort(values.ravel(), kind="stable")
            first = np.zeros(1 << 22, bool)
            first[values.ravel() >> np.uint64(42)] = True
            self.classes[int(u)] = (first, values.ravel()[order], np.tile(at, PERMUTATIONS)[order])

    def short_candidates(self, h: np.ndarray, counts: np.ndarray, threshold: float) -> set[tuple[int, int]]:
        """(text, item) pairs of short items that share enough shingle hashes."""
        if not len(self.short):
            return set()
        at = np.flatnonzero(self.short_first[h >> np.uint64(42)])
        place = np.minimum(np.searchsorted(self.short, h[at]), len(self.short) - 1)
        hit = self.short[place] == h[at]
        text = np.repeat(np.arange(len(counts)), counts)[at[hit]]
        text, place = np.divmod(np.unique(text * len(self.short) + place[hit]), len(self.short))
        begin, n = self.short_from[place], (self.short_till - self.short_from)[place]
        items = self.short_items[np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())]
        pairs, shared = np.unique(np.repeat(text, n) * len(self.ids) + items, return_counts=True)
        text, item = np.divmod(pairs, len(self.ids))
        # Shingles of an item with one hash in common count once in shared.
        need = np.ceil(threshold * self.distinct[item]) - (self.distinct - self.hashes)[item]
        enough = shared >= need
        return set(zip(text[enough].tolist(), item[enough].tolist()))

    def candidates(self, h: np.ndarray, counts: np.ndarray, threshold: float) -> set[tuple[int, int]]:
        """(text, item) pairs that share enough hashes or agree in a minimum of some window."""
        found = self.short_candidates(h, counts, threshold)
        n_blocks = -(-counts // LEAST)
        base_text = np.repeat(np.arange(len(counts)), n_blocks)
        nth = np.arange(len(base_text)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
        blocks = minima(h, np.repeat(np.cumsum(counts) - counts, n_blocks) + nth * LEAST)
        for u, (first, values, items) in self.classes.items():
            starts = np.flatnonzero(nth % (u // LEAST) == 0)
            if not len(starts):
                continue
            own = np.minimum.reduceat(blocks, starts, axis=1) if u > LEAST else blocks
            text = base_text[starts]
            pair = np.flatnonzero(text[1:] == text[:-1])
            windows = own.copy()
            windows[:, pair] = np.minimum(own[:, pair], own[:, pair + 1])
            windows += np.arange(PERMUTATIONS, dtype=np.uint64)[:, None]
            k, at = np.nonzero(first[windows >> np.uint64(42)])
            v = windows[k, at]
            a, b = np.searchsorted(values, v, side="left"), np.searchsorted(values, v, side="right")
            for i in np.flatnonzero(b > a):
                found.update(zip(repeat(int(text[at[i]])), items[a[i] : b[i]].tolist()))
        return found


def _found(index: Index, hashes: WordHashes, texts: list[list[bytes]], threshold: float) -> list[tuple[int, int, int, int]]:
    """(text, item, its shingles, those shared) of candidates that the exact check confirms."""
    rows, at, own = [], -1, set()
    for t, j in sorted(index.candidates(*shingle_hashes(hashes, texts), threshold)):
        if t != at:
            at, own = t, shingles_of(texts[t])
        item = index.shingles[j]
        shared = len(item & own)
        if shared >= threshold * len(item):
            rows.append((t, j, len(item), shared))
    return rows


def _keys(text: str) -> list:
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def _blocks(benchmark: DataFrame) -> Iterator[tuple[Index, bool]]:
    """Indexes of blocks of the benchmark's distinct texts, and whether one is the only one."""
    texts = benchmark.where("text IS NOT NULL").select(*_keys("text"), "text").distinct()
    n, size = texts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    passes = max(1, -(-n // ITEMS_AT_ONCE), -(-size // BYTES_AT_ONCE))
    for i in range(passes):
        own = texts.where(F.pmod("k1", F.lit(passes)) == i).orderBy("k1", "k2") if passes > 1 else texts.orderBy("k1", "k2")
        yield Index([((r["k1"], r["k2"]), r["text"]) for r in own.toLocalIterator()]), passes == 1


def leaks(documents: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment) of every leak."""
    documents = documents.select("doc_id", "text")
    schema = f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, k1 long, k2 long, n_shingles long, n_shared long"
    out = None
    for index, only in _blocks(benchmark):
        shared = documents.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            hashes = WordHashes()
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    few = batch.slice(at, 256)
                    rows = _found(shared.value, hashes, [words_of(t) for t in few.column(1).to_pylist()], threshold)
                    t, j, n, n_shared = (list(c) for c in zip(*rows)) if rows else ([], [], [], [])
                    keys = np.array([shared.value.ids[i] for i in j], np.int64).reshape(-1, 2)
                    yield pa.RecordBatch.from_arrays(
                        [few.column(0).take(pa.array(t, pa.int32())), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(n, pa.int64()), pa.array(n_shared, pa.int64())],
                        names=["doc_id", "k1", "k2", "n_shingles", "n_shared"],
                    )

        found = documents.mapInArrow(run, schema)
        if not only:
            found = cut(found)
            shared.destroy()
        out = found if out is None else out.unionByName(found)
    items = benchmark.where("text IS NOT NULL").select(*_keys("text"), "item_id")
    return out.join(items, ["k1", "k2"]).select("doc_id", "item_id", "n_shingles", "n_shared", (F.col("n_shared") / F.col("n_shingles")).alias("containment"))


def drop_leaky(documents: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The rows of documents, all columns, that contain no benchmark item; no shuffle of documents."""
    out, schema, place = documents, documents.schema, documents.columns.index("text")
    for index, only in _blocks(benchmark):
        shared = documents.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            hashes = WordHashes()
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    few = batch.slice(at, 256)
                    clean = np.ones(few.num_rows, bool)
                    clean[[r[0] for r in _found(shared.value, hashes, [words_of(t) for t in few.column(place).to_pylist()], threshold)]] = False
                    yield few.filter(pa.array(clean))

        out = out.mapInArrow(run, schema)
        if not only:
            out = cut(out)
            shared.destroy()
    return out


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item contained in a document."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Exact containment of all items in all documents, on the same definitions.
ORACLE = r"""
WITH w AS (SELECT 'd' AS k, doc_id AS id, row_number() OVER () AS rid, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
 UNION ALL SELECT 'b', item_id, -row_number() OVER (), regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') FROM benchmark),
p AS (SELECT k, id, rid, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0),
s AS (SELECT DISTINCT k, id, rid, array_to_string(words[i:i+4], ' ') AS s FROM p),
n AS (SELECT rid, count(*) AS n FROM s WHERE k = 'b' GROUP BY rid)
SELECT any_value(d.id) AS doc_id, any_value(b.id) AS item_id, any_value(n.n)::BIGINT AS n_shingles, count(*)::BIGINT AS n_shared, count(*) / any_value(n.n)::DOUBLE AS containment
FROM s d JOIN s b ON d.k = 'd' AND b.k = 'b' AND d.s = b.s JOIN n ON n.rid = b.rid GROUP BY d.rid, b.rid HAVING count(*) >= 0.8::DOUBLE * any_value(n.n)
"""
