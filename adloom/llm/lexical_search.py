"""Ranked lexical search: exact best documents of every item, by norm buckets of impact vectors.

A document's vector has a coordinate for each of its terms, the impact
``10^9 tf div (1000 tf + 8 m)``; an item's has the term's weight times its repeats, so a
score is their dot product.  Steps:

1. Each text is read once and becomes a short table: its number of terms, and those terms
   that the items may have (a filter of fixed size lets few others through; exact equality
   of terms decides later).
2. Vectors are ordered by length: a histogram of their norms (a row for each eighth of a
   doubling) deals them to shards of about ``SHARD`` documents of like norm.
3. An item meets a shard only if its norm times the shard's greatest norm reaches the
   item's threshold (Cauchy-Schwarz).  The threshold is the score of its last place among
   the longest vectors, which are searched first.
4. Within a shard, terms whose greatest contributions together stay under the threshold
   find no candidates; each further term first drops the candidates whose bound (greatest
   coordinates, and norms of what is left) stays under it.  What survives has its score in
   whole numbers, and each shard hands on the best ``k`` of an item.

Bounds are in doubles with some slack, scores in 64-bit integers; a bound equal to the
threshold passes, so ties are not lost.  No group grows with the corpus: a shard holds about
``SHARD`` documents, a block ``BLOCK`` items.

Defined results: a null text, or one without terms, is no document; rows that repeat an id
are documents of their own; a null id comes after all others of its score; each benchmark
row is an item of its own, one without terms or without hits has no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table, written

#: Every byte as it counts within terms: A-Z lower-cased, other ASCII but digits and a-z a space.
_SIGNS = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))
#: Bits of the filter of terms, in rows of ROW_BITS: one MiB, whatever the items.
FILTER_BITS, ROW_BITS = 1 << 23, 1 << 15
#: Terms that a task remembers as tested (memory only).
REMEMBERED = 1 << 20
#: Documents of a shard, items of a block, and the share of documents that is searched first.
SHARD, BLOCK, FIRST = 20_000, 2_000, 1 / 16
#: Norm buckets to a doubling.
STEPS = 8
#: Bounds are raised by so much, against rounding.
SLACK = 1 + 1e-9


def _places(term: bytes) -> tuple[int, int]:
    """The two bits of a term in the filter."""
    import xxhash

    h = xxhash.xxh3_64_intdigest(term)
    return h % FILTER_BITS, (h >> 32) % FILTER_BITS


def term_vectors(texts: DataFrame, keep: list[str], bits: bytes | None = None) -> DataFrame:
    """(keep, n, terms, tfs): the number of terms of each text, and its distinct terms that pass the filter, with repeats counted."""
    sc = texts.sparkSession.sparkContext
    shared = None if bits is None else sc.broadcast(bits)  # FILTER_BITS / 8 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passing: set[bytes] = set()
        tested: set[bytes] = set()
        for batch in batches:
            lengths, offsets, terms, tfs = [], [0], [], []
            for data in batch.column(batch.num_columns - 1):
                words = (data.as_py() or b"").translate(_SIGNS).split()
                counts = Counter(words)
                own = counts.keys()
                if shared is not None:
                    if len(tested) > REMEMBERED:
                        tested, passing = set(), set()
                    new = [t for t in own if t not in tested]
                    tested.update(new)
                    passing.update(t for t in new if all(shared.value[p >> 3] >> (p & 7) & 1 for p in _places(t)))
                    own = [t for t in own if t in passing]
                own = sorted(own)
                lengths.append(len(words))
                terms += own
                tfs += [counts[t] for t in own]
                offsets.append(len(terms))
            ends = pa.array(offsets, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(terms, pa.binary()).cast(pa.string())), pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lengths, pa.int64()), *lists], names=[*keep, "n", "terms", "tfs"])

    rows = texts.select(*keep, F.col("text").cast("binary").alias("_data"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kinds}, n long, terms array<string>, tfs array<long>")


def term_filter(terms: DataFrame) -> bytes:
    """A Bloom filter of (term): FILTER_BITS bits, in at most FILTER_BITS / ROW_BITS collected rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([p for t in batch.column(0).to_pylist() for p in _places(t.encode())], pa.int64())], names=["place"])

    places = terms.select("term").distinct().mapInArrow(run, "place long")
    rows = places.groupBy((F.col("place") / ROW_BITS).cast("int").alias("row")).agg(F.bitmap_construct_agg(F.col("place") % ROW_BITS).alias("bits"))
    out = bytearray(FILTER_BITS // 8)
    for r in rows.collect():
        out[r["row"] * ROW_BITS // 8 : (r["row"] + 1) * ROW_BITS // 8] = r["bits"]
    return bytes(out)


def _weighted(items: DataFrame, vectors: DataFrame, n_docs: int) -> DataFrame:
    """(item_no, terms, weights, norm): each item's terms that occur, with weight times repeats."""
    found = vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    own = items.select("item_no", F.explode(F.arrays_zip("terms", "tfs")).alias("t")).select("item_no", F.col("t.terms").alias("term"), F.col("t.tfs").alias("repeats"))
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1)))
    rows = own.join(found, "term").withColumn("weight", weight.cast("long") * F.col("repeats")).where("weight > 0")
    norm = F.sqrt(F.sum(F.col("weight").cast("double") * F.col("weight")))
    return rows.groupBy("item_no").agg(F.collect_list(F.struct("term", "weight")).alias("q"), norm.alias("q_norm")).select("item_no", F.col("q.term").alias("terms"), F.col("q.weight").alias("weights"), "q_norm")


def _shards(histogram: list, shard: int) -> list[dict]:
    """Groups of neighbouring norm buckets, the longest first, of about ``shard`` documents to each of their shards."""
    out: list[dict] = []
    first = 0
    open_group: dict | None = None
    for r in sorted(histogram, key=lambda r: -r["bucket"]):
        if open_group is None:
            open_group = {"first": first, "docs": 0, "norm": 0.0, "buckets": []}
            out.append(open_group)
        open_group["docs"] += r["docs"]
        open_group["norm"] = max(open_group["norm"], r["norm"])
        open_group["buckets"].append(r["bucket"])
        open_group["shards"] = -(-open_group["docs"] // shard)
        if open_group["docs"] >= shard:
            first += open_group["shards"]
            open_group = None
    return out


def _judge(docs: pa.Table, items: pa.Table, k: int) -> pa.Table:
    """The best k documents of a shard for each item of a block that reach its threshold."""
    best: dict[str, list] = {"item_no": [], "doc_id": [], "score": []}
    if docs.num_rows and items.num_rows:
        norms = docs.column("norm").to_numpy()
        order = np.argsort(-norms, kind="stable")  # the longest first
        norms, place = norms[order], np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        ids = docs.column("doc_id").combine_chunks().take(pa.array(order))
        id_keys = np.where(np.asarray(pc.is_null(ids)), np.iinfo(np.int64).max, pc.fill_null(ids, 0).to_numpy(zero_copy_only=False))
        flat = lambda t, c: t.column(c).combine_chunks().flatten()
        ends = lambda t, c: np.concatenate([[0], np.cumsum(pc.list_value_length(t.column(c)).to_numpy())])
        vocabulary = pc.unique(flat(items, "terms"))
        item_terms, item_ends = pc.index_in(flat(items, "terms"), vocabulary).to_numpy(), ends(items, "terms")
        weights = flat(items, "weights").to_numpy()
        codes = pc.fill_null(pc.index_in(flat(docs, "terms"), vocabulary), -1).to_numpy()
        rows = np.repeat(place, np.diff(ends(docs, "terms")))
        wanted = codes >= 0
        codes, rows, impacts = codes[wanted], rows[wanted], flat(docs, "impacts").to_numpy()[wanted]
        sort = np.lexsort((rows, codes))
        rows, impacts = rows[sort], impacts[sort]
        starts = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(vocabulary)))])
        greatest = np.array([impacts[a:b].max() if b > a else 0 for a, b in zip(starts[:-1], starts[1:])], np.int64)
        score, squares = np.zeros(len(norms), np.int64), np.zeros(len(norms))
        for i, (item, theta, q_norm) in enumerate(zip(items.column("item_no").to_pylist(), items.column("theta").to_pylist(), items.column("q_norm").to_pylist())):
            longest = int(np.searchsorted(-norms, -theta / q_norm / SLACK, side="right"))  # shorter ones can't reach it
            own, w = item_terms[item_ends[i] : item_ends[i + 1]], weights[item_ends[i] : item_ends[i + 1]]
            reach = greatest[own] * w
            by = np.argsort(-reach, kind="stable")
            own, w, reach = own[by], w[by], reach[by]
            rest = np.concatenate([np.cumsum(reach[::-1])[::-1], [0]])  # what terms from here on can add
            rest_norm = np.sqrt(np.concatenate([np.cumsum((w.astype(float) ** 2)[::-1])[::-1], [0]]))
            needed = int(np.argmax(rest < theta))  # terms that find candidates; the others alone stay under it
            for c, weight in zip(own[:needed], w[:needed]):
                a, b = starts[c], starts[c] + np.searchsorted(rows[starts[c] : starts[c + 1]], longest)
                score[rows[a:b]] += weight * impacts[a:b]
                squares[rows[a:b]] += impacts[a:b].astype(float) ** 2
            alive = np.flatnonzero(score[:longest])
            sums, sq = score[alive], squares[alive]
            score[:longest] = 0
            squares[:longest] = 0
            for at in range(needed, len(own) + 1):
                bound = np.minimum(sums + rest[at], (sums + rest_norm[at] * np.sqrt(np.maximum(norms[alive] ** 2 * SLACK - sq, 0))) * SLACK)
                stays = bound >= theta
                alive, sums, sq = alive[stays], sums[stays], sq[stays]
                if at == len(own) or not len(alive):
                    break
                a, b = starts[own[at]], starts[own[at] + 1]
                hit = np.minimum(a + np.searchsorted(rows[a:b], alive), max(b - 1, 0))
                add = np.where((hit < b) & (rows[hit] == alive), impacts[hit], 0) if b > a else np.zeros(len(alive), np.int64)
                sums = sums + w[at] * add
                sq = sq + add.astype(float) ** 2
            if len(sums) > k:
                high = sums >= np.partition(sums, -k)[-k]
                alive, sums = alive[high], sums[high]
            top = np.lexsort((id_keys[alive], -sums))[:k]
            best["item_no"] += [item] * len(top)
            best["doc_id"] += ids.take(pa.array(alive[top])).to_pylist()
            best["score"] += sums[top].tolist()
    return pa.table({"item_no": pa.array(best["item_no"], pa.int64()), "doc_id": pa.array(best["doc_id"], pa.int64()), "score": pa.array(best["score"], pa.int64())})


def _best(found: DataFrame, k: int) -> DataFrame:
    """Places 1 to k of each item; Spark cuts them to k in each task before it deals them by item."""
    order = Window.partitionBy("item_no").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(documents: DataFrame, benchmark: DataFrame, k: int = 10, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(item_id, rank, doc_id, score) of the k best documents of each item with a score above 0."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    items = written(term_vectors(benchmark.select("item_id", "text"), ["item_id"]).where("n > 0").withColumn("item_no", F.monotonically_increasing_id()))
    bits = term_filter(items.select(F.explode("terms").alias("term")))
    vectors = written(term_vectors(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"], bits).where("n > 0"))
    n_docs, length = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    nothing = items.limit(0).select("item_id", F.lit(0).alias("rank"), F.lit(0).cast(kind).alias("doc_id"), F.lit(0).cast("long").alias("score"))
    if not n_docs:
        return nothing
    blocks = -(-items.count() // block)
    queries = cut(_weighted(items, vectors, n_docs).withColumn("block", F.pmod(F.xxhash64("item_no"), F.lit(max(1, blocks)))))
    m = f"(100 - 75 + (75 * n * {n_docs}L) div {length}L)"
    hits = vectors.where("size(terms) > 0").withColumn("impacts", F.expr(f"transform(tfs, tf -> (1000000000L * tf) div (1000L * tf + 8L * {m}))"))
    hits = hits.withColumn("norm", F.expr("sqrt(aggregate(impacts, 0D, (s, v) -> s + CAST(v AS DOUBLE) * v))")).where("norm > 0")
    hits = hits.withColumn("bucket", F.floor(F.log2("norm") * STEPS).cast("int"))
    groups = _shards(hits.groupBy("bucket").agg(F.count("*").alias("docs"), F.max("norm").alias("norm")).collect(), shard)  # a row a bucket: some hundred
    if not groups:
        return nothing
    where = F.create_map(*[F.lit(x) for g in groups for b in g["buckets"] for x in (b, g["first"])])
    many = F.create_map(*[F.lit(x) for g in groups for b in g["buckets"] for x in (b, g["shards"])])
    dealt = hits.withColumn("shard", where[F.col("bucket")] + F.pmod(F.xxhash64(F.monotonically_increasing_id()), many[F.col("bucket")]).cast("int"))
    dealt = dealt.select("shard", "doc_id", "terms", "impacts", "norm")

    def rounds(part: list[dict], asked: DataFrame) -> DataFrame:
        """The best of these groups, for items with a threshold."""
        low, high = part[0]["first"], part[-1]["first"] + part[-1]["shards"]
        spans = F.array(*[F.struct(F.lit(g["first"]).alias("first"), F.lit(g["shards"]).alias("shards"), F.lit(g["norm"] * SLACK).alias("norm")) for g in part])
        reached = F.filter(spans, lambda g: g["norm"] * F.col("q_norm") >= F.col("theta"))
        asked = asked.withColumn("g", F.explode(reached)).withColumn("shard", F.explode(F.expr("sequence(g.first, g.first + g.shards - 1)"))).drop("g")
        left = dealt.where(F.col("shard").between(low, high - 1)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(max(0, blocks - 1)))))
        pairs = left.groupBy("shard", "block").cogroup(asked.withColumn("block", F.col("block").cast("int")).groupBy("shard", "block"))
        return pairs.applyInArrow(lambda a, b: _judge(a, b, k), "item_no long, doc_id long, score long")

    seen = 0
    for ahead, g in enumerate(groups, 1):
        seen += g["docs"]
        if seen >= FIRST * sum(x["docs"] for x in groups):
            break
    first = cut(_best(rounds(groups[:ahead], queries.withColumn("theta", F.lit(1.0))), k))
    found = first.drop("rank")
    if ahead < len(groups):
        last = first.where(F.col("rank") == k).select("item_no", F.col("score").cast("double").alias("theta"))
        later = rounds(groups[ahead:], queries.join(last, "item_no", "left").withColumn("theta", F.coalesce("theta", F.lit(1.0))))
        found = found.unionByName(later)
    return _best(found, k).join(items.select("item_no", "item_id"), "item_no").select("item_id", "rank", F.col("doc_id").cast(kind).alias("doc_id"), "score")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best ``documents`` of every ``benchmark`` item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""WITH d AS MATERIALIZED (SELECT doc_id, len({_TERMS}) AS n, {_TERMS} AS l FROM documents),
 s AS (SELECT count(*) AS c, sum(n)::BIGINT AS total FROM d WHERE n > 0),
 q AS MATERIALIZED (SELECT item_id, term, count(*) AS repeats FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
 t AS MATERIALIZED (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(l) AS term FROM d) SEMI JOIN q USING (term) GROUP BY ALL),
 w AS (SELECT term, floor(1000 * ln((2 * c + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM t CROSS JOIN s GROUP BY term, c),
 i AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * c) // total))) AS v FROM t JOIN w USING (term) CROSS JOIN s),
 r AS (SELECT item_id, doc_id, sum(v * repeats)::BIGINT AS score FROM q JOIN i USING (term) GROUP BY ALL)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) WHERE rank <= 10"""
