"""Edge cases and brute force for the training-data operators."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from adloom.llm import chat_format, common, components, decontaminate, learning, packing, quality_model, quality_rules, simhash, suffix_dedup, token_counts, toxicity, url_filter
from adloom.llm import queries as registered

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score int, fp int, sequence_id int"


def docs(spark, texts):
    rows = [(None if i == 3 else i, t, None, None, None, 1, 2, 3) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def odd_texts():
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa"]
    prose = " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(400))
    return [None, "", " \n\t", "x", prose, prose, "Pre " + prose, prose[:1500] + " changed " + prose[1500:], "a" * 700, "ab" * 500, "é" * 300 + "日本" * 120, "é" * 300 + "日本" * 120, "\0" * 450, prose[:210], "<|endoftext|> x", prose * 30]


def test_oracles(spark):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for name, sql in registered.oracle_sql().items():
        a, b = registered.queries()[name](spark, SF).toArrow(), con.execute(sql).to_arrow_table()
        assert sorted(a.column_names) == sorted(b.column_names)
        listed = [sorted(map(str, zip(*[x.column(c).to_pylist() for c in sorted(x.column_names)]))) for x in (a, b)]
        assert listed[0] == listed[1], name


def test_url_filter(spark):
    urls = [None, "no scheme", "http://A.Example.com/en/7x?q#f", "https://com/en/", "https://xcom/en/", "http://b.net/de/8", "http://b.example.net/de/81", "http://org", "http://o.org/es/#", "http://o.org/es/#", "x://", "http://org?/es/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({"host": F.lit(1), "rule": F.lit(2)})
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, action string")
    got = {r["page_id"]: r for r in url_filter.filter_urls(pages, rules).collect()}
    assert len(got) == len(urls)
    assert [got[i]["verdict"] for i in range(12)] == ["allow", "allow", "allow", "block", "allow", "allow", "block", "allow", "block", "block", "allow", "allow"]
    assert got[2]["rule"] == "example.com/en/7" and got[2]["host"] == "a.example.com" and got[2]["path"] == "/en/7x"
    assert (got[0]["host"], got[0]["path"]) == ("", "")
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_filter.filter_urls(pages, rules.limit(0)).collect()} == {"allow"}
    long = spark.createDataFrame([(1, "http://a.com/" + "x" * 200_000 + "/y"), (2, "http://" + "b." * 300 + "com/en/"), (3, "http://ex.org/es")], "page_id long, url string")
    same = spark.createDataFrame([("com", "/en/", "allow"), ("com", "/en/", "block"), ("b.com", "/x", "allow"), ("ex.org", "/", "allow"), ("org", "/es", "block")], "host string, path string, action string")
    assert {(r["page_id"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(long, same).collect()} == {(1, None, "allow"), (2, "com/en/", "block"), (3, "ex.org/", "allow")}  # equal lengths: the longer host


@pytest.mark.parametrize("at_once", [url_filter.RULES_AT_ONCE, 120_000])
def test_url_filter_of_many_rules(spark, monkeypatch, at_once):
    monkeypatch.setattr(url_filter, "RULES_AT_ONCE", at_once)
    many = spark.range(300_000).select(F.concat(F.lit("h"), F.col("id").cast("string"), F.lit(".com")).alias("host"), F.lit("/").alias("path"), F.lit("block").alias("action"))
    hit = spark.range(299_000, 305_000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://w.h"), F.col("id").cast("string"), F.lit(".com/")).alias("url"))
    got = url_filter.filter_urls(hit, many).groupBy("verdict").agg(F.count("*").alias("n"), F.max("page_id").alias("last")).collect()
    assert {tuple(r) for r in got} == {("block", 1000, 299_999), ("allow", 5000, 304_999)}


def test_url_filter_lets_few_false_positives_pass(spark):
    rules = spark.range(50_000).select(F.concat(F.lit("r"), "id").alias("rule"))
    words = url_filter.build_filter(rules, 50_000)
    others = spark.range(20_000).select(F.concat(F.lit("o"), "id").alias("rule"))
    for df, low, high in ((rules, 1.0, 1.0), (others, 0.0, 0.03)):
        rows = df.select(url_filter._word(F.col("rule"), len(words)).alias("at"), url_filter._mask(F.col("rule")).alias("m")).collect()
        share = sum(words[r["at"]] & r["m"] == r["m"] for r in rows) / len(rows)
        assert low <= share <= high


def test_chat_round_trip(spark):
    rng = random.Random(1)
    pieces = ["<|im_start|>", "<|im_end|>", "\n", "<", "\\", "|", "<\\|", "<n", "user", "ok", "", "$1"]
    rows = [(c, t, rng.choice(["user", "assistant", "sys\ntem", None, "<|x", "<n\\n<\\n"]), None if rng.random() < 0.1 else "".join(rng.choices(pieces, k=rng.randrange(6)))) for c in range(150) for t in range(rng.randrange(1, 5))]
    df = spark.createDataFrame([*rows, (None, None, None, None), *rows[:3]], "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    out = chat_format.format_conversations(df)
    assert out.where("NOT (recovered = turns)").count() == 0
    assert out.count() == 151 and out.where("escaped").count() > 20 and out.where("NOT escaped").count() > 20
    for r in out.collect():
        under = [r["formatted"][m["start"] : m["start"] + m["length"]] for m in r["loss_spans"]]
        if r["escaped"]:
            under = [re.sub(r"<(\\*)\\\|", r"<\1|", u) for u in under]
        assert under == [t["text"] for t in r["turns"] if t["role"] == "assistant"]
    assert chat_format.format_conversations(df.limit(0)).count() == 0


def test_quality_ledger(spark):
    texts = [*odd_texts()[:8], "one two three four five six seven eight " * 3, "a\na\n\na b\n a\n"]
    book = quality_rules.ledger(docs(spark, texts))
    assert book.count() == len(texts)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(None if i == 3 else i, t) for i, t in enumerate(texts)])
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "failure_bits"]
    assert sorted(map(str, book.select(*names).toArrow().to_pylist())) == sorted(map(str, con.execute(f"SELECT {', '.join(names)} FROM ({quality_rules.ORACLE})").to_arrow_table().to_pylist()))
    kept = quality_rules.apply_policy(book, "base").where("NOT kept").count()
    cut = {r["rule"]: r for r in quality_rules.ablation(book, "base").collect()}
    assert set(cut) == {"few_words", "repeated_words"} and max(r["n_failed"] for r in cut.values()) <= kept


def test_token_prefixes(spark):
    import public_tokenizers
    import sentencepiece

    model = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    texts = [*odd_texts(), "a  b", " lead", "▁x ▁", "<s>hi</s>\n\n", "🙂 x", "日本語の文章" * 60, "\ue000a" * 9]
    texts = [t if t is None else t[:1200] for t in texts]
    df = docs(spark, texts)
    stored = token_counts.prefix_counts(df, model).withColumns({"cut": token_counts.cut_for_budget(10), "seven": token_counts.tokens_of_prefix(F.lit(7))})
    by_text = {r["doc_id"]: r for r in stored.collect()}
    brief = {r["doc_id"]: r for r in token_counts.token_counts(df, model, 10).collect()}
    assert len(by_text) == len(brief) == len(texts)
    for i, t in enumerate(texts):
        r, b = by_text[None if i == 3 else i], brief[None if i == 3 else i]
        expected = [len(x) for x in sp.encode([(t or "")[:k] for k in range(len(t or "") + 1)])]
        assert list(r["prefix_tokens"]) == expected and r["n_tokens"] == b["n_tokens"] == expected[-1]
        assert r["n_bytes"] == b["n_bytes"] == len((t or "").encode())
        assert r["cut"] == b["chars_in_limit"] == max(k for k, n in enumerate(expected) if n <= 10)
        assert r["seven"] == (expected[7] if len(expected) > 7 else None)
    assert token_counts.prefix_counts(df.limit(0), model).count() == token_counts.token_counts(df.limit(0), model, 10).count() == 0


def test_packing(spark):
    from tokenizers import Tokenizer
    import public_tokenizers

    texts = odd_texts()
    out = packing.pack(docs(spark, texts), capacity=256, with_ids=True).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole, used = {}, {}
    for r in sorted(out, key=lambda r: (str(r["doc_id"]), r["piece"])):
        got = whole.setdefault(r["doc_id"], [])
        assert r["start"] == len(got) and r["length"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        assert r["piece"] == 0 or r["length"] == 256
        got += r["ids"]
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, t in enumerate(texts):
        assert whole[None if i == 3 else i] == [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
    for places in used.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 256
    assert packing.pack(docs(spark, texts).limit(0)).count() == 0


def test_packing_of_long_white_space(spark):
    from tokenizers import Tokenizer
    import public_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a" + " " * 1_200_000 + "b <|endoftext|> c", "\n" * 1_500_000, "short"]
    got = {r["doc_id"]: r for r in packing.pack(docs(spark, texts)).groupBy("doc_id").agg(F.sum("length").alias("n"), F.sort_array(F.collect_list(F.struct("piece", "ids_crc32"))).alias("pieces")).collect()}
    for i, t in enumerate(texts):
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4")
        starts = [0, *range((len(ids) - 1) % 2048 + 1, len(ids), 2048)]
        assert got[i]["n"] == len(ids)
        assert [c for _, c in got[i]["pieces"]] == [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, [*starts[1:], len(ids)])]


@pytest.mark.parametrize("seed", range(5))
def test_packing_plan(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 2049, 4000) if seed == 4 else np.clip(rng.lognormal(5 + seed * 0.5, 1, 4000).astype(int), 1, 2048)
    counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True))))
    plan = packing.plan_packing(counts, 2048)
    used: dict[int, int] = {}
    for times, own in plan:
        assert sum(own) <= 2048 and times > 0
        for x in own:
            used[x] = used.get(x, 0) + times
    assert used == counts
    assert sum(t for t, _ in plan) <= len(best_fit_decreasing(lengths.tolist(), 2048))


def best_fit_decreasing(lengths, capacity):
    """Gaps of the sequences that plain best-fit decreasing opens, one piece at a time."""
    import bisect

    gaps: list[int] = []
    for x in sorted(lengths, reverse=True):
        i = bisect.bisect_left(gaps, x)
        gap = gaps.pop(i) if i < len(gaps) else capacity
        bisect.insort(gaps, gap - x)
    return gaps


@pytest.mark.parametrize("lengths", [[], [2048] * 3, [1], [1025] * 5, [1024] * 5, [700, 700, 648, 1400, 300, 348]])
def test_packing_plan_of_few_lengths(lengths):
    counts = dict(zip(*(x.tolist() for x in np.unique(np.array(lengths, int), return_counts=True))))
    plan = packing.plan_packing(counts, 2048)
    assert sum(t for t, _ in plan) == len(best_fit_decreasing(lengths, 2048))


@pytest.mark.parametrize("seed", range(3))
def test_sum_index_agrees_with_all_combinations(seed):
    from itertools import combinations

    rng = np.random.default_rng(seed)
    pieces = rng.integers(1, 40, 14).tolist()
    counts = {x: pieces.count(x) for x in pieces}
    index = packing.SumIndex(counts, 64)
    for x in pieces[:4]:
        index.take(x)
        counts[x] -= 1
    pieces = [x for x, n in counts.items() for _ in range(n)]
    sums = [{sum(c) for c in combinations(pieces, k)} for k in (1, 2, 3)]
    for gap in range(1, 65):
        found = index.combination(gap, 3)
        assert (found is None) == all(gap not in s for s in sums)
        if found:
            assert sum(found) == gap and len(found) == next(k for k, s in enumerate(sums, 1) if gap in s)
            assert all(found.count(x) <= counts[x] for x in found)
        assert index.pairs[gap] == len({tuple(sorted(c)) for c in combinations(pieces, 2) if sum(c) == gap})


def test_tables_are_packed_as_well_as_by_best_fit_decreasing(spark):
    out = packing.pack(common.table(spark, SF, "documents")).select("length", "sequence_id").toPandas()
    assert out["sequence_id"].nunique() <= len(best_fit_decreasing(out["length"].tolist(), 2048))


def brute_contained(texts, items):
    out = set()
    for i, t in enumerate(texts):
        own = decontaminate.shingles_of(decontaminate.words_of(t))
        for j, x in enumerate(items):
            s = decontaminate.shingles_of(decontaminate.words_of(x))
            if s and len(s & own) >= 0.8 * len(s):
                out.add((None if i == 3 else i, j))
    return out


@pytest.mark.parametrize(("items_at_once", "bytes_at_once"), [(20_000, 32 << 20), (25, 32 << 20), (20_000, 5_000)])
def test_decontamination(spark, monkeypatch, items_at_once, bytes_at_once):
    monkeypatch.setattr(decontaminate, "ITEMS_AT_ONCE", items_at_once)
    monkeypatch.setattr(decontaminate, "BYTES_AT_ONCE", bytes_at_once)
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    items = [" ".join(word() for _ in range(rng.randrange(3, 120))) for _ in range(60)] + [None, "", "one two"]
    items[7] = items[6]
    texts = [" ".join(word() for _ in range(rng.randrange(1500))) for _ in range(80)]
    for i in range(0, 80, 2):
        at = rng.randrange(len(texts[i]) + 1)
        texts[i] = texts[i][:at] + " " + items[i % 60].upper() + " " + texts[i][at:]
    texts += [None, "", "one two", items[5], *odd_texts()[:6]]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string").withColumns({"doc_id": F.lit(0), "k1": F.lit(0)})
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs(spark, texts), bench).collect()}
    assert got == brute_contained(texts, items) and len(got) > 40
    clean = decontaminate.drop_leaky(docs(spark, texts), bench)
    assert clean.columns == docs(spark, texts).columns
    assert clean.count() == len(texts) - len({d for d, _ in got})
    assert decontaminate.leaks(docs(spark, texts).limit(0), bench).count() == 0
    assert decontaminate.leaks(docs(spark, texts), bench.limit(0)).count() == 0


def test_short_items_are_found_in_long_texts(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    items = [" ".join(word() for _ in range(n)) for n in range(1, 13) for _ in range(150)]
    items += ["a b c d e " * 3, items[700], "x y z a b c d e f"]
    texts = [" ".join(word() for _ in range(400)) for _ in range(20)]
    for k, item in enumerate(items):
        texts[k % 20] += " " + item + " " + " ".join(word() for _ in range(40))
    texts += items[:300:50]  # of one and two words
    texts.append(" . ".join(["x y z a b", word(), "y z a b c d e f"] + [word() for _ in range(200)]))  # 4 of 5 shingles, and one apart
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs(spark, texts), bench).collect()}
    assert got == brute_contained(texts, items)
    assert {j for _, j in got} >= set(range(600, len(items)))  # all of five words and more


def brute_repeats(texts):
    seen: dict[bytes, int] = {}
    for t in texts:
        b = (t or "").encode()
        for i in range(len(b) - 199):
            seen[b[i : i + 200]] = seen.get(b[i : i + 200], 0) + 1
    for t in texts:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        spans = int((np.diff(np.r_[0, gone.astype(np.int8)]) == 1).sum())
        yield len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 1])
def test_suffix_dedup(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 1000)
    rng = random.Random(9)
    base = "".join(rng.choices("abcd \n", k=3000))
    texts = odd_texts()
    texts += [base[a : a + n] + "".join(rng.choices("xyz", k=40)) + base[b : b + n] for a, b, n in [(rng.randrange(2500), rng.randrange(2500), rng.randrange(150, 420)) for _ in range(25)]]
    texts += [base[100:299] + "!", "?" + base[100:300], texts[-1]]
    df = docs(spark, texts).drop("score").withColumn("k1", F.lit(1)).withColumn("row", F.monotonically_increasing_id())
    got = [tuple(r)[1:] for r in suffix_dedup.remove_repeats(df.coalesce(1), ["row"]).orderBy("row").collect()]
    assert got == list(brute_repeats(texts))
    kept = [r["text"] for r in suffix_dedup.keep_text(df.coalesce(1), ["row"]).orderBy("row").collect()]
    assert kept[0] == "" and all(len(k) <= len(t or "") for k, t in zip(kept, texts))
    assert suffix_dedup.remove_repeats(df.limit(0), ["row"]).count() == 0


def brute_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(spark):
    for t in odd_texts():
        assert simhash.fingerprint(t) == brute_fingerprint(t)
    out = simhash.near_duplicates(docs(spark, odd_texts())).collect()
    by_id = {r["doc_id"]: r["component_id"] for r in out}
    assert len(out) == 16 and by_id[0] == by_id[1] == by_id[2] == 0 and by_id[5] == by_id[4] == 4
    assert simhash.near_duplicates(docs(spark, []).limit(0)).count() == 0


@pytest.mark.parametrize(("shard", "copies", "few", "sent"), [(8_192, 32, 100_000, 64 << 20), (40, 32, 100_000, 64 << 20), (40, 1, 100_000, 64 << 20), (40, 32, 0, 500), (40, 1, 0, 500)])
def test_near_links_are_exact(spark, monkeypatch, shard, copies, few, sent):
    monkeypatch.setattr(simhash, "SHARD", shard)
    monkeypatch.setattr(simhash, "FEW", few)  # 0: shards are joined by salt
    monkeypatch.setattr(simhash, "SENT", sent)  # small: trees are sent in passes
    monkeypatch.setattr(simhash, "COPIES", copies)  # 1: no tree will do, so neighbourhoods link all
    monkeypatch.setattr(simhash, "JUDGED", 8)
    monkeypatch.setattr(simhash, "SAMPLE", 200)
    monkeypatch.setattr(simhash, "LEAF", 8)
    rng = random.Random(4)
    fps = [rng.getrandbits(64) for _ in range(300)]
    for f in fps[:150]:
        for _ in range(rng.randrange(4)):
            for _ in range(rng.randrange(1, 4)):
                f ^= 1 << rng.randrange(64)
            fps.append(f)
    for _ in range(120):  # a dense group that no vantage point parts
        f = fps[0]
        for _ in range(4):
            f ^= 1 << rng.randrange(64)
        fps.append(f)
    signed = sorted({f - (1 << 64) if f >> 63 else f for f in fps})
    roots = components.components(simhash.near_links(spark.createDataFrame([(f,) for f in signed], "fp long")))
    got = {r["node"]: r["root"] for r in roots.collect()}
    assert {f: got.get(f, f) for f in signed} == least_reachable(signed, signed)


def least_reachable(nodes, fps):
    """For each node the least node that links of two bits or fewer reach, by brute force."""
    parent = {f: f for f in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    bits = np.array(fps, np.int64).view(np.uint64)
    for i, a in enumerate(nodes):
        for j in np.flatnonzero(np.bitwise_count(bits[i + 1 :] ^ bits[i]) <= 2) + i + 1:
            x, y = find(a), find(nodes[j])
            parent[max(x, y)] = min(x, y)
    return {f: find(f) for f in nodes}


def test_trees_part_fingerprints_and_keep_close_pairs_together():
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 2**63, 30_000, dtype=np.uint64)
    fps = np.unique(np.r_[fps, fps[:3000] ^ np.uint64(5), fps[:10] ^ np.uint64(1 << 40)])
    tree = simhash.grow(fps[::4], len(fps), 2)
    leaves = list(simhash.route(tree, fps, 2))
    assert max(len(at) for _, at in leaves) < 1.3 * simhash.SHARD and sum(len(at) for _, at in leaves) < 3 * len(fps)
    place = {int(f): i for i, f in enumerate(fps)}
    inside = [set(at.tolist()) for _, at in leaves]
    for i in range(0, len(fps), 7):
        j = place.get(int(fps[i]) ^ 5)
        assert j is None or any(i in x and j in x for x in inside)
    assert simhash.grow(np.full(20_000, 7, np.uint64) ^ (np.uint64(1) << rng.integers(0, 64, 20_000).astype(np.uint64)), 20_000, 2) is None


def test_component_ids_over_documents(spark):
    df = common.table(spark, SF, "documents")
    out = simhash.near_duplicates(df.withColumn("fp", F.lit(1)).withColumn("component_id", F.lit(2))).toPandas()
    text = {r["doc_id"]: r["text"] for r in df.collect()}
    ids = sorted(text)
    expected = least_reachable(ids, [np.array(brute_fingerprint(text[i]), np.uint64).view(np.int64) for i in ids])
    assert dict(zip(out["doc_id"], out["component_id"])) == expected


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[1000 + i] == 1000 for i in range(300)) and got[5000] == 5000


def auc(scores, y):
    order = np.argsort(np.argsort(scores))
    p = y == 1
    return (order[p].sum() - p.sum() * (p.sum() - 1) / 2) / (p.sum() * (~p).sum())


@pytest.mark.parametrize(("name", "label", "least"), [("op9_quality_classifier", "quality", 0.97), ("op10_toxicity", "toxic", 0.92)])
def test_held_out_accuracy(spark, name, label, least):
    sf = "/root/testdata/sf0.01"
    out = registered.queries()[name](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert auc(out["score"].to_numpy() + np.random.default_rng(0).random(len(out)) * 1e-9, out[label].to_numpy()) > least
    assert out["score"].between(0, 1).all()


def test_classifiers_on_odd_rows(spark):
    df = docs(spark, odd_texts())
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(16)] + [(None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.limit(0), labels.where("quality = 1")):
        quality = quality_model.score(df, quality_model.fit(df, some)).collect()
        toxic = toxicity.score(df, toxicity.fit(df, some), ["doc_id"]).collect()
        assert len(quality) == len(toxic) == 16
        assert all(0 <= r["score"] <= 1 for r in [*quality, *toxic])
    assert quality_model.score(df.limit(0), quality_model.fit(df.limit(0), labels)).count() == 0
    assert toxicity.score(df.limit(0), toxicity.fit(df.limit(0), labels), ["doc_id"]).count() == 0


def test_normal_equations_and_calibration_on_rows_left_out(spark):
    sf = "/root/testdata/sf0.01"
    df, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    model = quality_model.fit(df, labels)
    sample = {r["doc_id"]: r["y"] for r in learning.labelled_sample(labels, "quality", quality_model.FOLDS, quality_model.HELD_OUT, quality_model.MAX_LABELLED).collect()}
    rows = df.where(F.col("doc_id").isin(*sample)).select("doc_id", "text", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(quality_model.PARTS)).alias("part")).collect()
    assert not any(zlib.crc32(str(r["doc_id"]).encode()) % quality_model.FOLDS == quality_model.HELD_OUT for r in rows)
    stats = np.array([quality_model.statistics(r["text"]) for r in rows])
    y, part = np.array([sample[r["doc_id"]] for r in rows]), np.array([r["part"] for r in rows])
    assert np.allclose(model.mean, stats.mean(axis=0)) and np.allclose(model.scale, np.where(stats.std(axis=0) > 0, stats.std(axis=0), 1))
    x = model.features(stats)

    def solved(own):
        hold = quality_model.RIDGE * len(y) * np.eye(x.shape[1])
        hold[-1, -1] = 1e-9 * len(y)
        return np.linalg.lstsq(x[own].T @ x[own] + hold, x[own].T @ y[own], rcond=None)[0]

    assert np.allclose(model.raw(stats), x @ solved(part >= 0), atol=1e-6)
    raw = np.array([x[i] @ w for i, w in zip(range(len(y)), np.array([solved(part != p) for p in range(quality_model.PARTS)])[part])])
    bins = np.clip(np.floor(raw * 500), -500, 1000)
    at = np.unique(bins)
    knots, heights = learning.isotonic((at + 0.5) / 500, np.array([float((bins == b).sum()) for b in at]), np.array([y[bins == b].sum() for b in at]))
    grid = np.linspace(-0.5, 1.5, 41)
    assert np.allclose(np.interp(grid, *model.knots), np.interp(grid, knots, np.clip(heights, 1 / (len(y) + 2), 1 - 1 / (len(y) + 2))), atol=0.02)


def runs(*words):
    """Letter codes of words as the operator reads them."""
    return [bytes(toxicity.Letters.of_texts([w]).flat.astype(np.uint8)[toxicity.STRETCH : -toxicity.STRETCH]) for w in words]


def test_gaps_and_insertions_stay_close():
    counted = lambda words, n: list(zip(runs(*words), n))
    weights = toxicity.unpacked(toxicity._fit_runs(counted(("idiot", "worthless"), (30, 20)), counted(("the", "ideal", "worth", "order", "iota", "less", "riot", "those", "these"), [10] * 9)))
    words = ["idiot", "id.iot", "idxiot", "i-d-i-o-t", "i d i o t", "worthlless", "order", "the", "riot"]
    s = dict(zip(words, toxicity.Letters.of_texts(words).scores(weights)[:, 0]))
    assert min(s["id.iot"], s["i-d-i-o-t"], s["i d i o t"]) == pytest.approx(s["idiot"])
    assert s["idxiot"] > max(s["order"], s["the"], s["riot"]) and s["worthlless"] > s["order"]


def plain_features(letters):
    """Gap-weighted subsequences of four letters within six, from starts in the first eight letters, by plain enumeration."""
    from itertools import combinations

    out = {}
    for places in combinations(range(len(letters)), toxicity.ORDER):
        if places[-1] - places[0] < toxicity.SPAN and places[0] < toxicity.STRETCH:
            key = tuple(letters[i] for i in places)
            out[key] = out.get(key, 0) + toxicity.DECAY ** (places[-1] - places[0] + 1)
    return out


def test_kernel_against_plain_enumeration():
    rng = random.Random(4)
    own = [bytes([31] + [rng.randrange(1, 6) for _ in range(rng.randrange(1, 8))]) for _ in range(40)]
    codes, phi = toxicity.landmark_features(own[:9])
    got = toxicity.kernel(own, codes, phi)
    feats = [plain_features(r) for r in own]
    for i, f in enumerate(feats):
        norm = toxicity._NORM[min(len(own[i]), len(toxicity._NORM) - 1)]
        for j, g in enumerate(feats[:9]):
            size = sum(v * v for v in g.values()) ** 0.5 + 1e-12
            assert got[i, j] == pytest.approx(sum(v * g.get(k, 0) for k, v in f.items()) / size / norm, abs=1e-5)


def plain_sentences(text):
    """Words of each sentence of plain lower-case text, letters only."""
    for part in re.split(r"(?<=[.!?])\s+|\n\s*\n", text):
        words = [re.sub("[^a-z]", "", w) for w in part.split()]
        if any(words):
            yield [w for w in words if w]


def test_sentence_scores_against_plain_enumeration():
    rng = random.Random(11)
    weights = np.zeros(toxicity._CODES, np.float32)
    some = rng.sample(range(toxicity._CODES), 1_500_000)
    weights[some] = np.random.default_rng(2).normal(size=len(some))
    weights[~toxicity._VALID] = 0
    texts = ["One tw, three. Four5 fi-ve!\nsix\n\nseven eightninetenelevens x? Z", "", "...", "ab cd ef gh. ij", "\n\n a"] + [" ".join("".join(rng.choices("abcdefgh.", k=rng.randrange(2, 12))) for _ in range(25)) for _ in range(6)]
    for text in texts:
        letters = toxicity.Letters.of_texts([text])
        got = letters.scores(weights)
        sentences = list(plain_sentences(text.lower()))
        assert len(got) == len(sentences)
        for s, words in enumerate(sentences):
            for r in range(toxicity.RUN):
                best = -np.inf
                for w in range(len(words) - r):
                    own = [c for x in words[w : w + r + 1] for c in [31, *(ord(y) - 96 for y in x)]]
                    norm = toxicity._NORM[min(len(own), len(toxicity._NORM) - 1)]
                    for p in range(len(words[w]) + 1):
                        if p == 0 or p + toxicity.STRETCH <= len(own):
                            found = plain_features(own[p:])
                            best = max(best, sum(v * float(weights[((a * 40 + b) * 40 + c) * 40 + d]) for (a, b, c, d), v in found.items()) / norm)
                assert got[s, r] == pytest.approx(best, abs=1e-4)


def test_long_texts_are_cut_between_sentences(monkeypatch):
    weights = np.random.default_rng(3).normal(size=toxicity._CODES).astype(np.float32)
    weights[~toxicity._VALID] = 0
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.choice([1, 1, 2, 6, 9, 20])))
    joins = [" ", " ", " ", ". ", ".", "!\n", "\n", "\n\n", "... ", "? ", ".\0", "。", "。 ", " . ", ", "]
    texts = ["".join(word() + rng.choice(joins) for _ in range(400)) for _ in range(12)]
    texts += [" ".join(word() for _ in range(300)), None, "a. b", "x" * 3000, ". " * 900, ""]  # one sentence of some thousand letters, and others
    whole = toxicity.evidence_of(texts, weights)
    for size in (1, 37, 500):
        monkeypatch.setattr(toxicity, "PIECE", size)
        assert sum(len(own) for own, _ in toxicity._pieces(texts)) > len(texts)
        assert np.allclose(toxicity.evidence_of(texts, weights), whole, atol=1e-6)  # all twelve numbers
    assert whole[13].tolist() == [toxicity.NO_EVIDENCE, toxicity.NO_EVIDENCE, 0, 0] * toxicity.RUN


def test_no_script_has_the_codes_of_latin_letters():
    import unicodedata

    mark = 31
    for c in range(0x370, 0x32000):
        if unicodedata.category(chr(c))[0] in "LM" and len(low := chr(c).lower()) == 1 and ord(low) >= 0x370:
            own = set(runs(chr(c))[0]) if runs(chr(c)) else set()
            assert own <= {mark, *range(32, 40)}, hex(c)
    words = ["idiot", "рлрцы", "ؾعؾلث", "且丏且业丁", "stupid"]
    assert len({r for r in runs(*words)}) == len(words)
    weights = toxicity.unpacked(toxicity._fit_runs([(r, 9) for r in runs("idiot")], [(r, 9) for r in runs("table", "order")]))
    s = toxicity.Letters.of_texts(words).scores(weights)[:, 0]
    assert s[0] > 0.5 and max(s[1:4]) < s[0] / 4


def test_insults_of_several_words_and_in_other_scripts(spark):
    rng = random.Random(6)
    plain = ["green", "table", "water", "stone", "quick", "house", "light", "paper", "grows", "under", "stool", "piece"]
    cyrillic = ["\u0434\u043e\u0440\u043e\u0433\u0430", "\u043c\u0430\u0448\u0438\u043d\u0430", "\u043f\u043e\u0433\u043e\u0434\u0430", "\u0440\u0430\u0431\u043e\u0442\u0430"]
    insults = ["stool piece", "green stone under", "\u0441\u043a\u043e\u0442\u0438\u043d"]  # of words that clean texts have, and a word of another script
    rows, labels = [], []
    for i in range(1200):
        words = [rng.choice(plain + cyrillic) for _ in range(40)]
        words = [w for a, w in zip(["", *words], words) if (a, w) != ("stool", "piece")]
        words = [w for a, w in zip(["", *words], words) if (a, w) != ("green", "stone")]
        if i % 3 == 0:
            words.insert(rng.randrange(len(words)), insults[i // 3 % 3])
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 3 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string").where("text IS NOT NULL")
    marked = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, toxicity.fit(df, marked), ["doc_id"]).collect()}
    for which in range(3):
        ids = [i for i in range(1200) if learning_fold(i) == toxicity.HELD_OUT and (i % 3 or i // 3 % 3 == which)]
        assert auc(np.array([got[i] for i in ids]) + np.random.default_rng(0).random(len(ids)) * 1e-9, np.array([int(i % 3 == 0) for i in ids])) > 0.9, which


def learning_fold(i):
    return zlib.crc32(str(i).encode()) % toxicity.FOLDS


def test_folds(spark):
    got = {r[0]: r[1] for r in spark.range(200).select("id", learning.fold(F.col("id"), 5)).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 for i in range(200)}


def drop_by(text_of, rows):
    """Kept rows of a near-dedup by brute force: (doc_id, text) pairs, one of each group."""
    fps = [np.array(brute_fingerprint(t), np.uint64).view(np.int64) for _, t in rows]
    group = least_reachable(list(range(len(rows))), fps)
    kept = {}
    for i, (doc_id, text) in enumerate(rows):
        kept.setdefault(group[i], []).append((doc_id is None, doc_id, text))
    return kept


def test_one_of_each_judges_rows(spark):
    words = "amber birch cedar delta ember fjord grove heron islet jetty knoll larch".split()
    rng = random.Random(8)
    prose = [" ".join(rng.choices(words, k=60)) for _ in range(6)]
    rows = [(1, prose[0]), (5, prose[0]), (5, prose[1]), (7, prose[2]), (7, prose[3]), (None, prose[4]), (None, prose[4]), (None, None), (9, ""), (9, ""), (2, prose[5]), (2, prose[5])]
    df = spark.createDataFrame([(i, t, "x", None, 3) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").withColumn("fp", F.lit(1))
    got = sorted(((r["doc_id"], r["text"]) for r in simhash.one_of_each(df).collect()), key=str)
    assert got == sorted([(1, prose[0]), (5, prose[1]), (7, prose[2]), (7, prose[3]), (None, prose[4]), (9, ""), (2, prose[5])], key=str)
    assert simhash.one_of_each(df).columns == df.columns and simhash.one_of_each(df.limit(0)).count() == 0
    # Rows alike in id and text, but not in other columns: the same one stays however they are dealt.
    alike = spark.createDataFrame([(3, prose[0], f"l{i}", {"a": i}) for i in range(40)], "doc_id long, text string, lang string, tags map<string,int>")
    stays = {tuple(map(str, r)) for n in (1, 7) for r in simhash.one_of_each(alike.repartition(n, F.xxhash64("lang", F.lit(n)))).collect()}
    assert len(stays) == 1


def odd_documents(spark):
    """Documents with nulls, ties, repeated and clashing ids, very long texts, and columns that clash."""
    rows = [(d, t, "en", None, None) for d, t in enumerate(odd_texts())] + [(None, None, None, None, None), (4, "another text of id four " * 20, "en", "s", 1), (4, "another text of id four " * 20, "en", "s", 1), (None, "no id " * 90, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(7) for c in ("fp", "k1", "score", "length", "item_id", "shard", "_k1x")})


@pytest.mark.parametrize("which", ["table", "odd", "empty"])
def test_pipeline_stages_against_plain_versions(spark, which):
    import corpus_pipeline

    docs_ = {"table": lambda: common.table(spark, SF, "documents"), "odd": lambda: odd_documents(spark), "empty": lambda: odd_documents(spark).limit(0)}[which]()
    stages = dict(corpus_pipeline.STAGES)
    pairs = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)

    docs_ = docs_.withColumn("text", F.col("text"))
    kept = common.written(stages["toxicity"](spark, docs_, SF))
    assert kept.columns == corpus_pipeline.COLUMNS
    model = toxicity.fit(docs_.select(*corpus_pipeline.COLUMNS), common.table(spark, SF, "labels"))
    before = pairs(docs_)
    chance = model.probability(toxicity.evidence_of([t for _, t in before], model.weights)) if before else []
    assert pairs(kept) == [x for x, p in zip(before, chance) if p < 0.7]

    before, kept = pairs(kept), common.written(stages["simhash_near_dedup"](spark, kept, SF))
    groups, got = drop_by(None, before), pairs(kept)
    assert len(got) == len(groups)
    for own in groups.values():
        least = min(own, key=lambda x: (x[0], 0 if x[1] is None else x[1]))
        assert sum((i, t) in [(i, t) for _, i, t in own if i == least[1]] for i, t in got) >= 1
    assert {i for i, _ in got} >= {min((x for x in own), key=lambda x: (x[0], 0 if x[1] is None else x[1]))[1] for own in groups.values()}

    before, kept = pairs(kept), common.written(stages["suffix_array_dedup"](spark, kept, SF))
    assert kept.columns == corpus_pipeline.COLUMNS
    assert pairs(kept) == sorted(((i, t) for (i, _), t in zip(before, brute_kept_text([t for _, t in before]))), key=str)

    before, kept = pairs(kept), common.written(stages["benchmark_decontamination"](spark, kept, SF))
    items = [r["text"] for r in common.table(spark, SF, "benchmark").collect()]
    leaky = brute_leaky([t for _, t in before], items)
    assert pairs(kept) == [x for x, bad in zip(before, leaky) if not bad]

    before, out = pairs(kept), stages["best_fit_packing"](spark, kept, SF).toPandas()
    from tokenizers import Tokenizer
    import public_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = []
    for i, t in before:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        starts = [0, *range((len(ids) - 1) % 2048 + 1, len(ids), 2048)]
        expected += [(str(i), n, a, b - a, zlib.crc32(ids[a:b].tobytes())) for n, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)]))]
    got = [(str(None if i != i or i is None else int(i)), *map(int, rest)) for i, *rest in out[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)]
    assert sorted(got) == sorted(expected)
    for _, own in out.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own["offset"].tolist() == np.r_[0, own["length"].cumsum().to_numpy()[:-1]].tolist() and own["length"].sum() <= 2048
    assert out["sequence_id"].nunique() <= len(best_fit_decreasing(out["length"].tolist(), 2048))


def brute_kept_text(texts):
    """Texts without the characters of which every byte is covered by a repeated 200-byte string."""
    seen: dict[bytes, int] = {}
    blobs = [(t or "").encode() for t in texts]
    for b in blobs:
        for i in range(len(b) - 199):
            seen[b[i : i + 200]] = seen.get(b[i : i + 200], 0) + 1
    for b in blobs:
        gone = np.zeros(len(b) + 1, np.int64)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i] += 1
                gone[i + 200 :][:1] -= 1
        gone = np.cumsum(gone)[: len(b)] > 0
        out, at = [], 0
        for sign in b.decode():
            size = len(sign.encode())
            if not gone[at : at + size].all():
                out.append(sign)
            at += size
        yield "".join(out)


def brute_leaky(texts, items):
    """Is some item contained in a text?"""
    wanted = [s for s in (decontaminate.shingles_of(decontaminate.words_of(x)) for x in items) if s]
    of: dict[bytes, list[int]] = {}
    for j, s in enumerate(wanted):
        for x in s:
            of.setdefault(x, []).append(j)
    for t in texts:
        count: dict[int, int] = {}
        for x in decontaminate.shingles_of(decontaminate.words_of(t)):
            for j in of.get(x, ()):
                count[j] = count.get(j, 0) + 1
        yield any(n >= 0.8 * len(wanted[j]) for j, n in count.items())


def test_pipeline(spark):
    import corpus_pipeline

    docs_ = common.table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs_ = common.cut(stage(spark, docs_, SF))
    ids = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select(*ids).collect())) == sorted(map(tuple, docs_.select(*ids).collect()))
