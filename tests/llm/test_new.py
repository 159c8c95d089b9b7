"""Edge cases and brute force for the Merkle manifest, lexical search and personal data."""

import itertools
import math
import random
import re
import time
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from adloom.llm import lexical_search, merkle, pii

DOCS = "doc_id long, text string, lang string, source string, n_chars long, norm double, term string, shard int"


def ranked(documents, items, k=10):
    """Every item against every document, plainly."""
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").translate(fold))
    docs = [(i, words(t)) for i, t in documents]
    docs = [(i, len(w), Counter(w)) for i, w in docs if w]
    n, total = len(docs), sum(d[1] for d in docs)
    df = Counter(t for d in docs for t in d[2])
    out = []
    for item, text in items:
        scores = []
        for i, length, tf in docs:
            m = 100 - 75 + (75 * length * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in words(text) if tf[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("shard", "block"), [(7, 3), (lexical_search.SHARD, lexical_search.BLOCK)])
def test_lexical_search(spark, shard, block):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)] + ["Élan", "日本", "a-b", "X9", "straße"]
    text = lambda n: " ".join(rng.choices(vocabulary, weights=[1 / (i + 1) for i in range(len(vocabulary))], k=n))
    texts = [text(rng.choice([1, 3, 10, 40])) for _ in range(150)]
    texts += [None, "", " \n ", "...", texts[0], texts[0], texts[1] * 2, text(30_000), "W1,w1;W1", "İstanbul \0x\x7fy"]
    rows = [(None if i in (3, 9) else i % 140, t, None, None, None, 1.0, "x", 2) for i, t in enumerate(texts)]
    items = [(i, text(rng.choice([1, 2, 8, 25]))) for i in range(12)] + [(12, None), (13, "--"), (14, "unseen"), (15, "w1 w1 W1"), (15, texts[0]), (None, "w2 x y")]
    documents, benchmark = spark.createDataFrame(rows, DOCS), spark.createDataFrame([(*i, 1.0) for i in items], "item_id long, text string, norm double")
    got = sorted(map(tuple, lexical_search.search(documents, benchmark, shard=shard, block=block).collect()), key=str)
    assert got == ranked([(r[0], r[1]) for r in rows], items)
    assert lexical_search.search(documents.limit(0), benchmark).count() == lexical_search.search(documents, benchmark.limit(0)).count() == 0
    assert lexical_search.search(documents, spark.createDataFrame([(1, "unseen", 1.0)], benchmark.schema)).count() == 0


def test_lexical_search_among_copies(spark):
    """A third of all rows are one text, and ids repeat: the least ids win, none is lost."""
    documents = spark.range(3000).select((F.col("id") % 2000).alias("doc_id"), F.when(F.col("id") % 3 == 0, "red fox runs").otherwise(F.concat(F.lit("fox "), F.col("id").cast("string"))).alias("text"))
    benchmark = spark.createDataFrame([(1, "the red fox")], "item_id long, text string")
    got = [tuple(r)[1:3] for r in lexical_search.search(documents, benchmark, shard=100).orderBy("rank").collect()]
    assert got == list(enumerate(sorted(i % 2000 for i in range(0, 3000, 3))[:10], 1))


def hashed(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def climbed(nodes):
    """Root of a list of digests, and the siblings of each with their sides, level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for p, i in zip(paths, at):
            run = i - i % 3
            p.append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + 3])))
        at = [i // 3 for i in at]
        nodes = [hashed(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
    return nodes[0], paths


def plain_manifest(rows, claims):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of (doc_id, source, lang, n_chars, text) rows."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaves = [(r[1] is not None, (r[1] or "").encode(), r[0] is not None, r[0] or 0, hashed(*map(field, r)), hashed(*map(field, (*r[:4], c))), r[0]) for r, c in zip(rows, claims)]
    groups = {}
    for x in sorted(leaves):
        groups.setdefault(x[:2], []).append(x)
    subs = [climbed([x[4] for x in g]) for g in groups.values()]
    root, tops = climbed([s[0] for s in subs])
    out = []
    for g, (sub, paths), top in zip(groups.values(), subs, tops):
        for x, path in zip(g, paths):
            folded = x[5]
            for a, b in path + top:
                folded = hashed(a, folded, b)
            out.append((x[6], x[4], sub, root, hashed(*[s for ab in path + top for s in ab]), folded, folded == root))
    return sorted(out, key=str)


MANIFEST = "doc_id long, source string, lang string, n_chars long, text string, leaf int, tree int, slot int, bucket int"


def manifest_of(spark, rows, **more):
    claims = [None if r[4] is None else r[4].replace("\n", "") if r[0] is not None and r[0] % 3 == 0 else r[4] for r in rows]
    df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], MANIFEST)
    claimed = F.when(F.col("doc_id") % 3 == 0, F.regexp_replace("text", "\n", "")).otherwise(F.col("text"))
    return sorted(map(tuple, merkle.manifest(df, claimed, **more).collect()), key=str), plain_manifest(rows, claims)


def test_manifest(spark, monkeypatch):
    monkeypatch.setattr(merkle, "COPIES", 4)
    rng = random.Random(2)
    ids = [None, 0, -1, -(2**63), 2**63 - 1, 2**40, 2**40 + 1, 32767, 32768, *range(100, 160)]
    names = [None, "", "-", "+", "z", "é", "\U0001f600", "\uffff", "one"]
    rows = [(rng.choice(ids), rng.choice(names[:-1]), rng.choice([None, "en"]), rng.choice([None, 5]), rng.choice([None, "", "a\nb", "c", "\n"])) for _ in range(400)]
    rows += [(7, "one", None, 1, "only")] + [(9, "z", "en", 1, "copy\n")] * 23 + [(None, None, None, None, None)] * 9 + [(3, "é", None, 0, "x" * 300_000 + "\n")]
    rows += [(rng.choice(ids), f"s{i}", None, None, "t") for i in range(12)]
    got, expected = manifest_of(spark, rows)
    assert got == expected and {r[6] for r in got} == {True, False}
    assert merkle.manifest(spark.createDataFrame([], MANIFEST)).count() == 0
    one, expected = manifest_of(spark, [(5, None, None, None, None)])
    assert one == expected and one[0][1] == one[0][2] == one[0][3]


def test_manifest_of_several_rounds(spark):
    """Slot arrays of nine, so that trees take rounds; most rows share one source, and many one id."""
    rows = [(i * 40_009 % 3_000_017 if i % 3 else 11, "hot" if i % 5 else f"s{i % 70}", "en", i, f"text {i}\n") for i in range(900)]
    got, expected = manifest_of(spark, rows, levels=2)
    assert got == expected


def test_ranks_in_containers():
    rng = np.random.default_rng(3)
    for size in (1, 5, merkle.LISTED, merkle.LISTED + 1, 1 << merkle.PLACE_BITS):
        places = np.sort(rng.choice(1 << merkle.PLACE_BITS, size, replace=False))
        counts = rng.choice([1, 1, 1, 4], size)
        box = merkle.container(places, counts)
        assert len(box["bits"]) <= 4096
        asked = rng.choice(1 << merkle.PLACE_BITS, 300)
        assert merkle.rank(box, asked).tolist() == [int(counts[places < p].sum()) for p in asked]


@pytest.fixture(scope="module")
def field():
    return pii.fit(pii.labelled_sentences())


def plain_base(text):
    """The patterns as the contract writes them."""
    digits = lambda t: re.sub("[^0-9]", "", t)
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m.group())) <= 15]
    return sorted(out)


def test_base_patterns():
    rng = random.Random(8)
    pieces = ["a", "B.", "@", "@x", ".com", "-", "_", "%", "1", "12", "255", "256", "0012", ".", ". ", " ", "+", "+1", "(", ")", "4111111111111111", "5500 0000 0000 0004", "é", "\n", "10.0.0.1", "+49 (30) 1234567"]
    for _ in range(6000):
        text = "".join(rng.choices(pieces, k=rng.randrange(1, 14)))
        assert pii.base_spans(text) == plain_base(text), text


def test_viterbi_and_open_tokens(field):
    """Best sequences by trying all of them; runs of open tokens against one run over all."""
    rng = np.random.default_rng(5)
    e = rng.normal(0, 2, (8, 5, pii.N_LABELS))
    for scores, got in zip(e, field.viterbi(e)):
        value = lambda y: sum(s[a] for s, a in zip(scores, y)) + sum(field.moves[a, b] for a, b in zip((0, *y), (*y, 0)))  # noqa: E731,B023
        assert value(got) == pytest.approx(max(map(value, itertools.product(range(pii.N_LABELS), repeat=5))))
    for text in [t for t, _ in pii.labelled_sentences()] + ["plain words. " * 300 + "call (030) 123 4567 or " + "x, " * 200]:
        _, _, shapes = pii.tokens(np.frombuffer(text.encode("utf-32-le"), np.uint32))
        window, one = pii.windows(shapes.astype(np.int64), np.zeros(len(shapes), int)), np.zeros(len(shapes), int)
        assert field.labels(window, one).tolist() == field.viterbi(field.emissions(window)[None])[0].tolist()


def test_gradient_of_the_field():
    """The fit ends where the likelihood, by trying all sequences, has no slope."""
    few = [("a@b 12", [(0, 0, 3)]), ("12 34", []), ("x 12", [(2, 3, 4)])]
    f = pii.fit(few, rounds=3000, penalty=0.1, move_penalty=0.1)

    def loss(move):
        out = 0.05 * ((f.weights.astype(float) ** 2).sum() + (move**2).sum())
        for text, spans in few:
            starts, ends, shapes = pii.tokens(np.frombuffer(text.encode("utf-32-le"), np.uint32))
            e = f.weights[pii.features(pii.windows(shapes.astype(np.int64), np.zeros(len(shapes), int)))].sum(axis=1).astype(float)
            y = [next((1 + k for a, k, b in spans if s >= a and t <= b), 0) for s, t in zip(starts, ends)]
            value = lambda y: sum(s[a] for s, a in zip(e, y)) + sum(move[a, b] for a, b in zip((0, *y), (*y, 0)))  # noqa: E731,B023
            out += np.log(sum(np.exp(value(z)) for z in itertools.product(range(pii.N_LABELS), repeat=len(y)))) - value(y)
        return out

    for a, b in itertools.product(range(pii.N_LABELS), repeat=2):
        d = np.zeros_like(f.moves)
        d[a, b] = 1e-4
        assert abs(loss(f.moves + d) - loss(f.moves - d)) / 2e-4 < 0.01


def test_field_finds_unusual_forms(field):
    cases = {
        "Please mail sam.hill (at) office.example.org about it": ["sam.hill (at) office.example.org"],
        "you can ask tim dot bell at sample dot org for more": ["tim dot bell at sample dot org"],
        "phone (415) 555-0132 or come": ["(415) 555-0132"],
        "call +1 (269) 555-3296 4524132264652876 and": ["+1 (269) 555-3296", "4524132264652876"],
        "paid by 4012/8888/8888/1881 there": ["4012/8888/8888/1881"],
    }
    for text, want in cases.items():
        base, spans = pii.judged(field, [text])[0]
        assert base == plain_base(text) and [text[a:b] for a, _, b in spans] == want
    clean = ["The thing was at the dot of 10.5, in 2023 and 1,200 more.", "version 1.2.3 of 12-A; id 9807915762804490", "A!! B!! C### d%%% at. at. at. dot. dot.", "Ünd öde, çela. 12:30 (or 13:45)."]
    assert [s for _, s in pii.judged(field, clean)] == [[]] * 4


def test_personal_data(spark, field):
    texts = [None, "", " \n\t", "jo@x.org", "jo@x.org", "é" * 40 + " 10.1.2.3, 日本. Please mail sam.hill (at) office.example.org about it", "a\0b +44 20 7946 0958", "x" * 400_000 + " jo@x.org", "1" * 300_000, "word at. " * 60_000 + "call (030) 123 4567", "+1" * 50_000, "1.2.3." * 40_000, "@" * 100_000]
    rows = [(None if i == 3 else i, t, None, None, None, 1.0, "x", 2) for i, t in enumerate(texts)]
    began = time.time()
    got = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(rows, DOCS), field).collect()}
    assert len(got) == len(texts) and time.time() - began < 120
    for i, t in enumerate(texts):
        r, base = got[None if i == 3 else i], plain_base(t or "") if len(t or "") < 1000 else pii.base_spans(t)
        shown = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert r["base_sha256"] == hashed(shown) and [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[1] == j for x in base) for j in range(4)]
        assert set(filter(None, shown.split(","))) <= set(r["spans"].split(","))
        assert r["spans"] == pii.shown(pii.judged(field, [t or ""])[0][1])  # whatever stands beside it
    assert len(got[5]["spans"].split(",")) == 2 and got[9]["spans"].startswith("phone:540005:")
    assert pii.find(spark.createDataFrame([], DOCS), field).count() == 0
