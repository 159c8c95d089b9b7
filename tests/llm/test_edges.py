"""Very long rows, empty tables, clashing columns and counts of operators 3, 4, 5 and 8."""

import random

import pytest
from pyspark.sql import functions as F

from adloom.llm import chat_format, decontaminate, quality_rules, token_counts

WORDS = "amber birch cedar delta ember fjord grove heron islet jetty knoll larch".split()


def test_very_long_conversation(spark):
    rng = random.Random(2)
    said = [" ".join(rng.choices([*WORDS, "<|im_end|>", "🙂", "\n"], k=30)) for _ in range(3000)]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(said)] + [(2, 0, "assistant", "<|" * 400_000), (3, 0, "user", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r["conv_id"]: r for r in chat_format.format_conversations(df).withColumn("loss", chat_format.loss_text(F.col("recovered"))).collect()}
    assert len(out) == 3 and all(r["recovered"] == r["turns"] for r in out.values())
    assert out[1]["loss"] == "".join(said[1::2]) and out[2]["loss"] == "<|" * 400_000 and out[3]["loss"] == ""
    assert [t["text"] for t in out[1]["turns"]] == said and len(out[1]["loss_spans"]) == 1500
    under = [out[1]["formatted"][m["start"] : m["start"] + m["length"]] for m in out[1]["loss_spans"]]
    assert [u.replace("<\\|", "<|") for u in under] == said[1::2]


def test_tokens_of_very_long_texts(spark):
    import public_tokenizers
    import sentencepiece

    model = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    rng = random.Random(3)
    texts = [" ".join(rng.choices(WORDS, k=60_000)), "".join(rng.choices("abcdefghij", k=40_000)), "日本語の文章" * 8_000, " " * 50_000 + "x", "\n".join(WORDS) * 3_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"n_tokens": F.lit(1), "n_bytes": F.lit("x")})
    got = {r["doc_id"]: r for r in token_counts.token_counts(df, model, 4096).collect()}
    for i, t in enumerate(texts):
        assert got[i]["n_tokens"] == len(sp.encode(t)) and got[i]["n_bytes"] == len(t.encode())
        k = got[i]["chars_in_limit"]
        assert len(sp.encode(t[:k])) <= 4096 and (k == len(t) or all(len(sp.encode(t[:j])) > 4096 for j in range(k + 1, min(k + 12, len(t) + 1))))


@pytest.mark.parametrize("policy", list(quality_rules.POLICIES))
def test_ablation_counts(spark, policy):
    rng = random.Random(4)
    texts = [None, "", "A B C", "# # # $ " * 30, "a\n" * 40, "x" * 900 + " y" * 25, " ".join(WORDS) * 40, "LOUD WORDS ALL OVER " * 9, *(" ".join(rng.choices(WORDS, k=rng.randrange(5, 60))).upper() for _ in range(20))]
    df = spark.createDataFrame([(i % 7, t) for i, t in enumerate(texts * 2)], "doc_id long, text string").withColumns({"words": F.lit(1), "keyed": F.lit(2), "lines": F.lit(3)})
    book = quality_rules.ledger(df)
    bits = [r["failure_bits"] & quality_rules.POLICIES[policy] for r in book.collect()]
    assert len(bits) == 2 * len(texts)
    expected = {(n, sum(b & own != 0 for b in bits), sum(b == own for b in bits)) for n, own in quality_rules.BIT.items() if own & quality_rules.POLICIES[policy]}
    assert {tuple(r) for r in quality_rules.ablation(book, policy).select("rule", "n_failed", "n_only").collect()} == expected
    assert any(n for _, n, _ in expected) and any(n for *_, n in expected)
    empty = quality_rules.ledger(df.limit(0))
    assert empty.count() == quality_rules.ablation(empty, policy).count() == 0


def test_rules_on_a_very_long_text(spark):
    n = 60_000
    texts = [" ".join(f"w{i}" for i in range(n)), "same words again and again we say here " * (n // 8)]
    got = {r["doc_id"]: r for r in quality_rules.ledger(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert (got[0]["n_words"], got[0]["n_repeat_words"], got[1]["n_words"], got[1]["n_repeat_words"]) == (n, 0, n, n)


@pytest.mark.parametrize(("shingles", "pieces", "gap"), [(24, 2, 200), (60, 4, 1000), (250, 4, 1000), (250, 12, 300)])
def test_items_strewn_over_a_document(shingles, pieces, gap):
    rng = random.Random(5)

    def words(n):
        return [f"w{rng.randrange(10**7)}" for _ in range(n)]

    items = [words(shingles + 4) for _ in range(100)]
    index = decontaminate.Index([((i, i), " ".join(w)) for i, w in enumerate(items)])
    texts = []
    for w in items:
        ends = [len(w) * i // pieces for i in range(pieces + 1)]
        texts.append([x.encode() for a, b in zip(ends, ends[1:]) for x in [*words(gap), *w[a:b]]])
    leaky = {i for i, t in enumerate(texts) if len(index.shingles[i] & decontaminate.shingles_of(t)) >= 0.8 * len(index.shingles[i])}
    found = {t for t, j, *_ in decontaminate._found(index, decontaminate.WordHashes(), texts, 0.8) if t == j}
    assert len(leaky) == 100 and found == leaky
