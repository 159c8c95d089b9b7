r"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once a document.  The ledger keeps the measurements and
one failure bit a rule; a policy is a versioned mask, so judging by another
policy, and every ablation, is bit arithmetic on the ledger, without the texts.

Words are ``[^\x20\x09-\x0D]+``.  A null or empty text has no words.  Rows are
kept one for one; other input columns are not read unless asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_GAP, WORD_GAP_CHARS, table

WINDOW = 8
#: Rule -> failure condition over the measurements; its place is its bit.
RULES = {
    "few_words": "n_words < 20",
    "repeated_words": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "duplicate_lines": "10 * n_dup_lines > 3 * n_lines",
    "long_words": "word_chars > 25 * n_words",
    "capitals": "2 * n_upper > word_chars",
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}
#: Versioned policies: the rules that reject.
POLICIES = {
    "base": BIT["few_words"] | BIT["repeated_words"],
    "v1": sum(BIT.values()),
}


def words_of(text: Column) -> Column:
    """Words of a text; no text has none."""
    inner = F.trim(text, F.lit(WORD_GAP_CHARS))
    return F.when(F.length(inner) > 0, F.split(inner, WORD_GAP)).otherwise(F.expr("cast(array() as array<string>)"))


def _windows(key) -> Column:
    """key(words, place) of every window of 8 words."""
    return F.transform(F.sequence(F.lit(1), F.size("words") - (WINDOW - 1)), lambda i: key(F.slice("words", i, WINDOW), i))


def _covered(places: Column) -> Column:
    """Words covered by windows that start at sorted places."""
    steps = F.zip_with(places, F.slice(places, 2, F.greatest(F.size(places), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    return F.aggregate(steps, F.lit(0), lambda s, x: s + x)


def measure(documents: DataFrame, id_cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Measurements of every whole text."""
    df = documents.select(*id_cols, F.coalesce("text", F.lit("")).alias("text"))
    df = df.select(
        *id_cols,
        words_of(F.col("text")).alias("words"),
        F.length(F.translate("text", WORD_GAP_CHARS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.length("text") - F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long").alias("n_upper"),
        F.filter(F.split("text", "\n"), lambda line: F.length(F.trim(line, F.lit(WORD_GAP_CHARS))) > 0).alias("lines"),
    )
    df = df.select(
        *id_cols,
        "words",
        F.size("words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_upper",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    # 64-bit hashes of the windows tell which texts can have a repeat; only those compare strings.
    hashes = F.when(F.size("words") > WINDOW, _windows(lambda w, i: F.xxhash64(w))).otherwise(F.expr("cast(array() as array<bigint>)"))
    df = df.withColumn("hashes", hashes)
    df = df.withColumn("may_repeat", F.size(F.array_distinct("hashes")) < F.size("hashes")).drop("hashes")
    keyed = F.when(F.col("may_repeat"), F.array_sort(_windows(lambda w, i: F.struct(F.concat_ws(" ", w).alias("k"), i.alias("i")))))
    df = df.withColumn("keyed", keyed).drop("may_repeat")
    # Equal keys are neighbours: keep a place if the key before or after it is the same.
    before = F.concat(F.array(F.lit(None).cast("struct<k:string,i:int>")), F.slice("keyed", 1, F.size("keyed") - 1))
    after = F.slice("keyed", 2, F.size("keyed"))
    marked = F.zip_with(
        F.zip_with("keyed", before, lambda a, b: F.struct(a["k"].alias("k"), a["i"].alias("i"), F.coalesce(a["k"] == b["k"], F.lit(False)).alias("same"))),
        after,
        lambda a, b: F.when(a["same"] | F.coalesce(a["k"] == b["k"], F.lit(False)), a["i"]),
    )
    df = df.withColumn("places", F.when(F.col("keyed").isNotNull(), F.array_sort(F.filter(marked, lambda p: p.isNotNull()))))
    repeat = F.when(F.size("places") > 0, _covered(F.col("places"))).otherwise(F.lit(0)).cast("long")
    return df.select(*id_cols, "n_words", "word_chars", "n_symbols", "n_dup_lines", repeat.alias("n_repeat_words"), "n_lines", "n_upper")


def ledger(documents: DataFrame, id_cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Measurements and the failure bits of all rules, once a document."""
    bits = F.lit(0)
    for name, fails in RULES.items():
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(BIT[name])).otherwise(F.lit(0)))
    return measure(documents, id_cols).withColumn("failure_bits", bits)


def apply_policy(book: DataFrame, policy: str, out: str = "kept") -> DataFrame:
    """Judge a ledger by one of POLICIES."""
    return book.withColumn(out, F.col("failure_bits").bitwiseAND(F.lit(POLICIES[policy])) == 0)


def ablation(book: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: documents it fails, and those it alone rejects.

    The ledger shrinks to one row a bit pattern (at most 2 ** rules) before the
    rules are compared.
    """
    mask = POLICIES[policy]
    patterns = book.groupBy(F.col("failure_bits").bitwiseAND(F.lit(mask)).alias("bits")).count()
    rules = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(b).alias("bit")) for n, b in BIT.items() if b & mask])
    per = patterns.select("bits", "count", F.explode(rules).alias("r"))
    fails = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    return per.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(fails, F.col("count")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("count")).otherwise(0)).alias("n_only"),
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements, failure bits and verdict of every document."""
    book = apply_policy(apply_policy(ledger(table(spark, sf_dir, "documents")), "base", "base_kept"), "v1", "kept")
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~F.col("base_kept")).alias("base_failed"), "kept", "failure_bits")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
s AS (SELECT rid, unnest(range(1, len(words) - 6)) AS i, words FROM w WHERE len(words) >= 8),
k AS (SELECT rid, i, array_to_string(words[i:i+7], ' ') AS k FROM s),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS n FROM k),
c AS (SELECT rid, least(8, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 8)) AS step FROM g WHERE n > 1),
r AS (SELECT rid, sum(step)::BIGINT AS n_repeat_words FROM c GROUP BY rid),
m AS (SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper
 FROM w LEFT JOIN r USING (rid)),
b AS (SELECT *, ((n_words < 20)::INT + 2 * (100 * n_repeat_words > 30 * n_words)::INT + 4 * (10 * n_symbols > 3 * n_words)::INT + 8 * (10 * n_dup_lines > 3 * n_lines)::INT
  + 16 * (word_chars > 25 * n_words)::INT + 32 * (2 * n_upper > word_chars)::INT)::INT AS failure_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failure_bits & 3 <> 0 AS base_failed, failure_bits = 0 AS kept, failure_bits FROM b
"""
