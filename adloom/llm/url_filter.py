"""URL filters: a blocked Bloom filter ahead of an exact hash join.

Listed canonical URLs (rules: a host and the start of a path) are hashed into a
blocked Bloom filter, one 64-bit word a block, sized by the number of rules.  Each
page tests, inside its own row and once, the keys that could list it: every suffix of
its host at a label boundary with every listed length of path.  Only pages with a
possible hit go on to an exact hash join, which removes the false positives; all
other pages never enter a shuffle.  A filter holds at most ``RULES_AT_ONCE`` rules; a
longer list is dealt by hash to several filters, which are asked one after another, so
what a task holds stays bounded and the share of false positives stays the same.

Defined results: a null URL or one without ``://`` has an empty host and path
and fits no rule; rows are kept one for one, repeats included; an empty rule
list leaves every page at the default verdict.  Of the rules that fit, the
longest (host + path) wins; then the longer host; then ``block`` before
``allow``.  Input columns besides the id and the URL are not read, so clashing
names do no harm.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

#: Bits that a rule sets, and bits of the filter a rule.
BITS_SET, BITS_A_RULE = 4, 16
#: Rules of one filter (2 MB of words).
RULES_AT_ONCE = 1_000_000


def canonical_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.substring_index(F.substring_index(F.expr("substring(url, instr(url, '://') + 3)"), "#", 1), "?", 1)
    rest = F.when(at > 0, rest).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.substring_index(rest, "/", 1)
    path = F.substring(rest, F.length(host) + 1, F.lit(2_147_483_647))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def _mask(key: Column) -> Column:
    """The bits that a key sets in its word."""
    h = F.xxhash64(key, F.lit(1))
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(BITS_SET)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def _word(key: Column, words: int) -> Column:
    return F.xxhash64(key).bitwiseAND(F.lit(words - 1)).cast("int")


def build_filter(rules: DataFrame, n: int) -> list[int]:
    """The words of the filter of n rules; their number is a power of two."""
    words = [0] * (1 << max(0, math.ceil(math.log2(max(1, n) * BITS_A_RULE / 64))))
    filled = rules.groupBy(_word(F.col("rule"), len(words)).alias("at")).agg(F.bit_or(_mask(F.col("rule"))).alias("bits"))
    for row in filled.collect():  # at most RULES_AT_ONCE / 2 words
        words[row["at"]] = row["bits"]
    return words


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Judge each page by rules (host, path, action).

    Returns id, host, path, rule (host + path; null if none fits) and verdict.
    """
    rules = rules.where("host is not null and path is not null and action is not null").select(
        F.concat("host", "path").alias("rule"), F.length("host").alias("host_len"), F.length("path").alias("path_len"), "action"
    )
    n_rules = rules.count()
    lengths = sorted(r[0] for r in rules.select("path_len").distinct().collect())  # bounded by the longest URL
    parts = max(1, math.ceil(n_rules / RULES_AT_ONCE))

    def part_of(key: Column) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(2)), F.lit(parts))

    def possible(part: int, words: list[int]):
        bits = F.from_json(F.lit(str(words)), "array<bigint>")  # folded into one constant

        def test(key: Column) -> Column:
            fits = F.bitwise_not(F.get(bits, _word(key, len(words)))).bitwiseAND(_mask(key)) == 0
            return fits if parts == 1 else (part_of(key) == part) & fits

        return test

    pages = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    host, path = canonical_parts(F.col("url"))
    pages = pages.select("page_id", host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    usable = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("path")) if lengths else F.expr("cast(array() as array<int>)")
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(usable, lambda n: F.concat(s, F.substring(F.col("path"), F.lit(1), n)))))

    hits = F.expr("cast(array() as array<string>)")
    for part in range(parts):
        own = rules.where(part_of(F.col("rule")) == part)
        words = build_filter(own, n_rules if parts == 1 else own.count())
        found = F.filter(keys, possible(part, words))
        hits = found if parts == 1 else F.concat(hits, found)
    judged = cut(pages.select(F.monotonically_increasing_id().alias("row"), "page_id", "host", "path", hits.alias("hits")))

    tried = judged.where(F.size("hits") > 0).select("row", "page_id", "host", "path", F.explode("hits").alias("rule"))
    best = F.max(F.when(F.col("action").isNotNull(), F.struct(F.length("rule").alias("n"), "host_len", "action", "rule"))).alias("best")
    found = tried.join(rules, "rule", "left").groupBy("row", "page_id", "host", "path").agg(best)
    found = found.select("page_id", "host", "path", "best.rule", F.coalesce("best.action", F.lit(default)).alias("verdict"))
    rest = judged.where(F.size("hits") <= 0).select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    return found.unionByName(rest)


#: The rules of the query.
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts for every row of ``pages``."""
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    return filter_urls(table(spark, sf_dir, "pages"), rules)


ORACLE = """
WITH rules(h, p, action) AS (VALUES ('com','/en/','block'),('example.com','/en/7','allow'),('net','/de/','allow'),('example.net','/de/8','block'),('org','/es/','block')),
a AS (SELECT row_number() OVER () AS rid, page_id, CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest FROM pages),
b AS (SELECT rid, page_id, coalesce(translate(split_part(rest, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(substr(rest, length(split_part(rest, '/', 1)) + 1), '') AS path FROM a),
f AS (SELECT b.*, h || p AS r, action, row_number() OVER (PARTITION BY rid ORDER BY length(h || p) DESC NULLS LAST, length(h) DESC, action DESC) AS k
      FROM b LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, r AS rule, coalesce(action, 'allow') AS verdict FROM f WHERE k = 1
"""
