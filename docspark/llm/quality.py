"""Quality rules as a ledger of bits, in DataFrame functions only.

Every rule is evaluated once. The ledger keeps, for each document, the
measurements and one bit for each rule that failed. A policy is a version's
set of rules: a mask. Applying one is a bitwise AND with the ledger, and the
effect of leaving a rule out is a bitwise aggregation over it; over a written
ledger neither reads a text again.

Defined results: a null or empty text has no words and fails the rule on few
words; rows with equal or null ids are judged apart; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Rules in bit order: name and when it fails, over the measurements.
RULES = [
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "4 * n_symbols > n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 15 * n_words"),
    ("repeated_lines", "2 * n_dup_lines > n_lines"),
    ("few_distinct_words", "100 * n_distinct_words < 10 * n_words AND n_words < 2000"),
    ("short_lines", "n_lines >= 10 AND n_words < 2 * n_lines"),
]
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}

#: Versioned policies.
POLICIES = {
    "base-1": ("few_words", "repeated_windows"),
    "full-1": tuple(BIT),
}

WORD_GAP = "[\\x20\\x09-\\x0D]+"


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _covered(positions: Column) -> Column:
    return F.size(F.array_distinct(F.flatten(F.transform(positions, lambda p: F.array(p, p + 1, p + 2)))))


def _repeated(h: str, ordered: str) -> Column:
    """Words in 3-word windows found twice or more, from the windows' hashes in
    reading order and sorted. The few hashes that repeat are looked up one by one;
    where they are many, hashes are sorted with their places instead."""
    twice = F.array_distinct(F.filter(F.col(ordered), lambda x, k: x == F.get(F.col(ordered), k + 1)))

    def by_lookup(t: Column) -> Column:
        places = F.filter(F.transform(F.col(h), lambda x, k: F.when(F.array_contains(t, x), k)), lambda p: p.isNotNull())
        return _covered(places)

    def by_sort(s: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)) | ((k > 0) & F.coalesce(F.get(s, F.greatest(k - 1, F.lit(0)))["h"] == x["h"], F.lit(False)))
        places = F.filter(F.transform(s, lambda x, k: F.when(same(x, k), x["p"])), lambda p: p.isNotNull())
        return _covered(places)

    placed = F.array_sort(F.transform(F.col(h), lambda x, k: F.struct(x.alias("h"), k.alias("p"))))
    return _let(twice, lambda t: F.when(F.size(t) == 0, F.lit(0)).when(F.size(t) <= 12, by_lookup(t)).otherwise(_let(placed, by_sort)))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements: n_words, word_chars, n_symbols, n_lines (lines
    with a word), n_dup_lines, n_repeat_words, n_distinct_words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    cut = docs.select("doc_id", text.alias("text"), F.filter(F.split(text, WORD_GAP), lambda w: w != "").alias("words"), F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("lines"))
    n = F.size("words")
    hashes = F.transform(F.slice("words", F.lit(1), F.greatest(n - 2, F.lit(0))), lambda w, k: F.xxhash64(w, F.get("words", k + 1), F.get("words", k + 2)))
    hashed = cut.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct_words"),
        hashes.alias("h"),
    )
    ordered = hashed.select("*", F.sort_array("h").alias("s"))
    return ordered.select(*[c for c in hashed.columns if c != "h"], _repeated("h", "s").cast("long").alias("n_repeat_words"))


def ledger(docs: DataFrame) -> DataFrame:
    """measured() and fail_bits: bit k is set if rule k failed."""
    bits = sum((F.when(F.expr(rule), F.lit(BIT[name])).otherwise(F.lit(0)).cast("long") for name, rule in RULES), F.lit(0).cast("long"))
    return measured(docs).withColumn("fail_bits", bits)


def written(docs: DataFrame) -> DataFrame:
    """The ledger kept in the shared folder: policies and ablations read its bits from
    there and evaluate no rule again."""
    return stored(ledger(docs), "ledger")


def mask(policy: str) -> int:
    return sum(BIT[name] for name in POLICIES[policy])


def applied(book: DataFrame, policy: str = "full-1") -> DataFrame:
    """A ledger with base_failed and kept, by a policy."""
    failed = lambda p: F.col("fail_bits").bitwiseAND(F.lit(mask(p))) != 0
    base = failed("base-1")
    return book.withColumns({"base_failed": base, "kept": ~base & ~failed(policy)})


def ablations(book: DataFrame, policy: str = "full-1") -> DataFrame:
    """One row for each rule of a policy: documents that fail it, that fail it alone
    (which leaving it out would bring back), and all that the policy rejects. One
    aggregation over the ledger's bits."""
    m = mask(policy)
    bits = F.col("fail_bits").bitwiseAND(F.lit(m))
    counts = book.groupBy(bits.alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(BIT[name]).cast("long").alias("bit")) for name in POLICIES[policy]])).alias("r")
    each = counts.select("bits", "n", rules)
    return each.groupBy("r.rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(F.col("bits") != 0, F.col("n")).otherwise(0)).alias("n_rejected"),
    )


SQL = (
    r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
m AS (
  SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
         len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS n_lines,
         len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_lines_distinct,
         len(list_distinct(words)) AS n_distinct_words
  FROM t),
win AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w FROM t, unnest(range(1, len(words) - 1)) AS r(i)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
a AS (SELECT m.doc_id, n_words, word_chars, n_symbols, n_lines, n_lines - n_lines_distinct AS n_dup_lines, n_distinct_words, coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM m LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, ("""
    + " + ".join(f"CASE WHEN {rule} THEN {BIT[name]} ELSE 0 END" for name, rule in RULES)
    + """) AS fail_bits FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits,
       fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept FROM b
"""
)

ABLATION_SQL = (
    "WITH l AS ("
    + SQL
    + "), r(rule, bit) AS (VALUES "
    + ", ".join(f"('{name}', {BIT[name]})" for name in POLICIES["full-1"])
    + """)
SELECT rule, count(*) FILTER (fail_bits & bit <> 0) AS n_failed, count(*) FILTER (fail_bits = bit) AS n_only, count(*) FILTER (fail_bits <> 0) AS n_rejected FROM l, r GROUP BY rule"""
)
