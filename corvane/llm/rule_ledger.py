"""Quality rules as a bitmask ledger: every rule is evaluated once per document; policies and ablations only read bits.

The ledger holds the measurements and one bit per rule that fails. A policy is a versioned set of rules (a bit mask) and
the number of its rules that a document may fail. What a policy keeps, and what leaving out each rule would change, is
bitwise arithmetic on the histogram of the ledger's masks, which has at most 2**rules rows however many documents.
Everything is built-in column functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _common as c


@dataclass(frozen=True)
class Policy:
    """Documents are kept that fail at most ``allowed`` of ``rules`` and none of ``hard``."""

    version: str
    rules: tuple[str, ...]
    hard: tuple[str, ...] = ("too_short", "repeated_words")
    allowed: int = 0

    def mask(self, names: tuple[str, ...]) -> int:
        return sum(1 << RULES.index(r) for r in names)


#: Order fixes the bits; new rules go to the end.
RULES = ("too_short", "repeated_words", "symbols", "duplicate_lines", "word_length", "shouting")
POLICIES = {
    "2024-1": Policy("2024-1", ("symbols", "duplicate_lines", "word_length")),
    "2024-2": Policy("2024-2", ("symbols", "duplicate_lines", "word_length", "shouting")),
}
CURRENT = "2024-2"




POSITION = (1 << 30) - 1


def measure(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns ``__n_words``, ``__word_chars``, ``__n_symbols``, ``__n_lines``, ``__n_dup_lines``, ``__n_repeat_words``, ``__n_upper`` (long).

    Words of a null or empty text: none, so all counts are 0 (one line). Whole texts are used, however long. Windows of
    three words are told apart by sorting 34 bits of their hash with their position in one long; those that share them
    with another (few) are then compared as words, so a collision of hashes changes nothing.
    """
    t = c.text_or_empty()
    trimmed = F.btrim(t, F.lit(c.SPACES))
    gram = lambda i: (F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    w = F.col("__w")
    d = docs.withColumn("__w", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+")))
    d = d.withColumn("__l", F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    packed = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda _, i: F.xxhash64(*gram(i)).bitwiseAND(F.lit(~POSITION)).bitwiseOR(i.cast("long")))
    d = d.withColumn("__k", F.sort_array(packed))
    k, hashed = F.col("__k"), lambda x: F.shiftright(x, 30)
    alike = F.filter(k, lambda x, i: (hashed(x) == hashed(F.get(k, i + 1))) | (hashed(x) == hashed(F.get(k, i - 1))))
    d = d.withColumn("__s", F.sort_array(F.transform(alike, lambda x: F.struct(F.concat_ws(" ", *gram(x.bitwiseAND(F.lit(POSITION)).cast("int"))).alias("g"), x.bitwiseAND(F.lit(POSITION)).cast("int").alias("i")))))
    s = F.col("__s")
    twice = F.filter(s, lambda x, i: (x["g"] == F.get(s, i - 1)["g"]) | (x["g"] == F.get(s, i + 1)["g"]))
    d = d.withColumn("__p", F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate("__p", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), lambda a, p: F.struct((p + 3).alias("end"), (a["n"] + p + 3 - F.greatest(p, a["end"])).alias("n")), lambda a: a["n"])
    long = lambda x: x.cast("long")
    return d.select(
        *c.cols(docs),
        long(F.size(w)).alias("__n_words"),
        long(F.length(F.array_join(w, ""))).alias("__word_chars"),
        long(F.regexp_count(t, F.lit("[#*$%&|<>]"))).alias("__n_symbols"),
        long(F.size(F.split(t, "\n"))).alias("__n_lines"),
        long(F.size("__l") - F.size(F.array_distinct("__l"))).alias("__n_dup_lines"),
        long(covered).alias("__n_repeat_words"),
        long(F.regexp_count(t, F.lit("[A-Z]"))).alias("__n_upper"),
    )


def _failures() -> dict[str, Column]:
    n = F.col("__n_words")
    return {
        "too_short": n < 50,
        "repeated_words": 100 * F.col("__n_repeat_words") > 50 * n,
        "symbols": 10 * F.col("__n_symbols") > n,
        "duplicate_lines": 2 * F.col("__n_dup_lines") > F.col("__n_lines"),
        "word_length": (F.col("__word_chars") < 3 * n) | (F.col("__word_chars") > 12 * n),
        "shouting": 2 * F.col("__n_upper") > F.col("__word_chars"),
    }


def ledger(docs: DataFrame) -> DataFrame:
    """``docs`` with the measurements and ``__failed``, the bits (long) of the rules that each row fails."""
    d = measure(docs)
    bits = [F.when(bad, F.lit(1 << RULES.index(name))).otherwise(F.lit(0)).cast("long") for name, bad in _failures().items()]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask.bitwiseOR(b)
    # as the output of a generator the bits stay a column: a filter on them isn't moved down and doesn't evaluate the rules again
    return d.select("*", F.explode(F.array(mask)).alias("__failed"))


def verdict(failed: Column, policy: Policy) -> Column:
    """Whether ``policy`` keeps a row with these failure bits."""
    hard, soft = policy.mask(policy.hard), policy.mask(policy.rules)
    return (failed.bitwiseAND(F.lit(hard)) == 0) & (F.bit_count(failed.bitwiseAND(F.lit(soft))) <= policy.allowed)


def ablations(ledger_rows: DataFrame, policy: Policy) -> DataFrame:
    """For the whole policy (rule null) and with each rule left out: documents kept, and kept that the policy rejects.

    Columns: version, rule, n_docs, n_kept, n_regained. Documents are first counted by mask: at most 2**rules rows.
    """
    masks = c.staged(ledger_rows.groupBy("__failed").agg(F.count("*").alias("n")), "rule-masks")
    out = None
    for rule in (None, *policy.hard, *policy.rules):
        less = Policy(policy.version, tuple(r for r in policy.rules if r != rule), tuple(r for r in policy.hard if r != rule), policy.allowed)
        kept = verdict(F.col("__failed"), less)
        one = masks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum(F.when(kept, F.col("n"))), F.lit(0)).alias("n_kept"), F.coalesce(F.sum(F.when(kept & ~verdict(F.col("__failed"), policy), F.col("n"))), F.lit(0)).alias("n_regained"))
        one = one.select(F.lit(policy.version).alias("version"), F.lit(rule).cast("string").alias("rule"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def keep_good(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Stage: the rows of ``docs`` that the policy keeps, with their own columns. Null and empty texts fail ``too_short``."""
    own = c.fresh(docs, *[f"__own{i}" for i in range(len(docs.columns))])
    renamed = docs.select(*(c.col(n).alias(o) for n, o in zip(docs.columns, own)), c.col("text").alias("text"))
    return ledger(renamed).filter(verdict(F.col("__failed"), POLICIES[policy])).select(*(c.col(o).alias(n) for n, o in zip(docs.columns, own)))


def op2(spark, sf_dir: str) -> DataFrame:
    rows = ledger(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    base = Policy("base", ()).mask(("too_short", "repeated_words"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return rows.select("doc_id", *(F.col(f"__{x}").alias(x) for x in names), (F.col("__failed").bitwiseAND(F.lit(base)) != 0).alias("base_failed"), verdict(F.col("__failed"), POLICIES[CURRENT]).alias("kept"), F.col("__failed").alias("failed_rules"))


_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
OP2_SQL = rf"""
WITH a AS (
  SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (SELECT rowid AS r, unnest(list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: {{'i': i, 'g': w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]}})) AS x
      FROM (SELECT row_number() OVER () AS rowid, w FROM a)),
c AS (SELECT r, x.i AS i, count(*) OVER (PARTITION BY r, x.g) AS n FROM g),
p AS (SELECT DISTINCT r, i + k AS p FROM c, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1),
q AS (SELECT r, count(*) AS n FROM p GROUP BY r),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, len(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(q.n, 0)::BIGINT AS n_repeat_words, len(string_split(t, chr(10))) AS n_lines,
         length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper
  FROM (SELECT row_number() OVER () AS r, * FROM a) LEFT JOIN q USING (r)),
f AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
           + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END
           + CASE WHEN word_chars < 3 * n_words OR word_chars > 12 * n_words THEN 16 ELSE 0 END
           + CASE WHEN 2 * n_upper > word_chars THEN 32 ELSE 0 END)::BIGINT AS failed_rules
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_rules & 3) <> 0 AS base_failed, failed_rules = 0 AS kept, failed_rules
FROM f
"""
