"""Quality rules: a rule bitmask ledger in native expressions.

``ledger`` measures every text and evaluates every rule once; each rule that
fails sets one bit of ``failed``.  ``apply_policy`` turns the stored bits into
verdicts for any policy version without looking at the text again, and
``ablation`` counts, with bitwise aggregation, what each rule removes alone and
what would come back without it.

No Python runs on the executors: words and lines are arrays, the repeated
three-word windows are found by sorting 64-bit window hashes within the row.

Edge cases: a null or blank text has no words and fails ``few_words``; ties and
repeated rows are judged alike, each row by its own text; an empty table gives
an empty ledger; other columns pass through unless named like a measurement,
which then replaces them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import let, table

WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")

#: Rules in bit order: a name and the condition, over the measurements, that fails a text.
#: New rules go at the end, so that stored ledgers keep their meaning.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbol_heavy", "10 * n_symbols > 3 * n_words"),
    ("repeated_lines", "n_lines >= 4 and 100 * n_dup_lines > 50 * n_lines"),
    ("short_words", "n_words > 0 and word_chars < 2 * n_words"),
    ("long_words", "word_chars > 40 * n_words"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_windows"]

#: Policy versions: the bits that reject a text.
POLICIES = {
    "v1-base": BASE,
    "v2": BASE | BIT["symbol_heavy"] | BIT["repeated_lines"] | BIT["short_words"] | BIT["long_words"],
}
CURRENT = "v2"


def _covered(words: Column) -> Column:
    """Words that lie in a three-word window found twice or more in the text."""
    def count(positions):
        # each repeated window covers three words, less what the next one covers as well
        return F.aggregate(
            positions,
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
            lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["last"]))
                                    .cast("long").alias("n"), p.alias("last")),
            lambda acc: acc["n"])

    def repeated(pairs):
        # equal hashes stand side by side after sorting; out of range is null, hence not equal
        same = lambda x, i: (F.coalesce(x["h"] == F.get(pairs, i - 1)["h"], F.lit(False))
                             | F.coalesce(x["h"] == F.get(pairs, i + 1)["h"], F.lit(False)))
        return count(F.sort_array(F.transform(F.filter(pairs, same), lambda x: x["i"])))

    def search(hashes):
        pairs = F.sort_array(F.transform(
            hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")) \
            .otherwise(let(pairs, repeated))

    def windows(w):
        starts = F.when(F.size(w) >= 3, F.sequence(F.lit(0), F.size(w) - 3)) \
            .otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    return let(windows(words), search)


def measures(text: Column) -> Column:
    """A struct of the measurements of a text."""
    t = F.coalesce(text, F.lit(""))

    def of(t):
        words = F.filter(F.split(t, BLANKS), lambda w: w != "")
        lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
        squeezed = F.length(F.regexp_replace(t, BLANKS, ""))
        symbols = F.length(t) - F.length(F.translate(t, SYMBOLS, ""))
        return let(words, lambda w: let(lines, lambda ls: F.struct(
            F.size(w).cast("long").alias("n_words"),
            squeezed.cast("long").alias("word_chars"),
            symbols.cast("long").alias("n_symbols"),
            (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
            _covered(w).alias("n_repeat_words"),
            F.size(ls).cast("long").alias("n_lines"))))

    return let(t, of)


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measurements and ``failed``, the bitmask of the rules not met."""
    out = docs.drop(*(set(MEASURES) | {"failed"}) - {text}) \
        .withColumn("__m", measures(F.col(text)))
    out = out.select(*[c for c in out.columns if c != "__m"], *[F.col(f"__m.{m}").alias(m) for m in MEASURES])
    failed = F.lit(0).cast("long")
    for name, condition in RULES:
        failed = failed.bitwiseOR(F.when(F.expr(condition), F.lit(BIT[name])).otherwise(F.lit(0)).cast("long"))
    return out.withColumn("failed", failed)


def apply_policy(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Adds ``kept``: no bit of the policy is set."""
    return rows.withColumn("kept", F.col("failed").bitwiseAND(F.lit(POLICIES[policy]).cast("long")) == 0)


def ablation(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Per rule of the policy: texts that fail it, that fail it alone, and the rejected without it."""
    mask = POLICIES[policy]
    bits = F.col("failed").bitwiseAND(F.lit(mask).cast("long"))
    one = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    aggs = []
    names = [n for n, _ in RULES if BIT[n] & mask]
    for n in names:
        rest = bits.bitwiseAND(F.lit(mask & ~BIT[n]).cast("long"))
        aggs += [one(bits.bitwiseAND(F.lit(BIT[n]).cast("long")) != 0).alias(f"f_{n}"),
                 one(bits == BIT[n]).alias(f"a_{n}"), one(rest != 0).alias(f"r_{n}")]
    total = rows.agg(*aggs)
    return total.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("rule"), F.col(f"f_{n}").alias("failing"),
                 F.col(f"a_{n}").alias("failing_alone"), F.col(f"r_{n}").alias("rejected_without"))
        for n in names])))


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    rows = apply_policy(ledger(table(spark, sf_dir, "documents", "doc_id", "text")))
    base = F.col("failed").bitwiseAND(F.lit(BASE).cast("long")) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                       "n_repeat_words", base.alias("base_failed"), "kept")


ORACLE_SQL = {
    "op5_quality_rules": r"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
w as (select r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w, string_split(t, chr(10)) as l, t, doc_id from d),
g as (select r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g
      from (select r, w, unnest(range(1, len(w) - 1)) as i from w where len(w) >= 3)),
rep as (select r, i from (select r, i, count(*) over (partition by r, g) as c from g) where c >= 2),
cov as (select r, count(*) as n from (select distinct r, i + k as p from rep, (values (0), (1), (2)) v(k)) group by r),
m as (select w.r, doc_id, len(w)::bigint as n_words,
  length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
  list_filter(l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls, coalesce(cov.n, 0)::bigint as n_repeat_words
  from w left join cov on cov.r = w.r),
f as (select *, len(ls)::bigint as n_lines, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
  (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or 10 * n_symbols > 3 * n_words or (n_lines >= 4 and 100 * n_dup_lines > 50 * n_lines)
       or (n_words > 0 and word_chars < 2 * n_words) or word_chars > 40 * n_words) as kept
from f
""",
}
