"""Rule bitmask ledger: rules are evaluated once, policies are masks over the stored bits.

ledger() measures each text, and sets one bit per failed rule. A policy names the
rules it applies and has a version; judge() applies it with a bitwise AND, and
ablations() counts, from the stored bits alone, what each policy and each policy
without one of its rules would keep. Everything is built-in DataFrame functions.

A word is a run of characters other than space and the ASCII controls tab to
return. null text: no words, so it fails few_words. Windows are compared by
64-bit hashes of their words. Very long texts: whole, in one row's arrays. Repeated rows: judged each. No rows: no rows.
Columns of other names pass through judge(); ledger() alone reads text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, staged

#: Fixed value: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Name and SQL condition of failure, over the measurements; a rule's bit is its place here.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "2 * n_dup_lines > n_lines"),
    ("word_length", "n_words > 0 and (word_chars < 2 * n_words or word_chars > 16 * n_words)"),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
WINDOW = 5


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << [r for r, _ in RULES].index(x) for x in self.rules)

    def without(self, rule: str) -> Policy:
        return Policy(f"{self.name}-{rule}", self.version, tuple(x for x in self.rules if x != rule))


BASE = Policy("base", 1, ("few_words", "repeated_windows"))
STANDARD = Policy("standard", 1, tuple(r for r, _ in RULES))


def let(value: Column, body) -> Column:
    """body(value), with value computed once for each row however often body names it."""
    return F.transform(F.array(value), body)[0]


def repeated(words: Column) -> Column:
    """Words that lie in windows found twice or more."""
    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))

    def covered(h: Column) -> Column:
        ranked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = lambda k, j: s[k]["h"] == s[j]["h"]
            last = F.size(s) - 1
            return F.filter(F.transform(F.sequence(F.lit(0), last), lambda k: F.when((k > 0) & same(k, F.greatest(k - 1, F.lit(0))) | (k < last) & same(k, F.least(k + 1, last)), s[k]["i"])), lambda x: x.isNotNull())

        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
        grow = lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n"))
        return F.aggregate(F.sort_array(let(ranked, places)), start, grow, lambda a: a["n"])

    counted = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(counted)


def ledger(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """docs with the measurements and failed (long: the bits of failed rules); names start with prefix."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(t, f"{SPACE}+", -1), lambda w: w != "")
    of_words = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated(w).cast("long").alias("n_repeat_words"), F.char_length(F.array_join(w, "")).cast("long").alias("word_chars")))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.translate(x, " \t\n\x0b\x0c\r", "") != "")
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    symbols = (F.char_length(t) - F.char_length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols")
    seen = docs.select("*", of_words.alias(f"{prefix}__w"), of_lines.alias(f"{prefix}__l"), symbols.alias(f"{prefix}n_symbols"))
    where = {"n_words": "__w", "n_repeat_words": "__w", "word_chars": "__w", "n_lines": "__l", "n_dup_lines": "__l"}
    seen = seen.withColumns({f"{prefix}{m}": F.col(f"{prefix}{c}")[m] for m, c in where.items()}).drop(f"{prefix}__w", f"{prefix}__l")
    bits = "0L"
    for k, (_, rule) in enumerate(RULES):
        for m in sorted(MEASURES, key=len, reverse=True):
            rule = rule.replace(m, f"`{prefix}{m}`") if f"`{prefix}{m}`" not in rule else rule
        bits += f" | if({rule}, {1 << k}L, 0L)"
    return seen.withColumn(f"{prefix}failed", F.expr(bits))


def stored(docs: DataFrame) -> DataFrame:
    """The ledger of docs, written without the texts: doc_id, measurements, failed. Policies and ablations read it alone."""
    return staged(ledger(docs.select("doc_id", "text")).drop("text"), "rules")


def judge(rows: DataFrame, policy: Policy = STANDARD, failed: str = "failed") -> Column:
    """Whether the policy keeps a row, from its stored bits."""
    return F.col(failed).bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def ablations(rows: DataFrame, policies: list[Policy], failed: str = "failed") -> DataFrame:
    """policy, version, n_docs, n_kept of each policy and of it without each of its rules.

    Rows are summed by their bits first: at most one group per combination of rules, however many rows.
    """
    patterns = rows.groupBy(F.col(failed).alias("bits")).count()
    tried = _tried(policies)
    each = F.explode(F.array(*(F.struct(F.lit(p.name).alias("policy"), F.lit(p.version).alias("version"), F.lit(p.mask).cast("long").alias("mask")) for p in tried)))
    flat = patterns.select("bits", "count", each.alias("p")).select("bits", "count", "p.*")
    return flat.groupBy("policy", "version").agg(F.sum("count").alias("n_docs"), F.sum(F.when(F.expr("bits & mask") == 0, F.col("count")).otherwise(0)).alias("n_kept"))


def report(docs: DataFrame, policy: Policy = STANDARD) -> DataFrame:
    """doc_id, measurements, base_failed, kept and the failed bits of every text."""
    rows = stored(docs)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~judge(rows, BASE)).alias("base_failed"), (judge(rows, BASE) & judge(rows, policy)).alias("kept"), "n_lines", "failed")


#: Policies whose ablations are reported: of the same rules, in versions.
POLICIES = (BASE, Policy("base", 2, (*BASE.rules, "duplicate_lines")), STANDARD)


_FACTS = r"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
m as (
  select r, doc_id, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols
  from d),
x5 as (select r, unnest(w) as x, generate_subscripts(w, 1) as i from m),
win as (select r, i, x || ' ' || lead(x, 1) over o || ' ' || lead(x, 2) over o || ' ' || lead(x, 3) over o || ' ' || lead(x, 4) over o as five from x5 window o as (partition by r order by i)),
hot as (select r, i from (select r, i, count(*) over (partition by r, five) as n from win where five is not null) where n > 1),
rep as (select r, count(distinct p) as n from (select r, unnest(range(i, i + 5)) as p from hot) group by r),
x as (
  select m.doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars, n_symbols::bigint as n_symbols,
    (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words, len(l)::bigint as n_lines
  from m left join rep using (r)),
b as (select *, (n_words < 10)::bigint + 2 * (100 * n_repeat_words > 20 * n_words)::bigint + 4 * (10 * n_symbols > n_words)::bigint
    + 8 * (2 * n_dup_lines > n_lines)::bigint + 16 * (n_words > 0 and (word_chars < 2 * n_words or word_chars > 16 * n_words))::bigint as failed from x)
"""
ORACLE = f"""{_FACTS}select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 as base_failed, failed = 0 as kept, n_lines, failed from b"""


def _tried(policies) -> list[Policy]:
    return list(dict.fromkeys(q for p in policies for q in [p, *(p.without(r) for r in p.rules)]))


ABLATIONS_ORACLE = f"""{_FACTS}select policy, version, count(*)::bigint as n_docs, count(*) filter (failed & mask = 0)::bigint as n_kept from b, (values {", ".join(f"('{p.name}', {p.version}, {p.mask})" for p in _tried(POLICIES))}) t(policy, version, mask) group by policy, version"""
