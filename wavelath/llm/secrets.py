"""Secret scans with an incremental blob ledger, in built-in DataFrame functions.

Every version of a file is known by the SHA-256 of its text. The ledger holds
what was found for each pair of blob and rule version; a scan reads only texts of
pairs that the ledger lacks, each distinct text once, and joins the findings back
to all paths. The ledger is written before it is used, so that nothing is scanned twice.
A finding is kind:start:end in code points, end exclusive.

A scan gives the lengths of the matches and of what lies between them; places are running
sums over one narrow row for each match, so the work is in proportion to text and findings.

null text: an empty blob, without findings. Very long texts: scanned whole, as any other. Repeated rows and copies: each path
gets its blob's findings. No rows: no findings. Only the key and text are read; other columns
pass through redact(), inner names start with two underscores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Raise it when RULES change: then all blobs count as unseen.
RULE_VERSION = 2
#: Kind, Java pattern, least length of the whole match (group 0) or of the value (group 2), in the order of the report.
BASE_RULES: tuple[tuple[str, str, int, int], ...] = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    # Runs of 24 or more, which are the runs [0-9a-f]+ that pass: a run that is shorter holds no match.
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
MORE_RULES: tuple[tuple[str, str, int, int], ...] = (
    # With the key's lines and the end line, or as far as the lines go.
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\r\n]*(?:-----END [A-Z ]*PRIVATE KEY-----)?", 0, 1),
    ("bearer", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
)
RULES = BASE_RULES + MORE_RULES
#: A finding: code points start to end; bytes first to last; and, if no earlier finding reaches into it, the byte where the last one before ends.
FINDINGS = "array<struct<start:bigint,ord:int,kind:string,end:bigint,first:bigint,last:bigint,after:bigint>>"


def lengths(text: Column, pattern: str, group: int) -> Column:
    """Of a rule's leftmost non-overlapping matches: gap (before it), size and value in code points, and gap and size in bytes."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    # The pieces between matches and the matches themselves alternate; the last piece stands after all.
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("hit"), value.alias("value"))
    sizes = lambda x: F.struct(F.char_length(x["gap"]).alias("gap"), F.char_length(x["hit"]).alias("hit"), F.char_length(x["value"]).alias("value"), F.octet_length(x["gap"]).alias("gap_bytes"), F.octet_length(x["hit"]).alias("hit_bytes"))
    return F.when(text.rlike(pattern), F.filter(F.transform(zipped, sizes), lambda x: x["hit"].isNotNull()))


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(blobs: DataFrame, rules=RULES) -> DataFrame:
    """blob, rule_version and found of rows (blob, text), one for each blob; those without findings too."""
    seen = staged(blobs.select("blob", *(lengths(F.col("text"), pattern, group).alias(f"k{i}") for i, (_, pattern, group, _) in enumerate(rules))), "scans")
    some = seen.where(" or ".join(f"k{i} is not null" for i in range(len(rules))))
    kinds = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(kind).alias("kind"), F.lit(least).alias("least"), F.col(f"k{i}").alias("m")) for i, (kind, _, _, least) in enumerate(rules)))
    each = some.select("blob", F.explode(kinds).alias("r")).where("r.m is not null")
    each = each.select("blob", "r.ord", "r.kind", "r.least", F.posexplode("r.m").alias("place", "m")).select("blob", "ord", "kind", "least", "place", "m.*")
    until = Window.partitionBy("blob", "ord").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("end", F.sum(F.col("gap") + F.col("hit")).over(until)).withColumn("last", F.sum(F.col("gap_bytes") + F.col("hit_bytes")).over(until)).where("value >= least")
    each = each.withColumn("start", F.col("end") - F.col("hit")).withColumn("first", F.col("last") - F.col("hit_bytes"))
    ahead = F.coalesce(F.max("last").over(Window.partitionBy("blob").orderBy("start", "ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = each.withColumn("after", F.when(F.col("first") >= ahead, ahead))
    found = each.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", "ord", "kind", "end", "first", "last", "after"))).alias("found"))
    return seen.select("blob").join(found, "blob", "left").select("blob", F.lit(RULE_VERSION).alias("rule_version"), F.coalesce("found", F.array()).cast(FINDINGS).alias("found"))


def update(docs: DataFrame, ledger: DataFrame | None = None, rules=RULES, text: str = "text") -> DataFrame:
    """The ledger (blob, rule_version, found), written, grown by docs' unseen pairs; those alone are scanned."""
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).select(F.sha2("text", 256).alias("blob"), "text")
    if ledger is not None:
        rows = rows.join(ledger.where(F.col("rule_version") == RULE_VERSION).select("blob"), "blob", "left_anti")
    unseen = scan(rows.groupBy("blob").agg(F.first("text").alias("text")), rules)
    return staged(unseen if ledger is None else ledger.unionByName(unseen), "ledger")


def paths(docs: DataFrame, ledger: DataFrame, text: str = "text") -> DataFrame:
    """docs with __found, their blobs' findings; blobs without any need no join partner."""
    hits = ledger.where((F.col("rule_version") == RULE_VERSION) & (F.size("found") > 0)).select(F.col("blob").alias("__blob"), F.col("found").alias("__found"))
    named = docs.withColumn("__blob", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    return named.join(hits, "__blob", "left").drop("__blob")


def report(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every text."""
    # Only the key and the digest of a path go to the join.
    rows = paths(docs.select("doc_id", "text"), update(docs, ledger)).withColumn("__found", F.coalesce("__found", F.array().cast(FINDINGS)))
    count = lambda kind: F.size(F.filter("__found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("__found", lambda s: s["ord"] < len(BASE_RULES))
    return rows.select("doc_id", *(count(r[0]) for r in BASE_RULES), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("__found")).alias("spans"))


def redact(docs: DataFrame, ledger: DataFrame, mask: str = "[secret]", text: str = "text") -> DataFrame:
    """docs with the spans found in their texts replaced; overlapping spans become one."""
    own = F.filter("__found", lambda s: s["after"].isNotNull())

    def clean(raw: Column) -> Column:
        part = lambda first, last: F.substring(raw, (first + 1).cast("int"), (last - first).cast("int")).cast("string")
        rest = part(F.array_max(F.transform("__found", lambda s: s["last"])), F.octet_length(raw).cast("long"))
        return F.array_join(F.concat(F.transform(own, lambda s: part(s["after"], s["first"])), F.array(rest)), mask)

    # The text's bytes are made once for each row, not for each finding.
    clean = F.transform(F.array(F.col(text).cast("binary")), clean)[0]
    return paths(docs, ledger, text).withColumn(text, F.when(F.col("__found").isNotNull(), clean).otherwise(F.col(text))).select(*(F.col(f"`{c}`") for c in docs.columns))


def _oracle_rule(order: int, kind: str, pattern: str, group: int, least: int) -> str:
    p = pattern.replace("'", "''")
    gaps, hits = f"string_split_regex(t, '{p}')", f"regexp_extract_all(t, '{p}', 0)"
    return f"""select r, {order} as ord, '{kind}' as kind, s as start, s + length(h) as fin from (
      select r, hits[k] as h, vals[k] as v, (list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:k-1], lambda x: length(x))), 0))::bigint as s
      from (select r, gaps, hits, vals, unnest(range(1, len(hits) + 1)) as k from (select r, {gaps} as gaps, {hits} as hits, regexp_extract_all(t, '{p}', {group}) as vals from d))) where length(v) >= {least}"""


ORACLE = f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
s as ({" union all ".join(_oracle_rule(k, *r) for k, r in enumerate(RULES))}),
g as (
  select r, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
    string_agg(kind || ':' || start || ':' || fin, ',' order by start, ord) filter (ord < {len(BASE_RULES)}) as base, string_agg(kind || ':' || start || ':' || fin, ',' order by start, ord) as spans
  from s group by r)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join g using (r)
"""
