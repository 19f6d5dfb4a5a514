"""Secret scans over a trigram inverted index, in DataFrame expressions only.

For each rule a Boolean trigram query is derived from its regex (``trigram_query``). The index holds
postings (trigram, document key) for the trigrams that some rule asks for. Intersecting postings is a
relational division: an alternative holds where a document has all its trigrams, a clause where one
alternative holds, a rule where all its clauses hold. Candidates are then verified by the regex
itself. Rules without a mandatory trigram (runs of hex digits) scan every text.

Spans are in code points, end exclusive. The key of a document is a hash of doc_id and text; a
collision can only add a candidate, which verification settles, so no id has to be unique or non-null.

Scale: a document yields at most one posting per indexed trigram (a few dozen), postings are shuffled
by document key. Candidates, a key and its rules' names each, are written and broadcast where there are few of
them; else texts are shuffled once to meet them. No key is hot, because keys are per document. Copies that repeat doc_id and text share a key, and the equi-join with the (distinct)
candidates is split by adaptive execution if one is hot.

Edge cases: null text counts as empty and gives zero counts, the hash of the empty string and an empty
span list; rows that repeat are answered row by row; an empty table gives an empty result; other
columns are ignored. Very long texts are scanned whole, in one task each, in time that grows as their length and number of
matches do; spans that start at one place are in the order of the rules.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.textnorm import text_or_empty
from leafmill.llm.totals import bound, totals_before
from leafmill.llm.trigram_query import trigram_query
from leafmill.session import broadcast_if_small, materialize


@dataclass(frozen=True)
class Rule:
    """``pattern``: regex without capturing groups except one around ``measured`` where that is set.
    A match counts if the measured part (group 1, or the whole match) has ``least`` characters."""

    kind: str
    pattern: str
    least: int = 1
    measured: bool = False
    base: bool = True


RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
    Rule("hosttoken", r"gh[opsu]_[A-Za-z0-9]+", 40, base=False),
    Rule("keyblock", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", base=False),
)

SPAN = "array<struct<start:int,ord:int,kind:string,stop:int>>"


def index_postings(keyed: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Postings (trigram, key) of the trigrams that the rules' queries name."""
    grams = sorted({g for r in rules for c in trigram_query(r.pattern) for a in c for g in a})
    low = keyed.select("key", F.lower("text").alias("low"))
    hits = F.array_compact(F.array(*[F.when(F.contains(F.col("low"), F.lit(g)), F.lit(g)) for g in grams]))
    return low.select("key", F.explode(hits).alias("trigram"))


def candidates(postings: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Documents that satisfy a rule's trigram query: key, kinds (array of rule kinds)."""
    spark = postings.sparkSession
    wanted, clauses = [], {}
    for r in rules:
        query = trigram_query(r.pattern)
        clauses[r.kind] = len(query)
        for c, clause in enumerate(query):
            wanted += [(r.kind, c, a, g, len(grams)) for a, grams in enumerate(clause) for g in sorted(grams)]
    terms = spark.createDataFrame(wanted or [("", 0, 0, "", 1)], "kind string, clause int, alt int, trigram string, n int")
    full = F.element_at(F.create_map(*[F.lit(x) for kv in clauses.items() for x in kv]), F.col("kind"))
    # The term list is as long as the rules' texts, whatever the data: its broadcast is bounded.
    return (
        postings.join(F.broadcast(terms), "trigram")
        .groupBy("key", "kind", "clause", "alt", "n")
        .agg(F.count_distinct("trigram").alias("have"))
        .where("have = n")
        .groupBy("key", "kind")
        .agg(F.count_distinct("clause").alias("held"))
        .where(F.col("held") == full)
        .groupBy("key")
        .agg(F.collect_set("kind").alias("kinds"))
    )


def _spans(text: Column, rule: Rule, ord_: int) -> Column:
    """All leftmost non-overlapping matches of the rule, those that are too short left out."""
    # Text before each match and the match itself, one after the other, give the offsets.
    paced = rf"\G((?s:.*?))({rule.pattern})"
    part = lambda k: F.regexp_extract_all(text, F.lit(paced), F.lit(k))
    pieces = F.arrays_zip(part(1).alias("gap"), part(2).alias("hit"), part(3 if rule.measured else 2).alias("own"))

    def one(x: Column, before: Column) -> Column:
        start = (before + F.length(x["gap"])).cast("int")
        stop = start + F.length(x["hit"])
        span = F.struct(start.alias("start"), F.lit(ord_).alias("ord"), F.lit(rule.kind).alias("kind"), stop.alias("stop"))
        return F.when(F.length(x["own"]) >= rule.least, span)

    def spans(found: Column) -> Column:
        sizes = F.transform(found, lambda x: (F.length(x["gap"]) + F.length(x["hit"])).cast("long"))
        return F.array_compact(F.zip_with(found, totals_before(sizes), one))

    return bound(pieces, spans)


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text) with ``found``: all spans by start, then rule."""
    keyed = docs.select("doc_id", text_or_empty(F.col("text")).alias("text"))
    keyed = keyed.withColumn("key", F.xxhash64("doc_id", "text"))
    indexed = tuple(r for r in rules if trigram_query(r.pattern))
    hits = candidates(index_postings(keyed, indexed), indexed)
    none = F.array().cast(SPAN)
    per_rule = []
    for n, rule in enumerate(rules):
        if rule in indexed:
            wanted = F.array_contains(F.col("kinds"), rule.kind)
            spans = _spans(F.col("text"), rule, n)
        else:
            # A run of at least this many class characters is what the plain rule finds and keeps.
            least = Rule(rule.kind, rule.pattern.removesuffix("+") + f"{{{rule.least},}}", rule.least)
            wanted, spans = F.col("text").rlike(least.pattern), _spans(F.col("text"), least, n)
        per_rule.append(F.when(wanted, spans).otherwise(none))
    joined = keyed.join(broadcast_if_small(materialize(hits, "candidates")), "key", "left")
    return joined.select("doc_id", F.array_sort(F.concat(*per_rule)).alias("found"))


def _listed(spans: Column) -> Column:
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def secret_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, a count per base kind, base_sha256 and spans."""
    base = [r for r in rules if r.base]
    of = lambda kinds: F.filter("found", lambda s: s["kind"].isin(kinds))
    return scan_secrets(docs, rules).select(
        "doc_id",
        *[F.size(of([r.kind])).cast("long").alias(f"n_{r.kind}") for r in base],
        F.sha2(_listed(of([r.kind for r in base])), 256).alias("base_sha256"),
        _listed(F.col("found")).alias("spans"),
    )


def _sql_rule(rule: Rule, ord_: int) -> str:
    quoted = rule.pattern.replace("'", "''")
    own = 3 if rule.measured else 2
    return f"""
  SELECT rid, start, {ord_} AS ord, '{rule.kind}' AS kind, start + length(hit) AS stop, {rule.base} AS base FROM (
    SELECT rid, hit, own, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0) AS start
    FROM (SELECT rid, gaps, hits, unnest(hits) AS hit, unnest(owns) AS own, unnest(range(1, len(hits) + 1)) AS i FROM (
      SELECT rid, regexp_extract_all(text, '(?s:(.*?))({quoted})', 1) AS gaps, regexp_extract_all(text, '(?s:(.*?))({quoted})', 2) AS hits,
             regexp_extract_all(text, '(?s:(.*?))({quoted})', {own}) AS owns FROM d)))
  WHERE length(own) >= {rule.least}"""


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    base = [r for r in rules if r.base]
    counts = ",\n       ".join(f"CAST(coalesce(count(*) FILTER (WHERE kind = '{r.kind}'), 0) AS BIGINT) AS n_{r.kind}" for r in base)
    listed = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord{}){}"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
spans AS ({" UNION ALL ".join(_sql_rule(r, n) for n, r in enumerate(rules))})
SELECT any_value(doc_id) AS doc_id,
       {counts},
       sha256(coalesce({listed.format("", " FILTER (WHERE base)")}, '')) AS base_sha256,
       coalesce({listed.format("", " FILTER (WHERE kind IS NOT NULL)")}, '') AS spans
FROM d LEFT JOIN spans USING (rid) GROUP BY rid
"""
