"""Operator 3: secret scans through a trigram inverted index (DataFrame functions only).

Each rule's regular expression yields a Boolean trigram query (trigrams.py). The index
holds postings (trigram, document) of the trigrams that some query asks for; a rule's
candidates come from intersecting its clauses' postings. Only candidates are verified
with the regular expression; a rule without mandatory trigrams scans every text.

Base rules: assign, access and hex. Rules that the method adds: github, jwt and pem.
Spans are code points, end exclusive, leftmost and non-overlapping for each rule.

Null and empty texts have no spans; an empty table stays empty. Rows that share an id (null
included) are each verified on their own text; equal rows get equal spans. Matches of
several rules may overlap; spans are ordered by start, then rule. Columns of the table keep
their values, whatever their names, but for `spans`, which replaces one that it had. A text
of any length is matched whole, by one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import trigrams
from ._common import free_name


@dataclass(frozen=True)
class Rule:
    """pattern for Python and Java alike; checked: the group that must be least long, 0 the match."""

    kind: str
    pattern: str
    checked: int = 0
    least: int = 0


# The base rules' patterns. A run of fewer than 16 hex digits, or of fewer than
# 14 characters after AKIA, can't hold a longer one, so the length may stand in the pattern.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
ADDED = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"),
)
RULES = BASE + ADDED
MASK = "[SECRET]"


def postings(df: DataFrame, id_col: str, text_col: str, wanted: list[str]) -> DataFrame:
    """The index: (trigram, id), a row for each wanted trigram that a text contains."""
    low = df.select(F.col(id_col).alias("_id"), F.lower(text_col).alias("_low"))
    found = F.array_compact(F.array(*(F.when(F.contains("_low", F.lit(t)), F.lit(t)) for t in wanted)))
    return low.select("_id", F.explode(found).alias("trigram"))


def candidates(df: DataFrame, id_col: str, text_col: str, rules: tuple[Rule, ...]) -> DataFrame:
    """(_id, _kinds): by id, the rules whose query its postings satisfy; rules that scan fully aren't in it."""
    spark = df.sparkSession
    terms = [(t, r.kind, i, len(c)) for r in rules for i, c in enumerate(trigrams.query(r.pattern) or []) for t in sorted(c)]
    # A row for each trigram of each clause: its size is that of the rules.
    rows = F.array(*(F.struct(*map(F.lit, t)) for t in terms)).cast("array<struct<trigram:string,kind:string,clause:int,needs:int>>")
    wanted = F.broadcast(spark.range(1).select(F.inline(rows)))
    hits = postings(df, id_col, text_col, sorted({t[0] for t in terms}) or ["\0\0\0"]).join(wanted, "trigram")
    # Rows that share an id are one entry here: distinct terms are counted, and each row's text is verified.
    met = hits.groupBy("_id", "kind", "clause", "needs").agg(F.count_distinct("trigram").alias("has")).filter("has = needs")
    return met.groupBy("_id").agg(F.collect_set("kind").alias("_kinds"))


def matches(text: Column, rule: Rule) -> Column:
    """array<struct<start, rank, end>> of a rule's spans: match lengths and the lengths between matches, summed."""
    rank = [r.kind for r in RULES].index(rule.kind)
    rx = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, rx, F.lit(0))
    part = F.regexp_extract_all(text, rx, F.lit(rule.checked)) if rule.checked else whole
    between = F.split(text, rule.pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,rank:int,end:int>>").alias("out"))
    joined = F.arrays_zip(between.alias("gap"), whole.alias("hit"), part.alias("part"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.coalesce(F.length(x["hit"]), F.lit(0))
        keep = x["hit"].isNotNull() & (F.length(x["part"]) >= rule.least)
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(keep, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(joined, start, step, lambda acc: acc["out"])


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """df with spans array<struct<start, rank, end>>, by start and then rule; rank counts RULES."""
    df = df.drop("spans")
    text = free_name(df, "text")
    by_id = candidates(df, id_col, text_col, rules).alias("c")
    nothing = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    known = df.withColumn(text, F.coalesce(text_col, F.lit(""))).alias("d")
    joined = known.join(by_id, F.col(f"d.`{id_col}`").eqNullSafe(F.col("c._id")), "left")
    found = []
    for rule in rules:
        spans = matches(F.col(f"d.{text}"), rule)
        indexed = trigrams.query(rule.pattern) is not None
        found.append(F.when(F.array_contains("c._kinds", rule.kind), spans).otherwise(nothing) if indexed else spans)
    return joined.select(*(F.col(f"d.`{c}`") for c in df.columns), F.array_sort(F.concat(*found)).alias("spans"))


def span_list(spans: Column, ranks: range) -> Column:
    """kind:start:end of the spans of some rules, comma-joined."""
    names = F.array(*(F.lit(r.kind) for r in RULES))
    kept = F.filter(spans, lambda s: s["rank"].between(ranks.start, ranks.stop - 1))
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ",")


def redact(text: Column, spans: Column) -> Column:
    """text with each maximal run of overlapping spans replaced by MASK."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], gap, F.lit(MASK))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text")
    count = lambda i: F.size(F.filter("spans", lambda s: s["rank"] == i)).cast("bigint")
    return docs.select(
        "doc_id",
        *(count(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE)),
        F.sha2(span_list(F.col("spans"), range(len(BASE))), 256).alias("base_sha256"),
        span_list(F.col("spans"), range(len(RULES))).alias("spans"),
    )


def _sql() -> str:
    """The same spans in DuckDB's words: a full scan by every rule."""
    parts = []
    for rank, r in enumerate(RULES):
        rx = r.pattern.replace("'", "''")
        parts.append(f"""
  SELECT k, {rank} AS rank, '{r.kind}' AS kind, unnest(list_filter(list_transform(range(1, len(m) + 1), lambda i: struct_pack(
      s := list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0),
      n := length(m[i]), c := length(g[i]))), lambda x: x.c >= {r.least})) AS u
  FROM (SELECT k, string_split_regex(t, '{rx}') AS p, regexp_extract_all(t, '{rx}') AS m, regexp_extract_all(t, '{rx}', {r.checked}) AS g FROM d)""")
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(parts)}),
s AS (SELECT k, rank, CAST(u.s AS BIGINT) AS b, kind || ':' || CAST(u.s AS BIGINT) || ':' || CAST(u.s + u.n AS BIGINT) AS x FROM f),
a AS (SELECT k, count(*) FILTER (rank = 0) AS n0, count(*) FILTER (rank = 1) AS n1, count(*) FILTER (rank = 2) AS n2,
  string_agg(x, ',' ORDER BY b, rank) FILTER (rank < {len(BASE)}) AS base, string_agg(x, ',' ORDER BY b, rank) AS every FROM s GROUP BY k)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans FROM d LEFT JOIN a USING (k)"""


QUERIES = {"op3_secrets": op3_secrets}
SQL = {"op3_secrets": _sql()}
