"""Operator 5: mixing sources to target weights by subset-sum budget fitting.

A document's size is its number of words. A source's target is its weighted share of all
words, at most REPEATS times its own; what a source can't take goes to the others by
weight (water filling, closed form over the sorted ratios). A source takes every document
target div source_size times. For the rest of its budget:

* documents are counted by exact size. A budget of up to RESIDUE words goes to a bounded-
  knapsack dynamic programme over all sizes, which gets as near under it as any subset does;
* of a larger budget each size first yields its proportional part, and the programme fits what
  remains with the documents still free: to the word where their sizes allow it, as they do
  with many sizes, and as near under it as any subset of the free ones gets;
* documents of a size are picked in the order of a seeded hash.

A plan's input is a row for each size of a source, not for each document. Each size of a
source is cut into slices of the hash's range, so many that a slice of the largest group
has about SLICE_ROWS documents. Slices before the one where the wanted count is reached are
taken whole, so only documents of one slice are ever ranked together, and a group that holds
a third of all rows is spread over its slices. Windows over all sources see a row for each.

Null and empty texts have size 0 and are taken 0 times; an empty table stays empty. A null
source is a source, the last. Documents rank by (hash of id, id, hash of text if it is
there); equal rows may swap. Columns of the table keep their values, whatever their names,
but for the result's own (size, source_size, target, taken), which replace any that it had.
A text's length doesn't matter: only its number of words goes on.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import stage

WEIGHTS = (1, 2, 3)
REPEATS = 3
SLICE_ROWS = 4096
SEED = 17
RESIDUE = 1 << 16


def word_count(text):
    """Number of [^\\x20\\x09-\\x0D]+; a null text has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, size): a row for each source.

    The windows run over one row for each source, not over documents.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(WEIGHTS))) + 1)
    ranked = totals.withColumn("weight", weight.cast("double"))
    # In the order of the level at which a source is full, the first sources with full < level stop there.
    by_level = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    every, before = Window.partitionBy(), by_level.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) - REPEATS * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    share = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    stepped = ranked.withColumn("level", left / share).withColumn("full", REPEATS * F.col("source_size") <= F.col("level") * F.col("weight"))
    level = F.min(F.when(~F.col("full"), F.struct(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(Window.partitionBy())["level"]
    filled = F.when(F.col("full"), F.lit(float(REPEATS)) * F.col("source_size")).otherwise(F.col("weight") * F.col("_level"))
    return stepped.withColumn("_level", level).select("source", "source_size", F.coalesce(filled, F.lit(0.0)).alias("target"))


def fit(sizes: np.ndarray, free: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each size to take, free[i] of sizes[i] at most, so that their words come near budget from below."""
    take = np.zeros(len(sizes), np.int64)
    total = int((sizes * free).sum())
    if budget <= 0 or not total:
        return take
    if budget >= total:
        return free.copy()
    if budget <= RESIDUE:
        return knapsack(sizes, free, budget)
    take = free * budget // total if total < (1 << 31) else np.floor(free * (budget / total)).astype(np.int64)
    left = budget - int((take * sizes).sum())
    # Large sizes first, until the residue is small enough for the table; one document is kept back where there's one.
    for i in np.argsort(-sizes, kind="stable"):
        if left <= RESIDUE:
            break
        more = min(int(free[i] - take[i]), (left - RESIDUE // 2) // int(sizes[i]))
        if more > 0:
            take[i] += more
            left -= more * int(sizes[i])
    # A few documents go back, so that the programme has sizes to choose from.
    for i in np.argsort(sizes, kind="stable"):
        if left + sizes[i] > RESIDUE:
            break
        back = min(int(take[i]), 2, int((RESIDUE - left) // sizes[i]))
        take[i] -= back
        left += back * int(sizes[i])
    return take + knapsack(sizes, free - take, left)


def knapsack(sizes: np.ndarray, free: np.ndarray, budget: int) -> np.ndarray:
    """Bounded knapsack: the counts whose words come nearest under budget. Counts are split into powers of two."""
    items = []
    for i, (size, n) in enumerate(zip(sizes.tolist(), free.tolist(), strict=True)):
        n, k = min(n, budget // size), 1
        while n > 0:
            k = min(k, n)
            items.append((i, k, k * size))
            n, k = n - k, 2 * k
    by = np.full(budget + 1, -1, np.int32)
    by[0] = len(items)
    for at, (_, _, weight) in enumerate(items):
        if weight <= budget:
            # A sum's entry is the first item that reaches it, so its predecessor uses earlier items only.
            new = (by[: budget + 1 - weight] >= 0) & (by[weight:] < 0)
            by[weight:][new] = at
        if by[budget] >= 0:
            break
    take = np.zeros(len(sizes), np.int64)
    at = int(np.flatnonzero(by >= 0).max())
    while at:
        i, k, weight = items[by[at]]
        take[i] += k
        at -= weight
    return take


def _plan(frame: pd.DataFrame) -> pd.DataFrame:
    """Of one source's counts by size: how often all documents are taken, and how many of each size once more."""
    source_size, target = int(frame.source_size.iloc[0]), float(frame.target.iloc[0])
    times = min(REPEATS, int(target // source_size)) if source_size else 0
    frame = frame.sort_values("size")
    sizes, free = frame["size"].to_numpy(np.int64), frame["n"].to_numpy(np.int64)
    budget = int(round(target)) - times * source_size if times < REPEATS else 0
    some = sizes > 0
    want = np.zeros(len(sizes), np.int64)
    want[some] = fit(sizes[some], free[some], budget)
    return pd.DataFrame({"source": frame.source, "size": sizes, "times": np.int32(times), "want": want, "source_size": source_size, "target": target})


RESULT = ("size", "source_size", "target", "taken")


def mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """df with size, source_size, target and taken (words taken, repeats counted)."""
    return mix_sized(df.withColumn("size", word_count(F.col(text_col))), id_col, source_col, seed, F.xxhash64(text_col))


def mix_sized(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", seed: int = SEED, last=None) -> DataFrame:
    """mix() for rows that have their size; last: what ranks rows of one id."""
    kept = [c for c in df.columns if c not in RESULT]
    docs = df.select(F.struct(*kept).alias("row"), F.col("size"), F.col(source_col).alias("source"), F.col(id_col).alias("id"), F.xxhash64(F.lit(seed), id_col).alias("key"), (F.lit(0) if last is None else last).alias("last"))
    counts = stage(docs.groupBy("source", "size").agg(F.count("*").alias("n")), "sizes")
    slices = max(1, -(-(counts.agg(F.max("n")).first()[0] or 0) // SLICE_ROWS))
    by_source = targets(counts.select("source", (F.col("size") * F.col("n")).alias("size")))
    # A source's distinct sizes are few: d of them need d*d/2 words at least.
    asked = counts.alias("c").join(by_source.alias("t"), F.expr("c.source <=> t.source")).select("c.source", "size", "n", "source_size", "target")
    kind = df.schema[source_col].dataType.simpleString()
    plan = stage(asked.groupBy("source").applyInPandas(_plan, f"source {kind}, size bigint, times int, want bigint, source_size bigint, target double"), "plan")
    # What a slice still takes: the wanted count less what the slices before it hold.
    docs = docs.withColumn("slice", F.pmod(F.shiftrightunsigned("key", 24), F.lit(slices)).cast("int"))
    held = docs.groupBy("source", "size", "slice").agg(F.count("*").alias("n"))
    by_slice = Window.partitionBy("source", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("before", F.coalesce(F.sum("n").over(by_slice), F.lit(0))).alias("h")
    per_slice = held.join(plan.alias("p"), F.expr("h.source <=> p.source AND h.size = p.size"))
    per_slice = per_slice.select("h.source", "h.size", "slice", "times", (F.col("want") - F.col("before")).alias("more"), "source_size", "target").alias("p")
    inner = Window.partitionBy("d.source", "d.size", "d.slice").orderBy("key", F.col("id").asc_nulls_last(), "last")
    ranked = docs.alias("d").join(per_slice, F.expr("d.source <=> p.source AND d.size = p.size AND d.slice = p.slice")).withColumn("rank", F.row_number().over(inner))
    taken = F.col("d.size") * (F.col("times") + (F.col("rank") <= F.col("more")).cast("int"))
    return ranked.select(*(F.col("row")[c].alias(c) for c in kept), F.col("d.size").alias("size"), "source_size", "target", taken.cast("bigint").alias("taken"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return mix_sized(docs).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op5_mixing": op5_mixing}
SQL: dict[str, str] = {}
