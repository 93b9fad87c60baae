"""Dataset assembly: type filter, keep-first de-duplication, counts, splits, training text (B1-B9)."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vocab import TRAINING_PROMPT
from .paths import parts_of


def types_argument(value: str | None) -> list[str] | None:
    """Types of a comma-separated argument; blanks are kept, unlike in scope filters."""
    return [t.strip() for t in value.split(",")] if value else None


def of_types(df: DataFrame, types: list[str] | None) -> DataFrame:
    return df if types is None else df.filter(F.coalesce("tipo", F.lit("")).isin(types))


def keep_first(qa: DataFrame) -> DataFrame:
    """The first pair of each question, by path and place.

    A minimum over the order key and the rest of the row combines on the map side, so one
    question in very many documents is no hot task (a window would be).
    """
    rest = [c for c in qa.columns if c not in ("question", "path", "pair_idx")]
    first = F.min(F.struct(parts_of(F.col("path")).alias("_parts"), F.col("pair_idx").alias("pair_idx"), F.col("path").alias("path"), *rest)).alias("_first")
    kept = qa.groupBy("question").agg(first)
    return kept.select(*(F.col("question") if c == "question" else F.col(f"_first.{c}").alias(c) for c in qa.columns))


def duplicate_count(qa: DataFrame) -> DataFrame:
    return qa.agg((F.count("*") - F.count_distinct("question")).alias("duplicates"))


def pairs_by_type(docs: DataFrame) -> DataFrame:
    """(tipo, n_pairs) of documents with pairs, before de-duplication; types without pairs too; most first, then first seen."""
    seen = docs.groupBy("tipo").agg(F.sum(F.size("pairs")).alias("n_pairs"), F.min(parts_of(F.col("path"))).alias("_first"))
    return seen.orderBy(F.desc("n_pairs"), "_first").select("tipo", "n_pairs")


def kept_by_type(qa: DataFrame) -> DataFrame:
    """(tipo, n_pairs, n_kept): pairs of each type, and those of them that are the first of their question.

    qa has a row for each pair, and for a document without pairs one whose question is null.
    Pairs are summed by question and type before anything else, so a question in very many
    documents is no hot task.
    """
    order = F.struct(parts_of(F.col("path")).alias("parts"), F.col("pair_idx").alias("pair_idx"))
    each = qa.groupBy("question", "tipo").agg(F.count("question").alias("n"), F.min(order).alias("first"))
    best = F.min("first").over(Window.partitionBy("question"))
    told = each.withColumn("kept", F.col("question").isNotNull() & (F.col("first") == best))
    return told.groupBy("tipo").agg(F.sum("n").alias("n_pairs"), F.count_if("kept").alias("n_kept"))


def split_hash(df: DataFrame, key: str, test: float = 0.30, seed: int = 42) -> DataFrame:
    """df with split: int(n * test) rows, the least by seeded hash of key, are test.

    Only the hash ranges around the cut are told apart row by row: counts of hash buckets
    give the bucket in which the cut falls, so no task ranks all rows. Null keys come last, as a
    bucket of their own: a bucket that may be null would have the join filter one of df's two
    readings, so that an exchange that both could share runs twice.
    """
    digest = F.md5(F.concat(F.lit(str(seed)), F.lit(":"), F.col(key)))
    marked = df.withColumns({"_h": digest, "_b": F.coalesce(F.conv(F.substring(digest, 1, 4), 16, 10).cast("int"), F.lit(1 << 16))})
    counts = marked.groupBy("_b").agg(F.count("*").alias("_n"))
    every = Window.partitionBy()
    upto = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    # 65,537 buckets at most.
    before = counts.select("_b", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"), F.floor(F.sum("_n").over(every) * F.lit(test)).alias("_test"))
    inner = Window.partitionBy("_b").orderBy("_h", key)
    placed = marked.join(F.broadcast(before), "_b").withColumn("_rank", F.row_number().over(inner) + F.col("_before"))
    return placed.withColumn("split", F.when(F.col("_rank") <= F.col("_test"), "test").otherwise("train")).drop("_h", "_b", "_before", "_test", "_rank")


def split_exact(df: DataFrame, n: int, test: float = 0.30, seed: int = 42, index: str = "row_idx") -> DataFrame:
    """df with split, by the standard library's seeded shuffle of 0..n-1: the first int(n * test) are test.

    The permutation is made on the driver and broadcast as a set of indices: for tables of up to a million rows.
    """
    if n > 1_000_000:
        raise ValueError("split_exact() is for small tables; use split_hash()")
    order = list(range(n))
    random.Random(seed).shuffle(order)
    chosen = df.sparkSession.createDataFrame([(i,) for i in sorted(order[: int(n * test)])], f"{index} bigint")
    return df.join(F.broadcast(chosen.withColumn("split", F.lit("test"))), index, "left").withColumn("split", F.coalesce("split", F.lit("train")))


def training_messages(qa: DataFrame, system_prompt: str | None = None) -> DataFrame:
    """(messages, text): system, user and assistant, as an array and in the ChatML form."""
    prompt = (system_prompt or "").strip() or TRAINING_PROMPT
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    messages = F.array(turn("system", F.lit(prompt)), turn("user", F.col("question")), turn("assistant", F.col("answer")))
    text = F.array_join(F.transform("messages", lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>\n"))), "")
    return qa.select(messages.alias("messages")).withColumn("text", text)
