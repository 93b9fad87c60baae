"""Operator 7: reproducible sharding by a Feistel permutation with cycle walking (DataFrame functions only).

Every row gets a global row number g, 0 to N-1, in the order (bucket, order columns), where
bucket is a hash of the order columns (id, crc32 of the text, size): so many buckets that
each has about BUCKET_ROWS rows. Their counts give each bucket's first number, and the rows
of a bucket are numbered inside it, so nothing is sorted as a whole, and a hot id is spread
by its texts. A generalised Feistel network on a rectangle of a * b >= N cells permutes g;
results of N or more walk on along their cycle until they fall under N. The permuted number p
gives shard = p mod shards and slot = p div shards: shards differ by one row at most, slots
have no gap, and both can be computed for any g without the data.

The cells beyond N are fewer than a = ceil(sqrt(N)), and a walk visits each of them once at
most. The first SHORT_WALK steps are done for all rows; a row that isn't there by then walks
on for as many steps as there are cells beyond N, so every walk ends.

Nulls: a null text has no bytes (size 8, crc32 0); a null id is a value of its own. Rows
that are equal in all order columns share a bucket and get neighbouring numbers; which gets
which can't be told. An empty table stays empty. A text of any length counts by its size
only. Columns of the table keep their values, whatever their names, but for shard and slot,
which replace any that it had.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import free_name

SEED = 20240229
SHARDS = 24
ROUNDS = 4
BUCKET_ROWS = 1 << 15
MOST_BUCKETS = 1 << 22
SHORT_WALK = 4


def _feistel(x: Column, a: int, b: int, seed: int) -> Column:
    """One pass of the network over 0 .. a*b-1: halves are added to, in turn, by a hash of the other."""
    right = F.pmod(x, F.lit(b))
    left = ((x - right) / F.lit(b)).cast("bigint")
    for i in range(ROUNDS):
        left = F.pmod(left + F.pmod(F.xxhash64(right, F.lit(seed), F.lit(2 * i)), F.lit(a)), F.lit(a))
        right = F.pmod(right + F.pmod(F.xxhash64(left, F.lit(seed), F.lit(2 * i + 1)), F.lit(b)), F.lit(b))
    return left * F.lit(b) + right


def sides(n: int) -> tuple[int, int]:
    """a and b with a*b >= n and fewer than a cells to spare."""
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return a, -(-max(n, 1) // a)


def permute(x: Column, n: int, seed: int = SEED) -> Column:
    """The permuted value of x, 0 <= x < n: the network, then the walk."""
    a, b = sides(n)
    let = lambda v, f: F.aggregate(F.array(v), F.lit(0).cast("bigint"), lambda _, x: f(x))  # noqa: E731  bound once
    walk = lambda v, steps: F.aggregate(F.sequence(F.lit(1), F.lit(steps)), v, lambda x, _: F.when(x < n, x).otherwise(_feistel(x, a, b, seed)))
    once = let(x.cast("bigint"), lambda v: _feistel(v, a, b, seed))
    short = walk(once, SHORT_WALK)
    return let(short, lambda v: F.when(v < n, v).otherwise(walk(v, max(1, a * b - n))))


def bucket_of(columns: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*columns, F.lit(SEED)), F.lit(buckets))


def row_numbers(df: DataFrame, order: list[str], out_col: str, bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, int]:
    """df with its global row number, and the number of rows.

    Counts read the order columns only. Their table has a row for each bucket, MOST_BUCKETS
    at most, so it may be broadcast.
    """
    n = df.select(order[0]).count()
    buckets = min(MOST_BUCKETS, max(1, -(-n // bucket_rows)))
    bucket, inside = free_name(df, "bucket"), free_name(df, "inside")
    counts = df.select(bucket_of(order, buckets).alias("at")).groupBy("at").agg(F.count("*").alias("n"))
    first = counts.select("at", (F.sum("n").over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("first"))
    inner = Window.partitionBy(bucket).orderBy(*(F.col(c).asc_nulls_last() for c in order))
    numbered = df.withColumn(bucket, bucket_of(order, buckets)).withColumn(inside, F.row_number().over(inner)).alias("d")
    met = numbered.join(F.broadcast(first).alias("f"), F.col(f"d.{bucket}") == F.col("f.at"))
    return met.select(*(F.col(f"d.`{c}`") for c in df.columns), (F.col("f.first") + F.col(f"d.{inside}") - 1).alias(out_col)), n


def shard(df: DataFrame, order: list[str], shards: int = SHARDS, seed: int = SEED, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """df with shard int and slot bigint, by the law `rows`; order: columns that tell rows apart."""
    df = df.drop("shard", "slot")
    number, place = free_name(df, "number"), free_name(df, "place")
    numbered, n = row_numbers(df, order, number, bucket_rows)
    placed = numbered.withColumn(place, permute(F.col(number), n, seed))
    at = F.pmod(place, F.lit(shards))
    return placed.withColumns({"shard": at.cast("int"), "slot": ((F.col(place) - at) / shards).cast("bigint")}).drop(number, place)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", (F.octet_length(text) + 8).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))
    return shard(docs, ["doc_id", "text_crc32", "size"]).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op7_sharding": op7_sharding}
SQL: dict[str, str] = {}
