"""A training corpus from `documents`: five stages, each over all that the one before kept.

Each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read back as the next one's docs. All but the last return the columns of
`documents`, and any others that docs has, whatever their names; rows that a stage keeps keep
their other columns' values.

Every stage takes null ids, texts and sources, repeated ids and equal rows, empty tables and
texts of any length, as its operator's docstring says. Null and empty texts aren't toxic, link
with nothing, hold no secret, are taken 0 times by the mix, and encode to nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import bpe, jaccard, mixing, secrets, toxicity
from foliospark.llm._common import free_name, stage


def _packed(docs: DataFrame, *columns: str) -> tuple[DataFrame, str]:
    """docs as one struct column and some of its columns, so that an operator's own columns can't clash with others."""
    row = free_name(docs, "row")
    return docs.select(F.struct(*docs.columns).alias(row), *columns), row


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold stay."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = free_name(docs, "score")
    return toxicity.score(docs, model, out_col=score).filter(F.col(score) < toxicity.THRESHOLD).drop(score)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows that link, directly or through others, exactly one stays: that of the least id, nulls last, then the first by row number.

    Rows are told apart by their place in the files that docs reads, so ids may repeat or be
    null; docs must be a read of files, as it is in run(): then every read gives a row one number.
    """
    number = free_name(docs, "number")
    numbered = docs.withColumn(number, F.monotonically_increasing_id())
    found = jaccard.jaccard_components(numbered, id_col=number)
    named = found.join(numbered.select(number, F.col("doc_id").alias("id")), number)
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", F.col(number).alias("number")))
    stay = named.groupBy("component_id").agg(least.alias("least")).select(F.col("least.number").alias(number))
    return numbered.join(stay, number, "left_semi").select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret's span is replaced by a mask; n_chars follows."""
    packed, row = _packed(docs, "doc_id", "text")
    found = secrets.scan(packed).select(row, F.when(F.size("spans") > 0, secrets.redact(F.col("text"), F.col("spans"))).alias("masked"))
    new = {"text": F.col("masked"), "n_chars": F.length("masked").cast("bigint")}
    return found.select(*(F.coalesce(new[c], F.col(row)[c]).alias(c) if c in new else F.col(row)[c].alias(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; texts without words aren't taken."""
    packed, row = _packed(docs, "doc_id", "source", "text")
    times = (F.col("taken") / F.greatest("size", F.lit(1))).cast("int")
    return mixing.mix(packed).select(row, F.explode(F.array_repeat(F.lit(0), times))).select(f"{row}.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of what they decode to."""
    return bpe.round_trip(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard join", one_of_each_group),
    ("secret scans", mask_secrets),
    ("mixing", mix_sources),
    ("byte-level BPE", encode),
]

# Learned scores and the BPE merges aren't SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
