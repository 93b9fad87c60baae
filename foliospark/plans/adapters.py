"""Domain inputs made from the test tables, in the same way in Spark and in SQL (plans/oracle.py)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOC_TYPES = ["RESOLUCION_SUPERIOR", "ACUERDO_ACADEMICO", "LEY", "ACTA_CONSEJO_SUPERIOR", "RESOLUCION_RECTORAL", "Plan", "DECRETO_NACIONAL", "CIRCULAR_interna 3a"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def legal_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path, raw_md): each document's lines under the headings of a regulation."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("l"))
    i = F.col("doc_id")
    kind = F.element_at(F.array(*map(F.lit, DOC_TYPES)), (i % 8 + 1).cast("int"))
    number, year = (i % 20).cast("string"), (2000 + i % 10).cast("string")
    path = F.concat(year, F.lit("/si/normatividad/"), kind, F.lit("/"), number, F.lit("_"), year, F.lit("_"), i.cast("string"), F.lit(".pdf"))
    first = F.get("l", 0)
    articles = F.transform(F.filter("l", lambda x, k: k >= 1), lambda x, k: F.concat(F.lit("**ARTÍCULO "), ((k + 1) % 6 + 1).cast("string"), F.lit("º.-** "), x))
    head = F.array(
        F.concat(F.lit("## **RESOLUCIÓN SUPERIOR No. "), number, F.lit(" DE "), year, F.lit("**")),
        F.lit("( Mayo 05 )"),
        F.when(i % 3 != 0, F.concat(F.lit("“Por la cual se adopta "), F.substring(first, 1, 60), F.lit(" y se dictan otras disposiciones”"))).otherwise("Sin epígrafe"),
        F.lit("**CONSIDERANDO:**"),
        first,
        F.lit("Página 1 de 2"),
        F.lit("---"),
        F.when(i % 5 == 0, "R E S U E L V E").otherwise("ACUERDA:"),
        F.concat(F.lit("Disposición del documento "), number),
    )
    tail = F.array(
        F.lit("PARÁGRAFO PRIMERO. Se aplica a todos"),
        F.lit("| a | b |"),
        F.lit("Línea que se repite en todas las hojas"),
        F.lit("correo@example.edu"),
        F.lit("LÍNEA que se repite en todas las hojas"),
        F.lit("CAPÍTULO II - Vigencia"),
        F.lit("La presente norma rige a partir de la fecha de su expedición"),
    )
    return d.select("doc_id", path.alias("path"), F.array_join(F.concat(head, articles, tail), "\n").alias("raw_md"))


def eval_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(example_id, reference, prediction): an assistant's turn against the user's before it, both with citations."""
    c = table(spark, sf_dir, "conversations")
    a, u = c.filter("role = 'assistant'").alias("a"), c.filter("role = 'user'").alias("u")
    k = F.col("a.conv_id") % 4
    said = F.when(k == 0, "Según la Resolución 007 de 1990, ").when(k == 1, "El Acuerdo No. 12 de 2004 dice: ").when(k == 2, "Ley 30 de 1992: ").otherwise("no tengo información: ")
    asked = F.when(k == 0, "Resolución No. 7 de 1990 ").when(k == 1, "Acuerdo No. 13 de 2004 ").when(k == 2, "Acuerdo 3 de 2001 ").otherwise("")
    return a.join(u, F.expr("a.conv_id = u.conv_id AND a.turn = u.turn + 1")).select(
        F.concat_ws("-", F.col("a.conv_id").cast("string"), F.col("a.turn").cast("string")).alias("example_id"),
        F.concat(asked, F.col("u.text")).alias("reference"),
        F.concat(said, F.col("a.text")).alias("prediction"),
    )


def embedding_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    a, b = e.alias("a"), e.alias("b")
    return a.join(b, F.expr("b.vec_id = a.vec_id + 1 AND a.vec_id % 2 = 0")).select("a.vec_id", F.col("a.embedding").alias("emb_p"), F.col("b.embedding").alias("emb_r"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(((F.col("doc_id") % 17 + 1) / 8.0).alias("nll"), ((F.col("doc_id") % 11 + 1) / 4.0).alias("entropy"))
