"""Which reader a document needs (X8-X13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let
from ..functions.vocab import CORRUPT

ROUTES = ["digital", "ocr", "escaneado_omitido", "corrupto_omitido", "vacio_a_ocr", "filtrado", "ya_procesado", "errores"]


def has_text_layer(pages: Column, sample: int = 3, least: int = 50) -> Column:
    """Whether the first of an array of page texts hold enough characters on average; without pages, not."""
    sizes = F.transform(F.slice(F.coalesce(pages, F.array().cast("array<string>")), 1, sample), lambda x: F.length(F.coalesce(x, F.lit(""))))
    return F.coalesce(F.try_divide(F.aggregate(sizes, F.lit(0), lambda a, x: a + x), F.size(sizes)) >= least, F.lit(False))


def likely_digital(pages: DataFrame, key: str = "path", sample: int = 3, least: int = 50, docs: DataFrame | None = None) -> DataFrame:
    """(key, is_digital): whether the first pages hold enough characters on average; pages: key, page_no, page_text.

    docs: all documents (key); those without pages aren't digital.
    """
    found = _likely_digital(pages, key, sample, least)
    return found if docs is None else docs.select(key).join(found, key, "left").withColumn("is_digital", F.coalesce("is_digital", F.lit(False)))


def _likely_digital(pages: DataFrame, key: str, sample: int, least: int) -> DataFrame:
    first = pages.filter(F.col("page_no") <= sample)
    return first.groupBy(key).agg(F.coalesce(F.avg(F.length(F.coalesce("page_text", F.lit("")))) >= least, F.lit(False)).alias("is_digital"))


def looks_corrupt(text: Column, threshold: int = 6) -> Column:
    """Letter-digit-letter grams that occur three times or more, in all threshold times or more.

    Sorted grams stand in runs, so a gram counts if the one two places before or after it
    is equal: no pass over all pairs, no shuffle.
    """
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CORRUPT), F.lit(0)), F.lower)

    def in_run(grams: Column) -> Column:
        near = lambda g, i, k: g == F.get(grams, i + k)
        return F.filter(grams, lambda g, i: F.coalesce(near(g, i, -2), F.lit(False)) | F.coalesce(near(g, i, 2), F.lit(False)) | F.coalesce(near(g, i, -1) & near(g, i, 1), F.lit(False)))

    return F.size(let(F.array_sort(found), in_run)) >= threshold


def is_empty(text: Column) -> Column:
    return F.length(F.coalesce(text, F.lit(""))) < 100


def route(digital: Column, corrupt: Column, empty: Column, ocr: bool, ocr_empty: Column | None = None) -> Column:
    """The outcome of a document; ocr_empty: whether the OCR text, where it is read, is empty."""
    if not ocr:
        return F.when(~digital, "escaneado_omitido").when(corrupt, "corrupto_omitido").when(empty, "vacio_a_ocr").otherwise("digital")
    read = F.when(F.coalesce(ocr_empty, F.lit(True)), "vacio_a_ocr").otherwise("ocr")
    return F.when(~digital | corrupt | empty, read).otherwise("digital")


def route_documents(df: DataFrame, text_col: str = "text", digital_col: str | None = None, ocr: bool = False, ocr_text_col: str | None = None) -> DataFrame:
    """df with is_corrupt, is_blank, route and queued (whether it goes to the OCR queue)."""
    text = F.col(text_col)
    digital = F.col(digital_col) if digital_col else F.length(F.coalesce(text, F.lit(""))) >= 50
    out = df.withColumns({"is_corrupt": looks_corrupt(text), "is_blank": is_empty(text)})
    out = out.withColumn("route", route(digital, F.col("is_corrupt"), F.col("is_blank"), ocr, is_empty(F.col(ocr_text_col)) if ocr_text_col else None))
    return out.withColumn("queued", ~F.col("route").isin("digital", "ocr") & F.lit(not ocr))


def route_stats(routed: DataFrame) -> DataFrame:
    """One row: how many documents went each way."""
    return routed.agg(*(F.count_if(F.col("route") == r).alias(r) for r in ROUTES))


def running_pages(df: DataFrame, key: str, order: str, text_col: str) -> DataFrame:
    """(key, page_no, page_text): rows of a key in order, as pages."""
    return df.select(key, F.row_number().over(Window.partitionBy(key).orderBy(order)).alias("page_no"), F.col(text_col).alias("page_text"))
