"""One extraction run: scan, scope, skip what is done, read, route, OCR, statistics (IO1-IO10, X1-X13)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import paths, routing
from .corpus import read_documents, read_ocr

OUTCOME = ("path", "out_path", "text", "method", "route", "queued", "error")


def extract(
    files: DataFrame,
    primary: Callable[[bytes], str | None],
    fallback: Callable[[bytes], str | None] | None = None,
    pages: Callable[[bytes], list[str]] | None = None,
    ocr: Callable[[], Callable[[bytes], str]] | None = None,
    types: list[str] | None = None,
    years: list[str] | None = None,
    done: DataFrame | None = None,
    limit: int = 0,
) -> DataFrame:
    """OUTCOME for each of files (path, content); route is one of routing.ROUTES.

    A file out of scope or whose output is there (done: out_path) isn't read. One that no
    reader could read, with an error, is an error and doesn't stop the run. ocr makes the OCR
    reader; only files that need it reach it, and without one they are queued. limit: up to
    so many texts are written, in path order; 0: no limit.
    """
    meta = paths.path_meta(files)
    ok = F.lit(True)
    for column, names in (("doc_type", types), ("year", years)):
        ok = ok & F.col(column).isin(names) if names is not None else ok
    known = meta.select("path", "content", "out_path", ok.alias("wanted"))
    before = done.select("out_path").distinct().withColumn("written", F.lit(True)) if done is not None else None
    known = known.withColumn("written", F.lit(False)) if before is None else known.join(before, "out_path", "left").withColumn("written", F.coalesce("written", F.lit(False)))
    none = F.lit(None).cast("string")
    skipped = known.filter(~F.col("wanted") | F.col("written")).select(
        "path", "out_path", none.alias("text"), none.alias("method"), F.when(~F.col("wanted"), "filtrado").otherwise("ya_procesado").alias("route"), F.lit(False).alias("queued"), none.alias("error")
    )
    todo = known.filter(F.col("wanted") & ~F.col("written"))
    read = read_documents(todo, primary, fallback, pages).withColumn("digital", routing.has_text_layer(F.col("page_texts")))
    failed = F.col("error").isNotNull() & (F.col("text") == "")
    routed = routing.route_documents(read, digital_col="digital").withColumn("route", F.when(failed, "errores").otherwise(F.col("route"))).withColumn("queued", F.col("queued") & ~failed)
    routed = todo.select("path", "out_path").join(routed.select("path", "text", "method", "route", "queued", "error"), "path")
    if ocr is not None:
        scanned = read_ocr(todo.join(routed.filter("queued").select("path"), "path", "left_semi"), ocr)
        outcome = F.when(F.col("error").isNotNull(), "errores").when(routing.is_empty(F.col("text")), "vacio_a_ocr").otherwise("ocr")
        again = todo.select("path", "out_path").join(scanned, "path").select("path", "out_path", "text", "method", outcome.alias("route"), F.lit(False).alias("queued"), "error")
        routed = routed.filter("NOT queued").unionByName(again)
    every = skipped.select(*OUTCOME).unionByName(routed.select(*OUTCOME))
    return paths.until_written(every.withColumn("_wrote", F.col("route").isin("digital", "ocr")), limit, "_wrote").drop("_wrote") if limit else every
