"""Sinks: Markdown tables and files, OCR queue, datasets, the experiment log (IO9-IO11, IO14-IO15)."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vocab import LOG_COLUMNS


def write_markdown_table(df: DataFrame, path: str) -> None:
    """Documents as a table partitioned by year and type, so that later reads by either leave files out."""
    df.write.mode("append").partitionBy("year", "doc_type").parquet(path)


def export_markdown_files(df: DataFrame, folder: str) -> None:
    """One file for each document at out_path; the folder must be one that all executors share."""

    def write(rows):
        for r in rows:
            to = Path(folder) / r.out_path
            to.parent.mkdir(parents=True, exist_ok=True)
            to.write_text(r.md, encoding="utf-8")

    df.select("out_path", "md").foreachPartition(write)


def write_ocr_queue(routed: DataFrame, path: str) -> None:
    routed.filter("queued").select(F.col("rel_path").alias("value")).write.mode("overwrite").text(path)


def write_dataset(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path, ignoreNullFields=False)


def export_json_array(df: DataFrame, path: str) -> None:
    """One JSON array file, rows fetched one partition at a time."""
    with open(path, "w", encoding="utf-8") as f:
        f.write("[")
        for i, r in enumerate(df.toLocalIterator()):
            f.write("," * bool(i) + "\n" + json.dumps(r.asDict(recursive=True), ensure_ascii=False, indent=2))
        f.write("\n]")


def append_log(row: DataFrame, path: str) -> None:
    """A result row at the end of the experiment log, in the log's column order."""
    row.select(*LOG_COLUMNS).write.mode("append").parquet(path)
