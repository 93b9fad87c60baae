"""Sources: corpus trees, Markdown, JSON arrays, configuration; readers of documents are injected (IO1-IO8, IO12-IO13, IO16-IO19)."""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.paths import doc_type_of, parts_of, year_of

ALPACA = "instruction string, input string, output string"
ADAPTER = "adapter_config.json"
WHOLE_NAME = re.compile(r"\$\{(.*)\}", re.DOTALL)
READ = "path string, text string, pages int, method string, page_texts array<string>, error string"


def _below(spark: SparkSession, root: str):
    """A file's path relative to root, as a column of its `_metadata.file_path` (an encoded URI)."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    whole = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toUri().getPath().rstrip("/")
    # url_decode takes a plus for a space, as forms do and URIs don't.
    decoded = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return F.substring(F.regexp_replace(decoded, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", ""), len(whole) + 2, 1 << 20)


def scan_files(spark: SparkSession, root: str, glob: str, types: list[str] | None = None, years: list[str] | None = None) -> DataFrame:
    """(path relative to root, content) of the files under root that match.

    Types and years are those that path_meta() finds in the relative path. They are tested
    on the file's metadata, which leaves files out when the scan is planned, before any is opened.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    path = _below(spark, root)
    for of, names in ((doc_type_of, types), (year_of, years)):
        if names is not None:
            files = files.filter(of(path).isin(names))
    return files.select(path.alias("path"), "content")


def scan_pdfs(spark: SparkSession, root: str, types: list[str] | None = None, years: list[str] | None = None) -> DataFrame:
    return scan_files(spark, root, "*.pdf", types, years)


def scan_markdown(spark: SparkSession, root: str) -> DataFrame:
    """(path, md) of Markdown files, UTF-8."""
    return scan_files(spark, root, "*.md").select("path", F.decode("content", "UTF-8").alias("md"))


def in_path_order(df: DataFrame) -> DataFrame:
    return df.orderBy(parts_of(F.col("path")))


def read_documents(files: DataFrame, primary: Callable[[bytes], str | None], fallback: Callable[[bytes], str | None] | None = None, pages: Callable[[bytes], list[str]] | None = None, names: tuple[str, str] = ("primary", "fallback")) -> DataFrame:
    """READ for (path, content): the first reader's text, else the second's, else empty.

    Readers are plain functions of a file's bytes that the Python workers call; an error is
    a value of the row, never a failed task. page_texts holds the first pages, for the
    test whether a document has a text layer.
    """

    def one(path: str, content: bytes) -> tuple:
        error = None

        def attempt(call, default):
            nonlocal error
            try:
                return call(content) if call else default
            except Exception as e:
                error = error or f"{type(e).__name__}: {e}"
                return default

        text, method = attempt(primary, None), names[0]
        if not (text and text.strip()):
            text, method = attempt(fallback, None) or "", names[1]
        leaves = attempt(pages, [])
        return path, text, len(leaves), method, leaves[:3], error

    def run(frames):
        for f in frames:
            yield pd.DataFrame([one(p, bytes(c)) for p, c in zip(f.path, f.content, strict=True)], columns=["path", "text", "pages", "method", "page_texts", "error"])

    return files.select("path", "content").mapInPandas(run, READ)


def read_ocr(files: DataFrame, load: Callable[[], Callable[[bytes], str]], method: str = "ocr") -> DataFrame:
    """(path, text, method, error) of (path, content) by a reader that load makes once in each task: models and libraries are imported there.

    Give it the rows that are routed to OCR only. A library that is missing is every row's error, with its message.
    """

    def run(frames):
        read, failed = None, None
        try:
            read = load()
        except ImportError as e:
            failed = f"ImportError: {e}"

        def one(content: bytes) -> tuple:
            try:
                return (read(content) or "", None) if read else ("", failed)
            except Exception as e:
                return "", f"{type(e).__name__}: {e}"

        for f in frames:
            made = [one(bytes(c)) for c in f.content]
            yield pd.DataFrame({"path": f.path, "text": [t for t, _ in made], "method": method, "error": [e for _, e in made]})

    return files.select("path", "content").mapInPandas(run, "path string, text string, method string, error string")


def plain_text_reader(content: bytes) -> str:
    """A stub reader for tests: the bytes as UTF-8 text."""
    return content.decode("utf-8")


def read_alpaca(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON array files."""
    return spark.read.schema(ALPACA).json(path, multiLine=True)


def read_string_array(spark: SparkSession, path: str, name: str = "question") -> DataFrame:
    """(idx, name) of a JSON array of strings."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<string>")).alias("idx", name))


def _from_environment(node) -> None:
    """Whole ${NAME} values of nested dicts and lists, in place, by what the environment has (else empty)."""
    waiting = [node]
    while waiting:
        at = waiting.pop()
        for key, value in list(at.items() if isinstance(at, dict) else enumerate(at)):
            if isinstance(value, dict | list):
                waiting.append(value)
            elif isinstance(value, str) and (name := WHOLE_NAME.fullmatch(value)):
                at[key] = os.environ.get(name[1], "")


def load_config(path: str = "config/config.yaml", root: str | None = None) -> dict:
    """A YAML file, looked for in the working folder and then in root; whole ${NAME} values come from the environment."""
    import yaml

    for folder in (Path.cwd(), Path(root) if root else Path(__file__).resolve().parents[2]):
        if (folder / path).is_file():  # an absolute path stands for itself
            data = yaml.safe_load((folder / path).read_text(encoding="utf-8")) or {}
            _from_environment(data)
            return data
    raise FileNotFoundError(f"configuration not found: {path}")


def system_prompt(path: str, default: str) -> str:
    """chat.system_prompt of a configuration, or default where it can't be had."""
    try:
        return (load_config(path).get("chat", {}).get("system_prompt") or "").strip() or default
    except (OSError, ValueError, AttributeError):
        return default


def adapter_settings(spark: SparkSession, folder: str) -> tuple:
    """(r, lora_alpha, lora_dropout) of an adapter's settings file in folder, or three None; read by Spark, so folder may be on any store."""
    fields = spark.read.schema("r int, lora_alpha int, lora_dropout double").option("multiLine", True).option("pathGlobFilter", ADAPTER).json(folder)
    found = fields.head(1)
    return tuple(found[0]) if found else (None, None, None)


def checkpoint_kind(spark: SparkSession, folder: str | None) -> str | None:
    """What a checkpoint folder holds: `adapter` (to be put on its base model), `model`, or None where there is none."""
    if not folder:
        return None
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(where):
        return None
    return "adapter" if store.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where, ADAPTER)) else "model"
