"""Document metadata from corpus paths, scope filters and incremental runs (X1-X7, X14, IO3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let
from ..functions.vocab import FLAT_PARTS, TYPE_LABELS


def csv_list(value: str | None) -> list[str] | None:
    """Names in a comma-separated argument; without any, None: no filter."""
    names = sorted({v.strip() for v in (value or "").split(",") if v.strip()})
    return names or None


def parts_of(path: Column) -> Column:
    """Also the sort key of a path: arrays compare component by component."""
    return F.split(path, "/")


def title_case(c: Column) -> Column:
    """As str.title(): a letter after anything but a letter is a capital, the others are small."""
    letter = lambda x: x.rlike(r"\p{L}")
    up = lambda chars: F.transform(chars, lambda x, i: F.when((i == 0) | ~letter(F.get(chars, i - 1)), F.upper(x)).otherwise(x))
    return F.array_join(let(F.split(F.lower(c), ""), up), "")


def label_of(doc_type: Column) -> Column:
    labels = F.create_map(*(F.lit(x) for pair in TYPE_LABELS.items() for x in pair))
    return F.coalesce(F.try_element_at(labels, doc_type), title_case(F.replace(doc_type, F.lit("_"), F.lit(" "))))


def title_of(label: Column, number: Column, year: Column) -> Column:
    return F.when((number != "") & (year != ""), F.concat(label, F.lit(" No. "), number, F.lit(" de "), year)).when(year != "", F.concat(label, F.lit(" ("), year, F.lit(")"))).otherwise(label)


def doc_type_of(path: Column) -> Column:
    """The folder after `normatividad`, else the file's folder."""
    p = parts_of(path)
    n, at = F.size(p), F.array_position(p, "normatividad")
    after = F.when((at > 0) & (at < n - 1), F.get(p, at.cast("int")))
    return F.coalesce(after, F.when(n >= 2, F.get(p, n - 2)), F.lit(""))


def year_of(path: Column) -> Column:
    return F.coalesce(F.get(F.filter(parts_of(path), lambda x: x.rlike(r"(?d)^(19|20)\d{2}\z")), 0), F.lit(""))


def path_meta(df: DataFrame, path_col: str = "path") -> DataFrame:
    """df with doc_type, type_label, year, number, source_filename, rel_path, titulo and out_path."""
    path = F.col(path_col)
    p = parts_of(path)
    name = F.element_at(p, -1)
    stem = F.regexp_replace(name, r"(?s)(.)\.[^.]+$", "$1")
    number = F.regexp_extract(stem, r"(?U)^(\d+)(?:[_\-]|$)", 1)
    folders = F.filter(F.slice(p, F.lit(1), F.size(p) - 1), lambda x: ~x.isin(FLAT_PARTS))
    base = df.withColumns({"doc_type": doc_type_of(path), "year": year_of(path), "number": number, "source_filename": name, "rel_path": path})
    labelled = base.withColumn("type_label", label_of(F.col("doc_type")))
    return labelled.withColumns({"titulo": title_of(F.col("type_label"), F.col("number"), F.col("year")), "out_path": F.array_join(F.concat(folders, F.array(F.concat(stem, F.lit(".md")))), "/")})


def in_scope(df: DataFrame, types: list[str] | None = None, years: list[str] | None = None) -> DataFrame:
    """Rows of path_meta() whose type and year are asked for; years are strings."""
    if types is not None:
        df = df.filter(F.col("doc_type").isin(types))
    return df.filter(F.col("year").isin(years)) if years is not None else df


def not_done(df: DataFrame, done: DataFrame, key: str = "out_path") -> DataFrame:
    """Rows whose output isn't there yet."""
    return df.join(done.select(key), key, "left_anti")


def _ranges(df: DataFrame, path_col: str) -> DataFrame:
    """df with _key (the path's parts) and _range: rows of one range come before those of the next in path order.

    The ranges' bounds are values, found once (of a sample by hash, a fixed number for each
    partition): repartitionByRange would draw its own each time a branch of a plan runs, and
    what a range holds and the places in it must be of the same rows.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sample = df.select(path_col).filter(F.col(path_col).isNotNull()).orderBy(F.xxhash64(path_col), path_col).limit(32 * n).collect()
    some = sorted((r[0] for r in sample), key=lambda p: [x.encode() for x in p.split("/")])
    bounds = F.array(*(parts_of(F.lit(some[i])) for i in range(32, len(some), 32)))
    of = F.size(F.filter(bounds, lambda b: b <= F.col("_key"))) if len(some) > 32 else F.lit(0)
    return df.withColumn("_key", parts_of(F.col(path_col))).withColumn("_range", F.greatest(of, F.lit(0)))


def _running(ranged: DataFrame, what: Column, out_col: str) -> DataFrame:
    """ranged with the sum of what over all rows before each in path order: inside its range, and of the ranges before (a row for each)."""
    per_range = ranged.groupBy("_range").agg(F.coalesce(F.sum(what), F.lit(0)).alias("_sum"))
    earlier = per_range.select("_range", F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_earlier"))
    inner = Window.partitionBy("_range").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    counted = ranged.withColumn("_before", F.coalesce(F.sum(what).over(inner), F.lit(0)))
    return counted.join(F.broadcast(earlier), "_range").withColumn(out_col, F.col("_before") + F.col("_earlier")).drop("_key", "_range", "_before", "_earlier")


def until_written(df: DataFrame, limit: int, success_col: str, path_col: str = "path") -> DataFrame:
    """Rows in path order up to the one with which limit successes are reached."""
    return _running(_ranges(df, path_col), F.col(success_col).cast("bigint"), "_done").filter(F.col("_done") < limit).drop("_done")


def ranked(df: DataFrame, path_col: str = "path", rank_col: str = "rank") -> DataFrame:
    """All rows with their rank in path order, from 1."""
    return _running(_ranges(df, path_col), F.lit(1), rank_col).withColumn(rank_col, F.col(rank_col) + 1)
