"""Frontmatter and structure of normalised Markdown (P1-P11), as expressions of one row: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as v
from ..functions.text import BLANK, let, lines, rstrip, rx, squeeze, strip

FRONT = r"(?s)^---\n(.*?)\n---\n?(.*)\z"
FIELDS = ["tipo", "tipo_legible", "numero", "anio", "titulo", "fuente", "ruta_origen", "metodo_extraccion", "paginas", "caracteres"]


def split_frontmatter(df: DataFrame, md_col: str = "md") -> DataFrame:
    """df with meta map<string,string> (the last of equal keys wins) and body."""
    md = F.coalesce(md_col, F.lit(""))
    has = md.rlike(FRONT)
    pairs = F.filter(F.split(F.regexp_extract(md, FRONT, 1), "\n"), lambda x: F.contains(x, F.lit(":")))
    entry = lambda x: F.struct(strip(F.substring_index(x, ":", 1)).alias("k"), F.regexp_replace(strip(F.substring(x, F.instr(x, ":") + 1, F.length(x))), '^"+|"+$', "").alias("v"))
    entries = F.transform(pairs, entry)
    # Sorted by key and place, the last of each run of keys is what stays; map keys must differ.
    placed = F.array_sort(F.transform(entries, lambda x, i: F.struct(x["k"].alias("k"), i.alias("i"), x["v"].alias("v"))))
    last = let(placed, lambda p: F.filter(p, lambda x, i: (i == F.size(p) - 1) | (x["k"] != F.get(p, i + 1)["k"])))
    meta = F.map_from_entries(F.transform(last, lambda x: F.struct(x["k"].alias("key"), x["v"].alias("value"))))
    return df.withColumns({"meta": F.when(has, meta).otherwise(F.create_map().cast("map<string,string>")), "body": F.when(has, F.regexp_replace(F.regexp_extract(md, FRONT, 2), "^\n+", "")).otherwise(md)})


def meta_field(name: str, meta: str = "meta") -> Column:
    return F.coalesce(F.try_element_at(F.col(meta), F.lit(name)), F.lit(""))


def clean_number(raw: Column) -> Column:
    """The number of an article heading, without what surrounds it."""
    return strip(F.regexp_replace(strip(raw), r"^[.:°º\-–) ]+|[.:°º\-–) ]+$", ""))


def classify_lines(body: Column) -> Column:
    """array<struct<kind, name, text>>: article, section or content; titles are left out, paragraph headings are content."""

    content = lambda text: F.struct(F.lit("content").alias("kind"), F.lit(None).cast("string").alias("name"), text.alias("text"))
    named = lambda kind, name, s: F.struct(F.lit(kind).alias("kind"), name.alias("name"), s.alias("text"))

    def heading(s: Column) -> Column:
        number = let(strip(F.regexp_extract(s, rx(v.HEAD_PARAGRAPH), 1)), lambda n: F.when(n != "", F.concat(F.lit(" "), n)).otherwise(""))
        fold = s.rlike(rx(v.HEAD_PARAGRAPH))
        text = F.concat(F.lit("Parágrafo"), number, F.lit(":"))
        article = named("article", clean_number(F.regexp_extract(s, rx(v.HEAD_ARTICLE), 1)), s)
        section = named("section", F.upper(strip(F.regexp_extract(s, rx(v.HEAD_SECTION, fold=False), 1))), s)
        title = named("title", F.lit(None).cast("string"), s)
        return F.when(s.startswith("# "), title).when(s.rlike(rx(v.HEAD_ARTICLE)), article).when(fold, content(text)).when(s.rlike(rx(v.HEAD_SECTION, fold=False)), section).otherwise(content(s))

    # Only what begins with a mark can be a heading; most lines don't.
    one = lambda raw: let(rstrip(raw), lambda s: F.when(s.startswith("#"), heading(s)).otherwise(content(s)))
    return F.filter(F.transform(lines(body), one), lambda x: x["kind"] != "title")


def join_lines(texts: Column) -> Column:
    return squeeze(F.array_join(texts, " "))


def _structure(x: Column) -> Column:
    """struct<descripcion, considerando, resuelve, articles> of classified lines.

    Blocks lie between boundary lines, so a block's content is a slice of the line array.
    """
    heads = F.filter(F.transform(x, lambda y, i: F.struct(i.alias("at"), y["kind"].alias("kind"), y["name"].alias("name"))), lambda y: y["kind"] != "content")
    texts = F.transform(x, lambda y: y["text"])

    def with_heads(h: Column, t: Column) -> Column:
        upto = lambda i: F.coalesce(F.get(h, i)["at"], F.size(t))
        blocks = F.transform(h, lambda y, i: F.struct(y["kind"].alias("kind"), y["name"].alias("name"), F.slice(t, y["at"] + 2, upto(i + 1) - y["at"] - 1).alias("texts")))
        header = F.array_join(F.slice(t, F.lit(1), upto(F.lit(0))), " ")
        return let(blocks, lambda b: with_blocks(b, header))

    def with_blocks(b: Column, header: Column) -> Column:
        section = lambda name: F.flatten(F.transform(F.filter(b, lambda y: (y["kind"] == "section") & (y["name"] == name)), lambda y: y["texts"]))
        content = F.transform(F.filter(b, lambda y: y["kind"] == "article"), lambda y: F.struct(y["name"].alias("num"), join_lines(y["texts"]).alias("content")))
        # A list of blank lines counts: what matters is whether there's any line.
        resolves = let(section("RESUELVE"), lambda r: F.when(F.size(r) > 0, join_lines(r)).otherwise(join_lines(section("ACUERDA"))))
        return F.struct(
            squeeze(F.regexp_extract(header, rx(v.DESCRIPTION), 1)).alias("descripcion"),
            join_lines(section("CONSIDERANDO")).alias("considerando"),
            resolves.alias("resuelve"),
            F.filter(content, lambda y: y["content"] != "").alias("articles"),
        )

    return let(heads, lambda h: let(texts, lambda t: with_heads(h, t)))


def parse_structure(df: DataFrame, body_col: str = "body") -> DataFrame:
    """df with descripcion, considerando, resuelve and articles array<struct<num, content>>.

    It is one expression that binds what it uses twice, so a filter that the optimizer
    pushes below it repeats it once and not for each line.
    """
    staged = df.withColumn("_st", let(classify_lines(F.coalesce(body_col, F.lit(""))), _structure))
    return staged.select("*", "_st.*").drop("_st")
