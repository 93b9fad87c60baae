"""Raw Markdown to clean legal structure (N1-N19), as expressions of one row: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as v
from ..functions.text import BLANK, SPACES, either, either_of, let, lines, rstrip, rx, squeeze, strip

REPEAT_LENGTH = 25
#: Every heading begins with one of these, so one test spares most lines the four patterns.
HEADING_START = r"^(CONS|R\s*E\s*S|ACUE|DECR|DISP|ORDE|CERT|HACE|EN\s|CAP|T[IÍ]T|ART|PAR)"


def is_table(line: Column) -> Column:
    return F.ltrim(line, F.lit(SPACES)).startswith("|")


def strip_decoration(line: Column) -> Column:
    """Plain text of a Markdown line."""
    return let(strip(line), _plain)


def _plain(s: Column) -> Column:
    """strip_decoration() of a line without blanks at its ends."""
    has = lambda x, c: F.contains(x, F.lit(c))
    # Most lines hold few marks or none; a test for a character spares them the patterns.
    tagged = lambda x: F.when(has(x, "<"), F.regexp_replace(x, "</?[a-zA-Z][^>]*>", "")).otherwise(x)
    headed = lambda x: F.when(x.startswith("#"), F.regexp_replace(x, rf"^#{{1,6}}{BLANK}*", "")).otherwise(x)
    starred = lambda x: F.replace(F.replace(x, F.lit("*"), F.lit("")), F.lit("`"), F.lit(""))
    ruled = lambda x: F.when(has(x, "_") | has(x, "\\"), F.regexp_replace(x, r"_+|\\", " ")).otherwise(x)
    uncommented = F.when(has(s, "<"), F.regexp_replace(s, "<!--.*?-->", "")).otherwise(s)
    out = let(let(uncommented, headed), tagged)
    return squeeze(let(starred(out), ruled))


def is_noise(s: Column) -> Column:
    """Page marks, lone dates, banners and footers."""
    # What the patterns begin with, or hold, tells most lines apart; letters with other forms under case folding (i, k, s) aren't asked for.
    first = F.substring(s, 1, 1)
    begins = first.isin(list("PpUuRrAaDd(")) & either(s, [rx(v.PAGE_NOISE), rx(v.DATE_LINE, fold=False), rx(v.BANNER)])
    hint = lambda low: either_of(low, ["@", "metro", "vereda", "conmutador"])
    return begins | (let(F.lower(s), hint) & s.rlike(rx(v.FOOTER)))


def classify(md: Column) -> Column:
    """array<struct<pos, out, key, s>>: the lines that stay; out is set for lines that pass as they are, key for
    those that stay only at their first place."""

    def line(raw: Column, i: Column) -> Column:
        return let(strip(raw), lambda t: parts(raw, t, i))

    def parts(raw: Column, t: Column, i: Column) -> Column:
        table = t.startswith("|")
        s = F.when(table, F.lit("")).otherwise(_plain(t))
        return F.struct(i.alias("pos"), raw.alias("raw"), table.alias("table"), t.startswith("---").alias("ruled"), s.alias("s"))

    first = F.transform(lines(md), line)
    kept = F.filter(first, lambda x: x["table"] | ~((x["ruled"] & strip(x["raw"]).rlike(v.RULE_LINE)) | is_noise(x["s"])))
    key = lambda x: F.when(~x["table"] & (F.length(x["s"]) >= REPEAT_LENGTH), F.lower(x["s"]))
    out = lambda x: F.when(x["table"], rstrip(x["raw"])).when(x["s"] == "", F.lit(""))
    return F.transform(kept, lambda x: F.struct(x["pos"].alias("pos"), out(x).alias("out"), key(x).alias("key"), x["s"].alias("s")))


def first_of_repeats(kept: Column) -> Column:
    """Lines with a key only at its first place: after a sort by key and place, the first of each run."""
    sorted_ = F.sort_array(F.transform(F.filter(kept, lambda x: x["key"].isNotNull()), lambda x: F.struct(x["key"].alias("key"), x["pos"].alias("pos"), x["out"].alias("out"), x["s"].alias("s"))))
    firsts = let(sorted_, lambda keyed: F.filter(keyed, lambda x, i: (i == 0) | (x["key"] != F.get(keyed, i - 1)["key"])))
    by_pos = lambda a: F.transform(a, lambda x: F.struct(x["pos"].alias("pos"), x["out"].alias("out"), x["s"].alias("s")))
    return F.sort_array(F.concat(by_pos(F.filter(kept, lambda x: x["key"].isNull())), by_pos(firsts)))


def promote(s: Column) -> Column:
    """array<string>: a plain line, or the heading that it announces and what follows it on the line."""
    group = lambda p, i: F.regexp_extract(s, rx(p), i)
    rest = lambda p: strip(group(p, 3))
    headed = lambda label, p: F.filter(F.array(F.lit(""), label, rest(p)), lambda x, i: (i < 2) | (x != ""))
    section = F.array(F.lit(""), F.concat(F.lit("## "), F.upper(F.regexp_replace(group(v.SECTION, 1), f"{BLANK}+", ""))), F.lit(""))
    after = rest(v.CHAPTER)
    chapter = F.array(F.lit(""), F.concat(F.lit("## "), F.upper(group(v.CHAPTER, 1)), F.lit(" "), F.upper(group(v.CHAPTER, 2)), F.when(after != "", F.concat(F.lit(" — "), after)).otherwise("")))
    article = headed(F.concat(F.lit("### ARTÍCULO "), F.upper(group(v.ARTICLE, 2))), v.ARTICLE)
    ordinal = F.upper(strip(group(v.PARAGRAPH, 2)))
    paragraph = headed(F.concat(F.lit("#### PARÁGRAFO"), F.when(ordinal != "", F.concat(F.lit(" "), ordinal)).otherwise("")), v.PARAGRAPH)
    plain = ~F.substring(s, 1, 1).isin(list("CcRrAaDdOoHhEeTtPp")) | ~s.rlike(rx(HEADING_START))
    return F.when(plain, F.array(s)).when(s.rlike(rx(v.SECTION)), section).when(s.rlike(rx(v.CHAPTER)), chapter).when(s.rlike(rx(v.ARTICLE)), article).when(s.rlike(rx(v.PARAGRAPH)), paragraph).otherwise(F.array(s))


def assemble(kept: Column) -> Column:
    every = F.flatten(F.transform(kept, lambda x: F.when(x["out"].isNotNull(), F.array(x["out"])).otherwise(promote(x["s"]))))
    return strip(let(F.array_join(every, "\n"), lambda x: F.when(F.contains(x, F.lit("\n\n\n")), F.regexp_replace(x, "\n{3,}", "\n\n")).otherwise(x)))


def normalize(df: DataFrame, raw_col: str = "raw_md", out_col: str = "body") -> DataFrame:
    """df with the normalised Markdown of raw_col."""
    staged = df.withColumn("_kept", classify(F.coalesce(raw_col, F.lit(""))))
    return staged.withColumn("_kept", first_of_repeats(F.col("_kept"))).withColumn(out_col, assemble(F.col("_kept"))).drop("_kept")


def line_frequency(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, n): how often each long text line stands in its document; the two keys deal it out, so no document is one task."""
    each = df.select(id_col, F.explode(lines(F.coalesce(text_col, F.lit("")))).alias("raw")).filter(~is_table(F.col("raw")))
    s = each.withColumn("s", strip_decoration(F.col("raw"))).filter(F.length("s") >= REPEAT_LENGTH)
    return s.groupBy(id_col, F.lower("s").alias("key")).agg(F.count("*").alias("n"))


def frontmatter(doc_type: Column, label: Column, number: Column, year: Column, title: Column, source: Column, path: Column, method: Column, pages: Column, chars: Column) -> Column:
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"'))
    rows = [("tipo", doc_type), ("tipo_legible", quoted(label)), ("numero", quoted(number)), ("anio", quoted(year)), ("titulo", quoted(title)), ("fuente", quoted(source)), ("ruta_origen", quoted(path)), ("metodo_extraccion", method), ("paginas", pages.cast("string")), ("caracteres", chars.cast("string"))]
    return F.concat(F.lit("---\n"), *(x for name, value in rows for x in (F.lit(f"{name}: "), value, F.lit("\n"))), F.lit("---\n"))


def to_markdown(df: DataFrame, raw_col: str = "raw_md", method: str = "pymupdf4llm", pages_col: str | None = None) -> DataFrame:
    """df (with path_meta() columns) with body and md: frontmatter, title and body; `caracteres` is the raw text's length."""
    pages = F.col(pages_col) if pages_col else F.lit(1)
    head = frontmatter(*(F.col(c) for c in ("doc_type", "type_label", "number", "year", "titulo", "source_filename", "rel_path")), F.lit(method), pages, F.length(F.coalesce(raw_col, F.lit(""))))
    return normalize(df, raw_col).withColumn("md", F.concat(head, F.lit("\n# "), F.col("titulo"), F.lit("\n\n"), F.col("body"), F.lit("\n")))
