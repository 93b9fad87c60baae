"""Grounded question-answer pairs (Q1-Q17)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as v
from ..functions.text import let, or_else, rx, strip
from .structure import meta_field

MAX_PAIRS = 10
EXCERPT = 1200
PAIR = "array<struct<question:string,answer:string,source:string>>"
ARTICLE = "array<struct<num:string,content:string>>"


def references(df: DataFrame) -> DataFrame:
    """df (with meta) with tipo, cita, source, el, al, del_ (article, capital article, contraction), suffix, entity and skipped: whether the type yields no pairs (Q1-Q6).

    A flag, not a filter: the optimizer would push a filter on parsed text below the parsing and so do that twice."""
    tipo, year, number = meta_field("tipo"), meta_field("anio"), meta_field("numero")
    name = or_else(meta_field("tipo_legible"), or_else(tipo, F.lit("documento normativo")))
    cite = F.when((number != "") & (year != ""), F.concat(name, F.lit(" No. "), number, F.lit(" de "), year)).when(year != "", F.concat(name, F.lit(" ("), year, F.lit(")"))).otherwise(name)
    masculine = F.lower(name).rlike("^(" + "|".join(v.MASCULINE) + ")")
    national = F.upper(tipo).rlike("|".join(v.NATIONAL_HINTS))
    forms = {"el": ("el", "la"), "al": ("El", "La"), "del_": ("del", "de la")}
    out = df.withColumns({"tipo": tipo, "cita": cite}).withColumn("skipped", F.col("tipo").isin(v.SKIP_TYPES))
    out = out.withColumns({k: F.when(masculine, a).otherwise(b) for k, (a, b) in forms.items()})
    return out.withColumns({"source": or_else(meta_field("fuente"), F.col("cita")), "suffix": F.when(national, "").otherwise(v.SHORT_SUFFIX), "entity": F.when(national, "").otherwise(v.LONG_SUFFIX)})


def valid_number(raw: Column) -> Column:
    """An article number if it is one (digits, roman letters, an ordinal), else empty (Q8)."""
    roman = lambda n: n.rlike(rx("^[IVXLCDM]+$")) & (F.length(n) <= 5)
    return let(strip(raw), lambda n: F.when(n.rlike(r"(?U)^\d{1,3}\z"), n).when(roman(n), F.upper(n)).when(F.lower(n).isin(v.ORDINAL_WORDS), F.lower(n)).otherwise(""))


def number_articles(articles: Column, room: Column) -> Column:
    """array<struct<num, content>>: articles under numbers that differ, room at most (Q9).

    Each number depends on those given before, so this is a fold; it stops early and its
    state holds at most room entries.
    """
    start = F.struct(F.lit(0).alias("idx"), F.array().cast(ARTICLE).alias("out"))

    def step(acc: Column, a: Column) -> Column:
        seen = lambda n: F.exists(acc["out"], lambda x: x["num"] == n)
        idx = acc["idx"] + 1
        lead = F.regexp_extract(a["content"], r"(?U)^\s*(\d{1,3})[.\)]", 1)
        second = let(lead, lambda n: F.when((n != "") & ~seen(n), n).otherwise(idx.cast("string")))
        num = let(valid_number(a["num"]), lambda n: F.when((n != "") & ~seen(n), n).otherwise(second))
        grown = lambda n: F.concat(acc["out"], F.array(F.struct(n.alias("num"), a["content"].alias("content"))))
        out = let(num, lambda n: F.when(seen(n), acc["out"]).otherwise(grown(n)))
        return F.when(F.size(acc["out"]) >= room, acc).otherwise(F.struct(idx.alias("idx"), out.alias("out")))

    return F.aggregate(articles, start, step, lambda acc: acc["out"])


def heuristic_pairs(df: DataFrame, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """df (references() and parse_structure() columns) with pairs."""
    cat = lambda *parts: F.concat(*(F.col(p[1:]) if isinstance(p, str) and p.startswith("$") else F.lit(p) if isinstance(p, str) else p for p in parts))
    pair = lambda q, a: F.struct(q.alias("question"), a.alias("answer"), F.col("source").alias("source"))
    none = F.array().cast(PAIR)
    described, any_article = F.col("descripcion") != "", F.size("articles") > 0
    first = F.get("articles", 0)
    intro = F.concat(
        cat("$al", " ", "$cita", "$entity", " es la norma «", "$descripcion", "»."),
        F.when(any_article, F.concat(F.lit(" En su artículo "), or_else(first["num"], F.lit("1")), F.lit(" establece: "), first["content"])).otherwise(""),
    )
    general = F.when(described, F.array(pair(cat("¿De qué trata ", "$el", " ", "$cita", "$suffix", "?"), intro), pair(cat("¿Qué regula ", "$el", " ", "$cita", "$suffix", "?"), intro))).otherwise(none)
    room = F.lit(max_pairs - 1) - F.when(described, 2).otherwise(0)
    staged = df.withColumn("_numbered", number_articles(F.col("articles"), room))
    by_article = F.transform(
        "_numbered",
        lambda a: pair(cat("¿Qué establece el artículo ", a["num"], " ", "$del_", " ", "$cita", "$suffix", "?"), cat("Según el artículo ", a["num"], " ", "$del_", " ", "$cita", "$entity", ", se establece: ", a["content"])),
    )
    text = or_else(F.col("resuelve"), or_else(F.col("considerando"), F.col("descripcion")))
    head = lambda c: F.substring(c, 1, EXCERPT)
    orders = F.when(~described, F.array(pair(cat("¿Qué dispone ", "$el", " ", "$cita", "$suffix", "?"), cat("$al", " ", "$cita", "$entity", " dispone: ", head(text))))).otherwise(none)
    grounds = F.when(F.col("considerando") != "", F.array(pair(cat("¿Cuál es el fundamento ", "$del_", " ", "$cita", "$suffix", "?"), cat("$al", " ", "$cita", "$entity", " considera: ", head(F.col("considerando")))))).otherwise(none)
    fallback = F.when(~any_article & (text != ""), F.concat(orders, grounds)).otherwise(none)
    since = lambda found: F.array(pair(cat("¿Desde cuándo rige ", "$el", " ", "$cita", "$suffix", "?"), cat("$al", " ", "$cita", "$entity", " ", strip(found), ".")))
    in_force = let(F.regexp_extract("body", rx(v.IN_FORCE), 1), lambda found: F.when(found != "", since(found)).otherwise(none))
    # Effective dates come last, so the cut leaves them out where the pairs are full already.
    every = F.slice(F.concat(general, by_article, fallback, in_force), 1, max_pairs)
    return staged.withColumn("pairs", F.when(F.col("skipped"), none).otherwise(every)).drop("_numbered")


def template_pairs(df: DataFrame, n: int = 5) -> DataFrame:
    """df (references() columns) with pairs to be filled in (Q14)."""
    one = lambda i: F.struct(
        F.concat(F.lit("[PREGUNTA "), i.cast("string"), F.lit(" sobre "), F.col("cita"), F.lit("]")).alias("question"),
        F.concat(F.lit("[RESPUESTA "), i.cast("string"), F.lit(" — completar con información de "), F.col("cita"), F.lit("]")).alias("answer"),
        F.col("source").alias("source"),
    )
    return df.withColumn("pairs", F.when(~F.col("skipped"), F.transform(F.sequence(F.lit(1), F.lit(n)), one)).otherwise(F.array().cast(PAIR)))


def explode_pairs(df: DataFrame, *keys: str) -> DataFrame:
    """A row for each pair: keys, pair_idx (from 0), question, answer, source."""
    # The outer form, as the plain one makes the optimizer compute pairs twice, to drop empty arrays early.
    return df.select(*keys, F.posexplode_outer("pairs").alias("pair_idx", "p")).filter("pair_idx IS NOT NULL").select(*keys, "pair_idx", "p.question", "p.answer", F.col("p.source").alias("source"))


def alpaca_columns() -> list[Column]:
    return [F.col("question").alias("instruction"), F.lit("").alias("input"), F.col("answer").alias("output")]


def conversations() -> Column:
    turn = lambda who, c: F.struct(F.lit(who).alias("from"), F.col(c).alias("value"))
    return F.array(turn("human", "question"), turn("gpt", "answer")).alias("conversations")


def to_alpaca(qa: DataFrame) -> DataFrame:
    return qa.select(*alpaca_columns())


def to_sharegpt(qa: DataFrame) -> DataFrame:
    return qa.select(conversations())


def records(qa: DataFrame) -> DataFrame:
    """(format, record): each pair as JSON in both formats; pairs are made once for the two."""
    one = lambda fmt, *c: F.struct(F.lit(fmt).alias("format"), F.to_json(F.struct(*c)).alias("record"))
    return qa.select(F.explode(F.array(one("alpaca", *alpaca_columns()), one("sharegpt", conversations()))).alias("x")).select("x.format", "x.record")


def formatted(qa: DataFrame, fmt: str = "alpaca") -> DataFrame:
    return to_alpaca(qa) if fmt == "alpaca" else to_sharegpt(qa)
