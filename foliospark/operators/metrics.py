"""Evaluation of predictions against references (M1-M17). Pairs: example_id, reference, prediction."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..functions import vocab as v
from ..functions.text import ngrams, rx, tokens

N_MAX = 4


def citations(text: Column) -> Column:
    """array<string>: the distinct `number/year` citations, numbers without leading zeros."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rx(v.CITATION)), F.lit(0))
    part = lambda x, i: F.regexp_extract(x, rx(v.CITATION), i)
    number = lambda x: F.coalesce(F.nullif(F.ltrim(part(x, 1), F.lit("0")), F.lit("")), F.lit("0"))
    return F.array_distinct(F.transform(found, lambda x: F.concat_ws("/", number(x), part(x, 2))))


def citation_accuracy(pairs: DataFrame) -> DataFrame:
    """(exactitud_citas): of references that cite, the share whose prediction shares a citation; 0 without any."""
    both = pairs.select(citations(F.col("reference")).alias("r"), citations(F.col("prediction")).alias("p")).filter(F.size("r") > 0)
    return both.agg(F.coalesce(F.avg(F.arrays_overlap("r", "p").cast("double")), F.lit(0.0)).alias("exactitud_citas"))


def admits(text: Column) -> Column:
    """Whether an answer admits not to know."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.contains(low, F.lit(v.ADMISSIONS[0]))
    for phrase in v.ADMISSIONS[1:]:
        out = out | F.contains(low, F.lit(phrase))
    return out


def hallucination_rate(answers: DataFrame, answer_col: str = "answer") -> DataFrame:
    return answers.agg(F.coalesce(F.avg((~admits(F.col(answer_col))).cast("double")), F.lit(0.0)).alias("tasa_alucinacion"))


def _sided(words: DataFrame, sides: list[tuple[str, int, int]], n_max: int) -> DataFrame:
    """(example_id, n, gram, p, r): how often each n-gram of 1 to n_max words stands in each side of an example.

    words is dealt out by example, so a gram's counts meet where the example lies: grams, many times larger than
    the texts, cross no shuffle.
    """
    grams = F.array(*(F.struct(F.lit(n).alias("n"), F.lit(p).alias("p"), F.lit(r).alias("r"), ngrams(F.col(c), n).alias("g")) for c, p, r in sides for n in range(1, n_max + 1)))
    each = words.select("example_id", F.explode(grams).alias("x")).select("example_id", "x.n", "x.p", "x.r", F.explode("x.g").alias("gram"))
    return each.groupBy("example_id", "n", "gram").agg(F.sum("p").alias("p"), F.sum("r").alias("r"))


def gram_counts(pairs: DataFrame, n_max: int = N_MAX, sides: tuple[str, ...] = ("prediction", "reference")) -> DataFrame:
    """(example_id, n, gram, p, r): how often each n-gram of 1 to n_max words stands in prediction and reference."""
    dealt = pairs.select("example_id", "prediction", "reference").repartition("example_id")
    words = dealt.select("example_id", *(tokens(F.coalesce(c, F.lit(""))).alias(c) for c in sides))
    return _sided(words, [(c, int(c == "prediction"), int(c == "reference")) for c in sides], n_max)


def cider(pairs: DataFrame, n_max: int = N_MAX) -> DataFrame:
    """(cider): mean TF-IDF cosine of n-grams over examples and n; the IDF is the references'.

    Document frequencies join by gram and order; one common gram is a hot key that a skew
    join splits, and frequencies aren't broadcast, as they grow with the corpus.
    """
    counts = gram_counts(pairs, n_max)
    total = pairs.agg(F.count("*").alias("total"))
    df = gram_counts(pairs, n_max, ("reference",)).groupBy("n", "gram").agg(F.count("*").alias("df"))
    weighted = counts.join(df, ["n", "gram"], "left").join(F.broadcast(total)).withColumn("idf", F.ln((F.col("total") + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1)
    a, b = F.col("p") * F.col("idf"), F.col("r") * F.col("idf")
    cos = weighted.groupBy("example_id", "n").agg(F.sum(a * b).alias("ab"), F.sum(a * a).alias("aa"), F.sum(b * b).alias("bb"))
    score = F.coalesce(F.try_divide(F.col("ab"), F.sqrt("aa") * F.sqrt("bb")), F.lit(0.0))
    summed = cos.agg(F.coalesce(F.sum(score), F.lit(0.0)).alias("s"))
    return summed.join(F.broadcast(total)).select(F.coalesce(F.try_divide("s", F.col("total") * n_max), F.lit(0.0)).alias("cider"))


def vocabulary_mi(pairs: DataFrame) -> DataFrame:
    """(example_id, mi): divergence of the two vocabularies; 0 where either is empty."""
    counts = gram_counts(pairs, 1).select("example_id", "p", "r")
    sizes = counts.groupBy("example_id").agg(F.sum("p").alias("tp"), F.sum("r").alias("tr"))
    joined = counts.join(sizes.filter("tp > 0 AND tr > 0"), "example_id")
    n = F.col("tp") + F.col("tr")
    term = lambda c, t: F.when(F.col(c) > 0, F.col(c) / n * F.ln((F.col(c) / n) / ((F.col(t) / n) * ((F.col("p") + F.col("r")) / n)))).otherwise(0.0)
    mi = joined.groupBy("example_id").agg(F.sum(term("p", "tp") + term("r", "tr")).alias("mi"))
    return pairs.select("example_id").join(mi, "example_id", "left").select("example_id", F.coalesce("mi", F.lit(0.0)).alias("mi"))


def mean_mi(pairs: DataFrame) -> DataFrame:
    return vocabulary_mi(pairs).agg(F.coalesce(F.avg("mi"), F.lit(0.0)).alias("info_mutua"))


def rouge_tokens(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "), " "), lambda t: t != "")


@F.pandas_udf(IntegerType())
def _lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence: one long integer holds a row of the table, a bit for each word (Hyyrö's form)."""
    out = []
    for x, y in zip(a, b, strict=True):
        where: dict[str, int] = {}
        for i, w in enumerate(x):
            where[w] = where.get(w, 0) | 1 << i
        full = row = (1 << len(x)) - 1
        for w in y:
            met = row & where.get(w, 0)
            row = ((row + met) | (row - met)) & full
        out.append(len(x) - row.bit_count())
    return pd.Series(out)


def rouge_l(pairs: DataFrame) -> DataFrame:
    """(example_id, rouge_l): F measure of the longest common subsequence, without stemming."""
    t = pairs.select("example_id", rouge_tokens(F.col("prediction")).alias("p"), rouge_tokens(F.col("reference")).alias("r"))
    lcs = t.withColumn("lcs", _lcs("p", "r"))
    return lcs.select("example_id", F.coalesce(F.try_divide(2 * F.col("lcs"), F.size("p") + F.size("r")), F.lit(0.0)).alias("rouge_l"))


def bleu_tokens(text: Column) -> Column:
    """The international 13a rules: punctuation apart, but points and commas between digits."""
    s = F.coalesce(text, F.lit(""))
    for pattern, by in (("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        s = F.replace(s, F.lit(pattern), F.lit(by))
    s = F.concat(F.lit(" "), s, F.lit(" "))
    for pattern, by in ((r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 "), (r"([^0-9])([\.,])", "$1 $2 "), (r"([\.,])([^0-9])", " $1 $2"), (r"([0-9])(-)", "$1 $2 ")):
        s = F.regexp_replace(s, pattern, by)
    return F.filter(F.split(F.trim(s), r"\s+"), lambda t: t != "")


def bleu(pairs: DataFrame) -> DataFrame:
    """(bleu): corpus BLEU, 0 to 100: clipped n-gram matches over all pairs, exponential smoothing of zero counts, brevity penalty."""
    dealt = pairs.select("example_id", "prediction", "reference").repartition("example_id")
    words = dealt.select("example_id", bleu_tokens(F.col("prediction")).alias("p"), bleu_tokens(F.col("reference")).alias("r"))
    counts = _sided(words, [("p", 1, 0), ("r", 0, 1)], N_MAX)
    agg = counts.groupBy().agg(*(f(n) for n in range(1, N_MAX + 1) for f in (lambda n: F.sum(F.when(F.col("n") == n, F.least("p", "r")).otherwise(0)).alias(f"m{n}"), lambda n: F.sum(F.when(F.col("n") == n, F.col("p")).otherwise(0)).alias(f"t{n}"))), F.sum(F.when(F.col("n") == 1, F.col("r")).otherwise(0)).alias("ref"))
    logs, halvings = F.lit(0.0), F.lit(0)
    for n in range(1, N_MAX + 1):
        m, total = F.col(f"m{n}").cast("double"), F.col(f"t{n}").cast("double")
        halvings = F.when((m == 0) & (total > 0), halvings + 1).otherwise(halvings)
        precision = F.when(m > 0, 100 * m / F.greatest(total, F.lit(1.0))).when(total > 0, 100 / (F.pow(F.lit(2.0), halvings) * F.greatest(total, F.lit(1.0)))).otherwise(0.0)
        logs = logs + F.ln(F.greatest(precision, F.lit(1e-300)))
    sys_len, ref = F.col("t1"), F.col("ref")
    penalty = F.when(sys_len >= ref, 1.0).otherwise(F.exp(1 - F.try_divide(ref, sys_len)))
    return agg.select(F.when(F.coalesce(F.col("m1"), F.lit(0)) == 0, 0.0).otherwise(penalty * F.exp(logs / N_MAX)).alias("bleu"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, z: s + z)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def embedding_cosine(pairs: DataFrame, a: str = "emb_p", b: str = "emb_r") -> DataFrame:
    return pairs.agg(F.avg(cosine(F.col(a), F.col(b))).alias("coseno_sem"))


def perplexity(scores: DataFrame) -> DataFrame:
    """(perdida, perplejidad, entropia) from nll and entropy by example; means over examples, not tokens."""
    return scores.agg(F.avg("nll").alias("perdida"), F.exp(F.avg("nll")).alias("perplejidad"), F.avg("entropy").alias("entropia"))


def with_plugin(df: DataFrame, columns: list[str], outputs: dict[str, str], call: Callable[..., dict]) -> DataFrame:
    """df with what call gives for the named columns' values: embedders, forward passes, similarity models.

    call runs in the Python workers and should load its model once for each process.
    """
    from pyspark.sql.types import StructType

    schema = StructType([*df.schema.fields, *StructType.fromDDL(", ".join(f"{k} {t}" for k, t in outputs.items())).fields])

    def run(frames):
        for f in frames:
            made = [call(*row) for row in zip(*(f[c] for c in columns), strict=True)]
            yield f.assign(**{k: [m[k] for m in made] for k in outputs})

    return df.mapInPandas(run, schema)


def mean_similarity(pairs: DataFrame, score: Callable[[str, str], float]) -> DataFrame:
    """(bertscore_f1): the mean of a plug-in's token similarity of prediction and reference; 0 without pairs."""
    scored = with_plugin(pairs.select(F.coalesce("prediction", F.lit("")).alias("p"), F.coalesce("reference", F.lit("")).alias("r")), ["p", "r"], {"f1": "double"}, lambda p, r: {"f1": float(score(p, r))})
    return scored.agg(F.coalesce(F.avg("f1"), F.lit(0.0)).alias("bertscore_f1"))


def answer_losses(pairs: DataFrame, forward: Callable[[str, str], list[tuple[float, float]]], most: int = 1024) -> DataFrame:
    """pairs with nll and entropy: means over the answer's tokens among the first most of prompt and answer; both 0 if none is there.

    forward(question, reference) is a plug-in's single pass: for each token of prompt and
    answer after the first, (loss, entropy), prompt positions as (nan, nan).
    """

    def one(question: str, reference: str) -> dict:
        kept = [x for x in forward(question or "", reference or "")[: most - 1] if x[0] == x[0]]
        return {k: float(sum(x[i] for x in kept) / len(kept)) if kept else 0.0 for i, k in enumerate(("nll", "entropy"))}

    return with_plugin(pairs, ["question", "reference"], {"nll": "double", "entropy": "double"}, one)


def first_rows(pairs: DataFrame, limit: int, index: str = "idx") -> DataFrame:
    """The first limit examples in file order; 0: all."""
    return pairs.filter(F.col(index) < limit) if limit else pairs


def result_row(pairs: DataFrame, out_of_domain: DataFrame, scores: DataFrame | None = None, embedded: DataFrame | None = None, **fixed) -> DataFrame:
    """One row in the order of LOG_COLUMNS; what isn't given is null."""
    one = lambda d: F.broadcast(d)  # noqa: E731  a single row each
    row = pairs.agg(F.count("*").cast("int").alias("n_prueba"))
    parts = [cider(pairs), mean_mi(pairs), rouge_l(pairs).agg(F.coalesce(F.avg("rouge_l"), F.lit(0.0)).alias("rouge_l")), bleu(pairs), citation_accuracy(pairs), hallucination_rate(out_of_domain)]
    parts += [perplexity(scores)] if scores is not None else []
    parts += [embedding_cosine(embedded)] if embedded is not None else []
    for p in parts:
        row = row.join(one(p))
    digits = {c: 4 for c in ("coseno_sem", "rouge_l", "cider", "perdida", "entropia", "info_mutua", "exactitud_citas", "tasa_alucinacion", "bertscore_f1")} | {"bleu": 2, "perplejidad": 2}
    row = row.withColumn("fecha", F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm") if "fecha" not in fixed else F.lit(fixed["fecha"]))
    kinds = {"rank": "int", "lora_alpha": "int", "lora_dropout": "double", "bertscore_f1": "double", "checkpoint": "string", "epochs": "string", "learning_rate": "string"}
    out = []
    for c in v.LOG_COLUMNS:
        x = F.col(c) if c in row.columns else F.lit(fixed.get(c)).cast(kinds.get(c, "double"))
        # As Python's round(): of the binary value, halves to even.
        out.append((F.rint(x * 10 ** digits[c]) / 10 ** digits[c] if c in digits else x).alias(c))
    return row.select(*out)
