"""Plans and helpers that keep work in proportion to the input."""

import pytest
from pyspark.sql import functions as F

from foliospark.functions.text import BLANK, SPACES, lines, rstrip, squeeze, strip
from foliospark.operators import dataset, metrics, normalize
from foliospark.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"
NOT_MARKS = [c for c in map(chr, range(0x3100)) if not 0xD800 <= ord(c) < 0xE000]


def test_blanks_are_pythons(spark):
    assert set(SPACES) == {c for c in NOT_MARKS if c.isspace()}
    texts = [f"{c}a{c}b {c} c{c}" for c in NOT_MARKS if c != "\0"] + [" a  b ", "a b", "", "ñ ñ", "á\u2003 b"]
    made = spark.createDataFrame([(t,) for t in texts], "t string").select("t", strip(F.col("t")).alias("s"), rstrip(F.col("t")).alias("r"), squeeze(F.col("t")).alias("q"), lines(F.col("t")).alias("l"), F.col("t").rlike(BLANK).alias("b"))
    for x in made.collect():
        assert (x.s, x.r, x.q, x.l, x.b) == (x.t.strip(), x.t.rstrip(), " ".join(x.t.split()), x.t.splitlines(), any(c.isspace() for c in x.t)), x.t


def test_noise_beside_its_hints(spark):
    texts = ["(Mayo 5)", "página 3 de 4", "PAG. 3", "universidad de los llanos acuerdo", "Resolución x No. 1 DE 2004", "vía VEREDA barcelona 1", "sede: \u212aILÓMETRO 12 VIA a puerto lópez", "CONMUTADOR8", "a.b@c.de", "a b@c.de", "una línea", "kilómetro 12", ""]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(normalize.is_noise(F.col("t"))).collect()]
    assert got == [True] * 9 + [False] * 4


def plan(name, spark):
    spark.conf.set("spark.sql.maxPlanStringLength", "10000000")
    return QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize(("name", "most"), [("noise_drop", 1), ("formatted", 1)])
def test_a_line_is_made_plain_once(spark, name, most):
    assert plan(name, spark).count("<!--") == most


def test_split_reads_its_pairs_once(spark):
    done = QUERIES["split_hash"](spark, DATA)
    done.collect()
    assert "ReusedExchange" in done._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_split_keeps_null_keys_last(spark):
    made = dataset.split_hash(spark.createDataFrame([("a",), (None,), ("b",), ("c",)], "k string"), "k", 0.75).collect()
    assert sorted(r.split for r in made) == ["test"] * 3 + ["train"]
    assert [r.split for r in made if r.k is None] == ["train"]


@pytest.mark.parametrize("name", ["bleu", "vocab_mi", "ngrams"])
def test_grams_stay_where_their_example_lies(spark, name):
    pairs = spark.range(9).selectExpr("cast(id % 7 AS string) AS example_id", "'a b c' AS prediction", "'b c' AS reference")
    df = {"bleu": metrics.bleu, "vocab_mi": metrics.vocabulary_mi, "ngrams": metrics.gram_counts}[name](pairs)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in text.split("\n") if "Exchange" in x and "gram" in x]
