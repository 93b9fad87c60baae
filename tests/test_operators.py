"""Operators against values derived by hand from their rules."""

import math

import pytest
from pyspark.sql import functions as F

from foliospark.operators import chat, dataset, metrics, normalize, paths, qa, routing, structure


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize(
    ("path", "expected"),
    [
        ("2015/si/normatividad/LEY/3_2015_9JYqTCE.pdf", ("LEY", "Ley", "2015", "3", "Ley No. 3 de 2015", "2015/LEY/3_2015_9JYqTCE.md")),
        ("normatividad/x.pdf", ("normatividad", "Normatividad", "", "", "Normatividad", "x.md")),
        ("x.pdf", ("", "", "", "", "", "x.md")),
        ("2001/si/normatividad/otra_3a_norma/007.pdf", ("otra_3a_norma", "Otra 3A Norma", "2001", "007", "Otra 3A Norma No. 007 de 2001", "2001/otra_3a_norma/007.md")),
    ],
)
def test_path_meta(spark, path, expected):
    row = paths.path_meta(spark.createDataFrame([(path,)], "path string")).first()
    assert (row.doc_type, row.type_label, row.year, row.number, row.titulo, row.out_path) == expected


def test_scope_arguments():
    assert paths.csv_list(" , ") is None
    assert paths.csv_list("a, b,") == ["a", "b"]
    assert dataset.types_argument("a,,b") == ["a", "", "b"]


def test_limit_counts_successes(spark):
    rows = [(f"p/{i:02}.pdf", i % 2 == 1) for i in range(10)]
    kept = paths.until_written(spark.createDataFrame(rows, "path string, ok boolean"), 2, "ok").collect()
    assert sorted(r.path for r in kept) == [f"p/{i:02}.pdf" for i in range(4)]


def test_every_path_has_its_rank(spark):
    every = [f"{i * 37 % 500 // 20}/{'a' if i % 3 else 'a b'}/{i:03}.pdf" for i in range(500)]
    got = paths.ranked(spark.createDataFrame([(p,) for p in every], "path string").repartition(7)).collect()
    assert sorted((r.rank, r.path) for r in got) == list(enumerate(sorted(every, key=lambda p: p.split("/")), 1))


@pytest.mark.parametrize(("text", "corrupt"), [("a1b " * 6, True), ("a1b a1b a2b a2b a3b a3b", False), ("", False), ("a1b A1B a1b c22d c22d c22d", True), (None, False)])
def test_looks_corrupt(spark, text, corrupt):
    assert one(spark, text, routing.looks_corrupt) is corrupt


def test_routes(spark):
    long = "palabra " * 20
    docs = spark.createDataFrame([("", ""), ("x" * 60, long), (long, ""), ("a1b " * 30, "")], "text string, read string")
    assert [r.route for r in routing.route_documents(docs).collect()] == ["escaneado_omitido", "vacio_a_ocr", "digital", "corrupto_omitido"]
    assert [r.route for r in routing.route_documents(docs, ocr=True, ocr_text_col="read").collect()] == ["vacio_a_ocr", "ocr", "digital", "vacio_a_ocr"]


@pytest.mark.parametrize(
    ("raw", "body"),
    [
        ("**Artículo 1º.-OBJETO.**", "### ARTÍCULO 1º\nOBJETO."),
        ("HACE CONSTAR:", "## HACECONSTAR"),
        ("R E S U E L V E", "## RESUELVE"),
        ("Parágrafos del acto", "#### PARÁGRAFO\ns del acto"),
        ("TÍTULO II: De la matrícula", "## TÍTULO II — De la matrícula"),
        ("Título de grado", "Título de grado"),
        ("Página 1 de 2\n( Mayo 05 )\n---\ninfo@example.edu\nqueda", "queda"),
        ("| a | b |  \n| a | b |", "| a | b |\n| a | b |"),
        ("esta línea tiene veinticinco\nb\nEsta línea tiene veinticinco\nc", "esta línea tiene veinticinco\nb\nc"),
        ("esta línea tiene 24 letra\nesta línea tiene 24 letra"[:24] + "\nesta línea tiene 24 letr", "esta línea tiene 24 letr\nesta línea tiene 24 letr"),
        ("a\n\n\n\nb", "a\n\nb"),
        ("<u>x</u>_y_\\z", "x y z"),
        ("", ""),
        (None, ""),
    ],
)
def test_normalize(spark, raw, body):
    assert normalize.normalize(spark.createDataFrame([(raw,)], "raw_md string")).first().body == body


def parsed(spark, md):
    return structure.parse_structure(structure.split_frontmatter(spark.createDataFrame([(md,)], "md string"))).first()


def test_frontmatter(spark):
    row = parsed(spark, '---\ntipo: LEY\ntitulo: "a: \\"b\\""\ntipo: ACTA\nsuelto\n---\n\n\ncuerpo')
    assert row.meta == {"tipo": "ACTA", "titulo": 'a: \\"b\\'} and row.body == "cuerpo"
    assert parsed(spark, "sin cabecera").meta == {}


def test_structure(spark):
    row = parsed(spark, "# T\n“Por la cual se adopta un reglamento largo”\n## RESUELVE\n\n## ACUERDA\ntexto\n### ARTÍCULO 5°.\nuno\n#### PARÁGRAFO 1\ndos\n### ARTICULO 6\n\n## CONSIDERANDO\na\n## X\n## CONSIDERANDO\nb")
    assert row.descripcion == "Por la cual se adopta un reglamento largo"
    assert (row.resuelve, row.considerando) == ("", "a b")
    assert [tuple(a) for a in row.articles] == [("5", "uno Parágrafo 1: dos")]


@pytest.mark.parametrize(("raw", "number"), [("MIL", "MIL"), ("PRIMERO", "primero"), ("1234", ""), ("vi", "VI"), ("", ""), ("IIIIII", "")])
def test_valid_number(spark, raw, number):
    assert one(spark, raw, qa.valid_number) == number


@pytest.mark.parametrize(("raw", "numbers"), [(["1", "1", "1"], ["1", "2", "3"]), (["2", "2"], ["2"]), (["?", "PRIMERO", "1"], ["1", "primero", "3"]), ([], [])])
def test_article_numbers(spark, raw, numbers):
    articles = [(n, "texto") for n in raw]
    df = spark.createDataFrame([(articles,)], "a array<struct<num:string,content:string>>")
    assert [x.num for x in df.select(qa.number_articles(F.col("a"), F.lit(9)).alias("y")).first().y] == numbers


def made(spark, md):
    docs = structure.parse_structure(structure.split_frontmatter(spark.createDataFrame([("p/a.md", md)], "path string, md string")))
    return qa.explode_pairs(qa.heuristic_pairs(qa.references(docs)), "path", "tipo").orderBy("pair_idx").collect()


def test_pairs(spark):
    head = '---\ntipo: ACUERDO_SUPERIOR\ntipo_legible: "Acuerdo Superior"\nnumero: "7"\nanio: "2023"\n---\n'
    rows = made(spark, head + "\n".join(f"### ARTÍCULO {i}\nregla {i}" for i in range(1, 15)) + "\nrige a partir de su expedición.")
    assert len(rows) == 10
    assert rows[0].question == "¿Qué establece el artículo 1 del Acuerdo Superior No. 7 de 2023 de Unillanos?"
    assert rows[0].source == "Acuerdo Superior No. 7 de 2023"
    assert rows[9].answer.endswith(" rige a partir de su expedición.")
    assert made(spark, head.replace("ACUERDO_SUPERIOR", "Plan") + "### ARTÍCULO 1\nx") == []
    only = made(spark, "## CONSIDERANDO\nrazones")
    assert [r.question for r in only] == ["¿Qué dispone el documento normativo de Unillanos?", "¿Cuál es el fundamento del documento normativo de Unillanos?"]


def test_dataset(spark):
    rows = [("a/b/x", 0, "q1", "1", "T"), ("a-b/x", 0, "q1", "2", "T"), ("a/b/x", 1, "q2", "3", "U")]
    df = spark.createDataFrame(rows, "path string, pair_idx int, question string, answer string, tipo string")
    assert sorted((r.question, r.answer) for r in dataset.keep_first(df).collect()) == [("q1", "1"), ("q2", "3")]
    numbers = spark.range(100).select(F.col("id").alias("row_idx"), F.col("id").cast("string").alias("k"))
    for split in (dataset.split_exact(numbers, 100), dataset.split_hash(numbers, "k")):
        assert split.filter("split = 'test'").count() == 30 and split.count() == 100


def test_history(spark):
    rows = [(1, 2 * i + k, ("user", "assistant")[k], f"{'ua'[k]}{i}") for i in range(7) for k in (0, 1)] + [(1, 14, "user", "u7"), (2, 0, "system", "s"), (2, 1, "user", "x")]
    turns = chat.pair_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    last = {(r.conv_id, r.turn): r for r in chat.prompt_messages(turns, 5).collect()}[1, 14]
    assert [m.content for m in last.messages[1:]] == [x for i in range(2, 7) for x in (f"u{i}", f"a{i}")] + ["u7"]
    assert {r.turn: len(r.history) for r in chat.history(turns, 0).filter("conv_id = 1").collect()}[14] == 7
    assert chat.answer(chat.prompt_messages(turns), None).first().model_used == "sin modelo"
    assert chat.answer(chat.prompt_messages(turns), lambda m: f" {len(m)} ", "stub").filter("conv_id = 2").first().answer == "2"


@pytest.mark.parametrize(("text", "found"), [("Resolución 007 de 1990", ["7/1990"]), ("Ley 30 de 1992", []), ("Acuerdo 007 de 1990", []), ("No. 000 de 2001, N° 10 de 2015", ["0/2001", "10/2015"]), (None, [])])
def test_citations(spark, text, found):
    assert sorted(one(spark, text, metrics.citations)) == found


def pairs(spark, *rows):
    return spark.createDataFrame([(str(i), *r) for i, r in enumerate(rows)], "example_id string, reference string, prediction string")


def test_overlap_metrics(spark):
    same = pairs(spark, ("a b c d e", "a b c d e"))
    assert metrics.cider(same).first()[0] == pytest.approx(1)
    assert metrics.cider(pairs(spark, ("a b", "a b"))).first()[0] == pytest.approx(0.5)
    assert metrics.vocabulary_mi(same).first().mi == pytest.approx(0)
    assert metrics.vocabulary_mi(pairs(spark, ("a", "b"), ("", "b"))).orderBy("example_id").first().mi == pytest.approx(math.log(2))
    assert metrics.bleu(same).first()[0] == pytest.approx(100)
    assert metrics.rouge_l(pairs(spark, ("the cat sat", "the dog sat"), ("", ""))).orderBy("example_id").first().rouge_l == pytest.approx(2 / 3)
    assert metrics.citation_accuracy(pairs(spark, ("Resolución 1 de 2000", "la Resolución 1 de 2000"), ("Resolución 1 de 2000", "x"), ("x", "x"))).first()[0] == 0.5


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "example_id string, reference string, prediction string")
    row = metrics.result_row(none, none.select(F.col("prediction").alias("answer")), fecha="x").first()
    assert (row.n_prueba, row.cider, row.rouge_l, row.bleu, row.exactitud_citas, row.tasa_alucinacion, row["rank"]) == (0, 0, 0, 0, 0, 0, None)


def test_admissions(spark):
    assert one(spark, "Lo siento, NO TENGO información", metrics.admits) and not one(spark, "Sí", metrics.admits)


def test_running_limit_without_adaptive_plans(spark):
    """Rows up to the limit, and ranks, on many rows in many ranges, with adaptive execution off."""
    rows = [(f"{2000 + i % 10}/si/normatividad/LEY/{i * 7919 % 10007}_{i}.pdf", i % 3 == 0) for i in range(10000)]
    df = spark.createDataFrame(rows, "path string, ok boolean").repartition(7)
    ordered = sorted(rows, key=lambda r: r[0].split("/"))
    want, done = [], 0
    for path, ok in ordered:
        if done >= 2000:
            break
        want.append(path)
        done += ok
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert sorted(r.path for r in paths.until_written(df, 2000, "ok").collect()) == sorted(want)
        assert [r.path for r in paths.ranked(df).orderBy("rank").collect()] == [p for p, _ in ordered]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_conversation_store(spark):
    talks = spark.createDataFrame([(1, "uno"), (2, "dos")], "conv_id long, title string")
    names = spark.createDataFrame([(1, "  "), (2, " nuevo ")], "conv_id long, title string")
    assert {r.conv_id: r.title for r in chat.renamed(talks, names).collect()} == {1: "uno", 2: "nuevo"}
