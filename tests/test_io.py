"""Sources, sinks and streaming forms."""

import json

from pyspark.sql.functions import lit

from foliospark.operators import chat
from foliospark.operators.normalize import to_markdown
from foliospark.operators.paths import path_meta
from foliospark.sources import corpus, extraction, sinks
from foliospark.streaming import ingest


def test_scan_and_read(spark, tmp_path):
    for name, text in (("2001/si/normatividad/LEY/1_2001.pdf", "uno"), ("2002/si/normatividad/Plan/2_2002 b+c.pdf", " ")):
        (tmp_path / name).parent.mkdir(parents=True)
        (tmp_path / name).write_text(text)
    assert [r.path for r in corpus.scan_pdfs(spark, str(tmp_path), types=["LEY"]).collect()] == ["2001/si/normatividad/LEY/1_2001.pdf"]

    def broken(content):
        raise ValueError("no text layer")

    rows = {r.path: r for r in corpus.read_documents(corpus.scan_pdfs(spark, str(tmp_path)), corpus.plain_text_reader, broken, lambda b: [b.decode()]).collect()}
    assert rows["2001/si/normatividad/LEY/1_2001.pdf"].method == "primary"
    other = rows["2002/si/normatividad/Plan/2_2002 b+c.pdf"]
    assert (other.text, other.method, other.pages) == ("", "fallback", 1) and "no text layer" in other.error


def test_scan_by_type_and_year(spark, tmp_path):
    """Types are those of the path below the root: with spaces, and whatever folders stand above it."""
    root = tmp_path / "LEY" / "2001" / "corpus a+b"
    names = ["2001/si/normatividad/LEY/1_2001.pdf", "2002/si/normatividad/CIRCULAR interna/2_2002.pdf", "2002/si/normatividad/Resolución/3_2002.pdf", "2003/LEY/x/4.pdf"]
    for name in names:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("x")
    find = lambda **a: sorted(r.path for r in corpus.scan_pdfs(spark, str(root), **a).collect())
    assert find() == sorted(names) and find(types=["LEY"]) == names[:1] and find(types=["CIRCULAR interna"]) == names[1:2]
    assert find(types=["Resolución", "LEY"], years=["2002"]) == names[2:3] and find(years=["2002"]) == names[1:3] and find(types=[]) == []
    plan = corpus.scan_pdfs(spark, str(root), types=["CIRCULAR interna"])._jdf.queryExecution().toString()
    assert "file_path" in plan


def test_extraction_run(spark, tmp_path):
    """Every outcome, error isolation, the OCR reader's deferred import and the limit of written texts."""
    good = "texto legible " * 20
    made = {"LEY/1_2001": good, "LEY/2_2001": "", "LEY/3_2001": "corto pero con capa de texto, algo más de cincuenta letras", "LEY/4_2001": "a1b a1b a1b a1b a1b a1b " * 9, "LEY/5_2001": "!", "Plan/6_2001": good, "LEY/7_2001": good, "LEY/8_2001": good}
    rows = [(f"2001/si/normatividad/{k}.pdf", bytearray(v.encode())) for k, v in made.items()]
    files = spark.createDataFrame(rows, "path string, content binary")

    def read(content):
        if content == b"!":
            raise ValueError("damaged")
        return content.decode()

    done = spark.createDataFrame([("2001/LEY/7_2001.md",)], "out_path string")
    args = {"pages": lambda b: [b.decode()], "types": ["LEY"], "done": done}
    route = lambda **a: {r.path.split("/")[-1][0]: r.route for r in extraction.extract(files, read, read, **args, **a).collect()}
    plain = {"1": "digital", "2": "escaneado_omitido", "3": "vacio_a_ocr", "4": "corrupto_omitido", "5": "errores", "6": "filtrado", "7": "ya_procesado", "8": "digital"}
    assert route() == plain
    assert route(ocr=lambda: lambda b: good) == plain | {"2": "ocr", "3": "ocr", "4": "ocr"}

    def missing():
        raise ImportError("pip install the OCR library")

    failed = extraction.extract(files, read, read, **args, ocr=missing).filter("route = 'errores'").collect()
    assert {r.path.split("/")[-1][0] for r in failed} == {"2", "3", "4", "5"} and sum("pip install" in r.error for r in failed) == 3
    assert set(route(limit=1)) == {"1"}


def test_checkpoints(spark, tmp_path):
    assert corpus.checkpoint_kind(spark, None) is None and corpus.checkpoint_kind(spark, str(tmp_path / "none")) is None
    assert corpus.checkpoint_kind(spark, str(tmp_path)) == "model" and corpus.adapter_settings(spark, str(tmp_path)) == (None, None, None)
    (tmp_path / "adapter_config.json").write_text('{"r": 16,\n "lora_alpha": 32, "lora_dropout": 0.05, "other": [1]}')
    assert corpus.checkpoint_kind(spark, str(tmp_path)) == "adapter" and corpus.adapter_settings(spark, str(tmp_path)) == (16, 32, 0.05)
    turns = spark.createDataFrame([(1, 0, "hola", None)], "conv_id long, turn long, user string, assistant string")
    load = lambda where, kind: lambda messages: f"{kind} {messages[-1]['content']}"
    made = chat.pipeline_from(spark, {"model": {"checkpoint_path": "none"}}, load, checkpoint=str(tmp_path)).answers(turns).first()
    assert (made.answer, made.model_used) == ("adapter hola", tmp_path.name)


def test_sinks(spark, tmp_path):
    routed = spark.createDataFrame([("a.pdf", True), ("b.pdf", False)], "rel_path string, queued boolean")
    sinks.write_ocr_queue(routed, str(tmp_path / "queue"))
    assert [r.value for r in spark.read.text(str(tmp_path / "queue")).collect()] == ["a.pdf"]
    row = spark.range(1).select(*(lit("x").alias(c) for c in sinks.LOG_COLUMNS))
    for _ in range(2):
        sinks.append_log(row, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    sinks.write_dataset(row.select("fecha"), str(tmp_path / "result"))
    assert spark.read.json(str(tmp_path / "result")).first().fecha == "x"


def test_json_and_config(spark, tmp_path, monkeypatch):
    (tmp_path / "q.json").write_text(json.dumps(["¿a?", "b"]), encoding="utf-8")
    assert [tuple(r) for r in corpus.read_string_array(spark, str(tmp_path / "q.json")).collect()] == [(0, "¿a?"), (1, "b")]
    (tmp_path / "d.json").write_text(json.dumps([{"instruction": "a", "input": "", "output": "b"}]))
    records = corpus.read_alpaca(spark, str(tmp_path / "d.json"))
    sinks.export_json_array(records, str(tmp_path / "e.json"))
    assert json.loads((tmp_path / "e.json").read_text()) == [{"instruction": "a", "input": "", "output": "b"}]
    monkeypatch.setenv("HERE", "x")
    (tmp_path / "c.yaml").write_text("a: ${HERE}\nb: ['${GONE}', 'pre ${HERE}']\nchat: {system_prompt: ' hola '}\n")
    assert corpus.load_config(str(tmp_path / "c.yaml"))["b"] == ["", "pre ${HERE}"]
    assert corpus.system_prompt(str(tmp_path / "c.yaml"), "d") == "hola" and corpus.system_prompt(str(tmp_path / "none.yaml"), "d") == "d"


def test_markdown_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([("2001/si/normatividad/LEY/1_2001.pdf", "Artículo 1. Objeto")], "path string, raw_md string")
    md = to_markdown(path_meta(docs))
    sinks.export_markdown_files(md, str(tmp_path / "out"))
    sinks.write_markdown_table(md, str(tmp_path / "table"))
    assert [r.path for r in corpus.scan_markdown(spark, str(tmp_path / "out")).collect()] == ["2001/LEY/1_2001.md"]
    assert spark.read.parquet(str(tmp_path / "table")).filter("doc_type = 'LEY'").count() == 1


def test_stream(spark, tmp_path):
    spark.createDataFrame([("a.md", "---\ntipo: LEY\n---\n### ARTÍCULO 1\nuno")], "path string, md string").write.parquet(str(tmp_path / "in"))
    query = ingest.stream_pairs(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("pairs_out").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert [r.question for r in spark.table("pairs_out").collect()] == ["¿Qué establece el artículo 1 de la LEY?"]
    spark.createDataFrame([(1, i, f"u{i}", f"a{i}") for i in range(7)], ingest.TURNS).write.parquet(str(tmp_path / "turns"))
    stream = ingest.stream_history(spark.readStream.schema(ingest.TURNS).parquet(str(tmp_path / "turns")), 5)
    query = stream.writeStream.format("memory").queryName("history_out").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert [(r.n_turns, r.users) for r in spark.table("history_out").collect()] == [(5, [f"u{i}" for i in range(2, 7)])]
