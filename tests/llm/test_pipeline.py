"""The pipeline's stages on a small table."""

import random
import subprocess
import sys
import tracemalloc
from pathlib import Path

from pyspark.sql import functions as F

import corpus_pipeline
from foliospark.llm import toxicity
from foliospark.llm._common import stage

CLASHES = ["_score", "_row", "row", "_number", "spans", "_text", "_kinds", "size", "taken", "_slice", "key", "n", "component_id", "n_tokens"]


def test_odd_tables(spark, tmp_path):
    """Null and repeated ids, equal rows, clashing columns, a very long text; then no rows at all."""
    long = " ".join(f"v{random.Random(3).randrange(9)}{i}" for i in range(200_000))
    twin = "one two three four five six seven eight nine ten"
    rows = [(None, twin, "es", None, 1), (None, twin, "es", None, 1), (None, "", None, "a", 0), (None, None, None, None, None), (4, twin + " eleven", "es", "b", 1), (4, "token=abcdefghijkl0123 and more words", "en", "b", 1), (5, long, "en", "a", 1), (5, long, "en", "a", 1)]
    labels = spark.createDataFrame([(1, 1, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")
    for k, some in enumerate((rows, [])):
        d = str(tmp_path / str(k))
        docs = spark.createDataFrame(some, "doc_id long, text string, lang string, source string, n_chars long")
        docs.withColumns({c: F.lit(f"own {c}") for c in CLASHES}).write.parquet(f"{d}/documents.parquet")
        labels.write.parquet(f"{d}/labels.parquet")
        kept = spark.read.parquet(f"{d}/documents.parquet")
        columns, counts = kept.columns, []
        for name, step in corpus_pipeline.STAGES:
            kept = stage(step(spark, kept, d), name.replace(" ", "_"))
            counts.append(kept.count())
            clashes = [c for c in CLASHES if name != "byte-level BPE" or c != "n_tokens"]
            assert kept.filter(" OR ".join(f"`{c}` <> 'own {c}'" for c in clashes)).count() == 0
            assert name == "byte-level BPE" or kept.columns == columns
            if name == "jaccard join" and some:
                assert sorted((r.text or "")[:5] for r in kept.select("text").collect()) == sorted(["one t", "", "", "token", long[:5]])
        assert counts[:3] == ([8, 5, 5] if some else [0, 0, 0])
    assert corpus_pipeline.run(spark, d).count() == 0


def test_stages(spark, tmp_path):
    r = random.Random(4)
    text = lambda s, n=60: " ".join(f"w{random.Random(s * 1000 + i).randrange(500)}" for i in range(n))
    rows = [(i, text(i) + (" canalla vil" if i % 5 == 0 else ""), "es", r.choice("abc"), 1) for i in range(200)]
    rows += [(500, text(1), "es", "a", 1), (501, text(2) + " extra", "es", "a", 1), (502, "token=abcdefghijkl0123 " + text(900), "es", "b", 1), (503, None, None, None, None)]
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    kept = spark.read.parquet(f"{d}/documents.parquet")
    columns, seen = kept.columns, []
    for name, step in corpus_pipeline.STAGES:
        kept = stage(step(spark, kept, d), name.replace(" ", "_"))
        seen.append(kept)
    ids = [{x.doc_id for x in s.select("doc_id").collect()} for s in seen]
    assert all(s.columns == columns for s in seen[:-1])
    assert ids[0] == {i for i in range(200) if i % 5} | {500, 501, 502, 503}
    assert ids[1] == ids[0] - {500, 501} == ids[2]
    masked = seen[2].filter("doc_id = 502").first()
    assert masked.text.startswith("[SECRET] ") and masked.n_chars == len(masked.text)
    words = lambda s: s.agg(F.sum(F.size(F.split("text", " ")))).first()[0]
    assert abs(words(seen[3]) - words(seen[2].filter("text IS NOT NULL"))) < 200
    assert seen[4].count() == seen[3].count()


HOLDS = r"""
import re
import corpus_pipeline
import pyarrow as pa
from foliospark.llm._common import text_batches

batch = pa.record_batch({"x": [1]})  # this loads pandas
held = lambda: int(re.search(r"Anonymous:\s+(\d+)", open("/proc/self/smaps_rollup").read())[1]) // 1024
before = held()
for _ in text_batches(iter([batch])):
    many = [bytes(1000) for _ in range(200_000)]
    last = many.pop()  # it keeps the heap from shrinking by itself
    del many
print(held() - before)
"""


def test_workers_hold_little():
    """What a worker's task no longer uses goes back to the system when its input ends."""
    root = str(Path(corpus_pipeline.__file__).parent)
    done = subprocess.run([sys.executable, "-c", HOLDS], capture_output=True, text=True, cwd=root, timeout=120)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) < 50


def test_lexicon_holds_little():
    """The fit of the lexicon, one task's work, holds far less than all terms of the toxic texts (67 MB of these)."""
    r = random.Random(5)
    words = ["".join(r.choices("abcdefghij", k=9)) for _ in range(2000)]
    toxic = [" ".join(r.choices(words, k=300)) + " canalla" * (i % 2) for i in range(300)]
    tracemalloc.start()
    try:
        found = toxicity.learn_lexicon(toxic, [" ".join(r.choices(words, k=20)) for _ in range(300)])
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert ("canalla", False) in found
    assert peak < 20e6
