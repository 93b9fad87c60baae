"""The registered queries: one for each operator or small group of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let, lines, ngrams, tokens
from ..operators import chat, dataset, metrics, normalize, paths, qa, routing, structure
from ..sources import extraction
from .adapters import DOC_TYPES, embedding_pairs, eval_pairs, legal_docs, scores, table


def _meta(s: SparkSession, d: str) -> DataFrame:
    return paths.path_meta(legal_docs(s, d))


def _markdown(s: SparkSession, d: str) -> DataFrame:
    return normalize.to_markdown(_meta(s, d))


def _parsed(s: SparkSession, d: str) -> DataFrame:
    md = _markdown(s, d).select("doc_id", "path", "md")
    return structure.parse_structure(structure.split_frontmatter(md))


def _pairs(s: SparkSession, d: str) -> DataFrame:
    return qa.heuristic_pairs(qa.references(_parsed(s, d)))


def _qa(s: SparkSession, d: str) -> DataFrame:
    return qa.explode_pairs(_pairs(s, d), "doc_id", "path", "tipo")


def path_meta(s, d):
    return _meta(s, d).select("doc_id", "doc_type", "type_label", "year", "number", "source_filename", "titulo", "out_path")


def scope_filter(s, d):
    return paths.in_scope(_meta(s, d), paths.csv_list("LEY, RESOLUCION_SUPERIOR,"), paths.csv_list("2000,2002")).select("doc_id", "doc_type", "year")


def anti_skip(s, d):
    meta = _meta(s, d)
    return paths.not_done(meta, meta.filter("doc_id % 4 = 0")).select("doc_id", "out_path")


def limit_written(s, d):
    docs = legal_docs(s, d).join(table(s, d, "documents").select("doc_id", (F.length("text") >= 100).alias("ok")), "doc_id")
    return paths.until_written(docs, 50, "ok").select("doc_id", "path", "ok")


def path_order(s, d):
    return paths.ranked(legal_docs(s, d)).select("doc_id", "path", F.col("rank").cast("bigint").alias("rank"))


def is_digital(s, d):
    return routing.likely_digital(routing.running_pages(table(s, d, "documents"), "source", "doc_id", "text"), "source")


def is_digital_docs(s, d):
    """By document, of which every third has no pages."""
    docs = table(s, d, "documents")
    return routing.likely_digital(docs.filter("doc_id % 3 <> 0").select("doc_id", F.lit(1).alias("page_no"), F.col("text").alias("page_text")), "doc_id", docs=docs)


def looks_corrupt(s, d):
    return table(s, d, "documents").select("doc_id", routing.looks_corrupt(F.col("text")).alias("corrupt"))


def route(s, d):
    return routing.route_documents(table(s, d, "documents")).select("doc_id", "route", "queued")


def route_ocr(s, d):
    docs = table(s, d, "documents").withColumn("read", F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.repeat(F.lit("x"), F.lit(100)))).otherwise(F.lit("")))
    return routing.route_documents(docs, ocr=True, ocr_text_col="read").select("doc_id", "route", "queued")


def route_stats(s, d):
    return routing.route_stats(routing.route_documents(table(s, d, "documents")))


def _unreadable(content: bytes) -> str:
    """A stub reader: what begins with an exclamation mark is an error."""
    if content[:1] == b"!":
        raise ValueError("damaged file")
    return content[1:].decode()


def _stub_ocr():
    """A stub OCR reader: texts of an even number of bytes come out longer, others empty."""
    return lambda content: content[1:].decode() + "x" * 100 if len(content) % 2 else ""


def run_stats(s, d):
    """Statistics of two extraction runs over the documents as files, without and with OCR."""
    text = legal_docs(s, d).select("doc_id", "path").join(table(s, d, "documents").select("doc_id", "text"), "doc_id")
    files = text.select("path", F.encode(F.concat(F.when(F.col("doc_id") % 7 == 3, "!").otherwise("."), F.coalesce("text", F.lit(""))), "UTF-8").alias("content"))
    done = paths.path_meta(text.filter("doc_id % 20 = 4")).select("out_path")
    out = None
    for ocr in (None, _stub_ocr):
        run = extraction.extract(files, _unreadable, pages=lambda b: [b[1:].decode()], ocr=ocr, types=[t for t in DOC_TYPES if t != "Plan"], done=done)
        one = routing.route_stats(run).withColumn("with_ocr", F.lit(ocr is not None))
        out = one if out is None else out.unionByName(one)
    return out


def strip_decoration(s, d):
    each = table(s, d, "pages").select("page_id", F.posexplode_outer(lines(F.col("html"))).alias("pos", "raw"))
    return each.select("page_id", "pos", normalize.is_table(F.col("raw")).alias("is_table"), normalize.strip_decoration(F.col("raw")).alias("s"))


def line_frequency(s, d):
    return normalize.line_frequency(table(s, d, "documents"), "doc_id", "text")


def noise_drop(s, d):
    # Told apart in the document's array: the optimizer would repeat a line's text in each pattern of a filter.
    marked = lambda raw, i: let(normalize.strip_decoration(raw), lambda x: F.struct(i.alias("pos"), x.alias("s"), normalize.is_noise(x).alias("noise")))
    noise = F.filter(F.transform(lines(F.col("raw_md")), marked), lambda x: x["noise"])
    return legal_docs(s, d).select("doc_id", F.explode_outer(noise).alias("x")).filter("x IS NOT NULL").select("doc_id", "x.pos", "x.s")


def normalized_md(s, d):
    return normalize.normalize(legal_docs(s, d)).select("doc_id", "body")


def normalized_text(s, d):
    return normalize.normalize(table(s, d, "documents"), "text").select("doc_id", "body")


def frontmatter(s, d):
    return structure.split_frontmatter(_markdown(s, d).select("doc_id", "md")).select("doc_id", *(structure.meta_field(f).alias(f) for f in structure.FIELDS), F.length("body").alias("body_chars"))


def classify_lines(s, d):
    body = structure.split_frontmatter(_markdown(s, d).select("doc_id", "md"))
    return body.select("doc_id", F.posexplode_outer(structure.classify_lines(F.col("body"))).alias("pos", "x")).filter("pos IS NOT NULL").select("doc_id", "pos", "x.kind", "x.name", "x.text")


def articles(s, d):
    return _parsed(s, d).select("doc_id", F.posexplode_outer("articles").alias("pos", "a")).filter("pos IS NOT NULL").select("doc_id", "pos", "a.num", "a.content")


def doc_structure(s, d):
    return _parsed(s, d).select("doc_id", "descripcion", "considerando", "resuelve", F.size("articles").alias("n_articles"))


def citation_ref(s, d):
    return qa.references(structure.split_frontmatter(_markdown(s, d).select("doc_id", "md"))).select("doc_id", "tipo", "cita", "source", "el", "al", "del_", "suffix", "entity", "skipped")


def article_numbers(s, d):
    numbered = _parsed(s, d).select("doc_id", qa.number_articles(F.col("articles"), F.lit(9)).alias("n"))
    return numbered.select("doc_id", F.posexplode_outer("n").alias("pos", "a")).filter("pos IS NOT NULL").select("doc_id", "pos", "a.num")


def qa_pairs(s, d):
    return _qa(s, d)


def qa_template(s, d):
    return qa.explode_pairs(qa.template_pairs(qa.references(structure.split_frontmatter(_markdown(s, d).select("doc_id", "md")))), "doc_id")


def alpaca(s, d):
    return qa.to_alpaca(_qa(s, d))


def sharegpt(s, d):
    return qa.to_sharegpt(_qa(s, d)).select(F.to_json("conversations").alias("conversations"))


def dedupe_first(s, d):
    return dataset.keep_first(_qa(s, d)).select("doc_id", "pair_idx", "question", "answer")


def duplicate_count(s, d):
    return dataset.duplicate_count(_qa(s, d))


def pairs_by_type(s, d):
    each = _pairs(s, d).select("path", "tipo", F.posexplode_outer("pairs").alias("pair_idx", "p")).select("path", "tipo", "pair_idx", "p.question")
    return dataset.kept_by_type(each)


def formatted(s, d):
    """Both formats of the pairs of two types, by the arguments' text."""
    types = dataset.types_argument("LEY, Plan")
    # The type in the front matter is the path's: other documents needn't be parsed.
    some = _meta(s, d).filter(F.col("doc_type").isin(types))
    parsed = structure.parse_structure(structure.split_frontmatter(normalize.to_markdown(some).select("doc_id", "path", "md")))
    return qa.records(qa.explode_pairs(qa.heuristic_pairs(qa.references(parsed)), "doc_id"))


def split_hash(s, d):
    return dataset.split_hash(dataset.keep_first(_qa(s, d)), "question").select("question", "split")


def training_text(s, d):
    return dataset.training_messages(_qa(s, d)).select("text")


def chat_history(s, d):
    past = chat.history(chat.pair_turns(table(s, d, "conversations")), 2)
    return past.select("conv_id", "turn", F.array_join(F.transform("history", lambda h: F.concat_ws("|", h["user"], h["assistant"])), "||").alias("history"))


def prompt_messages(s, d):
    made = chat.prompt_messages(chat.pair_turns(table(s, d, "conversations")))
    return made.select("conv_id", "turn", F.size("messages").alias("n"), F.array_join(F.transform("messages", lambda m: F.concat_ws(":", m["role"], m["content"])), "|").alias("messages"))


def _echo(messages: list[dict], temperature: float = 0.7) -> str:
    """A stub generator."""
    return f" {len(messages)} mensajes, {messages[-1]['content'][:20]}, {temperature:.1f} "


def history_since_reset(s, d):
    """Histories after a reset at turn 2 of every other conversation."""
    turns = chat.pair_turns(table(s, d, "conversations"))
    kept = chat.since_reset(turns, turns.filter("conv_id % 2 = 0").select("conv_id", F.lit(2).alias("turn")))
    return chat.history(kept, 3).select("conv_id", "turn", F.size("history").cast("bigint").alias("n"), F.coalesce(F.get("history", 0)["user"], F.lit("")).alias("oldest"))


def answers(s, d):
    """Answers by a stub generator, and by a pipeline without a checkpoint."""
    turns = chat.pair_turns(table(s, d, "conversations"))
    some = chat.answer(chat.prompt_messages(turns, 2), _echo, chat.model_name("models/stub/")).select("conv_id", "turn", "answer", "model_used")
    return some.unionByName(chat.pipeline_from(s, {"model": {"checkpoint_path": " "}, "chat": {"max_history": 1}}).answers(turns).select("conv_id", "turn", "answer", "model_used"))


def batch_answers(s, d):
    asked = table(s, d, "conversations").filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    return chat.batch_answers(asked, _echo).select("conv_id", "turn", "answer", "model_used")


def conv_title(s, d):
    return chat.conversation_titles(table(s, d, "conversations"))


def citations(s, d):
    cite = lambda c: F.array_join(F.array_sort(metrics.citations(F.col(c))), ",")
    return eval_pairs(s, d).select("example_id", cite("reference").alias("r"), cite("prediction").alias("p"))


def citation_accuracy(s, d):
    return metrics.citation_accuracy(eval_pairs(s, d))


def no_answer_rate(s, d):
    return metrics.hallucination_rate(eval_pairs(s, d), "prediction")


def ngram_counts(s, d):
    t = eval_pairs(s, d).select("example_id", F.explode_outer(ngrams(tokens(F.col("prediction")), 2)).alias("gram")).filter("gram IS NOT NULL")
    return t.groupBy("example_id", "gram").agg(F.count("*").alias("n"))


def cider(s, d):
    return metrics.cider(eval_pairs(s, d)).select(F.round("cider", 6).alias("cider"))


def vocab_mi(s, d):
    return metrics.vocabulary_mi(eval_pairs(s, d)).select("example_id", F.round("mi", 6).alias("mi"))


def rouge_l(s, d):
    return metrics.rouge_l(eval_pairs(s, d)).select("example_id", F.round("rouge_l", 6).alias("rouge_l"))


def bleu(s, d):
    return metrics.bleu(eval_pairs(s, d)).select(F.round("bleu", 6).alias("bleu"))


def embedding_cosine(s, d):
    return metrics.embedding_cosine(embedding_pairs(s, d)).select(F.round("coseno_sem", 6).alias("coseno_sem"))


def perplexity(s, d):
    return metrics.perplexity(scores(s, d)).select(*(F.round(c, 6).alias(c) for c in ("perdida", "perplejidad", "entropia")))


def answer_losses(s, d):
    """A stub forward pass: a token for each word of both, prompt first, its loss its length, its entropy half of that."""

    def forward(question, reference):
        return [(float("nan"), float("nan"))] * len(question.split(" ")) + [(float(len(w)), len(w) / 2) for w in reference.split(" ")]

    pairs = eval_pairs(s, d).withColumn("question", F.lit("uno dos"))
    return metrics.answer_losses(pairs, forward, 12).select("example_id", F.round("nll", 6).alias("nll"), F.round("entropy", 6).alias("entropy"))


def mean_similarity(s, d):
    """A stub similarity: the shorter text's share of the longer."""
    share = lambda p, r: min(len(p), len(r)) / max(len(p), len(r), 1)
    return metrics.mean_similarity(eval_pairs(s, d), share).select(F.round("bertscore_f1", 6).alias("bertscore_f1"))


def eval_row(s, d):
    pairs = eval_pairs(s, d)
    return metrics.result_row(pairs, pairs.select(F.col("prediction").alias("answer")), scores(s, d), embedding_pairs(s, d), fecha="2024-01-01 00:00", checkpoint="stub", rank=16, lora_alpha=32, lora_dropout=0.05)


QUERIES = {f.__name__: f for f in (
    path_meta, scope_filter, anti_skip, limit_written, path_order, is_digital, is_digital_docs, looks_corrupt, route, route_ocr, route_stats, run_stats, strip_decoration, line_frequency,
    noise_drop, normalized_md, normalized_text, frontmatter, classify_lines, articles, doc_structure, citation_ref, article_numbers, qa_pairs, qa_template,
    alpaca, sharegpt, dedupe_first, duplicate_count, pairs_by_type, formatted, split_hash, training_text, chat_history, prompt_messages, history_since_reset, answers, batch_answers, conv_title, citations,
    citation_accuracy, no_answer_rate, ngram_counts, cider, vocab_mi, rouge_l, bleu, embedding_cosine, perplexity, answer_losses, mean_similarity, eval_row,
)}
