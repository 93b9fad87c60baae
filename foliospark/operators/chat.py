"""Chat turns, bounded history and prompts (C1-C10, C14). History is kept by conversation."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vocab import NO_MODEL, SYSTEM_PROMPT

MESSAGES = "array<struct<role:string,content:string>>"


def pair_turns(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, user, assistant): each user message with the answer right after it, null if there's none."""
    spoken = messages.filter(F.col("role").isin("user", "assistant"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    after = F.when(F.lead("role").over(w) == "assistant", F.lead("text").over(w))
    return spoken.withColumn("assistant", after).filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("user"), "assistant")


def history(turns: DataFrame, max_turns: int = 5) -> DataFrame:
    """turns with history: the last max_turns answered turns before each (0: all of them).

    Each answered turn gathers the max_turns answered ones up to it, in a frame of that many
    rows; any turn takes what the last answered one before it has gathered.
    """
    answered = F.col("assistant").isNotNull()
    w = Window.partitionBy("conv_id", answered).orderBy("turn")
    low = -(max_turns - 1) if max_turns else Window.unboundedPreceding
    upto = F.when(answered, F.collect_list(F.struct("user", "assistant")).over(w.rowsBetween(low, 0)))
    past = F.last("_upto", ignorenulls=True).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1))
    none = F.array().cast("array<struct<user:string,assistant:string>>")
    return turns.withColumn("_upto", upto).withColumn("history", F.coalesce(past, none)).drop("_upto")


def since_reset(turns: DataFrame, resets: DataFrame) -> DataFrame:
    """turns without those that a reset of their conversation, resets (conv_id, turn), has cleared: at or before the last one's turn."""
    last = resets.groupBy("conv_id").agg(F.max("turn").alias("_reset"))
    return turns.join(last, "conv_id", "left").filter(F.col("_reset").isNull() | (F.col("turn") > F.col("_reset"))).drop("_reset")


def prompt_messages(turns: DataFrame, max_turns: int = 5, system_prompt: str = "") -> DataFrame:
    """(conv_id, turn, messages): system prompt, history and question."""
    say = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    past = F.flatten(F.transform("history", lambda h: F.array(say("user", h["user"]), say("assistant", h["assistant"]))))
    system = F.array(say("system", F.lit(system_prompt or SYSTEM_PROMPT)))
    return history(turns, max_turns).select("conv_id", "turn", F.concat(system, past, F.array(say("user", F.col("user")))).alias("messages"))


def answer(prompts: DataFrame, generate: Callable[[list[dict]], str] | None, model_name: str = "") -> DataFrame:
    """prompts with answer and model_used. generate runs in the Python workers; without one the fixed message is given."""
    if generate is None:
        return prompts.withColumns({"answer": F.lit(NO_MODEL), "model_used": F.lit("sin modelo")})

    def run(frames):
        for f in frames:
            yield f.assign(answer=[str(generate([dict(m) for m in x])).strip() for x in f.messages], model_used=model_name)

    from pyspark.sql.types import StringType, StructField, StructType

    return prompts.mapInPandas(run, StructType([*prompts.schema.fields, StructField("answer", StringType()), StructField("model_used", StringType())]))


def single_prompt(questions: DataFrame, question_col: str = "question") -> DataFrame:
    return questions.withColumn("messages", F.array(F.struct(F.lit("user").alias("role"), F.col(question_col).alias("content"))))


def model_name(checkpoint: str | None) -> str:
    return checkpoint.rstrip("/").rpartition("/")[2] if checkpoint else "sin modelo (entrenamiento pendiente)"


def batch_answers(questions: DataFrame, generate: Callable[..., str] | None, question_col: str = "question", system_prompt: str = "") -> DataFrame:
    """questions with answer and model_used: each asked alone, without history, at temperature 0."""
    say = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    asked = questions.withColumn("messages", F.array(say("system", F.lit(system_prompt or SYSTEM_PROMPT)), say("user", F.col(question_col))))
    greedy = None if generate is None else (lambda m: generate(m, temperature=0.0))
    return answer(asked, greedy).drop("messages")


class Pipeline:
    """What a configuration asks for: prompts with its system prompt and history, answered by its model, if it is there."""

    def __init__(self, system_prompt: str = "", max_turns: int = 5, checkpoint: str | None = None, generate: Callable[[list[dict]], str] | None = None):
        self.system_prompt, self.max_turns, self.checkpoint, self.generate = system_prompt, max_turns, checkpoint, generate

    def answers(self, turns: DataFrame) -> DataFrame:
        return answer(prompt_messages(turns, self.max_turns, self.system_prompt), self.generate, model_name(self.checkpoint))


def pipeline_from(spark: SparkSession, config: dict, load: Callable[[str, str], Callable[[list[dict]], str]] | None = None, checkpoint: str | None = None) -> Pipeline:
    """The pipeline of a configuration; checkpoint goes before the configured one.

    load makes the generator of an available checkpoint from its folder and kind (adapter or
    model); without a checkpoint there, answers are the fixed message.
    """
    from ..sources.corpus import checkpoint_kind

    where = checkpoint or str((config.get("model") or {}).get("checkpoint_path") or "").strip() or None
    kind, chat = checkpoint_kind(spark, where), config.get("chat") or {}
    generate = load(where, kind) if load and kind else None
    return Pipeline(chat.get("system_prompt") or "", chat.get("max_history", 5), where, generate)


def renamed(conversations: DataFrame, names: DataFrame) -> DataFrame:
    """conversations (conv_id, title) under new names (conv_id, title); blank ones are ignored."""
    new = names.filter(F.trim("title") != "").select("conv_id", F.trim("title").alias("_new"))
    return conversations.join(new, "conv_id", "left").withColumn("title", F.coalesce("_new", "title")).drop("_new")


def conversation_titles(messages: DataFrame) -> DataFrame:
    """(conv_id, title): the first question, cut at 40 characters."""
    first = messages.filter(F.col("role") == "user").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    return first.select("conv_id", F.when(F.length("text") > 40, F.concat(F.substring("text", 1, 40), F.lit("..."))).otherwise(F.col("text")).alias("title"))


def state_after(turns: pd.DataFrame, kept: list[tuple[str, str]], max_turns: int) -> list[tuple[str, str]]:
    """History after new answered turns; max_turns 0 keeps all."""
    every = kept + [(u, a) for u, a in zip(turns.user, turns.assistant, strict=True) if a is not None]
    return every[-max_turns:] if max_turns else every
