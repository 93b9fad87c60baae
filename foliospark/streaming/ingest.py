"""Streaming forms: Markdown ingest from new files, and bounded chat history by conversation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.chat import state_after
from ..operators.dataset import of_types
from ..operators.qa import explode_pairs, heuristic_pairs, references
from ..operators.structure import parse_structure, split_frontmatter

TURNS = "conv_id bigint, turn bigint, user string, assistant string"


def pairs_from_markdown(docs: DataFrame, types: list[str] | None = None) -> DataFrame:
    """(path, tipo, pair_idx, question, answer, source) of (path, md); no operator here needs a shuffle, so it holds for streams as it is."""
    made = heuristic_pairs(parse_structure(of_types(references(split_frontmatter(docs)), types)))
    return explode_pairs(made, "path", "tipo")


def stream_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of the Parquet files (path, md) that arrive in folder."""
    return pairs_from_markdown(spark.readStream.schema("path string, md string").parquet(folder))


def stream_history(turns: DataFrame, max_turns: int = 5) -> DataFrame:
    """(conv_id, n_turns, users) after each batch of new answered turns; the state holds max_turns turns."""
    import pandas as pd

    def update(key, frames, state):
        kept = list(zip(*state.get, strict=True)) if state.exists else []
        for f in frames:
            kept = state_after(f.sort_values("turn"), kept, max_turns)
        state.update(([u for u, _ in kept], [a for _, a in kept]))
        yield pd.DataFrame({"conv_id": [key[0]], "n_turns": [len(kept)], "users": [[u for u, _ in kept]]})

    from pyspark.sql.streaming.state import GroupStateTimeout

    return turns.groupBy("conv_id").applyInPandasWithState(update, "conv_id bigint, n_turns int, users array<string>", "users array<string>, answers array<string>", "update", GroupStateTimeout.NoTimeout)
