"""Operator 4: byte-level BPE encoding and decoding with the tiktoken library.

Ranks come from a local rank file (a parameter). Long texts are encoded in pieces that
are cut only where no match of the split pattern can run across: before a space that
stands between two characters other than white space. Every alternative of the pattern
takes a space at its start or in a run of white space only, so the pieces' ids, joined,
are the ids of the whole text. Decoding joins the tokens' raw bytes, so a token may end
inside a character.

Null and empty texts give no ids and the digest of no bytes; repeated rows are kept;
other columns aren't touched.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ._common import text_batches, widened

RANKS = "byte_bpe_multi_50k.tiktoken"
PIECE_CHARS = 1 << 14
_CUT = re.compile(r"(?<=\S) (?=\S)")
_ENCODINGS: dict[tuple[str, str], object] = {}


def encoding(rank_path: str, pattern: str):
    """The tiktoken encoding of a rank file, loaded once in each worker process."""
    if (rank_path, pattern) not in _ENCODINGS:
        import tiktoken

        with open(rank_path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _ENCODINGS[rank_path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[rank_path, pattern]


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """text in pieces of at least size characters, cut at safe boundaries; without one it stays whole."""
    at = 0
    while len(text) - at > size and (cut := _CUT.search(text, at + size)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode_text(text: str, rank_path: str, pattern: str) -> np.ndarray:
    enc = encoding(rank_path, pattern)
    if len(text) <= PIECE_CHARS:
        return np.array(enc.encode_ordinary(text), "<u4")
    return np.concatenate([np.array(enc.encode_ordinary(p), "<u4") for p in pieces(text)])


def decode_ids(ids: np.ndarray, rank_path: str, pattern: str) -> bytes:
    """The tokens' bytes, joined; not decoded as UTF-8, so no id sequence fails."""
    return encoding(rank_path, pattern).decode_bytes(ids.tolist())


def encode(df: DataFrame, text_col: str = "text", out_col: str = "ids", rank_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """df with out_col array<int>: the ids of each whole text."""
    rank_path, pattern = rank_path or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN
    kept = df.drop(out_col)
    at = kept.columns.index(text_col)

    def run(batches):
        for b in text_batches(batches):
            ids = [encode_text(t or "", rank_path, pattern).astype(np.int32) for t in b.column(at).to_pylist()]
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))], names=[*b.schema.names, out_col])

    return kept.mapInArrow(run, widened(kept.schema, {out_col: "array<int>"}))


def decode(df: DataFrame, ids_col: str = "ids", out_col: str = "decoded", rank_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """df with out_col binary: the bytes that the ids stand for; null ids give no bytes."""
    rank_path, pattern = rank_path or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN
    kept = df.drop(out_col)
    at = kept.columns.index(ids_col)

    def run(batches):
        for b in text_batches(batches):
            found = [decode_ids(np.array(x or [], "<u4"), rank_path, pattern) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.binary())], names=[*b.schema.names, out_col])

    return kept.mapInArrow(run, widened(kept.schema, {out_col: "binary"}))


def round_trip(df: DataFrame, text_col: str = "text", rank_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """df without text_col, with n_tokens, ids_sha256 and decoded_sha256: encode and decode in one pass.

    The ids pass from one to the other inside the batch, so they aren't sent through the JVM.
    """
    rank_path, pattern = rank_path or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN
    added = {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}
    df = df.drop(*added)
    at, names = df.columns.index(text_col), [c for c in df.columns if c != text_col]

    def run(batches):
        for b in text_batches(batches):
            count, ids_sha, text_sha = [], [], []
            for text in b.column(at):
                ids = encode_text(text.as_py() or "", rank_path, pattern)
                count.append(len(ids))
                ids_sha.append(hashlib.sha256(ids.tobytes()).hexdigest())
                text_sha.append(hashlib.sha256(decode_ids(ids, rank_path, pattern)).hexdigest())
            kept = [c for i, c in enumerate(b.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(count, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], names=[*names, *added])

    return df.mapInArrow(run, widened(df.drop(text_col).schema, added))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op4_bpe": op4_bpe}
SQL: dict[str, str] = {}
