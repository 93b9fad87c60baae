"""Operator 1: removal of repeated passages by a log-structured fingerprint index.

A window is WINDOW consecutive words of one document; a word goes if a window that covers
it has a word sequence that also starts anywhere else. Of each window the index holds its
fingerprint: the least hash of its runs of GRAM words. Equal windows have equal
fingerprints, and neighbouring windows mostly share theirs, so an index entry stands for
about a dozen windows.

* FingerprintIndex: a batch becomes a sorted immutable run (fingerprint, occurrences), a
  Parquet table bucketed and sorted by fingerprint. Each new run is merge-joined with the
  history, bucket by bucket, without another exchange; compaction writes the merged run.
  Batches may come one after another, for as long as the index lives; the fingerprints
  that it has seen twice are those of all its batches.
* Fingerprints seen twice only make candidates. Every candidate window is verified by two
  64-bit digests of all its words, over two independent hashes of each word. The digests
  are sorted once; a window counts if a neighbour has its digests. Windows that meet
  within a scan task are settled there, and one row speaks for all of them, so a passage of
  a third of all documents is a row for each task's chunk, not for each document.

A bit filter, sized by how many fingerprints were seen twice, tells the scans which; values
that it lets through wrongly fail verification.

Null and empty texts, and texts of fewer words than a window, keep all their words. Equal
rows are documents of their own, each the other's copy. Windows find back to their text by
128 bits of its BLAKE2b digest; what repeats in a text depends on the text alone, so ids
may repeat or be null. Other columns aren't read, whatever their names. A text of any
length is held whole by one task, about a hundred bytes for each word.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import CHECK_BASE, CHECK_SEED, Filter, Words, as_long, inside, partitions, text_batches, text_slices, widened, windows

WINDOW = 35
GRAM = 10
BATCHES = 2
FLUSH = 1 << 20
U64 = np.uint64


def _running(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each run of width values, by doubling."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = pick(out[:-step], out[step:]) if len(out) > step else out[:0]
        have += step
    return out


class Fingerprints:
    """Of a slice's documents: ok and least by window start; and the index entries, each occurrence once."""

    def __init__(self, words: Words, hashes: np.ndarray, window: int = WINDOW, gram: int = GRAM):
        width = window - gram + 1
        self.ok = inside(words.doc, window)
        grams = windows(hashes, gram)
        self.least = _running(grams, width, np.minimum)[: len(self.ok)]
        chosen = np.zeros(len(grams) + width - 1, U64)
        if len(self.ok):
            chosen[width - 1 : width - 1 + len(self.ok)] = np.where(self.ok, self.least, U64(0))
            top = _running(chosen, width, np.maximum)
            self.entries = grams[(grams == top[: len(grams)]) & (grams > 0)]
        else:
            self.entries = grams[:0]


def entries(df: DataFrame, text_col: str, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(fp, n): fingerprints and how often they occur, summed for each slice of a task's texts."""

    def run(batches):
        for b in text_batches(batches):
            for _, _, data, offsets in text_slices(b.column(0)):
                words = Words(data, offsets)
                found, n = np.unique(Fingerprints(words, words.hashes(), window, gram).entries, return_counts=True)
                yield pa.RecordBatch.from_arrays([as_long(found), pa.array(n.astype(np.int32))], names=["fp", "n"])

    return df.select(text_col).mapInArrow(run, "fp bigint, n int")


class FingerprintIndex:
    """Sorted runs of a growing collection, in the session's warehouse."""

    def __init__(self, spark: SparkSession, text_col: str = "text", window: int = WINDOW, gram: int = GRAM):
        self.spark, self.text_col, self.window, self.gram = spark, text_col, window, gram
        self.name, self.buckets, self.runs, self.made = f"fingerprints_{uuid.uuid4().hex}", partitions(spark), [], 0

    def __enter__(self) -> FingerprintIndex:
        return self

    def __exit__(self, *_) -> None:
        self.drop()

    def _write(self, rows: DataFrame) -> str:
        self.made += 1
        name = f"{self.name}_{self.made}"
        rows.write.bucketBy(self.buckets, "fp").sortBy("fp").format("parquet").saveAsTable(name)
        return name

    def append(self, batch: DataFrame) -> None:
        """The batch's sorted run; occurrences beyond two don't matter and aren't counted."""
        found = entries(batch, self.text_col, self.window, self.gram).groupBy("fp").agg(F.least(F.sum("n"), F.lit(2)).cast("int").alias("n"))
        self.runs.append(self._write(found.repartition(self.buckets, "fp")))

    def merged(self) -> DataFrame:
        """(fp, n) over all runs: the history merge-joined with each run in turn."""
        out = self.spark.table(self.runs[0])
        for name in self.runs[1:]:
            new = self.spark.table(name).withColumnRenamed("n", "m").hint("merge")
            out = out.join(new, "fp", "full_outer").select("fp", F.least(F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0)), F.lit(2)).alias("n"))
        return out

    def compact(self) -> None:
        if len(self.runs) > 1:
            old, self.runs = self.runs, [self._write(self.merged())]
            for name in old:
                self.spark.sql(f"DROP TABLE {name}")

    def seen_twice(self) -> Filter:
        """The filter of the fingerprints that occur twice in all batches so far."""
        self.compact()
        return Filter(self.merged().filter("n > 1").select("fp"), "fp")

    def drop(self) -> None:
        for name in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.runs = []


def _candidates(words: Words, hashes: np.ndarray, seen: Filter, window: int, gram: int) -> np.ndarray:
    """Starts of the windows whose fingerprint may occur twice."""
    prints = Fingerprints(words, hashes, window, gram)
    if not len(prints.ok):
        return np.zeros(0, np.int64)
    at = np.flatnonzero(prints.ok)
    return at[seen.has(prints.least[at])]


def text_digests(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each text."""
    both = np.frombuffer(b"".join(hashlib.blake2b(t, digest_size=16).digest() for t in texts), "<u8").reshape(-1, 2)
    return both[:, 0].astype(U64), both[:, 1].astype(U64)


def _texts(data: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> list[bytes]:
    return [data[offsets[r] : offsets[r + 1]].tobytes() for r in rows.tolist()]


def _grouped(t1: np.ndarray, t2: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Window starts by text: (t1, t2, sorted starts as bytes of int32, each once)."""
    order = np.lexsort((start, t2, t1))
    t1, t2, start = t1[order], t2[order], start[order]
    new = np.ones(len(order), bool)
    new[1:] = (t1[1:] != t1[:-1]) | (t2[1:] != t2[:-1])
    once = new.copy()
    once[1:] |= start[1:] != start[:-1]
    t1, t2, start, new = t1[once], t2[once], start[once], new[once]
    bounds = [*np.flatnonzero(new).tolist(), len(start)]
    raw = start.astype(np.int32).tobytes()
    return t1[new], t2[new], [raw[4 * x : 4 * y] for x, y in zip(bounds, bounds[1:], strict=False)]


WINDOWS = {"d1": "bigint", "d2": "bigint", "t1": "bigint", "t2": "bigint", "start": "int", "starts": "binary"}


def _window_rows(d1: np.ndarray, d2: np.ndarray, t1: np.ndarray, t2: np.ndarray, start: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of a chunk's candidate windows (WINDOWS): one row each for those that stand alone; of those that meet here,
    a row with start -1 for each sequence, and a row with all their starts for each text."""
    order = np.lexsort((d2, d1))
    a, b = d1[order], d2[order]
    same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    met = np.append(False, same) | np.append(same, False)
    first = met & ~np.append(False, same)
    alone, sure, n = order[~met], order[met], int(first.sum())
    k = len(alone)
    rows = np.concatenate([alone, order[first]])
    where = np.concatenate([start[alone].astype(np.int32), np.full(n, -1, np.int32)])
    yield pa.RecordBatch.from_arrays([as_long(d1[rows]), as_long(d2[rows]), as_long(np.where(np.arange(k + n) < k, t1[rows], U64(0))), as_long(np.where(np.arange(k + n) < k, t2[rows], U64(0))), pa.array(where), pa.nulls(k + n, pa.binary())], names=[*WINDOWS])
    if len(sure):
        x, y, starts = _grouped(t1[sure], t2[sure], start[sure])
        yield pa.RecordBatch.from_arrays([as_long(x), as_long(y), as_long(x), as_long(y), pa.nulls(len(x), pa.int32()), pa.array(starts, pa.binary())], names=[*WINDOWS])


def _met_windows(batches) -> Iterator[pa.RecordBatch]:
    """(t1, t2, start) from rows of WINDOWS sorted by digests: of windows whose digests a neighbour has, and of settled ones."""
    last = None  # the row before this batch: digests, text, start, and whether it has met its like
    names = ["t1", "t2", "start"]
    for b in text_batches(batches):
        settled = b.column(5).is_valid()
        if (some := b.filter(settled)).num_rows:
            starts = [np.frombuffer(x.as_buffer(), np.int32) for x in some.column(5)]
            each = pa.array(np.repeat(np.arange(len(starts)), [len(x) for x in starts]))
            yield pa.RecordBatch.from_arrays([some.column(2).take(each), some.column(3).take(each), pa.array(np.concatenate(starts))], names=names)
        b = b.filter(pa.compute.invert(settled))
        if not b.num_rows:
            continue
        d1, d2, t1, t2, start = (b.column(i).to_numpy() for i in range(5))
        if last is not None:
            d1, d2, t1, t2, start = (np.append(np.array([x], c.dtype), c) for x, c in zip(last[:5], (d1, d2, t1, t2, start), strict=True))
        same = (d1[1:] == d1[:-1]) & (d2[1:] == d2[:-1])
        met = np.append(last is not None and last[5], same) | np.append(same, False) | (start < 0)
        use = met & (start >= 0)
        if last is not None and last[5]:
            use[0] = False  # it went out with the batch before
        yield pa.RecordBatch.from_arrays([pa.array(t1[use]), pa.array(t2[use]), pa.array(start[use])], names=names)
        last = (d1[-1], d2[-1], t1[-1], t2[-1], start[-1], bool(met[-1]))


def repeated_windows(df: DataFrame, text_col: str, seen, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(t1, t2, start): by text digest, the starts of verified windows; a start may come more than once."""

    def run(batches):
        held, n = [], 0
        for b in text_batches(batches):
            for _, _, data, offsets in text_slices(b.column(0)):
                words = Words(data, offsets)
                hashes = words.hashes()
                at = _candidates(words, hashes, seen.value, window, gram)
                if not len(at):
                    continue
                row = np.searchsorted(words.doc, at, "right") - 1
                # The second word hash is needed where candidates are.
                mark = np.zeros(len(words) + 1, np.int32)
                np.add.at(mark, at, 1)
                np.add.at(mark, at + window, -1)
                some = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
                second = np.zeros(len(words), U64)
                second[some] = words.hashes(seed=CHECK_SEED, some=some)
                docs, which = np.unique(row, return_inverse=True)
                t1, t2 = text_digests(_texts(data, offsets, docs))
                held.append((windows(hashes, window)[at], windows(second, window, CHECK_BASE)[at], t1[which], t2[which], at - words.doc[row]))
                n += len(at)
                if n > FLUSH:
                    yield from _window_rows(*(np.concatenate(c) for c in zip(*held, strict=True)))
                    held, n = [], 0
        if held:
            yield from _window_rows(*(np.concatenate(c) for c in zip(*held, strict=True)))

    found = df.select(text_col).mapInArrow(run, ", ".join(f"{k} {v}" for k, v in WINDOWS.items()))
    sorted_ = found.repartition(partitions(df.sparkSession), "d1", "d2").sortWithinPartitions("d1", "d2")
    return sorted_.mapInArrow(_met_windows, "t1 bigint, t2 bigint, start int")


def _kept(text: bytes, at: np.ndarray, window: int) -> tuple[int, bytes]:
    """Words removed and what is kept."""
    found = text.split()
    gone = np.zeros(len(found) + 1, np.int64)
    gone[at] += 1
    gone[at + window] -= 1
    keep = np.cumsum(gone[:-1]) == 0
    return int(len(found) - keep.sum()), b" ".join(w for w, k in zip(found, keep.tolist(), strict=True) if k)


def remove_seen(df: DataFrame, seen_twice: Filter, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(id_col, n_words, n_removed, kept): each text of df without the passages that repeat in df; seen_twice has at least df's fingerprints that do."""
    shared = df.sparkSession.sparkContext.broadcast(seen_twice)
    starts = repeated_windows(df, text_col, shared, window, gram).groupBy("t1", "t2").agg(F.collect_set("start").alias("starts"))

    def split(batches):
        """Rows without a candidate window are done here; the others' texts go on to meet their windows."""
        for b in text_batches(batches):
            for low, high, data, offsets in text_slices(b.column(1)):
                words = Words(data, offsets)
                at = _candidates(words, words.hashes(), shared.value, window, gram)
                waits = np.zeros(high - low, bool)
                waits[np.searchsorted(words.doc, at, "right") - 1] = True
                texts = _texts(data, offsets, np.arange(high - low))
                kept = [None if w else b" ".join(t.split()) for t, w in zip(texts, waits.tolist(), strict=True)]
                later = [t if w else None for t, w in zip(texts, waits.tolist(), strict=True)]
                t1, t2 = np.zeros(high - low, U64), np.zeros(high - low, U64)
                t1[waits], t2[waits] = text_digests([t for t in later if t is not None])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(low, high - low), as_long(t1), as_long(t2), pa.array(np.diff(words.doc).astype(np.int64)), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(later, pa.binary()).cast(pa.string())], names=["_id", "t1", "t2", "n_words", "kept", "_text"])

    def finish(batches):
        for b in text_batches(batches):
            removed, kept = [], []
            for text, at in zip(b.column(2), b.column(3), strict=True):
                n, rest = _kept(text.as_buffer().to_pybytes(), at.values.to_numpy() if at.is_valid else np.zeros(0, np.int32), window)
                removed.append(n)
                kept.append(rest)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=[id_col, "n_words", "n_removed", "kept"])

    docs = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    done = docs.mapInArrow(split, widened(docs.drop("_text").schema, {"t1": "bigint", "t2": "bigint", "n_words": "bigint", "kept": "string", "_text": "string"}))
    settled = done.filter("_text IS NULL").select(F.col("_id").alias(id_col), "n_words", F.lit(0).cast("bigint").alias("n_removed"), "kept")
    waiting = done.filter("_text IS NOT NULL").join(starts, ["t1", "t2"], "left").select("_id", "n_words", "_text", "starts")
    kinds = widened(df.select(id_col).schema, {"n_words": "bigint", "n_removed": "bigint", "kept": "string"})
    return settled.unionByName(waiting.mapInArrow(finish, kinds))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES) -> DataFrame:
    """remove_seen() by an index to which df is appended in so many batches."""
    with FingerprintIndex(df.sparkSession, text_col, window, gram) as index:
        for i in range(batches):
            index.append(df.filter(F.pmod(F.xxhash64(id_col), F.lit(batches)) == i))
        return remove_seen(df, index.seen_twice(), id_col, text_col, window, gram)


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op1_substrings": op1_substrings}
# A full join of all windows with all windows, by their words; for small tables.
SQL = {
    "op1_substrings": rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
v AS (SELECT k, unnest(range(1, len(w) - {WINDOW - 2})) AS s, w FROM d WHERE len(w) >= {WINDOW}),
h AS (SELECT k, s, md5(array_to_string(w[s:s + {WINDOW - 1}], ' ')) AS g FROM v),
r AS (SELECT k, s FROM (SELECT k, s, count(*) OVER (PARTITION BY g) AS n FROM h) WHERE n > 1),
x AS (SELECT DISTINCT k, unnest(range(s, s + {WINDOW})) AS p FROM r),
y AS (SELECT k, list(p) AS gone FROM x GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: gone IS NULL OR NOT list_contains(gone, i)), lambda i: w[i]), ' '), '')) AS kept_sha256
FROM d LEFT JOIN y USING (k)"""
}
