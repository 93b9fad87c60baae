"""What the operators share: shared-folder staging and vectorised word hashing.

Words are ``[^\\x20\\x09-\\x0D]+``. These separators are single ASCII bytes, so words
are found on the UTF-8 bytes of a whole Arrow column at once, without a Python loop
over words or documents.
"""

from __future__ import annotations

import atexit
import ctypes
import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType

U64 = np.uint64
SLICE_BYTES = 1 << 20
try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim
except (OSError, AttributeError):  # not glibc
    _LIBC = None


# ----------------------------------------------------------------------- staging


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir).

    Only a local master may go without the setting (tests): there a temporary folder is set.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="foliospark-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have."""
    taken, name = {c.lower() for c in df.columns}, f"_{stem}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def _drop_folder(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended: the folder's owner cleans up
        return


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_drop_folder, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def widened(schema: StructType, added: dict[str, str]) -> StructType:
    """schema, all of it nullable, with more columns, their types as DDL."""
    return StructType([*(StructField(f.name, f.dataType, True, f.metadata) for f in schema.fields), *StructType.fromDDL(", ".join(f"`{k}` {v}" for k, v in added.items())).fields])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ------------------------------------------------------------------ word hashing


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


WORD_BASE, CHECK_BASE = 0xD1B54A32D192ED03, 0xAEF17502108EF2DB
WORD_SEED, CHECK_SEED = 0x9E3779B97F4A7C15, 0x3C6EF372FE94F82B
LANES = 8
_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[65:91] += 32
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], U64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def text_slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of slices of about SLICE_BYTES; a null is an empty text.

    A text longer than that is a slice of its own, whole.
    """
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    low = 0
    while low < n:
        high = int(np.searchsorted(offsets, offsets[low] + SLICE_BYTES, "right")) - 1
        high = min(max(high, low + 1), n)
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


class Words:
    """The words of a slice: starts and ends (bytes), doc (offsets into the words by document)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, n = data, len(data)
        space = _SPACE[data]
        before, after = np.ones(n, bool), np.ones(n, bool)
        before[1:], after[:-1] = space[:-1], space[1:]
        inner = offsets[(offsets > 0) & (offsets < n)]
        before[inner] = True
        after[inner - 1] = True
        word = ~space
        self.starts = np.flatnonzero(word & before)
        self.ends = np.flatnonzero(word & after) + 1
        self.doc = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, fold: bool = False, seed: int = WORD_SEED, some: np.ndarray | None = None) -> np.ndarray:
        """64 bits for each word (or for some words, by number); fold: A-Z count as a-z.

        A word of up to LANES * 8 bytes goes through a bijective mixer eight bytes at a time, from a
        start that depends on seed and length, so words of one length up to eight bytes never
        collide; a longer word is digested by BLAKE2b, keyed by the seed.
        """
        starts, ends = (self.starts, self.ends) if some is None else (self.starts[some], self.ends[some])
        left = ends - starts
        padded = np.zeros(len(self.data) + 8, np.uint8)
        np.take(_FOLDED, self.data, out=padded[: len(self.data)]) if fold else padded.__setitem__(slice(len(self.data)), self.data)
        eight = np.ndarray(len(self.data) + 1, "<u8", padded, strides=(1,))
        out = mix(left.astype(U64) * U64(0x9FB21C651E98DF25) ^ U64(seed))
        out = mix(out ^ (eight[starts] & _MASK[np.minimum(left, 8)])) if len(starts) else out
        at = np.flatnonzero(left > 8)
        for lane in range(1, LANES):
            if not len(at):
                break
            rest = left[at] - 8 * lane
            out[at] = mix(out[at] ^ (eight[starts[at] + 8 * lane] & _MASK[np.minimum(rest, 8)]))
            at = at[rest > 8]
        key = seed.to_bytes(8, "little")
        for i in np.flatnonzero(left > 8 * LANES).tolist():
            out[i] = int.from_bytes(hashlib.blake2b(padded[starts[i] : ends[i]], digest_size=8, key=key).digest(), "little")
        return out


def windows(hashes: np.ndarray, size: int, base: int = WORD_BASE) -> np.ndarray:
    """64 bits for each run of size hashes: a polynomial in them, built by doubling (runs across documents are the caller's to drop)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    out, done, block, width = None, 0, hashes, 1
    while True:
        step = U64(pow(base, width, 1 << 64))
        if size & width:
            out = block[:n].copy() if out is None else out * step + block[done : done + n]
            done += width
        if done == size:
            return mix(out)
        block = block[:-width] * step + block[width:]
        width *= 2


def by_row(row: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The order by (row, key) for fewer than 2**20 rows: one sort of both's high bits; by both in full where these tie."""
    short = (row.astype(U64) << U64(44)) | (key >> U64(20))
    order = np.argsort(short)
    short = short[order]
    tied = short[1:] == short[:-1]
    if tied.any() and (key[order][1:] != key[order][:-1])[tied].any():
        return np.lexsort((key, row))
    return order


def inside(doc: np.ndarray, size: int) -> np.ndarray:
    """For each run start of windows(): whether the run lies in one document."""
    total = int(doc[-1])
    ok = np.zeros(max(0, total - size + 1), bool)
    last = doc[1:] - size
    begin = doc[:-1]
    use = last >= begin
    edges = np.zeros(len(ok) + 1, np.int64)
    np.add.at(edges, begin[use], 1)
    np.add.at(edges, last[use] + 1, -1)
    ok[:] = np.cumsum(edges[:-1]) > 0
    return ok


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def release() -> None:
    """Gives back to the system what this process no longer uses: workers are kept, and what they keep adds up beside the JVM."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def text_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches without the empty ones; a worker's unused memory goes back when a task begins and when its input ends."""
    release()
    for b in batches:
        if b.num_rows:
            yield b
    release()


# ----------------------------------------------------------- membership filters

MOST_BITS = 30


def filter_bits(values: int) -> int:
    """The filter's size for so many values: 16 bits for each at least, in all 2**MOST_BITS at most.

    Beyond that bound more absent values look present; the exact step that follows every
    filter then sees more rows, at worst all of them, and results stay the same.
    """
    return min(MOST_BITS, max(15, (16 * max(1, values) - 1).bit_length()))


class Filter:
    """A set of 64-bit values by two bits for each: the lowest bits of the value and the highest.

    A value may look present that isn't, never the reverse, so it only precedes an exact step.
    """

    def __init__(self, df: DataFrame, column: str):
        from pyspark.sql import functions as F

        self.bits = filter_bits(df.count())
        low = F.col(column).bitwiseAND(F.lit((1 << self.bits) - 1))
        high = F.shiftrightunsigned(column, 64 - self.bits)
        rows = (
            df.select(F.explode(F.array(low, high)).alias("at"))
            .groupBy(F.shiftright("at", 15).alias("block"))
            .agg(F.expr("bitmap_construct_agg(at & 32767)").alias("bitmap"))
            .collect()
        )
        out = bytearray(1 << (self.bits - 3))
        for block, bitmap in rows:
            out[block * 4096 : block * 4096 + len(bitmap)] = bitmap
        self.bitmap = np.frombuffer(bytes(out), np.uint8)

    def _bit(self, at: np.ndarray) -> np.ndarray:
        return (self.bitmap[(at >> U64(3)).astype(np.int64)] >> (at & U64(7)).astype(np.uint8)) & 1 == 1

    def has(self, values: np.ndarray) -> np.ndarray:
        """For each value, whether both its bits are set."""
        found = self._bit(values & U64((1 << self.bits) - 1))
        found[found] = self._bit(values[found] >> U64(64 - self.bits))
        return found
