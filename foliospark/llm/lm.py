"""Operator 6: language-model scores by online logistic context mixing.

A text is its words, A-Z folded, and an end. A token is coded in binary decisions:

* whether it is the word that followed the same three tokens most often in the training
  texts, if the run table knows such a word; whether it is what followed the same two tokens
  when they last stood in this very text, if they did;
* else the bits of its Huffman code among the TOP most frequent words that occur twice, the end and
  an escape (words seen once show how new words look);
  after an escape, the bits of the word's byte pairs, a terminator after its last byte, along a
  Huffman tree of pairs.

Predictors of a bit are tables of hashed contexts at the tree's node: for words the node
itself, the word before, and the most frequent of the six words before (which mostly tells
the language); for byte pairs the last two, four and six bytes of the word. The stretched
predictions and a constant are combined by weights that a gate selects (kind of decision,
depth, place, what the run predictors say); a probability map, by gate and prediction,
refines the result. After each block of tokens and pairs (BLOCKS: longer ones later on), a text's own
weights take a step against the error made, and its own map towards the bits seen, so a text's score depends on
nothing but itself and the model. The sum of the bits' log10 probabilities is the score;
divided by bytes it is the usual bits per byte.

Training counts every training text: bytes, words, tables, and the run table's contexts. A
scan task keeps the bit tables and sends them in compressed blocks; the run contexts travel
with check bits, and where contexts share a cell the most frequent stays. Tables are sized
by the number of training tokens, up to 2**MOST_BITS cells each: beyond that, rarer contexts
give way. First weights and map are a classifier that is fitted to the decisions of every
training text, each predicted with its own occurrence taken off the counts; what is held of
them is how often each gate meets each combination of inputs (in LEVELS steps) and bit.

Base score: exact counts c of words and ends over all training texts. The TOP most
frequent words are broadcast (a fixed number); a chunk of documents lists for each rarer
word where it stands, the lists meet the counts in a join, and go back to their chunk.
Words are compared by 64-bit hashes.

Null and empty texts are the end alone. Ids may repeat or be null (null: the text '');
equal texts get equal scores. Other columns aren't read, whatever their names. A long text
is coded in pieces of CHUNK tokens and pairs (a piece ends a block) that hand on its weights and
map, so memory is some fifty bytes for each of its bytes. Without training texts N = V = 0 and the model predicts every bit with 1/2.
"""

from __future__ import annotations

import heapq
import math
import pickle
import secrets
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import _FOLDED, _SPACE, Words, as_long, mix, partitions, stage, text_batches, text_slices, widened
from .toxicity import remainder

TOP = 1 << 17
MOST_BITS = {"word": 22, "anchor": 20, "bytes": 21, "run": 22}
CELLS = 1 << 14
RUN_BLOCKS = 1 << 10
FLUSH = 1 << 21
LEVELS = 33
WIDE, MOST_ROWS = 1 << 17, 1 << 10
CHUNK = 3 << 16
PART, PAIRS = 3 << 12, 1 << 14  # units, and pairs of context and word, whose decisions are made at once: few enough for a core's cache
BLOCKS = ((1 << 10, 32), (1 << 13, 128), (0, 512))  # up to so many tokens and pairs of a text, blocks of so many
RATE = 0.02
MAP_RATE = 0.05
INPUTS = 4
DEPTHS, PLACES, STEPS = 8, 4, 33
MATCH, REPEAT, WORD, BYTE = 0, 6, 18, 34  # the first gates of each kind of decision
GATES = BYTE + 4 * PLACES
TALLIES = 2 * GATES * LEVELS ** (INPUTS - 1)
LIMIT = 8.0
END_WORD = np.uint64(0x9E3779B97F4A7C15)
U64 = np.uint64


# ------------------------------------------------------------------------ code tables


_HELD: dict[str, object] = {}


class Shared:
    """A broadcast that travels and lies on disks compressed; a worker unpacks it once and holds two at most."""

    def __init__(self, spark: SparkSession, value):
        self.name = uuid.uuid4().hex
        self.packed = spark.sparkContext.broadcast(zstandard.ZstdCompressor(level=3).compress(pickle.dumps(value, protocol=5)))

    @property
    def value(self):
        if self.name not in _HELD:
            while len(_HELD) > 1:
                _HELD.pop(next(iter(_HELD)))
            _HELD[self.name] = pickle.loads(zstandard.ZstdDecompressor().decompress(self.packed.value))
        return _HELD[self.name]

    def drop(self) -> None:
        self.packed.destroy()


class Tree:
    """A Huffman tree: each symbol's nodes and bits from the root, and each node's stretched share of ones."""

    def __init__(self, counts: list[int]):
        n = len(counts)
        heap = [(c + 1, s) for s, c in enumerate(counts)]
        heapq.heapify(heap)
        parent, side, weight = np.full(2 * n - 1, -1), np.zeros(2 * n - 1, np.uint8), np.zeros(2 * n - 1)
        made = n
        while len(heap) > 1:
            (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
            parent[x] = parent[y] = made
            side[y] = 1
            weight[x], weight[y] = a, b
            heapq.heappush(heap, (a + b, made))
            made += 1
        steps, at = [], np.arange(n)
        while (parent[at] >= 0).any():
            inner = parent[at] >= 0
            steps.append((np.where(inner, parent[at] - n, -1), side[at]))
            at = np.where(inner, parent[at], at)
        self.length = np.sum([node >= 0 for node, _ in steps], axis=0, dtype=np.int32) if steps else np.zeros(n, np.int32)
        self.node, self.bit = np.zeros((n, max(1, len(steps))), np.int32), np.zeros((n, max(1, len(steps))), np.uint8)
        for k, (node, bit) in enumerate(steps):
            rows = np.flatnonzero(node >= 0)
            self.node[rows, self.length[rows] - 1 - k], self.bit[rows, self.length[rows] - 1 - k] = node[rows], bit[rows]
        ones, zeros = np.zeros(max(1, n - 1)), np.zeros(max(1, n - 1))
        child = np.flatnonzero(parent >= 0)
        np.add.at(ones, parent[child] - n, weight[child] * side[child])
        np.add.at(zeros, parent[child] - n, weight[child] * (1 - side[child]))
        self.share = stretch(zeros, ones)

    def steps(self, symbols: np.ndarray):
        """(number in symbols, depth, node, bit) of each step from the root to the symbols; whole words as places, which take() needs."""
        lens = self.length.take(symbols)
        which = np.repeat(np.arange(len(symbols)), lens)
        depth = np.arange(len(which))
        depth -= (np.cumsum(lens, dtype=np.int64) - lens).take(which)
        spot = (symbols * np.int64(self.node.shape[1])).take(which)
        spot += depth
        return which, depth, self.node.ravel().take(spot), self.bit.ravel().take(spot)


def stretch(zeros, ones) -> np.ndarray:
    return np.clip(np.log((ones + 0.4) / (zeros + 0.4)), -LIMIT, LIMIT).astype(np.float32)


def level(x: np.ndarray) -> np.ndarray:
    """The step, of LEVELS, that a stretched prediction is nearest to."""
    return np.round((np.clip(x, -LIMIT, LIMIT) + LIMIT) * ((LEVELS - 1) / (2 * LIMIT))).astype(np.int8)


class Code:
    """Vocabulary and trees: of a size that TOP fixes. Words come with the most frequent first."""

    def __init__(self, words: list[tuple[int, int]], others: int, pair_counts: list[int], tokens: int):
        hashes = np.array([h & ((1 << 64) - 1) for h, _ in words], U64)
        order = np.argsort(hashes)
        self.known, self.rank = hashes[order], order.astype(np.int32)
        self.many = np.array([n for _, n in words], np.int64)[order]
        self.size = len(words)
        # Where the hashes with the same first bits begin: about one word for each.
        self.shift = U64(64 - max(1, self.size.bit_length()))
        self.begin = np.searchsorted(self.known, np.arange(1 << (64 - int(self.shift)), dtype=U64) << self.shift).astype(np.int32)
        self.escape, self.none = self.size, self.size + 2
        found = np.flatnonzero(hashes == END_WORD)
        self.end = int(found[0]) if len(found) else self.size + 1
        self.words = Tree([n for _, n in words] + [others, 0])
        self.bytes = Tree(pair_counts)
        self.bits = {k: max(14, min(most, tokens.bit_length())) for k, most in MOST_BITS.items()}
        self.first = dict(zip(("word", "anchor", "bytes", ""), np.cumsum([0, *(1 << self.bits[k] for k in ("word", "anchor", "bytes"))]).tolist(), strict=True))

    def look(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in known, whether it is there) of each hash."""
        if not self.size:
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(self.begin[hashes >> self.shift], self.size - 1).astype(np.int64)
        rest = np.flatnonzero(self.known[at] < hashes)
        while len(rest):
            at[rest] += 1
            rest = rest[at[rest] < self.size]
            rest = rest[self.known[at[rest]] < hashes[rest]]
        np.minimum(at, self.size - 1, out=at)
        return at, self.known[at] == hashes

    def cells(self, table: str, context: np.ndarray, node: np.ndarray) -> np.ndarray:
        return self.places(table, spread(context), turned(node))

    def places(self, table: str, context: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Cells by a context's 32 bits and a node's. A context's own nodes, up to 2**17 of them, stand in cells of their own."""
        x = context ^ node
        x >>= np.uint32(32 - self.bits[table])
        x = x.astype(np.int64)
        x += self.first[table]
        return x


def spread(context: np.ndarray) -> np.ndarray:
    """32 bits of each context, reached by all of its bits."""
    x = context.astype(U64)
    x *= U64(0x9FB21C651E98DF25)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(29)
    x *= U64(0x9E3779B97F4A7C15)
    x >>= U64(32)
    return x.astype(np.uint32)


def turned(node: np.ndarray) -> np.ndarray:
    """32 bits of each node: their high bits lie evenly spaced."""
    return node.astype(np.uint32) * np.uint32(0x9E3779B1)


# ----------------------------------------------------------------------- tokens of a slice


def ordered(key: np.ndarray, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """The stable order of keys below 2**bits, and the keys in it.

    Keys, or their high bits, are sorted with their places in the low bits: numbers are sorted much faster than places.
    """
    low = max(1, len(key).bit_length())
    cut = U64(max(0, bits + low - 64))
    both = key >> cut
    both <<= U64(low)
    both |= np.arange(len(key), dtype=U64)
    both.sort()
    order = (both & U64((1 << low) - 1)).view(np.int64)
    both >>= U64(low)
    if not cut:
        return order, both
    found = key.take(order)
    if ((both[1:] == both[:-1]) & (found[1:] != found[:-1])).any():
        order = np.argsort(key, kind="stable")
        found = key[order]
    return order, found


def _back(x: np.ndarray, at: np.ndarray, k: int, nothing) -> np.ndarray:
    """x of the token k before, nothing before a text's first."""
    out = np.full(len(x), nothing, x.dtype)
    out[k:] = np.where(at[k:] >= k, x[:-k], x.dtype.type(nothing))
    return out


class Tokens:
    """The tokens of a slice, text by text, an end after each text's words, with their contexts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, code: Code, words: Words | None = None, hashes: np.ndarray | None = None):
        words = words or Words(data, offsets)
        hashes = words.hashes(fold=True) if hashes is None else hashes
        self.code, rows = code, len(offsets) - 1
        count = np.diff(words.doc)
        self.first = words.doc[:-1] + np.arange(rows)
        self.row = np.repeat(np.arange(rows, dtype=np.int32), count + 1)
        self.at = (np.arange(len(self.row)) - self.first[self.row]).astype(np.int32)
        spot = np.arange(len(words)) + np.repeat(np.arange(rows), count)
        self.hash, self.start, self.size = np.full(len(self.row), END_WORD), np.zeros(len(self.row), np.int64), np.zeros(len(self.row), np.int64)
        self.hash[spot], self.start[spot], self.size[spot] = hashes, words.starts, words.ends - words.starts
        at, hit = code.look(self.hash)
        self.id = np.where(hit, code.rank[at] if code.size else 0, code.escape).astype(np.int32)
        self.id[self.first + count] = code.end
        self.length = np.bincount(self.row, self.size + 1, rows).astype(np.int64)
        # Bytes behind eight zeros, so that the eight before any place can be read at once.
        self._padded = np.zeros(len(data) + 16, np.uint8)
        self._padded[8 : 8 + len(data)] = _FOLDED[data]
        self._eight = np.ndarray(len(data) + 9, "<u8", self._padded, strides=(1,))
        self.escaped = self.id == code.escape

    def before(self) -> tuple[np.ndarray, np.ndarray]:
        """The word before, and the most frequent of the six before."""
        last = _back(self.id, self.at, 1, self.code.none)
        anchor = last
        for k in range(2, 7):
            anchor = np.minimum(anchor, _back(self.id, self.at, k, self.code.none))
        return last, anchor

    def last(self, k: int) -> np.ndarray:
        """A hash of the k tokens before."""
        out = np.full(len(self.hash), U64(k))
        for j in range(1, k + 1):
            out = mix(out * U64(0x9E3779B97F4A7C15) + _back(self.hash, self.at, j, 0))
        return out

    def word_bits(self, tokens: np.ndarray, last: np.ndarray, anchor: np.ndarray):
        """Of the words' codes: (number in tokens, depth, node, value, cells) of each bit."""
        which, depth, node, value = self.code.words.steps(self.id.take(tokens))
        turn = turned(node)
        cells = [self.code.places(name, spread(context.take(tokens)).take(which), turn) for name, context in (("word", last), ("anchor", anchor))]
        return which, depth, node, value, cells

    def pairs(self) -> np.ndarray:
        """By token: the byte pairs that spell it, where it is escaped."""
        return np.where(self.escaped, (self.size >> 1) + 1, 0)

    def pair_bits(self, tokens: np.ndarray, place: np.ndarray):
        """Of byte pairs (the place-th of each token): (number in tokens, depth, node, value, cells) of each bit."""
        at = self.start[tokens] + 2 * place
        left = self.size[tokens] - 2 * place  # what stands behind the word is a terminator and a zero
        pair = (self._eight[at + 8] & U64(0xFFFF)).astype(np.int32)
        sym = np.where(left > 1, pair, np.where(left == 1, (pair & 255) | 0x2000, 0x20))
        which, depth, node, value = self.code.bytes.steps(sym)
        cells, past, turn = [], self._eight[at], turned(node)
        for k in (1, 2, 3):
            have = np.minimum(place, k)
            seen = np.where(have > 0, past >> (U64(64) - U64(16) * np.maximum(have, 1).astype(U64)), U64(0))
            cells.append(self.code.places("bytes", spread(mix(seen * U64(8) + have.astype(U64) + U64(k << 56))).take(which), turn))
        return which, depth, node, value, cells


def _slices(column: pa.Array, size: int = WIDE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of about size bytes and MOST_ROWS rows at most; a longer text is a slice of its own."""
    for low, high, data, offsets in text_slices(column):
        at = 0
        while at < high - low:
            to = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
            to = min(max(to, at + 1), high - low, at + MOST_ROWS)
            yield low + at, low + to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


# ------------------------------------------------------------------------- training


def _pieces(units: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(token, unit of the token) of all units, where token i has units[i], in pieces of size."""
    ends = np.cumsum(units)
    low = 0
    while low < len(units):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + size, "right")))
        if high == low + 1 and units[low] > size:  # one long word: in parts
            for at in range(0, int(units[low]), size):
                unit = np.arange(at, min(at + size, int(units[low])))
                yield np.full(len(unit), low), unit
        else:
            token = np.repeat(np.arange(low, high), units[low:high])
            yield token, np.arange(len(token)) - (ends[low:high] - units[low:high] - (ends[low] - units[low]))[token - low]
        low = high


_PACKER, _UNPACKER = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()  # made once: blocks are many and small


def _pack(x: np.ndarray) -> bytes:
    return _PACKER.compress(x.tobytes())


def _unpack(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(_UNPACKER.decompress(x), kind)


def _pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte by byte."""
    return _pack(np.diff(keys, prepend=U64(0)).view(np.uint8).reshape(-1, 8).T)


def _unpack_keys(x: bytes) -> np.ndarray:
    planes = _unpack(x, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(U64).ravel(), dtype=U64)


def run_keys(tokens: Tokens) -> np.ndarray:
    """Of each token: cell of its context in the run table, 8 check bits, 24 bits of the token."""
    bits = tokens.code.bits["run"]
    return ((tokens.last(3) >> U64(56 - bits)) << U64(24)) | (tokens.hash >> U64(40))


def count_tables(texts: DataFrame, code) -> DataFrame:
    """(kind, block, keys, n): of each scan task, what its texts add to the bit tables (kind 0: zeros and ones of each cell
    of a block) and to the run table (kind 1: the keys of a block and how often each occurs)."""

    def run(batches):
        c = code.value
        table = np.zeros(2 * c.first[""], np.int32)
        one = np.int32(1)  # of the table's type: else numpy takes a slower path
        runs, held = [], 0
        pairs: dict[str, list[np.ndarray]] = {"word": [], "anchor": []}

        def add_words():
            """Each pair of context and word that was met, once."""
            for name, parts in pairs.items():
                if not parts:  # they went in with the last slice
                    continue
                pair, n = np.unique(np.concatenate(parts), return_counts=True)
                n = n.astype(np.int32)
                parts.clear()
                for low in range(0, len(pair), PAIRS):
                    some = pair[low : low + PAIRS]
                    which, _, node, bit = c.words.steps(some & 0xFFFFFFFF)
                    x = c.places(name, spread(some >> 32).take(which), turned(node))
                    x += x
                    x += bit
                    np.add.at(table, x, n[low : low + PAIRS].take(which))

        def out():
            keys, n = np.unique(np.concatenate(runs), return_counts=True)
            block = (keys >> U64(32 + c.bits["run"] - RUN_BLOCKS.bit_length() + 1)).astype(np.int64)
            bounds = np.searchsorted(block, np.arange(RUN_BLOCKS + 1))
            rows = [(i, x, y) for i, x, y in zip(range(RUN_BLOCKS), bounds, bounds[1:], strict=False) if y > x]
            yield pa.RecordBatch.from_arrays([pa.array([1] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.int32()), pa.array([_pack_keys(keys[x:y]) for _, x, y in rows], pa.binary()), pa.array([_pack(np.minimum(n[x:y], 255).astype(np.uint8)) for _, x, y in rows], pa.binary())], names=["kind", "block", "keys", "n"])

        for b in text_batches(batches):
            for _, _, data, offsets in _slices(b.column(0)):
                tokens = Tokens(data, offsets, c)
                last, anchor = tokens.before()
                for name, context in (("word", last), ("anchor", anchor)):
                    pairs[name].append(context.astype(np.int64) << 32 | tokens.id)
                if sum(map(len, pairs["word"])) > PAIRS << 5:
                    add_words()
                for at, place in _pieces(tokens.pairs(), PART):
                    _, _, _, value, cells = tokens.pair_bits(at, place)
                    for x in cells:
                        x += x
                        x += value
                        np.add.at(table, x, one)
                runs.append(run_keys(tokens))
                held += len(runs[-1])
                if held > FLUSH:
                    yield from out()
                    runs, held = [], 0
        add_words()
        if runs:
            yield from out()
        for block, part in enumerate(table.reshape(-1, 2 * CELLS)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([block], pa.int32()), pa.array([_pack(part)]), pa.array([b""])], names=["kind", "block", "keys", "n"])

    return texts.mapInArrow(run, "kind int, block int, keys binary, n binary")


def _best_runs(keys: np.ndarray, n: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """For each cell of a block: check bits and token of the word that follows its most frequent context, and, in four bits each, how often and of how many."""
    keys, where = np.unique(keys, return_inverse=True)
    w = np.bincount(where, n, len(keys)).astype(np.int64)
    context, each = np.unique(keys >> U64(24), return_inverse=True)
    total = np.bincount(each, w, len(context)).astype(np.int64)
    order = np.lexsort((w, each))  # the last of each context is its most frequent word
    best = order[np.append(np.diff(each[order]) > 0, True)]
    cell = ((context >> U64(8)) & U64(cells - 1)).astype(np.int64)
    order = np.lexsort((total, cell))
    top = order[np.append(np.diff(cell[order]) > 0, True)]
    token, conf = np.zeros(cells, np.uint32), np.zeros(cells, np.uint8)
    token[cell[top]] = (keys[best[top]] & U64(0xFFFFFFFF)).astype(np.uint32)
    part, whole = w[best[top]], total[top]
    scale = np.maximum(1, -(-whole // 15))
    whole, part = np.maximum(1, whole // scale), np.maximum(1, part // scale)
    conf[cell[top]] = (np.minimum(part, whole) * 16 + whole).astype(np.uint8)
    return token, conf


def merged_tables(counted: DataFrame, code) -> DataFrame:
    """(kind, block, a, b): the tables' blocks over all tasks; kind 0: zeros and ones (at most 16 bits each); kind 1: token and confidence."""

    def run(batches):
        c = code.value
        sums: dict[int, np.ndarray] = {}
        runs: dict[int, list] = {}
        for b in text_batches(batches):
            for kind, block, keys, n in zip(*(b.column(i) for i in range(4)), strict=True):
                block = block.as_py()
                if kind.as_py():
                    runs.setdefault(block, []).append((_unpack_keys(keys.as_py()), _unpack(n.as_py(), np.uint8)))
                elif block in sums:
                    sums[block] += _unpack(keys.as_py(), np.int32)
                else:
                    sums[block] = _unpack(keys.as_py(), np.int32).astype(np.int64)
        for block, n in sums.items():
            n = n.reshape(-1, 2)
            scale = np.maximum(1, -(-n.max(1) // 65535))[:, None]
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([block], pa.int32()), pa.array([_pack((n // scale).astype(np.uint16))]), pa.array([b""])], names=["kind", "block", "a", "b"])
        for block, parts in runs.items():
            token, conf = _best_runs(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), (1 << c.bits["run"]) // RUN_BLOCKS)
            yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([block], pa.int32()), pa.array([_pack(token)]), pa.array([_pack(conf)])], names=["kind", "block", "a", "b"])

    return counted.repartition(partitions(counted.sparkSession), "kind", "block").mapInArrow(run, "kind int, block int, a binary, b binary")


class Model:
    """Code, tables, weights and map; of a size that the parameters bound.

    A byte for each cell; until the model is settled, also the levels that each cell predicts to a text of its own, without the bit that is predicted.
    """

    def __init__(self, code: Code, counts: np.ndarray, token: np.ndarray, conf: np.ndarray):
        self.code, self.token, self.conf = code, token, conf
        self.weights, self.chart = np.full((GATES, INPUTS), 0.4), np.full((GATES, STEPS), 0.5)
        self.table, self.left = np.zeros(len(counts), np.int8), np.zeros(2 * len(counts), np.int8)
        self.share = level(code.words.share)
        for at in range(0, len(counts), CHUNK):
            zeros, ones = counts[at : at + CHUNK].T.astype(np.float32)
            self.table[at : at + CHUNK] = np.round(stretch(zeros, ones) * (127 / LIMIT))
            self.left[2 * at : 2 * (at + CHUNK) : 2] = level(stretch(np.maximum(zeros - 1, 0), ones))
            self.left[2 * at + 1 : 2 * (at + CHUNK) : 2] = level(stretch(zeros, np.maximum(ones - 1, 0)))

    def settle(self, weights: np.ndarray, chart: np.ndarray) -> None:
        """The model for scoring."""
        self.weights, self.chart, self.left = weights, chart, None

    def predict(self, cells: np.ndarray, value: np.ndarray) -> np.ndarray:
        """What cells predict, in steps of LIMIT / 127; while the model is fitted, their levels without the bit that is predicted. Cells may be changed."""
        if self.left is None:
            return self.table.take(cells)
        cells += cells
        cells += value
        return self.left.take(cells)


def blocks(number: np.ndarray) -> np.ndarray:
    """The block of each token or pair, by its place in the text."""
    out, before, done = np.zeros(len(number), np.int32), 0, 0
    for upto, size in BLOCKS:
        here = np.minimum(number, upto - 1) if upto else number
        out += np.where(number >= before, (here - before) // size + (done > 0), 0).astype(np.int32)
        done, before = 1, upto
    return out


class Decisions:
    """The binary decisions of a slice's tokens: asked for in pieces of units, a token or a byte pair of one."""

    def __init__(self, tokens: Tokens, model: Model):
        self.tokens, self.model = tokens, model
        self.last, self.anchor = tokens.before()
        fitting = model.left is not None
        # What the run table says.
        key = run_keys(tokens)
        at = (key >> U64(32)).astype(np.int64)
        check, word = ((key >> U64(24)) & U64(255)).astype(np.uint32), (key & U64(0xFFFFFF)).astype(np.uint32)
        token, conf = model.token[at], model.conf[at]
        self.part, self.whole = (conf >> 4).astype(np.int16), (conf & 15).astype(np.int16)
        known = (self.whole > 0) & (token >> np.uint32(24) == check)
        hit = known & (token & np.uint32(0xFFFFFF) == word)
        if fitting:
            self.part[hit] -= 1
            self.whole[known] -= 1
            self.whole = np.maximum(self.whole, self.part)
            known &= (self.part > 0) & (self.whole > 0)
            hit &= known
        # What followed when the two tokens before last stood in this text.
        two = mix(tokens.last(2) + tokens.row.astype(U64) * U64(0xA24BAED4963EE407))
        order, two = ordered(two)
        same = np.append(False, two[1:] == two[:-1])
        past = np.full(len(order), -1)
        past[order[1:][same[1:]]] = order[:-1][same[1:]]
        seen = past >= 0
        again = seen & (tokens.hash[past] == tokens.hash)
        twice = seen & seen[past]
        self.state = np.where(seen, 1 + 2 * twice + (twice & again[past]) + 2 * (twice & seen[past[past]] & again[past] & again[past[past]]), 0)
        agree = known & seen & ((tokens.hash[past] >> U64(40)).astype(np.uint32) == (token & np.uint32(0xFFFFFF)))
        self.known, self.hit, self.again, self.agree = known, hit, again, agree
        self.asked = seen & ~(known & (hit | agree))
        self.open = ~(known & hit) & ~(self.asked & again)
        self.units = 1 + np.where(self.open, tokens.pairs(), 0)

    def kinds(self, token: np.ndarray, unit: np.ndarray):
        """Of units, kind by kind: (numbers in units, number in those of each decision, gate, inputs but the constant, value).

        Inputs are levels while the model is fitted; else those of one byte are in steps of LIMIT / 127.
        """
        t, m = self.tokens, self.model
        own = (lambda x: x) if m.left is None else level
        whole = np.flatnonzero(unit == 0)
        lone = token[whole]
        # The run table's word.
        use = whole[self.known[lone]]
        at = token[use]
        says = np.where(self.state[at] > 0, np.where(self.agree[at], 1, 2), 0)
        x = np.zeros((INPUTS - 1, len(at)), np.float32)
        x[0] = stretch((self.whole[at] - self.part[at]).astype(np.float32), self.part[at].astype(np.float32))
        x[1] = np.where(says == 1, 1, -1) * (says > 0) * (0.5 * self.state[at])
        yield use, np.arange(len(use)), MATCH + 2 * says + (self.part[at] == self.whole[at]), own(x), self.hit[at]
        # The text's own.
        use = whole[self.asked[lone]]
        at = token[use]
        x = np.zeros((INPUTS - 1, len(at)), np.float32)
        x[1] = 0.5 * self.state[at]
        yield use, np.arange(len(use)), REPEAT + 2 * np.minimum(self.state[at] - 1, 5) + self.known[at], own(x), self.again[at]
        # The code.
        use = whole[self.open[lone]]
        which, depth, node, value, cells = t.word_bits(token[use], self.last, self.anchor)
        share = m.code.words.share if m.left is None else m.share
        fresh = (self.last.take(token[use]) >= m.code.escape) + np.int64(WORD)
        gate = np.minimum(depth, DEPTHS - 1, out=depth)
        gate += gate
        gate += fresh.take(which)
        yield use, which, gate, [share.take(node), *(m.predict(c, value) for c in cells)], value
        use = np.flatnonzero(unit > 0)
        which, depth, node, value, cells = t.pair_bits(token[use], unit[use] - 1)
        place = np.minimum(unit[use] - 1, PLACES - 1) + BYTE
        gate = np.minimum(depth, 3, out=depth)
        gate *= 4
        gate += place.take(which)
        yield use, which, gate, [m.predict(c, value) for c in cells], value

    def pieces(self):
        """(run, inputs, value) of the decisions of consecutive units; run: (block of the unit in its text, row, gate) as one number, blocks counted from the piece's first."""
        t = self.tokens
        ends = np.cumsum(self.units)
        base = (ends - self.units)[t.first]  # the first unit of each text
        for token, unit in _pieces(self.units, CHUNK):
            row = t.row[token]
            block = blocks(ends[token] - self.units[token] + unit - base[row])
            key = ((block - block.min()) * np.int64(len(t.first)) + row) * GATES
            out = [(key[at : at + PART].take(use).take(which), *more) for at in range(0, len(token), PART) for use, which, *more in self.kinds(token[at : at + PART], unit[at : at + PART])]
            n = sum(len(o[0]) for o in out)
            run, x, value, low = np.empty(n, np.int64), np.empty((n, INPUTS), np.float32), np.empty(n, np.uint8), 0
            x[:, INPUTS - 1] = 1
            for first, gate, inputs, values in out:
                here = slice(low, low := low + len(first))
                np.add(first, gate, out=run[here])
                value[here] = values
                for i, column in enumerate(inputs):
                    np.multiply(column, np.float32(LIMIT / 127 if column.dtype == np.int8 else 1), out=x[here, i])
            del out
            yield run, x, value

    def add_to(self, tally: np.ndarray) -> int:
        """Counts gates, levels and values of all decisions in tally; returns how many there are."""
        many, one = 0, np.int32(1)
        for token, unit in _pieces(self.units, PART):
            for _, _, gate, levels, value in self.kinds(token, unit):
                key = gate.astype(np.int32)
                for x in levels:
                    key *= np.int32(LEVELS)
                    key += x
                key += key
                key += value
                np.add.at(tally, key.astype(np.int64), one)
                many += len(key)
        return many


def _packed_blocks(x: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(block, n) of the blocks of x, CELLS long, that aren't all zeros."""
    for block, at in enumerate(range(0, len(x), CELLS)):
        if (part := x[at : at + CELLS]).any():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([_pack(part)], pa.binary())], names=["block", "n"])


def fit_tallies(texts: DataFrame, model) -> DataFrame:
    """(block, n): blocks of the number of decisions in all texts, by gate, levels of the inputs, and value."""

    def run(batches):
        tally, held = np.zeros(TALLIES, np.int32), 0
        for b in text_batches(batches):
            for _, _, data, offsets in _slices(b.column(0)):
                held += Decisions(Tokens(data, offsets, model.value.code), model.value).add_to(tally)
                if held > 1 << 30:
                    yield from _packed_blocks(tally)
                    tally[:], held = 0, 0
        yield from _packed_blocks(tally)

    def merge(batches):
        sums: dict[int, np.ndarray] = {}
        for b in text_batches(batches):
            for block, n in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                sums[block] = sums.get(block, 0) + _unpack(n.as_py(), np.int32).astype(np.int64)
        for block, n in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([_pack(n)], pa.binary())], names=["block", "n"])

    return texts.mapInArrow(run, "block int, n binary").repartition(partitions(texts.sparkSession), "block").mapInArrow(merge, "block int, n binary")


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -LIMIT, LIMIT)))


def _step(x: np.ndarray) -> np.ndarray:
    return ((np.clip(x, -LIMIT, LIMIT) + LIMIT) * ((STEPS - 1) / (2 * LIMIT)) + 0.5).astype(np.int64)


def fit_mixer(inputs: np.ndarray, gate: np.ndarray, zeros: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First weights (gate, input) by Newton's method for each gate, and the map (gate, step) of probabilities.

    Each column of inputs stands for zeros + ones bits.
    """
    start = np.append(np.full(INPUTS - 1, 0.4), 0.0)
    weights = np.tile(start, (GATES, 1))
    n = zeros + ones
    for g in range(GATES):
        use = gate == g
        if n[use].sum() < 200:
            continue
        x, y, m, w = inputs[:, use].T.astype(np.float64), ones[use], n[use], weights[g].copy()
        for _ in range(12):
            p = _squash(x @ w)
            w += np.clip(np.linalg.solve((x * (m * p * (1 - p))[:, None]).T @ x + np.eye(INPUTS), x.T @ (y - m * p) - (w - start)), -0.5, 0.5)
        weights[g] = w
    mixed = (weights[gate] * inputs.T).sum(1)
    cell = gate * STEPS + _step(mixed)
    centre = np.tile(_squash(np.linspace(-LIMIT, LIMIT, STEPS)), GATES)
    seen, hit = np.bincount(cell, n, GATES * STEPS), np.bincount(cell, ones, GATES * STEPS)
    return weights, ((hit + 20 * centre) / (seen + 20)).reshape(GATES, STEPS)


def _rows(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """x[at] of rows of INPUTS floats, which are as wide as one complex number and quicker to take as such."""
    return x.view(np.complex128).ravel().take(at).view(np.float32).reshape(-1, INPUTS)


def score_slice(tokens: Tokens, model: Model) -> np.ndarray:
    """log10 probability of each text of a slice. Block by block, all its texts at once; each has weights and a map of its own.

    Decisions of a block that share text and gate stand together, so a step is a sum over each such run.
    """
    rows = len(tokens.first)
    own, charts = np.tile(model.weights.astype(np.float32), (rows, 1)), np.tile(model.chart.astype(np.float32).ravel(), rows)
    total = np.zeros(rows)
    for run, x, value in Decisions(tokens, model).pieces():
        if not len(run):
            continue
        order, run = ordered(run.view(U64), int(run.max()).bit_length())
        x, y = _rows(x, order), value.take(order).astype(np.float32)
        first = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
        ends = np.append(first, len(run))
        long = np.diff(ends)
        block, name = np.divmod(run[first].view(np.int64), rows * GATES)
        which = np.repeat(np.arange(len(first)), long)
        base = name * STEPS
        scale = np.float32(RATE) / np.sqrt(long.astype(np.float32))
        pace = np.minimum(np.float32(MAP_RATE), 1 / long.astype(np.float32))  # all bits of a run move a place by 1 at most
        start = np.searchsorted(block, np.arange(int(block[-1]) + 2))
        refined = np.empty(len(order), np.float32)
        for i, j in zip(start.tolist(), start[1:].tolist(), strict=False):
            if i == j:
                continue
            low, high = ends[i], ends[j]
            mine, part, now, here = _rows(own, name[i:j]), x[low:high], y[low:high], which[low:high] - i
            each = _rows(mine, here)
            each *= part
            # Sums of two floats at a time, as complex numbers.
            pairs = each.view(np.complex64)
            both = pairs[:, 0] + pairs[:, 1]
            mixed = both.real + both.imag
            np.maximum(mixed, np.float32(-LIMIT), out=mixed)
            np.minimum(mixed, np.float32(LIMIT), out=mixed)
            p = np.exp(-mixed)
            p += 1
            np.reciprocal(p, out=p)
            mixed += np.float32(LIMIT)
            mixed *= np.float32((STEPS - 1) / (2 * LIMIT))
            mixed += np.float32(0.5)
            cell = mixed.astype(np.int64)
            cell += base[i:j].take(here)
            known = charts.take(cell)
            np.add(p, known, out=refined[low:high])
            np.subtract(now, p, out=p)
            for k in range(INPUTS):
                np.multiply(p, part[:, k], out=each[:, k])
            step = mine.view(np.complex64)
            for k in range(INPUTS // 2):
                step[:, k] += scale[i:j] * np.add.reduceat(pairs[:, k], first[i:j] - low)
            own.view(np.complex128)[name[i:j]] = mine.view(np.complex128)
            np.subtract(now, known, out=known)
            known *= pace[i:j].take(here)
            np.add.at(charts, cell, known)
        refined *= np.float32(0.5)
        y -= 1
        refined += y  # less 1 where the bit is 0
        logs = np.log(np.abs(refined, out=refined), out=refined)
        total += np.bincount(name // GATES, np.add.reduceat(logs.astype(np.float64), first), rows)
    return total / math.log(10)


def train(docs: DataFrame, text_col: str, counts: DataFrame, total: int) -> Model:
    """A model of all texts of docs; counts: their word counts (h, n), total: the sum."""
    spark, texts = docs.sparkSession, docs.select(text_col)

    def tally(batches):
        n = np.zeros(1 << 16, np.int64)
        plain = np.where(_SPACE, 32, _FOLDED).astype(np.int32)
        for b in text_batches(batches):
            for _, _, data, offsets in _slices(b.column(0)):
                x = np.append(plain[data], np.int32(32))
                after = x[1:].copy()
                after[offsets[1:][np.diff(offsets) > 0] - 1] = 32  # a text's end is a word's
                n += np.bincount(x[:-1] | after << 8, minlength=1 << 16)
        n[32] = n[32 << 8 : 33 << 8].sum() // 2  # a terminator alone follows every other word
        yield pa.RecordBatch.from_arrays([pa.array([_pack(n)])], names=["n"])

    pair_counts = sum((_unpack(r[0], np.int64) for r in texts.mapInArrow(tally, "n binary").toLocalIterator()), np.zeros(1 << 16, np.int64)).tolist()
    top = [(int(h), int(n)) for h, n in counts.filter("n > 1").orderBy(F.desc("n"), "h").limit(TOP).collect()]
    code = Code(top, total - sum(n for _, n in top), pair_counts, total)
    shared = Shared(spark, code)
    # As many tasks as the cluster can run, however many files there are: each sends tables.
    few = texts.coalesce(max(1, 2 * spark.sparkContext.defaultParallelism))
    found = np.zeros((code.first[""], 2), np.uint16)
    token, conf = np.zeros(1 << code.bits["run"], np.uint32), np.zeros(1 << code.bits["run"], np.uint8)
    step = (1 << code.bits["run"]) // RUN_BLOCKS
    for kind, block, a, b in merged_tables(count_tables(few, shared), shared).toLocalIterator():
        if kind:
            token[block * step : (block + 1) * step], conf[block * step : (block + 1) * step] = _unpack(a, np.uint32), _unpack(b, np.uint8)
        else:
            found[block * CELLS : (block + 1) * CELLS] = _unpack(a, np.uint16).reshape(-1, 2)
    model = Model(code, found, token, conf)
    del found
    shared.drop()
    raw = Shared(spark, model)
    tally = np.zeros(TALLIES, np.int64)
    for block, n in fit_tallies(few, raw).toLocalIterator():
        tally[block * CELLS : (block + 1) * CELLS] = _unpack(n, np.int64)
    tally = tally.reshape(-1, 2)
    cell = np.flatnonzero(tally.any(1))
    inputs = np.ones((INPUTS, len(cell)), np.float32)
    for i in range(INPUTS - 1):
        inputs[i] = cell // LEVELS ** (INPUTS - 2 - i) % LEVELS * (2 * LIMIT / (LEVELS - 1)) - LIMIT
    model.settle(*fit_mixer(inputs, cell // LEVELS ** (INPUTS - 1), tally[cell, 0], tally[cell, 1]))
    raw.drop()
    return model


# ----------------------------------------------------------------------- base scores


def word_counts(texts: DataFrame) -> DataFrame:
    """(h, n): how often each word, and the end, stands in the texts."""

    def run(batches):
        for b in text_batches(batches):
            found = [np.full(b.num_rows, END_WORD)]
            for _, _, data, offsets in text_slices(b.column(0)):
                found.append(Words(data, offsets).hashes(fold=True))
            h, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([as_long(h), pa.array(n)], names=["h", "n"])

    return texts.mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))


def score(df: DataFrame, training, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for all rows of df.

    training: the condition that training rows meet.
    """
    spark = df.sparkSession
    docs = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    learned = df.filter(training)
    counts = stage(word_counts(learned.select(text_col)), "words")
    total, distinct = (x or 0 for x in counts.agg(F.sum("n"), F.count("*")).first())
    model = train(learned, text_col, counts, total)
    below = math.log10(total + 0.5 * (distinct + 1))
    shared = Shared(spark, model)

    def scan(batches):
        model = shared.value
        code = model.code
        for b in text_batches(batches):
            chunk = secrets.randbits(62)
            rare, where, rows = [], [], [[], [], [], [], []]
            for low, _, data, offsets in _slices(b.column(1)):
                words = Words(data, offsets)
                hashes, count = words.hashes(fold=True), np.diff(words.doc)
                tokens = Tokens(data, offsets, code, words, hashes)
                hashes = np.append(hashes, np.full(len(count), END_WORD))
                row = np.append(np.repeat(np.arange(len(count)), count), np.arange(len(count)))
                at, hit = code.look(hashes)
                rare.append(hashes[~hit])
                where.append((low + row[~hit]).astype(np.int32))
                rows[0].append(count + 1)
                rows[1].append(np.bincount(row[hit], minlength=len(count)))
                rows[2].append(np.bincount(row[hit], np.log10(code.many[at[hit]] + 0.5), len(count)).astype(np.float64))  # of nothing it is integers
                rows[3].append(score_slice(tokens, model))
                rows[4].append(tokens.length)
            n = b.num_rows
            n_tokens, found, base, scored, length = (np.concatenate(x) for x in rows)
            nothing = lambda kind, k: pa.nulls(k, kind)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(n, chunk)), pa.array(np.arange(n, dtype=np.int32)), pa.array(n_tokens.astype(np.int64)), pa.array(found.astype(np.int64)), pa.array(base), pa.array(scored), pa.array(length.astype(np.int64)), nothing(pa.int64(), n), nothing(pa.binary(), n)], names=NAMES)
            h, at = np.concatenate(rare), np.concatenate(where)
            order = np.argsort(h, kind="stable")
            h, at = h[order], at[order]
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
            ends = np.append(first, len(h)).astype(np.int32) * 4
            k = len(first)
            lists = pa.Array.from_buffers(pa.binary(), k, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(at.tobytes())])
            yield pa.RecordBatch.from_arrays([nothing(b.column(0).type, k), pa.array(np.full(k, chunk)), nothing(pa.int32(), k), *(nothing(pa.int64(), k) for _ in range(2)), *(nothing(pa.float64(), k) for _ in range(2)), nothing(pa.int64(), k), as_long(h[first]), lists], names=NAMES)

    kinds = {"chunk": "bigint", "at": "int", "n_tokens": "bigint", "n_known": "bigint", "base": "double", "score": "double", "length": "bigint", "h": "bigint", "rows": "binary"}
    every = stage(docs.mapInArrow(scan, widened(docs.drop("_text").schema, kinds)), "scores")
    own = every.filter("h IS NULL").select("chunk", "_id", "at", "n_tokens", "n_known", "base", "score", "length", F.lit(0).cast("bigint").alias("n"), "rows")
    lists = every.filter("h IS NOT NULL").select("chunk", "h", "rows").join(counts, "h", "left")
    lists = lists.select("chunk", F.lit(None).cast(docs.schema["_id"].dataType).alias("_id"), F.lit(None).cast("int").alias("at"), *(F.lit(None).cast(k).alias(c) for c, k in (("n_tokens", "bigint"), ("n_known", "bigint"), ("base", "double"), ("score", "double"), ("length", "bigint"))), F.coalesce("n", F.lit(0)).alias("n"), "rows")

    def gather(batches):
        """A chunk's lists add to its rows; what is held is a number for each row."""
        held: dict[int, list[pa.RecordBatch]] = {}
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def room(chunk: int, n: int):
            base, known = sums.get(chunk, (np.zeros(0), np.zeros(0, np.int64)))
            if n > len(base):
                more = max(n, 2 * len(base)) - len(base)
                sums[chunk] = base, known = np.append(base, np.zeros(more)), np.append(known, np.zeros(more, np.int64))
            return base, known

        for b in text_batches(batches):
            chunks = b.column(0).to_numpy()
            is_list = b.column(9).is_valid().to_numpy(zero_copy_only=False)
            for chunk in np.unique(chunks[~is_list]).tolist():
                held.setdefault(chunk, []).append(b.filter(pa.array((chunks == chunk) & ~is_list)))
            for chunk in np.unique(chunks[is_list]).tolist():
                part = b.filter(pa.array((chunks == chunk) & is_list))
                lists, n = part.column(9), part.column(8).to_numpy()
                flat = np.frombuffer(b"".join(x.as_py() for x in lists), np.int32)
                sizes = np.array([len(x.as_py()) // 4 for x in lists])
                each = np.repeat(n, sizes)
                base, known = room(chunk, int(flat.max()) + 1)
                base += np.bincount(flat, np.log10(each + 0.5), len(base))
                known += np.bincount(flat, each > 0, len(known)).astype(np.int64)
        for chunk, parts in held.items():
            for part in parts:
                at = part.column(2).to_numpy()
                base, known = room(chunk, int(at.max()) + 1)
                tokens = part.column(3).to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [part.column(1), part.column(3), pa.array(part.column(4).to_numpy() + known[at]), pa.array(np.full(len(at), total)), pa.array(part.column(5).to_numpy() + base[at] - tokens * below), part.column(6), pa.array(-part.column(6).to_numpy() / math.log10(2) / part.column(7).to_numpy())],
                    names=[id_col, "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"],
                )

    met = own.unionByName(lists).repartition(partitions(spark), "chunk")
    return met.mapInArrow(gather, widened(df.select(id_col).schema, {"n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double", "bits_per_byte": "double"}))


NAMES = ["_id", "chunk", "at", "n_tokens", "n_known", "base", "score", "length", "h", "rows"]


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = score(docs, remainder("doc_id", 5) != 1)
    return found.select("doc_id", (remainder("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


QUERIES = {"op6_lm": op6_lm}
SQL: dict[str, str] = {}
