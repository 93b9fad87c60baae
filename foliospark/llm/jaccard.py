"""Operator 2: n-gram Jaccard join by prefix filters under several global token orders.

A document's set holds its distinct shingles of SIZE words (A-Z folded; fewer words: the
whole sequence as one). Two sets link when 100 * intersection >= 80 * union. Such sets
share a token among the first n - ceil(0.8 n) + 1 of each under any one total order of
all tokens, so a candidate pair must pass that filter under every one of three orders:

* Order A puts tokens by how many sets hold them (in steps of four times, as far as scan
  tasks see a token more than once; fixed once found), then by a hash. Documents are
  posted under their prefix tokens of order A, so passages of many unrelated documents
  stay out of most postings. Which step a token has only moves cost, never results.
* Orders B and C are hash orders. Each set's prefixes under both travel in short form
  (32 bits a token); a pair of order A goes on only if it shares a token under B and one
  under C. Only pairs in the intersection of the three filters meet their sets and are verified.
* Where a posting list would make many more pairs than its members have prefix tokens, no pair
  is made from it: its key grows by the tokens of order B, and then of order C, so that the
  filters are intersected while there are still only lists.
* Before all that, a document goes on only if enough of its tokens stand in a second set:
  the first l common tokens of a linked pair stand among the first n - ceil(0.8 n) + l of
  each under order C; with l(n) = ceil(n / 5), each document reports so many and needs as
  many reported twice as its smallest partner could share.
* Where a token stands in the two sets bounds what they can share from there on; a pair
  meets at a token only if that is enough.

Equal sets are one class, and a class is one node. No pairs of a whole group are made: in
each of ROUNDS rounds a posting list meets one leader only (first the member that has the
fewest rare tokens, as the original of a group of copies has; then others); links are
contracted to components, and lists within one component are done. Lists that still hold
several make pairs between different components. Links inside a component can't change
it, so the components are exact.

Null and empty texts have no shingles and link with nothing; their component is their own
id. Rows are classes by their sets alone, so ids may repeat or be null: a component's id is
the least that one of its rows has, null if none has any. Equal rows get equal results.
Other columns aren't read, whatever their names. A text of any length is one set, held
whole by one task. Tokens are 64-bit hashes, classes are told apart by 128 bits and n.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Filter, Words, as_long, by_row, inside, mix, stage, text_batches, text_slices, widened, windows
from .components import components

SIZE = 5
PERCENT = 80
SEEDS = (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179, 0x510E527FADE682D1)
FIRST_STEP, STEP, STEPS = 6, 4, 15
ROUNDS = 2
PAIRS = 8
FLUSH = 1 << 20
U64 = np.uint64


def more_common(n):
    """l(n): how many common tokens the report of order C looks for."""
    return (n + 4) // 5


def prefix_length(n, percent: int = PERCENT):
    """Of a set of n tokens: the tokens of which a linked set must share one, under any order."""
    return n - (percent * n + 99) // 100 + 1


class Sets:
    """The shingle sets of a slice: token and row, sorted by row and then token, and the set sizes n by row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, size: int = SIZE):
        words = Words(data, offsets)
        hashes = words.hashes(fold=True)
        count = np.diff(words.doc)
        at = np.flatnonzero(inside(words.doc, size))
        token, row = [windows(hashes, size)[at]], [np.searchsorted(words.doc, at, "right") - 1]
        for k in range(1, size):
            short = np.flatnonzero(count == k)
            if len(short):
                token.append(mix(windows(hashes, k)[words.doc[short]] ^ U64(k)))
                row.append(short)
        token, row = np.concatenate(token), np.concatenate(row)
        order = by_row(row, token)
        token, row = token[order], row[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (row[1:] != row[:-1])
        self._hold(token[new], row[new], len(offsets) - 1)

    def _hold(self, token: np.ndarray, row: np.ndarray, rows: int) -> None:
        self.token, self.row = token, row
        self.n = np.bincount(row, minlength=rows)
        self.first = np.cumsum(self.n) - self.n

    def keep(self, rows: np.ndarray) -> None:
        """From now on only some rows have tokens."""
        use = rows[self.row]
        self._hold(self.token[use], self.row[use], len(self.n))

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits that equal sets share: sums of two mixed forms of their tokens."""
        out = []
        for seed in SEEDS[:2]:
            sums = np.zeros(len(self.token) + 1, U64)
            np.cumsum(mix(self.token + U64(seed)), out=sums[1:])
            out.append(mix(sums[self.first + self.n] - sums[self.first] + self.n.astype(U64)))
        return out[0], out[1]

    def prefixes(self, seed: int, length: np.ndarray, steps: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order, row, rank): of each row the first length[row] tokens under the order of seed, after that of steps."""
        key = mix(self.token ^ U64(seed))
        if steps is not None:
            key = (key >> U64(4)) + (steps.astype(U64) << U64(60))
        order = by_row(self.row, key)
        rank = np.arange(len(order)) - self.first[self.row[order]]
        use = rank < length[self.row[order]]
        order = order[use]
        return order, self.row[order], rank[use]


def _docs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))


def profile(df: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """Rows of each document (_id, n, c1, c2: size and digests of its set) and, with heavy set,
    of tokens that several sets of a batch hold (c1 the token, n in how many)."""
    docs = _docs(df, id_col, text_col)

    def often(tokens: list[np.ndarray], kind: pa.DataType) -> pa.RecordBatch:
        token, n = np.unique(np.concatenate(tokens), return_counts=True)
        token, n = token[n > 1], n[n > 1]
        return pa.RecordBatch.from_arrays([pa.nulls(len(n), kind), pa.array(n), as_long(token), as_long(token), pa.array(np.ones(len(n), bool))], names=["_id", "n", "c1", "c2", "heavy"])

    def run(batches):
        for b in text_batches(batches):
            every, held = [], 0
            for low, high, data, offsets in text_slices(b.column(1)):
                sets = Sets(data, offsets, size)
                c1, c2 = sets.digests()
                every.append(sets.token)
                held += len(sets.token)
                if held > 2 * FLUSH:
                    yield often(every, b.column(0).type)
                    every, held = [], 0
                yield pa.RecordBatch.from_arrays([b.column(0).slice(low, high - low), pa.array(sets.n), as_long(c1), as_long(c2), pa.array(np.zeros(high - low, bool))], names=["_id", "n", "c1", "c2", "heavy"])
            if every:
                yield often(every, b.column(0).type)

    return docs.mapInArrow(run, widened(docs.drop("_text").schema, {"n": "bigint", "c1": "bigint", "c2": "bigint", "heavy": "boolean"}))


def _reported(sets: Sets, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The report of order C (token, row): the prefix in which the first l(n) common tokens stand."""
    order, row, _ = sets.prefixes(SEEDS[0], prefix_length(sets.n, percent) + more_common(sets.n) - 1)
    return sets.token[order], row


def _reported_twice(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(token): what at least two documents report."""

    def run(batches):
        for b in text_batches(batches):
            found, held = [], 0
            for _, high, data, offsets in text_slices(b.column(0)):
                found.append(_reported(Sets(data, offsets, size), percent)[0])
                held += len(found[-1])
                if held > FLUSH or high == b.num_rows:
                    token, n = np.unique(np.concatenate(found), return_counts=True)
                    yield pa.RecordBatch.from_arrays([as_long(token), pa.array(np.minimum(n, 2).astype(np.int32))], names=["token", "n"])
                    found, held = [], 0

    rows = docs.select("_text").mapInArrow(run, "token bigint, n int")
    return rows.groupBy("token").agg(F.sum("n").alias("n")).filter("n > 1").select("token")


def _passing(sets: Sets, twice: Filter, percent: int) -> np.ndarray:
    """By row: whether enough of what it reports is reported twice."""
    token, row = _reported(sets, percent)
    met = np.bincount(row[twice.has(token)], minlength=len(sets.n))
    least = more_common((percent * sets.n + 99) // 100)
    return (sets.n > 0) & (met >= least)


def _steps(token: np.ndarray, ranked: list[Filter]) -> np.ndarray:
    """Of each token: in how many of the nested filters it is."""
    out, at = np.zeros(len(token), np.uint8), np.arange(len(token))
    for level in ranked:
        at = at[level.has(token[at])]
        out[at] += 1
    return out


def _lists(values: np.ndarray, count: np.ndarray) -> pa.Array:
    """Consecutive runs of values, count[i] long, as lists of ints."""
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)).astype(np.int32)), pa.array(values.view(np.int32)))


POSTED = {"token": "bigint", "c1": "bigint", "c2": "bigint", "n": "bigint", "rank": "bigint", "rare": "bigint", "whole": "binary", "pb": "array<int>", "pc": "array<int>"}


def _postings(docs: DataFrame, ranked, twice, size: int, percent: int) -> DataFrame:
    """Of the documents that pass: rows (token, c1, c2, n, rank, rare) under order A; and rows with
    whole (the sorted set as bytes), pb and pc (its prefixes under B and C, 32 bits a token)."""

    def post(batches):
        for b in text_batches(batches):
            for _, _, data, offsets in text_slices(b.column(0)):
                sets = Sets(data, offsets, size)
                rows = _passing(sets, twice.value, percent)
                if not rows.any():
                    continue
                c1, c2 = sets.digests()
                sets.keep(rows)
                length = np.where(rows, prefix_length(sets.n, percent), 0)
                steps = _steps(sets.token, ranked.value)
                rare = np.bincount(sets.row[steps == 0], minlength=len(rows))
                order, row, rank = sets.prefixes(SEEDS[1], length, steps)
                nothing = [pa.nulls(len(order), pa.binary()), *(pa.nulls(len(order), pa.list_(pa.int32())) for _ in range(2))]
                yield pa.RecordBatch.from_arrays([as_long(sets.token[order]), as_long(c1[row]), as_long(c2[row]), pa.array(sets.n[row]), pa.array(rank), pa.array(rare[row]), *nothing], names=[*POSTED])
                kept = np.flatnonzero(rows)
                bounds = np.append(sets.first, len(sets.token))
                raw = sets.token.tobytes()
                whole = pa.array([raw[8 * bounds[r] : 8 * (bounds[r] + sets.n[r])] for r in kept.tolist()], pa.binary())
                short = [_lists((mix(sets.token[sets.prefixes(seed, length)[0]] ^ U64(seed)) >> U64(32)).astype(np.uint32), length[kept]) for seed in (SEEDS[2], SEEDS[0])]
                none = pa.nulls(len(kept), pa.int64())
                yield pa.RecordBatch.from_arrays([none, as_long(c1[kept]), as_long(c2[kept]), pa.array(sets.n[kept]), none, none, whole, *short], names=[*POSTED])

    return docs.select("_text").mapInArrow(post, ", ".join(f"{k} {v}" for k, v in POSTED.items()))


def linked(x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sets, sorted, link."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _met(pairs: DataFrame, by_node: DataFrame, columns: list[str]) -> DataFrame:
    """pairs (a, b) with the columns of both nodes, in turn."""
    for side in ("a", "b"):
        pairs = pairs.join(by_node.select(F.col("node").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in columns)), side)
    return pairs.select("a", "b", *(f"{s}_{c}" for c in columns for s in "ab"))


def _in_every_filter(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that share a prefix token under orders B and C, too."""
    return _met(pairs, nodes, ["pb", "pc"]).filter(F.arrays_overlap("a_pb", "b_pb") & F.arrays_overlap("a_pc", "b_pc")).select("a", "b")


def _verified(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link."""

    def run(batches):
        for b in text_batches(batches):
            x, y = b.column(2), b.column(3)
            keep = [linked(np.frombuffer(x[i].as_buffer(), U64), np.frombuffer(y[i].as_buffer(), U64), percent) for i in range(b.num_rows)]
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return _met(pairs, nodes, ["whole"]).mapInArrow(run, "a bigint, b bigint")


def _near(a: str, b: str, percent: int):
    """Whether the sizes allow a link, and the ranks of the token: if it is the first that the two share, all that
    they share stands from there on, and 100 * shared >= percent * (sizes - shared) must be in reach."""
    n, m = F.col(f"{a}n"), F.col(f"{b}n")
    reach = F.least(n - F.col(f"{a}rank"), m - F.col(f"{b}rank"))
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (reach * (100 + percent) >= (n + m) * percent)


def _alive(known: DataFrame, percent: int) -> DataFrame:
    """The postings of lists that hold several components, without those that no size in the list leaves in reach.

    _near() at a token asks of a member of size n and rank r: (n - r) * (100 + percent) >= (n + m) * percent for
    a partner of size m; the list's least size, or the least that may link, is the easiest partner there can be.
    """
    by_token = known.groupBy("token").agg((F.min("c") != F.max("c")).alias("mixed"), F.min("n").alias("m")).filter("mixed").drop("mixed")
    easiest = F.greatest(F.col("m") * 100, F.col("n") * percent)
    return known.join(by_token, "token").filter((F.col("n") - F.col("rank")) * (100 + percent) * 100 >= (F.col("n") * 100 + easiest) * percent).drop("m")


def _across(known: DataFrame, nodes: DataFrame, percent: int) -> list[DataFrame]:
    """Pairs (a, b) between different components of each list: known has token, node, n, rank and c.

    A list makes its pairs if they are no more than PAIRS for each of its members' prefix tokens;
    else its key grows by the prefix tokens of order B, then C, and lists of the longer keys are asked again.
    """
    keys, out = ["token"], []
    for more in ("pb", "pc", None):
        by_c = known.groupBy(*keys, "c").agg(F.count("*").alias("s"), F.sum(percent_share("n", percent)).alias("p"))
        sizes = by_c.groupBy(*keys).agg(F.sum("s").alias("all"), F.sum(F.col("s") * F.col("s")).alias("own"), F.sum("p").alias("p")).filter((F.col("all") * F.col("all")) > F.col("own"))
        sizes = stage(sizes.select(*keys, ((F.col("all") * F.col("all") - F.col("own")) / 2 <= (F.col("p") * PAIRS if more else F.lit(float("inf")))).alias("direct")), "lists")
        few = known.join(sizes.filter("direct").drop("direct"), keys)
        x, y = few.alias("x"), few.alias("y")
        same = [F.col(f"x.{k}") == F.col(f"y.{k}") for k in keys]
        met = x.join(y, [*same, F.col("x.c") != F.col("y.c"), F.col("x.node") < F.col("y.node"), _near("x.", "y.", percent)])
        out.append(met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")))
        many = sizes.filter("NOT direct").drop("direct")
        if more is None or many.isEmpty():
            return out
        known = stage(known.join(many, keys).join(nodes.select("node", more), "node").select(*known.columns, F.explode(more).alias(f"t{more}")), "longer")
        keys = [*keys, f"t{more}"]
    return out


def percent_share(n: str, percent: int):
    """prefix_length of a column."""
    return F.col(n) - F.ceil(F.col(n) * percent / 100) + 1


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, percent: int = PERCENT, rounds: int = ROUNDS) -> DataFrame:
    """(id_col, n_shingles, component_id) for each row."""
    spark, docs = df.sparkSession, _docs(df, id_col, text_col)
    rows = stage(profile(df, id_col, text_col, size), "profile")
    digests = rows.filter("NOT heavy").drop("heavy")
    often = stage(rows.filter("heavy").groupBy("c1").agg(F.sum("n").alias("n")).filter(F.col("n") >= FIRST_STEP), "often")
    most = often.agg(F.max("n")).first()[0] or 0
    floors = [FIRST_STEP * STEP**k for k in range(STEPS) if FIRST_STEP * STEP**k <= most]
    ranked = spark.sparkContext.broadcast([Filter(often.filter(F.col("n") >= least), "c1") for least in floors])
    twice = spark.sparkContext.broadcast(Filter(stage(_reported_twice(docs, size, percent), "twice"), "token"))
    posted = stage(_postings(docs, ranked, twice, size, percent), "posted")

    # One node for each class of equal sets; the number is fixed by being written.
    classes = digests.filter("n > 0").groupBy("c1", "c2", "n").agg(F.min("_id").alias("least"))
    classes = stage(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    name = ["c1", "c2", "n"]
    lists = stage(posted.filter("token IS NOT NULL").drop("whole", "pb", "pc").distinct().join(classes, name).select("token", "node", "n", "rank", "rare"), "postings")
    held = posted.filter("token IS NULL").groupBy(*name).agg(*(F.first(c).alias(c) for c in ("whole", "pb", "pc")))
    nodes = stage(held.join(classes, name).select("node", "whole", "pb", "pc"), "sets")

    known = lists.withColumn("c", F.col("node"))
    tested = links = None

    def verify(pairs: DataFrame) -> None:
        nonlocal tested, links
        pairs = stage(pairs.distinct() if tested is None else pairs.distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
        new = stage(_verified(_in_every_filter(pairs, nodes), nodes, percent), "links")
        tested, links = (pairs, new) if tested is None else (tested.unionByName(pairs), links.unionByName(new))

    labels = None
    for k in range(rounds):
        # Lists that hold several components; each has a leader, another in each round.
        first = [] if k else ["rare"]
        leader = F.min(F.struct(*first, F.xxhash64("node", F.lit(k)).alias("h"), "node", "n", "c", "rank")).alias("l")
        leaders = known.groupBy("token").agg(leader, (F.min("c") != F.max("c")).alias("mixed")).filter("mixed").drop("mixed")
        led = known.join(leaders, "token").filter((F.col("c") != F.col("l.c")) & _near("", "l.", percent))
        verify(led.select(F.least("node", "l.node").alias("a"), F.greatest("node", "l.node").alias("b")))
        labels = components(links)
        known = lists.join(labels, "node", "left").select("token", "node", "n", "rank", F.coalesce("component", "node").alias("c"))
        known = stage(_alive(_alive(known, percent), percent), "mixed")
        if known.isEmpty():
            break
    else:
        pairs = _across(known, nodes, percent)
        every = pairs[0]
        for more in pairs[1:]:
            every = every.unionByName(more)
        verify(every)
        labels = components(links)

    # A component's id is the least of its classes' least ids.
    named = stage(classes.join(labels, "node", "left").withColumn("c", F.coalesce("component", "node")), "named")
    ids = named.groupBy("c").agg(F.min("least").alias("component_id"))
    by_class = named.join(ids, "c").select(*name, "component_id")
    found = digests.filter("n > 0").join(by_class, name).select("_id", "n", "component_id")
    alone = digests.filter("n = 0").select("_id", "n", F.col("_id").alias("component_id"))
    return found.unionByName(alone).select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op2_jaccard": op2_jaccard}
# All pairs of documents that share a shingle, and all that links reach; for small tables.
SQL = {
    "op2_jaccard": rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS k, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT k, s FROM (SELECT k, unnest(CASE WHEN len(w) >= {SIZE} THEN list_transform(range(1, len(w) - {SIZE - 2}), lambda i: array_to_string(w[i:i + {SIZE - 1}], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d)),
n AS (SELECT k, count(*) AS n FROM s GROUP BY k),
p AS (SELECT a.k AS x, b.k AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.k < b.k GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.k = x JOIN n b ON b.k = y WHERE 100 * c >= {PERCENT} * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(k, m) AS (SELECT k, k FROM d UNION SELECT r.k, e.y FROM r JOIN e ON r.m = e.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM d LEFT JOIN n USING (k)
  JOIN (SELECT r.k, min(t.doc_id) AS component_id FROM r JOIN d t ON t.k = r.m GROUP BY r.k) c USING (k)"""
}
