"""Operator 10: exact top-k by inner product as a Voronoi kNN join.

Components become floor(256 * x), so scores are exact integers. A bounded sample of vectors
gives pivots (farthest first; the square root of the number of vectors, MOST_PIVOTS at most);
queries and data both join the cell of their nearest pivot. Summaries hold each data cell's
size and radius r_j and each query cell's size and radius u_i: a row for each pivot, whatever
the data. For a query q of cell i (pivot c_i) and a vector x of cell j at distance b from c_j:

    |q.x - c_i.c_j| <= u_i |c_j| + b (|c_i| + u_i)

* With b = r_j that gives a least score of all of cell j for all of cell i. Cells by falling
  least score, until they hold K + 1 vectors, give the query cell's threshold: K vectors other
  than q reach it.
* A vector whose upper bound lies under a query cell's threshold isn't needed there. That is
  a least distance b for each pair of cells, so a vector is replicated to those groups of
  query cells that need it, and to no other (ties are needed).
* Query cells form groups of about QUERIES_EACH queries; a larger cell is cut by a hash. What a
  group needs is counted and cut into parts of about BLOCK vectors, so neither side of a
  local join grows with the data. A part keeps K for each query, and parts meet in a ranking.

How much is pruned is up to the data: nothing where all distances are much alike, as they
are for independent random vectors of many dimensions; nearly all but a query's own cluster
where there are clusters.

Null vectors and vectors with null or non-finite components or none take no part; a null id
is no query and no candidate. Vectors of one length are searched among themselves, so a
vector of another length is nobody's candidate. A row is told from others by a number fixed
when it is staged: rows that share an id are candidates of each other, equal rows too. Ties
go to the smaller id; of rows that share it, one is as good as another. An empty table gives
no rows. Other columns aren't read, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import stage

K = 5
SCALE = 256
MOST_PIVOTS = 256
SAMPLE = 4096
QUERIES_EACH = 2048
BLOCK = 8192
SAFE = float(1 << 53)


def integers(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v array<double>): usable vectors with integral components."""
    finite = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    ok = F.col(vec_col).isNotNull() & F.col(id_col).isNotNull() & finite
    whole = F.expr(f"transform(`{vec_col}`, x -> CAST(floor(CAST(x AS DOUBLE) * {SCALE}D) AS DOUBLE))")
    return df.filter(ok & (F.size(vec_col) > 0)).select(F.col(id_col).alias("id"), whole.alias("v"))


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first pivots of a sample, the first its nearest to the mean."""
    at = int(np.argmin(((sample - sample.mean(0)) ** 2).sum(1)))
    chosen, far = [at], ((sample - sample[at]) ** 2).sum(1)
    while len(chosen) < min(count, len(sample)) and far.max() > 0:
        at = int(np.argmax(far))
        chosen.append(at)
        far = np.minimum(far, ((sample - sample[at]) ** 2).sum(1))
    return sample[chosen]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(len(column), -1)


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products: by floats while these are exact, else by Python integers, held to a long's range."""
    if not len(q) or not len(x) or np.abs(q).max() * np.abs(x).max() * q.shape[1] < SAFE:
        return (q @ x.T).astype(np.int64)
    whole = lambda m: np.array([[int(c) for c in r] for r in m.tolist()], object)
    exact = whole(q) @ whole(x).T
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _best(score: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, column) of each row's k greatest scores, ties by the earlier column, without the column own (-1: none)."""
    n = score.shape[1]
    k = min(k + 1, n)  # one more, as its own may be among them
    if np.abs(score).max(initial=0) < (1 << 62) // n:
        unique = score * n - np.arange(n)
        top = np.argpartition(-unique, k - 1, axis=1)[:, :k] if k < n else np.tile(np.arange(n), (len(score), 1))
        top = np.take_along_axis(top, np.argsort(-np.take_along_axis(unique, top, 1), axis=1), 1)
    else:
        top = np.lexsort((np.tile(np.arange(n), (len(score), 1)), ~score))[:, :k]
    query, rank = np.nonzero(top != own[:, None])
    return query, top[query, rank]


class Plan:
    """Where queries and vectors go: from pivots and the two summaries, on the driver."""

    def __init__(self, centers: np.ndarray, data: pd.DataFrame, asked: pd.DataFrame, k: int, queries_each: int = QUERIES_EACH):
        self.centers = centers
        held, radius, count, spread = (np.zeros(len(centers)) for _ in range(4))
        held[data.cell], radius[data.cell] = data.n, data.r
        count[asked.cell], spread[asked.cell] = asked.n, asked.r
        radius, spread = (x * (1 + 1e-9) + 1e-6 for x in (radius, spread))
        cells, size = np.flatnonzero(count), np.sqrt((centers**2).sum(1))
        middle = centers[cells] @ centers.T
        lean = size[cells] + spread[cells]  # what a unit of distance from the pivot is worth
        wide = spread[cells][:, None] * size
        slack = 1e-9 * (np.abs(middle) + wide + lean[:, None] * radius) + 1
        low = np.where(held > 0, middle - wide - lean[:, None] * radius - slack, -np.inf)
        order = np.argsort(-low, axis=1)
        enough = (np.cumsum(held[order], axis=1) >= k + 1).argmax(1)
        bar = np.full(len(cells), -np.inf) if held.sum() < k + 1 else low[np.arange(len(cells)), order[np.arange(len(cells)), enough]]
        # The least distance at which a vector of cell j is needed by cell i.
        with np.errstate(divide="ignore", invalid="ignore"):
            least = np.where(np.isinf(bar)[:, None], -np.inf, (bar[:, None] - middle - wide - slack) / lean[:, None])
        # Cells next to each other, by their place along the first pivot's distances, form groups.
        near = np.argsort(((centers[cells] - centers[0]) ** 2).sum(1), kind="stable")
        self.group, self.cuts, total, g = np.full(len(centers), -1), [], 0, -1
        for i in near.tolist():
            n = int(count[cells[i]])
            if g < 0 or total + n > queries_each:
                g, total = g + 1, 0
                self.cuts.append(1)
            total += n
            self.group[cells[i]] = g
            self.cuts[g] = max(self.cuts[g], -(-n // queries_each))
        self.least = np.full((g + 1, len(centers)), np.inf)
        for i, c in enumerate(cells):
            self.least[self.group[c]] = np.minimum(self.least[self.group[c]], least[i])
        self.parts: np.ndarray | None = None

    def needed(self, cell: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vector, group): which groups need which vectors."""
        return np.nonzero(apart[:, None] * (1 + 1e-9) + 1e-6 >= self.least.T[cell])


def _searched(base: DataFrame, queries, k: int, kind: str, pivots: int, sample: int, block: int, queries_each: int) -> DataFrame:
    """(query_id, rank, id, score) for vectors (id, v) of one length."""
    # The sample bounds what the driver sees.
    seen = np.array([r[0] for r in base.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").collect()], np.float64)
    centers = choose_pivots(seen, min(pivots, max(1, math.isqrt(base.count()))))
    square = (centers**2).sum(1)

    def assign(frames):
        for f in frames:
            if len(f):
                x = np.array(f.v.tolist(), np.float64).reshape(len(f), -1)
                cell = ((x**2).sum(1)[:, None] - 2 * (x @ centers.T) + square).argmin(1)
                yield pd.DataFrame({"id": f.id, "v": [r.tobytes() for r in x], "cell": cell.astype(np.int32), "apart": np.sqrt(((x - centers[cell]) ** 2).sum(1)), "asked": f.asked})

    cells = base.withColumn("asked", F.coalesce(queries(F.col("id")), F.lit(False))).mapInPandas(assign, f"id {kind}, v binary, cell int, apart double, asked boolean")
    data = stage(cells.withColumn("row", F.monotonically_increasing_id()), "cells")
    summary = lambda df: df.groupBy("cell").agg(F.count("*").alias("n"), F.max("apart").alias("r")).toPandas()
    plan = Plan(centers, summary(data), summary(data.filter("asked")), k, queries_each)

    def count(frames):
        for f in frames:
            groups, n = np.unique(plan.needed(f.cell.to_numpy(), f.apart.to_numpy())[1], return_counts=True)
            yield pd.DataFrame({"g": groups.astype(np.int32), "n": n})

    needed = data.select("cell", "apart").mapInPandas(count, "g int, n bigint").groupBy("g").agg(F.sum("n").alias("n")).toPandas()
    plan.parts = np.ones(len(plan.cuts), np.int64)
    plan.parts[needed.g] = np.maximum(1, -(-needed.n // block))
    cuts = np.array(plan.cuts, np.int64)

    def spread(row: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each entry of row so many times, numbered."""
        each = np.repeat(np.arange(len(row)), times)
        return each, np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times)

    def send_data(frames):
        for f in frames:
            at, g = plan.needed(f.cell.to_numpy(), f.apart.to_numpy())
            each, cut = spread(at, cuts[g])
            at, g = at[each], g[each]
            yield pd.DataFrame({"id": f.id.to_numpy()[at], "v": f.v.to_numpy()[at], "row": f.row.to_numpy()[at], "g": g.astype(np.int32), "cut": cut.astype(np.int32), "part": (f.h.to_numpy()[at] % plan.parts[g]).astype(np.int32)})

    def send_queries(frames):
        for f in frames:
            g = plan.group[f.cell.to_numpy()]
            each, part = spread(g, plan.parts[g])
            yield pd.DataFrame({"id": f.id.to_numpy()[each], "v": f.v.to_numpy()[each], "row": f.row.to_numpy()[each], "g": g[each].astype(np.int32), "cut": (f.h.to_numpy() % cuts[g])[each].astype(np.int32), "part": part.astype(np.int32)})

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            right = right.sort_values(["id", "row"])
            x, rows = _matrix(right.v), right.row.to_numpy()
            place = pd.Series(np.arange(len(rows)), rows)
            for low in range(0, len(left), 512):
                some = left.iloc[low : low + 512]
                score = _scores(_matrix(some.v), x)
                query, at = _best(score, place.reindex(some.row, fill_value=-1).to_numpy(), k)
                out.append(pd.DataFrame({"query_id": some.id.to_numpy()[query], "query": some.row.to_numpy()[query], "id": right.id.to_numpy()[at], "row": rows[at], "score": score[query, at]}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("query_id", "query", "id", "row", "score")})

    rows = f"id {kind}, v binary, row bigint, g int, cut int, part int"
    hashed = data.withColumn("h", F.shiftrightunsigned(F.xxhash64("row"), 1))
    left, right = hashed.filter("asked").mapInPandas(send_queries, rows), hashed.mapInPandas(send_data, rows)
    key = ["g", "cut", "part"]
    met = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(best, f"query_id {kind}, query bigint, id {kind}, row bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id", "row"))
    return met.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def search(df: DataFrame, queries, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", pivots: int = MOST_PIVOTS, sample: int = SAMPLE, block: int = BLOCK, queries_each: int = QUERIES_EACH) -> DataFrame:
    """(query_id, rank, id_col, score): for each row that the condition queries takes, its k best others."""
    spark, kind = df.sparkSession, df.schema[id_col].dataType.simpleString()
    base = integers(df, id_col, vec_col)
    found = None
    # A search for each length that occurs: one, in all but odd tables.
    for (length,) in base.select(F.size("v")).distinct().collect():
        part = _searched(base.filter(F.size("v") == length), queries, k, kind, pivots, sample, block, queries_each)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], f"query_id {kind}, rank int, {id_col} {kind}, score bigint")
    return found.select("query_id", "rank", F.col("id").alias(id_col), "score")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda i: i % 50 == 0)


QUERIES = {"op10_topk": op10_topk}
SQL = {
    "op10_topk": f"""
WITH e AS (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.n AS q, c.n AS c, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.n <> c.n AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= {K}"""
}
