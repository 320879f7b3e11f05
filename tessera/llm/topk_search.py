"""Exact top-k by integer inner product over an impact-ordered index, score at a time.

Vectors are quantised to integers. In each block of candidates the postings are kept in
segments by their quantised impact, the power-of-two class of their size. Segments are
processed in descending impact, each posting once, for all queries of a tile. After each
segment, what a candidate can still gain is bounded by the product of the query's norm and
the norm of its postings not yet processed. A candidate that cannot reach the k-th best
score proven so far is dropped, and its later postings are not read; processing stops when
no posting is left or once fewer than ``RESCORE`` of the pairs are possible members. Those
are scored exactly. The proof starts from the k-th best score among ``SAMPLE`` vectors,
which every task holds, so it does not depend on how good its own block is.

A task sees one block and one tile, both of bounded size; tiles and blocks are dealt by a
hash of the vector, so a task that runs again sees the same rows.

Vectors that are null or hold null or non-finite components take no part, as query or
candidate. A query is never its own candidate (same vec_id). Ties go to the smaller
vec_id; repeated rows are candidates of their own (held once, with their number); empty
tables give an empty result; other columns are ignored, whatever their names. Vectors of
different lengths are compared over the shorter (missing components count as 0), very
long ones included; null ids take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, materialize

BLOCK_ROWS = 4096
TILE_ROWS = 2048
#: Queries that are scored at once, and vectors that every task holds (documented bounds).
AT_ONCE = 64
SAMPLE = 512
RESCORE = 0.02


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, q: floor(scale * x) of each component; rows that take part only."""
    x = F.col("embedding")
    fine = x.isNotNull() & F.col("vec_id").isNotNull() & (F.size(x) > 0) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == F.lit(float("inf"))))
    rows = vectors.where(fine)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("q"))


class ImpactIndex:
    """Postings of one block by descending impact class."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        size = np.abs(vectors)
        level = np.zeros(vectors.shape, np.int8)
        level[size > 0] = np.floor(np.log2(size[size > 0])) + 1
        self.segments = []
        rest = (vectors.astype(np.float64) ** 2).sum(1)
        for impact in range(int(level.max(initial=0)), 0, -1):
            rows, dims = np.nonzero(level == impact)
            if len(rows):
                values = vectors[rows, dims].astype(np.float64)
                rest = rest - np.bincount(rows, values * values, len(vectors))
                self.segments.append((rows, dims, values, np.sqrt(np.maximum(rest, 0.0))))

    def search(self, queries: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, rows, exact scores) of a set that holds the query's k best rows.

        ``own`` marks the pairs that are no candidates; ``floor`` is a score that each
        query's k-th best of all reaches.
        """
        q = queries.astype(np.float64)
        norm = np.sqrt((q * q).sum(1))[:, None]
        alive = np.arange(len(self.vectors))
        scores, possible = np.zeros((len(q), len(alive))), ~own
        for number, (rows, dims, values, rest) in enumerate(self.segments, 1):
            place = np.full(len(self.vectors), -1)
            place[alive] = np.arange(len(alive))
            on = place[rows] >= 0
            segment = np.zeros((q.shape[1], len(alive)))
            segment[dims[on], place[rows[on]]] = values[on]
            scores += q @ segment
            # One more than the bound, against rounding in the roots.
            slack = norm * rest[alive][None, :] + 1.0
            proven = floor[:, None]
            if len(alive) > k:
                low = np.where(possible, scores - slack, -np.inf)
                proven = np.maximum(proven, np.partition(low, len(alive) - k, axis=1)[:, len(alive) - k][:, None])
            possible &= scores + slack >= proven
            keep = possible.any(0)
            if number == len(self.segments) or possible.sum() <= RESCORE * own.size:
                break
            if keep.mean() < 0.7:
                alive, scores, possible = alive[keep], scores[:, keep], possible[:, keep]
        for i in range(len(q)):
            rows = alive[possible[i]]
            if len(rows):
                yield i, rows, self.vectors[rows] @ queries[i]


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), np.int64)
    for i, x in enumerate(column):
        out[i, : len(x)] = x[:width]
    return out


def _floors(queries: np.ndarray, asked: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score of each query among the sample, without its own rows."""
    if len(ids) < k:
        return np.full(len(asked), -np.inf)
    score = np.where(asked[:, None] == ids[None, :], -np.inf, (queries @ vectors.T).astype(np.float64))
    return np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k]


def _searcher(k: int, held):
    def run(key: tuple, candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "vec_id", "score", "copies"]
        out = []
        if len(candidates) and len(queries):
            candidates, queries = candidates.sort_values(["vec_id", "copies"], kind="stable"), queries.sort_values("vec_id", kind="stable")
            width = int(max(candidates["q"].map(len).max(), queries["q"].map(len).max()))
            index = ImpactIndex(_matrix(candidates["q"], width))
            ids, copies, asked = candidates["vec_id"].to_numpy(), candidates["copies"].to_numpy(), queries["vec_id"].to_numpy()
            matrix, (some, vectors) = _matrix(queries["q"], width), held.value
            sample = _matrix(pd.Series(vectors), width)
            for lo in range(0, len(asked), AT_ONCE):
                part = asked[lo : lo + AT_ONCE]
                floor = _floors(matrix[lo : lo + AT_ONCE], part, some, sample, k)
                for i, rows, score in index.search(matrix[lo : lo + AT_ONCE], part[:, None] == ids[None, :], floor, k):
                    best = np.lexsort((ids[rows], -score))[:k]
                    out.append((np.full(len(best), part[i]), ids[rows][best], score[best], copies[rows][best]))
            give_back()
        if not out:
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in names})
        return pd.DataFrame({c: np.concatenate(x) for c, x in zip(names, zip(*out, strict=True), strict=True)})

    return run


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score; the queries are the rows whose id ``every`` divides."""
    spark = vectors.sparkSession
    rows = materialize(quantised(vectors, scale).groupBy("vec_id", "q").agg(F.count(F.lit(1)).alias("copies")), "quantised")
    asks = F.col("vec_id") % every == 0
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(asks.cast("long")).alias("asked")).first()
    blocks, tiles = max(1, -(-n["n"] // BLOCK_ROWS)), max(1, -(-(n["asked"] or 0) // TILE_ROWS))
    # At most SAMPLE vectors: a bounded collect and broadcast. A query's floor is a score that its k best reach.
    some = rows.orderBy(F.xxhash64("q", "vec_id"), "vec_id").limit(SAMPLE).select("vec_id", "q").collect()
    held = spark.sparkContext.broadcast((np.array([r["vec_id"] for r in some], np.int64), [r["q"] for r in some]))
    place = lambda n, seed: F.pmod(F.xxhash64("vec_id", "q", F.lit(seed)), F.lit(n)).cast("int")
    every_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = rows.select("vec_id", "q", "copies", place(blocks, 1).alias("block"), every_of(tiles).alias("tile"))
    asked = rows.where(asks).select("vec_id", "q", place(tiles, 2).alias("tile"), every_of(blocks).alias("block"))
    found = candidates.groupBy("block", "tile").cogroup(asked.groupBy("block", "tile")).applyInPandas(_searcher(k, held), "query_id long, vec_id long, score long, copies long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # A row that repeats stands as often as it comes, k times at most.
    each = found.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.least("copies", F.lit(k)))))
    ranked = each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def top_k_sql(k: int = 5, every: int = 50, scale: int = 256) -> str:
    return f"""
with v as (select vec_id, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) as q from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::bigint as score
  from v a join v b on a.vec_id % {every} = 0 and a.vec_id <> b.vec_id)
select query_id, rank::int as rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= {k}
"""
