"""Exact top-k by inner product over integer vectors, in the manner of MaxScore.

A shard of the vectors is an index: for each dimension and sign a posting list of the vectors with such a component.
The terms of a query are the postings with the sign of its own components, which alone add to a score, bounded by
the list's largest value; the rest of a query's dimensions only lower it. Terms are ordered by bound. As soon as the
bounds of the remaining terms cannot lift a vector that no earlier list holds over the k-th best score so far, they
are non-essential: no new candidates are taken from them, and candidates are probed for their other components only while
their score so far plus the bounds still to come is competitive. The k best of each shard are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def integers(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """vec_id and floor(scale * x) of each component; vectors that are null or hold null, NaN or infinite ones are out."""
    whole = F.transform(F.col(f"`{vector}`").cast("array<double>"), lambda x: F.floor(x * F.lit(float(scale))).cast("long"))
    good = F.forall(F.col(f"`{vector}`").cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(F.col(f"`{key}`").isNotNull() & F.col(f"`{vector}`").isNotNull() & good).select(F.col(f"`{key}`").cast("long").alias("vec_id"), whole.alias("v"))


class Shard:
    """The postings of one run of vectors of one length: by dimension and sign, the places and values, and bounds."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, self.values = ids, values
        self.columns = np.ascontiguousarray(values.T)
        self.high = np.maximum(values.max(0), 0)
        self.low = np.minimum(values.min(0), 0)
        self.lists: dict[tuple[int, bool], np.ndarray] = {}

    def postings(self, dim: int, positive: bool) -> np.ndarray:
        if (dim, positive) not in self.lists:
            column = self.columns[dim]
            self.lists[dim, positive] = np.flatnonzero(column > 0 if positive else column < 0)
        return self.lists[dim, positive]

    def search(self, own: int, query: np.ndarray, k: int, floor: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best vectors, more if tied, that reach ``floor``; ``own`` is not a candidate."""
        bound = np.where(query > 0, query * self.high, query * self.low)
        order = np.argsort(-bound, kind="stable")
        order = order[query[order] != 0]
        rest = np.append(np.cumsum(bound[order][::-1])[::-1], 0)
        n = len(self.ids)
        alive = np.zeros(n, bool)
        # the score of a few vectors in full is a first threshold
        some = np.argsort(-(self.columns[order[0]] * query[order[0]]), kind="stable")[: 8 * k] if len(order) else np.arange(min(n, 8 * k))
        some = some[self.ids[some] != own]
        first = _kth(self.ids[some], self.values[some] @ query, k)
        floor = first if floor is None else floor if first is None else max(first, floor)
        essential = 0
        while essential < len(order) and (floor is None or rest[essential] >= floor):
            dim = order[essential]
            alive[self.postings(dim, bool(query[dim] > 0))] = True
            essential += 1
            if alive.all():
                break
        if floor is None or floor <= 0:
            alive[:] = True
        alive[self.ids == own] = False
        at = np.flatnonzero(alive)
        score = np.zeros(len(at), np.int64)
        for i, dim in enumerate(order):
            column = self.columns[dim]
            score += (column if len(at) == n else column[at]) * query[dim]
            if floor is not None and i % 4 == 3:
                good = score + rest[i + 1] >= floor
                if not good.all():
                    at, score = at[good], score[good]
            if not len(at):
                break
        ids = self.ids[at]
        last = _kth(ids, score, k)
        keep = score >= last if last is not None else np.ones(len(ids), bool)
        return ids[keep], score[keep]


def _kth(ids: np.ndarray, score: np.ndarray, k: int) -> int | None:
    """The k-th highest score over distinct ids and scores, or None if there are fewer."""
    if len(ids) < k:
        return None
    pairs = np.unique(np.stack([score, ids]), axis=1)
    return int(pairs[0, -k]) if pairs.shape[1] >= k else None


def _best(ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.unique(np.stack([-score, ids]), axis=1)[:, :k]
    return pairs[1], -pairs[0]


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, block: int = 8192, shard: int = 16384, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` highest integer inner products of each query row: query_id, rank, vec_id, score; ties to the smaller id.

    Queries are the rows whose id is divisible by ``every``, in blocks of about ``block``, each broadcast and held
    against all rows in one scan; a task holds ``shard`` vectors at a time. A query's own id is no candidate. Rows that
    repeat an id and score count once; of several vectors with one query id, the smallest is the query. Vectors of
    another length than the query's are no candidates. Null ids, null vectors and vectors with null or non-finite components
    take no part; with no candidates a query has no rows.
    """
    rows = integers(vectors, key, vector, scale)
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    parts = -(-max(1, queries.count()) // block)
    found = None
    for part in range(parts):
        own = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == part).collect()
        held = rows.sparkSession.sparkContext.broadcast([(r[0], np.array(r[1], np.int64)) for r in own])
        some = rows.mapInArrow(_searcher(held, k, shard), "query_id long, vec_id long, score long")
        found = some if found is None else found.union(some)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _searcher(held, k: int, shard: int):
    def search(ids, vectors, best):
        lengths = np.array([len(v) for v in vectors])
        for length in np.unique(lengths).tolist():
            own = np.flatnonzero(lengths == length)
            values = np.array([vectors[i] for i in own], np.int64).reshape(len(own), length)
            index = Shard(ids[own], values)
            for q, query in held.value:
                if len(query) == length:
                    before = best.get(q)
                    floor = int(before[1][k - 1]) if before is not None and len(before[1]) >= k else None
                    got = index.search(q, query, k, floor)
                    if before is not None:
                        got = tuple(map(np.concatenate, zip(before, got, strict=True)))
                    best[q] = _best(*got, k)

    def loop(batches):
        ids, vectors, best = [], [], {}
        for batch in batches:
            ids += batch.column("vec_id").to_pylist()
            flat = batch.column("v")
            offsets = flat.offsets.to_numpy()
            data = flat.values.to_numpy(zero_copy_only=False)
            vectors += [data[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            if len(ids) >= shard:
                search(np.array(ids, np.int64), vectors, best)
                ids, vectors = [], []
        if ids:
            search(np.array(ids, np.int64), vectors, best)
        out = [(q, i, s) for q, (found, score) in best.items() for i, s in zip(found.tolist(), score.tolist(), strict=True)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["query_id", "vec_id", "score"])

    return loop


TOP_K_SQL = """
with whole as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
scored as (
  select distinct q.vec_id as query_id, c.vec_id,
    cast(list_sum(list_transform(list_zip(q.v, c.v), lambda x: x[1] * x[2])) as bigint) as score
  from whole q join whole c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 50 = 0),
placed as (select *, row_number() over (partition by query_id order by score desc, vec_id) as place from scored)
select query_id, cast(place as integer) as rank, vec_id, score from placed where place <= 5
"""
