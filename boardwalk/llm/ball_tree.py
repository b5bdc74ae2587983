"""Ranked lexical search: exact inner products through trees of sparse balls.

A document is a sparse vector over the terms of the queries, of weighted term scores; a query is its term counts, so that a
score is an inner product of integers. Runs of documents become ball trees: each node has the centroid of its documents,
the radius that holds them all, and, as neither counts nor scores are negative, for each term how far its documents reach
above the centroid. No document of a node scores more than the centroid's score plus the smaller of the query's length times
the radius and its product with the reaches. Bounds are rounded up, so that nothing is cut that could still enter. Subtrees
are searched best bound first, until none is left that could; leaves are scored in integers.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boardwalk.llm.common import Scratch, giving_back, id_text, over_texts, ragged, raw
from boardwalk.llm.words import words

GAP = np.zeros(256, bool)
GAP[:128] = True
GAP[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


@dataclass(frozen=True)
class Rule:
    """``k`` documents a query. ``share`` percent of the length norm follow a document's length.

    ``leaf``, ``least``, ``shard``, ``block`` change the work only: documents of a leaf, the smaller part of a split at
    least, documents of a tree, and queries that one scan holds in memory.
    """

    k: int = 10
    share: int = 75
    leaf: int = 16
    least: float = 0.1
    shard: int = 4096
    block: int = 2_000


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms of each row: letters and digits of ASCII, and all else beyond it; only A-Z lower-cased."""
    return words(*raw(column), GAP)


def gathered(ptr: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the entries of the rows, one row after the other, and how many each has."""
    n = ptr[rows + 1] - ptr[rows]
    return np.repeat(ptr[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum()), n


def up(values: np.ndarray) -> np.ndarray:
    """Rounded up to single precision."""
    return np.nextafter(values.astype(np.float32), np.float32(np.inf))


class BallTree:
    """Over rows of positive integers: ``ptr`` their borders, ``term`` and ``value`` their entries; no row is empty."""

    def __init__(self, ptr: np.ndarray, term: np.ndarray, value: np.ndarray, leaf: int, least: float):
        self.rows = np.arange(len(ptr) - 1)
        self.low, self.high, self.kids, self.radius = [], [], [], []
        found: list[tuple[np.ndarray, ...]] = []
        stack = [(0, len(self.rows), None)]
        while stack:
            low, high, parent = stack.pop()
            node = len(self.low)
            if parent is not None:
                self.kids[parent].append(node)
            at, n = gathered(ptr, self.rows[low:high])
            first = np.cumsum(n) - n
            x = value[at].astype(np.float64)
            order = np.argsort(term[at], kind="stable")
            own = term[at][order]
            new = np.ones(len(own), bool)
            new[1:] = own[1:] != own[:-1]
            begins = np.flatnonzero(new)
            place = np.empty(len(own), np.int64)
            place[order] = np.cumsum(new) - 1
            centroid = up(np.add.reduceat(x[order], begins) / (high - low))
            reach = up(np.maximum.reduceat(x[order], begins) - centroid)
            c = centroid.astype(np.float64)
            norm = np.add.reduceat(x * x, first)
            apart = norm - 2 * np.add.reduceat(x * c[place], first) + c @ c
            self.radius.append(math.sqrt(max(apart.max(), 0.0) + 1e-10 * (norm.max() + c @ c)))
            self.low.append(low)
            self.high.append(high)
            self.kids.append([])
            found.append((own[begins], np.full(len(begins), node), centroid, np.maximum(reach, 0)))
            if high - low <= leaf or apart.max() <= 1e-9 * norm.max():
                continue

            def distances(row, x=x, place=place, first=first, n=n, norm=norm, size=len(begins)):
                point = np.zeros(size)
                mine = slice(first[row], first[row] + n[row])
                point[place[mine]] = x[mine]
                return norm - 2 * np.add.reduceat(x * point[place], first) + point @ point

            one = distances(int(apart.argmax()))
            lean = one - distances(int(one.argmax()))
            border = int(np.clip((lean < 0).sum(), max(1, least * len(lean)), len(lean) - max(1, least * len(lean))))
            self.rows[low:high] = self.rows[low:high][np.argsort(lean, kind="stable")]
            stack += [(low, low + border, node), (low + border, high, node)]
        order = np.argsort(np.concatenate([f[0] for f in found]), kind="stable")
        self.term, self.node, self.centroid, self.reach = (np.concatenate(f)[order] for f in zip(*found, strict=True))
        at, n = gathered(ptr, self.rows)
        self.ptr = np.concatenate([[0], np.cumsum(n)])
        self.terms, self.values = term[at], value[at]
        self.radius = np.array(self.radius)

    def bounds(self, wanted: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """For every node, what none of its documents scores more than."""
        begin, end = np.searchsorted(self.term, wanted), np.searchsorted(self.term, wanted, "right")
        n = end - begin
        at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
        times, node = np.repeat(counts, n), self.node[at]
        centre = np.bincount(node, self.centroid[at] * times, len(self.radius))
        above = np.bincount(node, self.reach[at] * times, len(self.radius))
        return (centre + np.minimum(math.sqrt(float(counts @ counts)) * self.radius, above)) * (1 + 1e-9) + 1

    def search(self, wanted: np.ndarray, counts: np.ndarray, query: np.ndarray, floor: int, k: int):
        """(rows, scores) of rows that score at least ``floor``, the k best among them, and how many were scored.

        ``query``: the counts by term, for the leaves.
        """
        bound = self.bounds(wanted, counts)
        heap, pending, size, seen = [(-bound[0], 0)], [], 0, 0
        rows, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while heap or pending:
            if heap and -heap[0][0] >= floor and size < 64:
                node = heapq.heappop(heap)[1]
                if self.kids[node]:
                    for kid in self.kids[node]:
                        if bound[kid] >= floor:
                            heapq.heappush(heap, (-bound[kid], kid))
                else:
                    pending.append(node)
                    size += self.high[node] - self.low[node]
                continue
            if not pending:
                break
            own = np.concatenate([np.arange(self.low[p], self.high[p]) for p in pending])
            at, n = gathered(self.ptr, own)
            got = np.add.reduceat(self.values[at] * query[self.terms[at]], np.cumsum(n) - n)
            seen, pending, size = seen + len(own), [], 0
            good = got >= floor
            if good.any():
                rows.append(own[good])
                scores.append(got[good])
                best = np.concatenate(scores)
                if len(best) >= k:
                    floor = max(floor, int(np.partition(best, len(best) - k)[len(best) - k]))
        row, score = np.concatenate(rows), np.concatenate(scores)
        keep = score >= floor
        return self.rows[row[keep]], score[keep], seen


class Queries:
    """A block of queries: sorted hashes of all their terms, and for each query its terms (places in them) and counts."""

    def __init__(self, ids: list, texts: list):
        counted: dict[int, dict[int, int]] = {}
        for i, text in zip(ids, texts, strict=True):
            own = counted.setdefault(i, {})
            for h in terms(pa.array([text], pa.string()))[0].tolist():
                own[h] = own.get(h, 0) + 1
        self.ids = sorted(i for i, own in counted.items() if own)
        self.known = np.array(sorted({h for own in counted.values() for h in own}), np.uint64)
        self.terms = [np.searchsorted(self.known, np.array(sorted(counted[i]), np.uint64)) for i in self.ids]
        self.counts = [np.array([counted[i][h] for h in sorted(counted[i])], np.int64) for i in self.ids]


def _vectors(docs: DataFrame, held) -> DataFrame:
    """Per document with a term: doc_id, n terms, and the queries' terms in it with their occurrences."""

    def work(batch):
        flat, counts = terms(batch.column("text"))
        known = held.value.known
        at = np.searchsorted(known, flat)
        at[at == len(known)] = 0
        hit = np.flatnonzero(known[at] == flat) if len(known) else np.zeros(0, np.int64)
        row = np.repeat(np.arange(len(counts)), counts)[hit]
        pair, times = np.unique(row * max(1, len(known)) + at[hit], return_counts=True)
        row, place = np.divmod(pair, max(1, len(known)))
        each = np.bincount(row, minlength=len(counts))
        return {"doc_id": batch.column("doc_id"), "n": counts, "term": ragged(place, each, pa.int32()), "tf": ragged(times, each, pa.int32())}

    return over_texts(docs, work, "doc_id long, n long, term array<int>, tf array<int>").where("n > 0")


def _held_by(vectors: DataFrame) -> DataFrame:
    """For each of the queries' terms, the number of documents that hold it; tasks add up their own first."""

    def loop(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            own = np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False))
            if len(own) > len(total):
                total, own = own, total
            total[: len(own)] += own
        place = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(total[place])], ["term", "df"])

    return vectors.select("term").mapInArrow(giving_back(loop), "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)


FOUND = "item_id long, doc_id long, score long, n_scored long"


def _searcher(held, weight, n_docs: int, n_terms: int, rule: Rule):
    def loop(batches):
        queries, w = held.value, weight.value
        dense = np.zeros(len(w), np.int64)
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), 0)] * len(queries.ids)

        def search(rows):
            ids, n, terms, tf, each = (np.concatenate(c) for c in zip(*rows, strict=True))
            norm = 100 - rule.share + (rule.share * n * n_docs) // n_terms
            value = w[terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(norm, each)))
            row = np.repeat(np.arange(len(ids)), each)[value > 0]
            terms, value = terms[value > 0], value[value > 0]
            some, each = np.unique(row, return_counts=True)
            if not len(some):
                return
            tree = BallTree(np.concatenate([[0], np.cumsum(each)]), terms, value, rule.leaf, rule.least)
            for q, (wanted, counts) in enumerate(zip(queries.terms, queries.counts, strict=True)):
                own, scores, seen = best[q]
                floor = int(scores[-1]) if len(scores) == rule.k else 1
                dense[wanted] = counts
                got, more, n_scored = tree.search(wanted, counts, dense, floor, rule.k)
                dense[wanted] = 0
                own, scores = np.concatenate([own, ids[some[got]]]), np.concatenate([scores, more])
                top = np.lexsort((own, -scores))[: rule.k]
                best[q] = own[top], scores[top], seen + n_scored

        rows, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, rule.shard):
                part = batch.slice(at, rule.shard)
                ids, n = (part.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
                flat = [part.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in (2, 3)]
                rows.append((ids, n, *flat, part.column(2).value_lengths().to_numpy(zero_copy_only=False)))
                size += len(ids)
                if size >= rule.shard:
                    search(rows)
                    rows, size = [], 0
        if rows:
            search(rows)
        for item, (ids, scores, seen) in zip(queries.ids, best, strict=True):
            if len(ids):
                columns = [np.full(len(ids), item), ids, scores, np.full(len(ids), seen)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item_id", "doc_id", "score", "n_scored"])

    return loop


def blocks(items: DataFrame, block: int, key: str, text: str):
    """The queries in blocks, by hash of their id, each broadcast with its terms."""
    rows = items.select(F.col(f"`{key}`").cast("long").alias("item_id"), F.col(f"`{text}`").cast("string").alias("text"))
    rows = rows.where("item_id is not null and text is not null").distinct()
    parts = -(-max(1, rows.count()) // block)
    for part in range(parts):
        own = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).orderBy("item_id", "text").collect()
        yield items.sparkSession.sparkContext.broadcast(Queries([r[0] for r in own], [r[1] for r in own]))


def found(docs: DataFrame, items: DataFrame, rule: Rule = Rule(), key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """What every task found best for every query, with how many documents it scored for it: ``ranked`` merges these.

    Each block of queries scans the documents once, for their vectors over the block's terms, which are written;
    the document frequencies come from them.
    """
    scratch = Scratch(docs.sparkSession, "ball-tree")
    docs = id_text(docs, key, text).where("doc_id is not null")
    total = None
    for i, held in enumerate(blocks(items, rule.block, item_key, item_text)):
        vectors = scratch.write(_vectors(docs, held), f"vectors{i}")
        n_docs, n_terms = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(held.value.known), np.int64)
        for place, n in _held_by(vectors).toLocalIterator():
            df[place] = n
        weight = docs.sparkSession.sparkContext.broadcast(weights(df, n_docs))
        part = vectors.mapInArrow(giving_back(_searcher(held, weight, n_docs, max(1, n_terms), rule)), FOUND)
        total = part if total is None else total.union(part)
    return total


def ranked(docs: DataFrame, items: DataFrame, rule: Rule = Rule(), key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The ``rule.k`` best documents of each query: item_id, rank, doc_id, score; equal scores by ascending doc_id.

    Each row with an id is a document of its own, so a repeated row may come twice; rows without an id are none. Null and
    empty texts, and texts without terms, count for nothing and are never found. The distinct texts of one item_id are
    one query; items without an id or terms have no rows. Documents that score 0 are not found. Other columns are not read.
    """
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    placed = found(docs, items, rule, key, text, item_key, item_text).withColumn("rank", F.row_number().over(order))
    return placed.where(F.col("rank") <= rule.k).select("item_id", "rank", "doc_id", "score")


RANKED_SQL = r"""
with terms as (
  select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents),
wanted as (
  select item_id, term, count(*) as times from (
    select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark) group by 1, 2),
lengths as (select doc_id, cast(count(*) as bigint) as n from terms group by 1),
whole as (select cast(count(*) as bigint) as docs, cast(sum(n) as bigint) as total from lengths),
counts as (select doc_id, term, cast(count(*) as bigint) as tf from terms
  where term in (select term from wanted) group by 1, 2),
weights as (
  select term, cast(floor(1000 * ln(cast(2 * docs + 2 as double) / cast(2 * count(*) + 1 as double))) as bigint) as w
  from counts, whole group by term, docs),
scored as (
  select item_id, doc_id, cast(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // total)))) as bigint) as score
  from wanted join counts using (term) join weights using (term) join lengths using (doc_id), whole group by 1, 2),
placed as (
  select *, row_number() over (partition by item_id order by score desc, doc_id) as place from scored where score > 0)
select item_id, cast(place as integer) as rank, doc_id, score from placed where place <= 10
"""
