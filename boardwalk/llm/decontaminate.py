"""Benchmark decontamination: fingerprints of item-sized windows, then exact similarity.

Each item and each window of an item's length in words is a set of word shingles, weighted by how rare they are among
the items. A SimHash of 128 bits stands for it. Fingerprints within ``radius`` are found block by block: cut into eight
parts of 16 bits, two of them differ in at most ``radius // 8`` bits in some part, so looking up every value of every part
at that distance finds all. At 3 bits that is one value in a hundred, so of the items of a window's length few are
candidates. These are verified by the weighted Jaccard similarity itself.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardwalk.llm.common import giving_back, id_text, pieces, raw
from boardwalk.llm.words import mix, shingle_rows, shingles, words

_BITS = np.arange(64, dtype=np.uint64)


@dataclass(frozen=True)
class Rule:
    """``radius``: bits in which the fingerprints of a window and an item may differ. Of sets that are just similar enough
    some 19 of 128 bits differ, give or take 4, so beyond 31 there are one or two in a thousand.
    ``items_at_once``: benchmark items that one scan of the documents holds in memory; more take more scans."""

    k: int = 5
    similarity: float = 0.8
    radius: int = 31
    items_at_once: int = 5_000


WORDS, PARTS, WIDTH = 2, 8, 16


def signs(found: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each hash."""
    hashed = np.stack([mix(found ^ np.uint64(0x9E3779B97F4A7C15 * word)) for word in range(WORDS)], axis=1)
    return ((hashed[:, :, None] >> _BITS) & np.uint64(1)).astype(np.float32).reshape(len(found), -1) * 2 - 1


def packed(sums: np.ndarray) -> np.ndarray:
    """The fingerprints, ``WORDS`` numbers of 64 bits each."""
    return ((sums.reshape(len(sums), WORDS, 64) > 0).astype(np.uint64) << _BITS).sum(axis=2, dtype=np.uint64)


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def part_of(prints: np.ndarray, part: int) -> np.ndarray:
    word, shift = divmod(part * WIDTH, 64)
    return ((prints[:, word] >> np.uint64(shift)) & np.uint64((1 << WIDTH) - 1)).astype(np.uint16)


class Items:
    """A block of benchmark items: their weighted shingles, lengths in words and fingerprints by part.

    ``over_all``: for a block that is not the whole benchmark, the number of all items, and the shingles that more than
    one of all items holds, sorted, with their numbers of items. All other shingles weigh the same, known or not.
    """

    def __init__(self, ids: list, texts: list, rule: Rule, over_all: tuple | None = None):
        data, offsets = raw(pa.array([t or "" for t in texts], pa.string()))
        flat, counts = words(data, offsets)
        rows = list(shingle_rows(flat, counts, rule.k))
        keep = [i for i, row in enumerate(rows) if len(row) and ids[i] is not None]
        self.rule = rule
        self.ids = np.array([ids[i] for i in keep], np.int64)
        self.lengths = counts[keep]
        self.rows = [rows[i] for i in keep]
        known = np.concatenate(self.rows) if keep else np.zeros(0, np.uint64)
        self.known, held = np.unique(known, return_counts=True)
        n, self.shared, held = over_all or (len(keep), self.known[held > 1], held[held > 1])
        self.weights = (1 + np.log(max(1, n) / held)).astype(np.float32)
        self.unknown = np.float32(1 + np.log(max(1, n)))
        self.prints = np.array([packed((signs(r) * self.weight(r)[:, None]).sum(0)[None])[0] for r in self.rows], np.uint64).reshape(-1, WORDS)
        self.totals = np.array([self.weight(r).sum() for r in self.rows], np.float64)
        near = [0] + [sum(1 << b for b in c) for n in range(1, rule.radius // PARTS + 1) for c in combinations(range(WIDTH), n)]
        self.near = np.array(near, np.uint16)
        self.by_length = {}
        for length in np.unique(self.lengths).tolist():
            own = np.flatnonzero(self.lengths == length)
            self.by_length[length] = (own, [self._table(own, part) for part in range(PARTS)])

    def _table(self, own, part):
        """For each value of a part: which items have a part near it."""
        values = (part_of(self.prints[own], part)[:, None] ^ self.near).ravel()
        items = np.repeat(np.arange(len(own), dtype=np.int32), len(self.near))
        order = np.argsort(values, kind="stable")
        return values[order], items[order]

    def weight(self, row: np.ndarray) -> np.ndarray:
        if not len(self.shared):
            return np.full(len(row), self.unknown, np.float32)
        at = np.minimum(np.searchsorted(self.shared, row), len(self.shared) - 1)
        return np.where(self.shared[at] == row, self.weights[at], self.unknown)

    def similarity(self, item: int, window: np.ndarray) -> float:
        both = np.intersect1d(self.rows[item], window, assume_unique=True)
        shared = float(self.weight(both).sum(dtype=np.float64))
        return shared / (self.totals[item] + float(self.weight(window).sum(dtype=np.float64)) - shared)

    def looked_up(self, prints: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (window, item) of one length that some part brings together."""
        own, tables = self.by_length[length]
        found = [np.zeros(0, np.int64)]
        for part, (values, items) in enumerate(tables):
            wanted = part_of(prints, part)
            low, high = np.searchsorted(values, wanted, "left"), np.searchsorted(values, wanted, "right")
            n = high - low
            at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
            found.append(np.repeat(np.arange(len(prints)), n) * len(own) + items[at])
        pairs = np.unique(np.concatenate(found))
        return pairs // len(own), own[pairs % len(own)]

    def candidates(self, prints: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (window, item) of one length whose fingerprints differ in at most ``radius`` bits: all of them."""
        window, item = self.looked_up(prints, length)
        close = differing(prints[window], self.prints[item]) <= self.rule.radius
        return window[close], item[close]

    def matches(self, flat: np.ndarray, counts: np.ndarray):
        """(row, item, first word, words, differing bits, similarity): for each row and item the most similar window.

        Windows are item-sized, at every word. Only those that can be similar enough are fingerprinted: they hold a shingle of
        some item, and no more than their share of different shingles of no item, which weigh as much as any.
        """
        k = self.rule.k
        best: dict[tuple[int, int], tuple] = {}
        by_size: dict[int, tuple] = {}
        for length in self.by_length if len(flat) else ():
            size = min(k, length)
            if size not in by_size:
                found, runs = shingles(flat, counts, size)
                row = np.repeat(np.arange(len(counts)), runs)
                at = np.minimum(np.searchsorted(self.known, found), len(self.known) - 1)
                by_size[size] = (found, row, np.arange(len(found)) - (np.cumsum(runs) - runs)[row], self.known[at] == found, _since(found, row))
            found, row, spot, known, since = by_size[size]
            if not known.any():
                continue
            span = length - size + 1
            long_enough = counts >= length
            hits = np.flatnonzero(known & long_enough[row])
            begin = np.unique((hits[:, None] - np.arange(span)).ravel())
            begin = begin[begin >= 0]
            begin = begin[spot[begin] + length <= counts[row[begin]]]
            hit_row = np.zeros(len(found) + 1, np.int64)
            np.cumsum(known, out=hit_row[1:])
            begin = begin[hit_row[begin + span] > hit_row[begin]]
            lone = np.zeros(len(found) + 1, np.int64)
            np.cumsum(~known & (since >= span), out=lone[1:])
            begin = begin[lone[begin + span] - lone[begin] <= (1 - self.rule.similarity) * span + 1e-9]
            for lo in range(0, len(begin), 2048):
                some = begin[lo : lo + 2048]
                inside = found[some[:, None] + np.arange(span)]
                inside.sort(axis=1)
                fresh = np.ones(inside.shape, bool)
                fresh[:, 1:] = inside[:, 1:] != inside[:, :-1]
                weight = self.weight(inside.ravel()).reshape(inside.shape) * fresh
                values, back = np.unique(inside, return_inverse=True)
                prints = packed(np.einsum("ij,ijb->ib", weight, signs(values)[back.reshape(inside.shape)]))
                for w, item in zip(*self.candidates(prints, length), strict=True):
                    like = self.similarity(item, inside[w][fresh[w]])
                    r = int(row[some[w]])
                    if like >= self.rule.similarity and like > best.get((r, item), (0, 0, 0, 0.0))[3]:
                        differ = int(differing(prints[w], self.prints[item]))
                        best[r, item] = (int(spot[some[w]]), length, differ, like)
        return [(r, int(self.ids[i]), *v) for (r, i), v in sorted(best.items())]


def _since(found: np.ndarray, row: np.ndarray) -> np.ndarray:
    """For each shingle, how many places before it the same one stands in its row; beyond all places if it is the first."""
    order = np.argsort(found, kind="stable")
    again = (found[order][1:] == found[order][:-1]) & (row[order][1:] == row[order][:-1])
    out = np.full(len(found), len(found) + 1, np.int64)
    out[order[1:][again]] = (order[1:] - order[:-1])[again]
    return out


def over_all(items: DataFrame, rule: Rule) -> tuple[int, np.ndarray, np.ndarray]:
    """How many of the items have words, and the shingles that several of them hold, with how many do."""

    def loop(batches):
        for batch in pieces(batches):
            rows = [row for row in shingle_rows(*words(*raw(batch.column("text"))), rule.k) if len(row)]
            if rows:
                found, held = np.unique(np.concatenate(rows), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([None, *found.view(np.int64).tolist()], pa.int64()), pa.array([len(rows), *held.tolist()], pa.int64())], ["shingle", "n"])

    counted = items.distinct().mapInArrow(giving_back(loop), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    table = counted.where("shingle is null or n > 1").toArrow()
    total = table.filter(table.column("shingle").is_null()).column("n").to_pylist()
    table = table.filter(table.column("shingle").is_valid())
    shared = table.column("shingle").to_numpy().view(np.uint64)
    order = np.argsort(shared)
    return sum(total), shared[order], table.column("n").to_numpy()[order]


def item_blocks(items: DataFrame, rule: Rule):
    """The benchmark in blocks of about ``items_at_once`` items, one after the other, each ready for the executors.

    All texts of an item are in one block, and weights are those of the whole benchmark, so blocks change no result.
    """
    items = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null and text is not null")
    parts = -(-max(1, items.count()) // rule.items_at_once)
    weights = over_all(items, rule) if parts > 1 else None
    for part in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).distinct().orderBy("item_id", "text").collect()
        yield items.sparkSession.sparkContext.broadcast(Items([r[0] for r in rows], [r[1] for r in rows], rule, weights))


SCHEMA = "doc_id long, item_id long, first_word int, n_words int, differing_bits int, similarity double"


def leaks(docs: DataFrame, items: DataFrame, rule: Rule = Rule(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document and benchmark item that it holds: the most similar item-sized window of its whole text,
    by first word and length, how many fingerprint bits differ, and the weighted similarity (at least
    ``rule.similarity``).

    Documents are scanned once for each block of items and never shuffled. Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z
    as a-z. Null or empty texts, and items without words, match nothing; an item of fewer than ``k`` words is one
    shingle. Rows without an id are reported with a null doc_id; repeated rows are reported as often as they come.
    Several texts of one item_id count for that item. Shingle weights are of all items; those that several
    items hold are broadcast with each block.
    """
    docs = id_text(docs, key, text)
    found = None
    for block in item_blocks(items, rule):
        part = docs.mapInArrow(giving_back(_reporter(block)), SCHEMA)
        found = part if found is None else found.union(part)
    return found


def _reporter(block):
    def loop(batches):
        for batch in pieces(batches):
            ids = batch.column("doc_id").to_pylist()
            rows = {}
            for r, item, *rest in block.value.matches(*words(*raw(batch.column("text")))):
                if (r, item) not in rows or rest[3] > rows[r, item][3]:
                    rows[r, item] = rest
            columns = list(zip(*[(ids[r], item, *rest) for (r, item), rest in rows.items()], strict=True))
            if columns:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
                names = ["doc_id", "item_id", "first_word", "n_words", "differing_bits", "similarity"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return loop


def clean(docs: DataFrame, items: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """Rows of ``docs``, all columns, whose text holds no benchmark item. Null and empty texts stay."""
    place = docs.columns.index("text")

    def keeper(block):
        def loop(batches):
            for batch in pieces(batches, size=1 << 20):
                data = words(*raw(batch.column(place)))
                mask = np.ones(batch.num_rows, bool)
                mask[[r for r, *_ in block.value.matches(*data)]] = False
                yield batch.filter(pa.array(mask))

        return loop

    for block in item_blocks(items, rule):
        docs = docs.mapInArrow(giving_back(keeper(block)), docs.schema)
    return docs
