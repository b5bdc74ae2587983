"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``passage`` words. Each passage is encoded from its words, by learned vectors of hashed
words, and from figures of its form; gated attention (a tanh and a sigmoid branch) gives it a weight; the weighted sum
stands for the document and is scored. Encoder, attention and score are learned together from document labels alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardwalk.llm.common import giving_back, id_text, over_texts, pieces, ragged, raw
from boardwalk.llm.fit import adam, labelled_texts, sigmoid
from boardwalk.llm.words import hashes, spans

N_FORM, N_SHAPE, N_WORDS = 13, 32, 2048
WIDTH = N_FORM + N_SHAPE


def _kinds() -> np.ndarray:
    kinds = np.full(256, 5)
    kinds[97:123], kinds[65:91], kinds[48:58], kinds[128:] = 0, 1, 2, 3
    kinds[[44, 46, 59, 58, 39, 45]] = 4
    kinds[[32, 9, 10, 11, 12, 13]] = 6
    return kinds


_KIND = _kinds()


@dataclass(frozen=True)
class Rule:
    """``bound``: labelled documents to fit on at most."""

    bound: int = 8_000
    passage: int = 64
    hidden: int = 24
    rounds: int = 16
    batch: int = 128


def passages(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The figures of every passage of each row, the number of passages, the slots of all words one after the other, and how
    many words each passage has; a row without words has one passage, of zeros and no words.

    Shares of kinds of characters, word lengths, repeats of a word, lone symbols, line ends, and a histogram of the
    hashed shapes of words (which kinds of characters they begin and end with, and their length).
    """
    data, offsets = raw(column)
    starts, ends, counts = spans(data, offsets)
    bags = np.maximum(1, -(-counts // size))
    out = np.zeros((bags.sum(), WIDTH), np.float32)
    if not len(starts):
        return out, bags, np.zeros(0, np.int32), np.zeros(len(out), np.int64)
    first_word = np.cumsum(counts) - counts
    row = np.repeat(np.arange(len(counts)), counts)
    spot = np.arange(len(starts)) - first_word[row]
    bag = (np.cumsum(bags) - bags)[row] + spot // size
    n = np.bincount(bag, minlength=len(out))
    full = np.maximum(n, 1)
    length = (ends - starts).astype(np.float64)
    kind = _KIND[data]
    sums = [np.concatenate([[0], np.cumsum(kind == k)]) for k in range(6)]
    share = np.stack([(s[ends] - s[starts]) for s in sums], axis=1)
    total = np.maximum(np.bincount(bag, length, len(out)), 1)
    add = lambda values: np.bincount(bag, values, len(out))
    for k in range(6):
        out[:, k] = add(share[:, k]) / total
    word = hashes(data, starts, ends)
    same = np.zeros(len(starts))
    same[1:] = (word[1:] == word[:-1]) & (bag[1:] == bag[:-1])
    out[:, 6] = add(same) / full
    order = np.lexsort((word, bag))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (word[order][1:] != word[order][:-1]) | (bag[order][1:] != bag[order][:-1])
    out[:, 7] = np.bincount(bag[order][fresh], minlength=len(out)) / full
    out[:, 8] = add(np.minimum(length, 40)) / full / 10
    out[:, 9] = add((share[:, 5] + share[:, 4]) == length) / full
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    gap_end = np.append(starts[1:], len(data))
    out[:, 10] = add(lines[np.maximum(gap_end, ends)] - lines[ends]) / full
    out[:, 11] = add(share[:, 5] > 0) / full
    out[:, 12] = np.log1p(n) / 5
    shape = kind[starts] * 49 + kind[ends - 1] * 7 + np.minimum(length, 6).astype(np.int64)
    slot = (shape * 2654435761 >> 7) % N_SHAPE
    out[:, N_FORM:] = np.bincount(bag * N_SHAPE + slot, minlength=len(out) * N_SHAPE).reshape(-1, N_SHAPE) / full[:, None]
    return out, bags, (word >> np.uint64(40)).astype(np.int64).astype(np.int32) % N_WORDS, n


def _forward(w: dict, x: np.ndarray, bags: np.ndarray, slots: np.ndarray, n: np.ndarray):
    first = np.cumsum(bags) - bags
    own = np.repeat(np.arange(len(bags)), bags)
    encoded = x @ w["encode"] + w["shift"]
    some = n > 0
    if len(slots):
        encoded[some] += np.add.reduceat(w["word"][slots], (np.cumsum(n) - n)[some], axis=0) / n[some, None]
    z = np.maximum(encoded, 0)
    left, gate = np.tanh(z @ w["tanh"]), sigmoid(z @ w["gate"])
    a = (left * gate) @ w["attend"]
    a = np.exp(a - np.maximum.reduceat(a, first)[own])
    a /= np.add.reduceat(a, first)[own]
    bag = np.add.reduceat(a[:, None] * z, first, axis=0)
    return z, left, gate, a, bag, own, first, sigmoid(bag @ w["score"] + w["bias"])


def _gradient(w: dict, batch) -> dict:
    x, bags, slots, n, y = batch
    z, left, gate, a, bag, own, first, p = _forward(w, x, bags, slots, n)
    d = (p - y) / len(y)
    d_bag = d[:, None] * w["score"]
    d_a = (z * d_bag[own]).sum(1)
    d_e = a * (d_a - np.add.reduceat(a * d_a, first)[own])
    d_left, d_gate = d_e[:, None] * w["attend"] * gate * (1 - left**2), d_e[:, None] * w["attend"] * left * gate * (1 - gate)
    d_z = (a[:, None] * d_bag[own] + d_left @ w["tanh"].T + d_gate @ w["gate"].T) * (z > 0)
    order = np.argsort(slots, kind="stable")
    used, begins = np.unique(slots[order], return_index=True)
    d_word = np.zeros_like(w["word"])
    if len(slots):
        d_word[used] = np.add.reduceat((d_z / np.maximum(n, 1)[:, None])[np.repeat(np.arange(len(n)), n)[order]], begins, axis=0)
    out = {"word": d_word, "encode": x.T @ d_z, "shift": d_z.sum(0), "tanh": z.T @ d_left, "gate": z.T @ d_gate, "attend": (left * gate).T @ d_e, "score": bag.T @ d, "bias": d.sum(keepdims=True)}
    return {k: v + 1e-4 * w[k] for k, v in out.items()}


@dataclass
class Model:
    weights: dict[str, np.ndarray]
    mean: np.ndarray
    spread: np.ndarray
    passage: int

    def score(self, column: pa.Array) -> np.ndarray:
        x, bags, slots, n = passages(column, self.passage)
        return _forward(self.weights, (x - self.mean) / self.spread, bags, slots, n)[-1] if len(bags) else np.zeros(0)


def fit(docs: DataFrame, labels: DataFrame, rule: Rule = Rule(), seen: Column | None = None) -> Model:
    """Fits in numpy on the passages of at most ``rule.bound`` labelled documents (``labels``: doc_id, quality 0/1).

    Where nothing is labelled, every score is one half.
    """
    size = rule.passage
    texts = labelled_texts(docs, labels, "quality", rule.bound, F.lit(True) if seen is None else seen)

    def loop(batches):
        for batch in pieces(batches):
            x, bags, slots, n = passages(batch.column("text"), size)
            words = np.add.reduceat(n, np.cumsum(bags) - bags) if len(bags) else n
            columns = [batch.column("doc_id"), batch.column("label"), ragged(x.ravel(), bags * WIDTH, pa.float32()), ragged(slots, words, pa.int32()), ragged(n.astype(np.int32), bags, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "label", "x", "slots", "n"])

    table = texts.mapInArrow(giving_back(loop), "doc_id long, label int, x array<float>, slots array<int>, n array<int>").toArrow().sort_by("doc_id")
    y = table.column("label").to_numpy().astype(np.float64)
    random = np.random.RandomState(7)
    h = rule.hidden
    weights = {"word": random.randn(N_WORDS, h) * 0.1, "encode": random.randn(WIDTH, h) / np.sqrt(WIDTH), "shift": np.zeros(h), "tanh": random.randn(h, h) / np.sqrt(h), "gate": random.randn(h, h) / np.sqrt(h), "attend": random.randn(h) / np.sqrt(h), "score": np.zeros(h), "bias": np.zeros(1)}
    if not len(y):
        return Model(weights, np.zeros(WIDTH), np.ones(WIDTH), size)
    x = table.column("x").combine_chunks()
    bags = x.value_lengths().to_numpy().astype(np.int64) // WIDTH
    x = x.flatten().to_numpy().reshape(-1, WIDTH).astype(np.float64)
    mean, spread = x.mean(0), x.std(0) + 1e-3
    x = (x - mean) / spread
    first = np.cumsum(bags) - bags
    slots, n = (table.column(c).combine_chunks().flatten().to_numpy() for c in ("slots", "n"))
    n = n.astype(np.int64)
    begin = np.cumsum(n) - n

    def batches():
        for _ in range(rule.rounds):
            order = random.permutation(len(y))
            for lo in range(0, len(y), rule.batch):
                some = order[lo : lo + rule.batch]
                rows = np.concatenate([np.arange(first[i], first[i] + bags[i]) for i in some])
                words = np.concatenate([np.arange(begin[r], begin[r] + n[r]) for r in rows])
                yield x[rows], bags[some], slots[words], n[rows], y[some]

    return Model(adam(weights, _gradient, batches(), 0.005), mean, spread, size)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, score (0 to 1, higher: better) and predicted (1 if score >= 0.5), from all passages of the whole
    text. Null and empty texts are scored as one passage of zeros. Ids may be null or repeated."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch):
        p = held.value.score(batch.column("text"))
        return {"doc_id": batch.column("doc_id"), "score": p, "predicted": (p >= 0.5).astype(np.int32)}

    return over_texts(id_text(docs, key, text), work, "doc_id long, score double, predicted int")


def accepted(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """Rows of ``docs``, all columns, with a score of at least ``limit``."""
    held, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def loop(batches):
        for batch in pieces(batches):
            yield batch.filter(pa.array(held.value.score(batch.column(place)) >= limit))

    return docs.mapInArrow(giving_back(loop), docs.schema)
