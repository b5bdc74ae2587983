"""Toxicity grades by cumulative-link ordinal regression on sparse word features.

``P(grade > j) = sigmoid(w . x - threshold_j)``: one weight a word, shared by all ordered thresholds. The labels say
toxic or not; grade 1 and above are toxic ones, told apart by how many words of the toxic vocabulary they hold.
The expected severity is the sum of ``P(grade > j)``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardwalk.llm.common import Scratch, giving_back, id_text, over_texts, pieces, ragged, raw
from boardwalk.llm.fit import adam, labelled_texts, sigmoid
from boardwalk.llm.words import hashes, spans

_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


@dataclass(frozen=True)
class Rule:
    """``bound``: labelled documents to fit on at most; ``features``: words with a weight at most; ``grades``: above 0."""

    bound: int = 20_000
    features: int = 2048
    least: int = 3
    grades: int = 3
    rounds: int = 600


@dataclass
class Model:
    words: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def linear(self, counts: np.ndarray, at: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        return np.bincount(row, self.weights[at] * (1 + np.log(counts)), minlength=rows)


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all rows without punctuation at their ends, A-Z as a-z, and the number of each row."""
    data, offsets = raw(column)
    starts, ends, counts = spans(data, offsets)
    row = np.repeat(np.arange(len(counts)), counts)
    if len(data):
        ok = _LETTER[data]
        place = np.arange(len(data))
        after = np.where(ok, place, len(data))
        after = np.minimum.accumulate(after[::-1])[::-1]
        before = np.maximum.accumulate(np.where(ok, place, -1))
        starts, ends = np.append(after, len(data))[starts], before[ends - 1] + 1
        real = starts < ends
        starts, ends, row = starts[real], ends[real], row[real]
    return hashes(data, starts, ends), np.bincount(row, minlength=len(counts))


def _vocabulary(texts: DataFrame, rule: Rule) -> np.ndarray:
    """The words that tell toxic from other documents best, by the document counts of each: at most ``features``."""

    def loop(batches):
        for batch in pieces(batches):
            found, counts = terms(batch.column("text"))
            row = np.repeat(np.arange(len(counts)), counts)
            order = np.lexsort((found, row))
            found, row = found[order], row[order]
            first = np.ones(len(found), bool)
            first[1:] = (found[1:] != found[:-1]) | (row[1:] != row[:-1])
            found, toxic = found[first], batch.column("label").to_numpy(zero_copy_only=False)[row[first]]
            keys, back = np.unique(found, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.bincount(back, toxic == 1, len(keys)).astype(np.int64)), pa.array(np.bincount(back, toxic != 1, len(keys)).astype(np.int64))], ["word", "bad", "good"])

    counted = texts.mapInArrow(giving_back(loop), "word long, bad long, good long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    all_bad, all_good = texts.agg(F.count(F.when(F.col("label") == 1, 1)), F.count(F.when(F.col("label") != 1, 1))).first()
    odds = F.log((F.col("bad") + 0.5) / (all_bad + 1.0)) - F.log((F.col("good") + 0.5) / (all_good + 1.0))
    scored = counted.where(F.col("bad") + F.col("good") >= rule.least).withColumn("z", F.abs(odds) / F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5)))
    return np.sort(np.array([r[0] for r in scored.where("z > 2").orderBy(F.desc("z"), "word").limit(rule.features).select("word").collect()], np.int64).view(np.uint64))


def _features(words: np.ndarray, found: np.ndarray, counts: np.ndarray):
    """(row, place in ``words``, count) of the known words."""
    if not len(words) or not len(found):
        return (np.zeros(0, np.int64),) * 3
    at = np.minimum(np.searchsorted(words, found), len(words) - 1)
    known = words[at] == found
    row = np.repeat(np.arange(len(counts)), counts)[known]
    keys, n = np.unique(row * len(words) + at[known], return_counts=True)
    return keys // len(words), keys % len(words), n


def fit(docs: DataFrame, labels: DataFrame, rule: Rule = Rule(), seen: Column | None = None) -> Model:
    """Fits on a sample of at most ``rule.bound`` labelled documents (``labels``: doc_id, toxic 0/1).

    Only the counts of the chosen words come to the driver. Without toxic or without other documents, nothing counts
    as toxic or as other, by a threshold alone.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    texts = scratch.write(labelled_texts(docs, labels, "toxic", rule.bound, F.lit(True) if seen is None else seen), "texts")
    words = _vocabulary(texts, rule)
    held = docs.sparkSession.sparkContext.broadcast(words)

    def loop(batches):
        for batch in pieces(batches):
            found, counts = terms(batch.column("text"))
            row, at, n = _features(held.value, found, counts)
            sizes = np.bincount(row, minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), ragged(at.astype(np.int32), sizes, pa.int32()), ragged(n.astype(np.int32), sizes, pa.int32())], ["doc_id", "label", "at", "n"])

    table = texts.mapInArrow(giving_back(loop), "doc_id long, label int, at array<int>, n array<int>").toArrow().sort_by("doc_id")
    scratch.drop("texts")
    label = table.column("label").to_numpy().astype(np.int64)
    sizes = np.array([len(x) for x in table.column("at").to_pylist()], np.int64)
    row = np.repeat(np.arange(len(label)), sizes)
    at = table.column("at").combine_chunks().flatten().to_numpy().astype(np.int64)
    x = 1 + np.log(table.column("n").combine_chunks().flatten().to_numpy().astype(np.float64))
    if not len(label) or label.min() == label.max():
        only = 40.0 if not len(label) or label.min() == 0 else -40.0
        return Model(words, np.zeros(len(words)), np.full(rule.grades, only))
    rate = (np.bincount(at, label[row], len(words)) + 0.5) / (np.bincount(at, minlength=len(words)) + 1.0)
    strength = np.bincount(row, x * (rate[at] > 0.5), len(label))
    grade = np.where(label == 1, 1, 0)
    cuts = np.quantile(strength[label == 1], np.arange(1, rule.grades) / rule.grades)
    for cut in cuts:
        grade += (label == 1) & (strength > cut)

    def gradient(w, _):
        score = np.bincount(row, w["word"][at] * x, len(label))
        edges = np.cumsum(np.concatenate([w["edge"][:1], np.exp(w["edge"][1:])]))
        above = np.concatenate([np.ones((len(label), 1)), sigmoid(score[:, None] - edges), np.zeros((len(label), 1))], axis=1)
        own, rows = np.maximum(above[np.arange(len(label)), grade] - above[np.arange(len(label)), grade + 1], 1e-9), np.arange(len(label))
        slope = above * (1 - above)
        by_score = -(slope[rows, grade] - slope[rows, grade + 1]) / own / len(label)
        by_edge = np.zeros(len(edges))
        np.add.at(by_edge, grade[grade > 0] - 1, (slope[rows, grade] / own)[grade > 0] / len(label))
        inner = grade < len(edges)
        np.add.at(by_edge, grade[inner], -(slope[rows, grade + 1] / own)[inner] / len(label))
        tail = np.cumsum(by_edge[::-1])[::-1]
        edge = np.concatenate([tail[:1], tail[1:] * np.exp(w["edge"][1:])])
        return {"word": np.bincount(at, by_score[row] * x, len(words)) + 1e-5 * w["word"], "edge": edge}

    start = {"word": np.zeros(len(words)), "edge": np.concatenate([[2.0], np.zeros(rule.grades - 1)])}
    fitted = adam(start, gradient, range(rule.rounds), 0.05)
    return Model(words, fitted["word"], np.cumsum(np.concatenate([fitted["edge"][:1], np.exp(fitted["edge"][1:])])))


def _severity(model: Model, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    found, counts = terms(column)
    row, at, n = _features(model.words, found, counts)
    above = sigmoid(model.linear(n, at, row, len(counts))[:, None] - model.thresholds)
    return above[:, 0], above.sum(axis=1)


def score(docs: DataFrame, model: Model, limit: float = 0.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, p_toxic (grade above 0), severity (expected grade) and toxic (p_toxic >= limit), from whole texts.

    Null and empty texts are scored by the thresholds alone. Ids may be null or repeated.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch):
        chance, severity = _severity(held.value, batch.column("text"))
        return {"doc_id": batch.column("doc_id"), "p_toxic": chance, "severity": severity, "toxic": chance >= limit}

    return over_texts(id_text(docs, key, text), work, "doc_id long, p_toxic double, severity double, toxic boolean")


def accepted(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """Rows of ``docs``, all columns, that are not toxic."""
    held, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def loop(batches):
        for batch in pieces(batches):
            yield batch.filter(pa.array(_severity(held.value, batch.column(place))[0] < limit))

    return docs.mapInArrow(giving_back(loop), docs.schema)
