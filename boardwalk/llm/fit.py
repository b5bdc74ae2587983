"""Labelled texts for the classifiers, and the optimiser that fits them."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardwalk.llm.common import id_text, labelled_sample


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, bound: int, seen: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, label) of at most ``bound`` labelled ids, spread by hash; the sample alone is broadcast."""
    sample = labelled_sample(labels, label, bound, seen)
    return id_text(docs, key, text).join(F.broadcast(sample), "doc_id")


class Rows(NamedTuple):
    """A gradient that is zero but for the rows ``at``, each named once; of an array with more axes, rows of its last ones."""

    at: np.ndarray
    values: np.ndarray


def rows_of(array: np.ndarray, part: Rows) -> np.ndarray:
    return array.reshape(-1, *part.values.shape[1:])


def whole(gradient: np.ndarray | Rows, like: np.ndarray) -> np.ndarray:
    if not isinstance(gradient, Rows):
        return gradient
    out = np.zeros_like(like)
    rows_of(out, gradient)[gradient.at] = gradient.values
    return out


def adam(weights: dict[str, np.ndarray], gradient, batches: Iterator, rate: float) -> dict[str, np.ndarray]:
    """Adam over the batches; ``gradient(weights, batch)`` gives the gradients by name. Where one is ``Rows``, only these
    move and only their moments decay, so that a step costs what its batch touches. The given arrays stay as they are."""
    weights = {k: v.copy() for k, v in weights.items()}
    first = {k: np.zeros_like(v) for k, v in weights.items()}
    second = {k: np.zeros_like(v) for k, v in weights.items()}
    for turn, batch in enumerate(batches, 1):
        step = lambda one, two: (one / (1 - 0.9**turn)) / (np.sqrt(two / (1 - 0.999**turn)) + 1e-8)  # noqa: B023, E731
        for k, g in gradient(weights, batch).items():
            if isinstance(g, Rows):
                one, two, own = (rows_of(x[k], g) for x in (first, second, weights))
                one[g.at] = mean = 0.9 * one[g.at] + 0.1 * g.values
                two[g.at] = square = 0.999 * two[g.at] + 0.001 * g.values * g.values
                own[g.at] -= rate * step(mean, square)
            else:
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                weights[k] = weights[k] - rate * step(first[k], second[k])
    return weights


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
