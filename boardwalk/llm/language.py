"""Language identification by rank-order profiles of character n-grams.

A profile is the list of a language's most frequent n-grams of one to three letters. A document's own most
frequent n-grams are compared to each: the distance is the sum of how far each n-gram's rank is out of place, and the
length of the profile for one that it lacks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardwalk.llm.common import Scratch, giving_back, id_text, over_texts, pieces
from boardwalk.llm.words import mix

UNDETERMINED = "und"
_TABLE: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point: its lower-case form if it is a letter, else 0."""
    if not _TABLE:
        table = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            if chr(c).isalpha():
                low = chr(c).lower()
                table[c] = ord(low) if len(low) == 1 else c
        _TABLE.append(table)
    return _TABLE[0]


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-grams, the row of each, and the number of letters of each row.

    Every run of letters is a word with a blank at both ends; n-grams are of one to three characters within it,
    the blank alone left out.
    """
    flat = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32) if texts else np.zeros(0, np.uint32)
    sizes = np.array([len(t) for t in texts], np.int64)
    row = np.repeat(np.arange(len(texts)), sizes + 1)[: len(flat)]
    code = letters()[np.minimum(flat, 0x10FFFF)].astype(np.uint64)
    blank = code == 0
    counts = np.bincount(row[~blank], minlength=len(texts)) if len(flat) else np.zeros(len(texts), np.int64)
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    keep[:-1] |= ~blank[1:]
    code, row = code[keep], row[keep]
    found, rows = [code[code > 0]], [row[code > 0]]
    for n in (2, 3):
        if len(code) < n:
            continue
        grams = code[: len(code) - n + 1].copy()
        inside = row[: len(code) - n + 1] == row[n - 1 :]
        for j in range(1, n):
            part = code[j : len(code) - n + 1 + j]
            grams = (grams << np.uint64(21)) | part
            inside &= (part > 0) | (j == n - 1)
        inside &= grams > 0
        found.append(grams[inside])
        rows.append(row[: len(code) - n + 1][inside])
    return mix(np.concatenate(found)) >> np.uint64(24), np.concatenate(rows), counts


def ranked(texts: list[str], size: int):
    """For each row its ``size`` most frequent n-grams, the most frequent first (ties by hash), and its letters."""
    grams, rows, counts = ngrams(texts)
    keys, n = np.unique((rows.astype(np.uint64) << np.uint64(40)) | grams, return_counts=True)
    owner, grams = (keys >> np.uint64(40)).astype(np.int64), keys & np.uint64((1 << 40) - 1)
    order = np.lexsort((grams, -n, owner))
    owner, grams = owner[order], grams[order]
    place = np.arange(len(owner)) - np.searchsorted(owner, owner)
    front = place < size
    return owner[front], grams[front], place[front], counts


def profiles(docs: DataFrame, learn: Column, size: int = 400, key: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """The most frequent n-grams of each language over the whole texts of all rows where ``learn`` holds.

    Counts are added up in each task, then by language and n-gram. The driver gets ``size`` rows a language. Rows
    without a language or text teach nothing.
    """
    rows = id_text(docs, key, text, F.col(f"`{lang}`").cast("string").alias("lang")).where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())

    def loop(batches):
        held: dict[str, list] = {}
        size_now = 0
        for batch in pieces(batches):
            langs = np.array(batch.column("lang").to_pylist(), object)
            texts = batch.column("text").to_pylist()
            for own in set(langs.tolist()):
                grams, n = np.unique(ngrams([texts[i] for i in np.flatnonzero(langs == own)])[0], return_counts=True)
                held.setdefault(own, []).append((grams, n))
                size_now += len(grams)
            if size_now > 1_000_000:
                held = {own: [_summed(parts)] for own, parts in held.items()}
                size_now = sum(len(parts[0][0]) for parts in held.values())
        for own, parts in held.items():
            grams, n = _summed(parts)
            names = pa.array([own], pa.string()).take(pa.array(np.zeros(len(grams), np.int32)))
            yield pa.RecordBatch.from_arrays([names, pa.array(grams.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    counted = rows.mapInArrow(giving_back(loop), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    scratch = Scratch(docs.sparkSession, "language")
    counted = scratch.write(counted, "counted")
    found = {}
    for own in sorted(r[0] for r in counted.select("lang").distinct().collect()):
        best = counted.where(F.col("lang") == own).orderBy(F.desc("n"), "gram").limit(size).select("gram").collect()
        found[own] = np.array([r[0] for r in best], np.uint64)
    scratch.drop("counted")
    return found


def _summed(parts: list) -> tuple[np.ndarray, np.ndarray]:
    keys, back = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    return keys, np.bincount(back, np.concatenate([n for _, n in parts])).astype(np.int64)


def identify(docs: DataFrame, known: dict[str, np.ndarray], size: int = 400, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, lang_pred and score: how much nearer the chosen profile is than the next, from 0 to 1.

    The distance of a document with m ranked n-grams to a profile is at most m times the profile's length. With one
    language the score is one minus the share of that; of equally near languages the first by name is taken, with score 0.
    Null texts and texts without a letter, and all texts if nothing was learned, are ``und`` with score 0.
    """
    names = sorted(known)
    grams = np.unique(np.concatenate([known[n] for n in names])) if names else np.zeros(0, np.uint64)
    ranks = np.full((len(names), len(grams) + 1), size, np.int32)
    for i, name in enumerate(names):
        ranks[i, np.searchsorted(grams, known[name])] = np.arange(len(known[name]))
    context = docs.sparkSession.sparkContext
    model = context.broadcast((names, grams, ranks))

    def work(batch):
        names, grams, ranks = model.value
        texts = batch.column("text").fill_null("").to_pylist()
        owner, found, place, counts = ranked(texts, size)
        away = np.zeros((len(names), len(texts)))
        if len(grams):
            at = np.minimum(np.searchsorted(grams, found), len(grams) - 1)
            at = np.where(grams[at] == found, at, len(grams))
            for i in range(len(names)):
                here = ranks[i, at]
                gap = np.where(here < size, np.minimum(np.abs(here - place), size), size)
                away[i] = np.bincount(owner, gap, len(texts))
        most = np.bincount(owner, minlength=len(texts)) * float(size)
        pred, score = [], []
        for j in range(len(texts)):
            if not counts[j] or not names:
                pred.append(UNDETERMINED)
                score.append(0.0)
                continue
            order = np.argsort(away[:, j], kind="stable")
            first, second = away[order[0], j], away[order[1], j] if len(names) > 1 else most[j]
            pred.append(names[order[0]])
            score.append(float((second - first) / second) if second else 0.0)
        return {"doc_id": batch.column("doc_id"), "lang_pred": pred, "score": np.array(score, np.float64)}

    return over_texts(id_text(docs, key, text), work, "doc_id long, lang_pred string, score double")
