import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from boardwalk.llm import ball_tree
from boardwalk.llm.ball_tree import Rule
from pyspark.sql import functions as F

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def cut(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(pairs, items, k=10):
    rows = [(i, cut(t)) for i, t in pairs if i is not None and cut(t)]
    n_docs, total = len(rows), sum(len(t) for _, t in rows)
    df = Counter(x for _, t in rows for x in set(t))
    queries = {}
    for i, t in set(items):
        if i is not None:
            queries.setdefault(i, Counter()).update(cut(t))
    out = []
    for item, query in queries.items():
        scored = []
        for doc, t in rows:
            tf = Counter(t)
            m = 25 + 75 * len(t) * n_docs // total
            score = sum(c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (1_000_000_000 * tf[x] // (1000 * tf[x] + 8 * m)) for x, c in query.items() if tf[x])
            if score > 0:
                scored.append((-score, doc))
        out += [(item, r, doc, -s) for r, (s, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def corpus(seed, n=300):
    draw = random.Random(seed)
    words = [f"w{int(draw.paretovariate(0.7))}" for _ in range(4000)]
    pairs = [(i * 3, " ".join(draw.choices(words, k=draw.choice([1, 3, 20, 80])))) for i in range(n)]
    pairs += [(10_000 + i, draw.choice(pairs)[1]) for i in range(n // 3)]
    items = [(i, " ".join(draw.choices(words, k=12))) for i in range(12)]
    return pairs, items


@pytest.fixture
def items(spark):
    return lambda rows: spark.createDataFrame(rows, "item_id long, text string")


def test_ranks_equal_brute_force(docs, items):
    edge = [(None, "w1 w2"), (50_001, None), (50_002, ""), (50_003, "-- !"), (50_004, "W1 W2 ÉTÉ été"), (50_005, "w1 " * 3000), (3, "w1 w1"), (3, "w1 w1")]
    more = [(None, "w1"), (90, None), (91, "..."), (92, "W1,w1;w2 été"), (92, "w1 w3"), (92, "w1 w3"), (93, "nowhere"), (94, "w1")]
    for seed, rule in enumerate((Rule(), Rule(shard=40, leaf=2), Rule(block=4, k=3))):
        pairs, asked = corpus(seed)
        pairs, asked = pairs + edge, asked + more
        got = ball_tree.ranked(docs(pairs), items(asked), rule).collect()
        assert sorted(map(tuple, got)) == brute(pairs, asked, rule.k)


def test_empty_tables(docs, items):
    assert ball_tree.ranked(docs([]), items([(1, "a")])).count() == 0
    assert ball_tree.ranked(docs([(1, "a")]), items([])).count() == 0
    assert ball_tree.ranked(docs([(1, None)]), items([(1, "a")])).count() == 0


def test_no_bound_is_below_a_score():
    draw = np.random.RandomState(3)
    n = draw.randint(1, 30, 500)
    term = np.concatenate([np.sort(draw.choice(200, k, replace=False)) for k in n])
    value = draw.randint(1, 10**10, len(term))
    tree = ball_tree.BallTree(np.concatenate([[0], np.cumsum(n)]), term, value, 4, 0.1)
    for _ in range(30):
        wanted = np.sort(draw.choice(200, 12, replace=False))
        counts = draw.randint(1, 4, 12)
        dense = np.zeros(200, np.int64)
        dense[wanted] = counts
        scores = np.add.reduceat(tree.values * dense[tree.terms], tree.ptr[:-1])
        bound = tree.bounds(wanted, counts)
        for node, (low, high) in enumerate(zip(tree.low, tree.high, strict=True)):
            assert scores[low:high].max() <= bound[node]


def test_trees_are_pruned(docs, items):
    """Topics of their own words: a query of one topic leaves the trees of the others alone."""
    draw = random.Random(1)
    pairs = [(i, " ".join(draw.choices([f"t{i % 20}x{j}" for j in range(40)], k=30))) for i in range(2000)]
    asked = [(t, " ".join(f"t{t}x{j}" for j in range(12))) for t in range(20)]
    found = ball_tree.found(docs(pairs), items(asked)).groupBy("item_id", F.spark_partition_id()).agg(F.first("n_scored").alias("n"))
    assert found.agg(F.sum("n")).first()[0] < 0.35 * 2000 * 20
    assert sorted(map(tuple, ball_tree.ranked(docs(pairs), items(asked)).collect())) == brute(pairs, asked)
