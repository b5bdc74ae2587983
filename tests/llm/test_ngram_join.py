import random
import re

import numpy as np

from boardwalk.llm import ngram_join
from boardwalk.llm.components import components
from boardwalk.llm.common import Scratch


def sets_of(pairs, k):
    out = {}
    for i, t in pairs:
        w = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    return out


def brute(pairs, rule):
    sets = sets_of(pairs, rule.k)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            shared, union = len(sets[x] & sets[y]), len(sets[x] | sets[y])
            if x < y and shared and rule.den * shared >= rule.num * union:
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [draw.choice(vocabulary) for _ in range(60)]
    out = []
    for _ in range(60):
        out.append([draw.choice(vocabulary) for _ in range(draw.choice([1, 2, 5, 9, 12, 40, 150, 400]))])
    for _ in range(120):
        row = list(draw.choice(out))
        for _ in range(draw.randint(0, 6)):
            row[draw.randrange(len(row))] = draw.choice(vocabulary)
        out.append(row + passage if draw.random() < 0.3 else row)
    return [(i * 7 % 1009, " ".join(w)) for i, w in enumerate(out)] + [(2000, None), (2001, ""), (2002, " \t\n"), (2003, "one"), (2004, "ONE")]


def test_components_equal_all_pairs(docs):
    for seed, rule in enumerate((ngram_join.Similarity(3, 90, 100, 2, 4), ngram_join.Similarity(5, 80, 100, 2, 4), ngram_join.Similarity(3, 90, 100))):
        pairs = corpus(seed)
        want = brute(pairs, rule)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(docs(pairs), rule).collect()}
        assert got == want


def test_similar_sets_share_a_signature():
    rule = ngram_join.Similarity(3, 80, 100)
    random_ = np.random.RandomState(5)
    none, every = np.zeros(1 << 14, np.uint64), np.full(1 << 14, 2**64 - 1, np.uint64)
    half = random_.randint(0, 2**63, 1 << 14).astype(np.uint64)
    for n in (9, 10, 31, 64, 127, 128, 500, 2000):
        a = np.unique(random_.randint(1, 2**63, n).astype(np.uint64))
        lost = rule.lack(len(a))
        for other in (a[lost:], np.unique(np.concatenate([a[lost // 2 :], random_.randint(1, 2**63, lost // 3).astype(np.uint64)]))):
            if len(np.intersect1d(a, other)) * 100 < 80 * len(np.union1d(a, other)):
                continue
            for common, frequent in ((none, none), (every, every), (half, half), (every, none)):
                signs = [np.concatenate([ngram_join.signatures(r, lv, rule, common, frequent) for lv in rule.levels(len(r))]) for r in (a, other)]
                assert len(np.intersect1d(*signs)), (n, len(other))


def test_null_and_repeated_ids_and_empty_tables(docs, spark):
    text = " ".join(map(str, range(30)))
    rule = ngram_join.Similarity()
    rows = ngram_join.ngram_components(docs([(None, text), (3, text), (3, text), (1, text), (9, None)]), rule).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in rows) == [(-1, -1), (1, 1), (3, 1), (3, 1), (9, 9)]
    assert ngram_join.ngram_components(docs([]), rule).count() == 0
    assert ngram_join.ngram_components(docs([(1, ""), (2, None)]), rule).count() == 2


def test_one_of_each_keeps_whole_rows(docs):
    text = " ".join(map(str, range(40)))
    given = docs([(5, text), (2, text + " more"), (7, "other words here"), (7, "other words here"), (8, None), (None, text)])
    kept = ngram_join.one_of_each(given, ngram_join.Similarity())
    assert kept.columns == given.columns
    assert sorted((r.doc_id if r.doc_id is not None else -1) for r in kept.collect()) == [-1, 2, 7, 8]


def test_components_of_a_chain_and_a_star(spark, docs):
    docs([])
    edges = [(i, i + 1) for i in range(20)] + [(100, i) for i in range(101, 140)] + [(200, 200)]
    found = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect()
    want = {i: 0 for i in range(21)} | {i: 100 for i in range(100, 140)}
    assert {r.node: r.component for r in found} == want and len(found) == len(want)


def near_copies(n, seed=1, edits=(2, 4), size=200):
    """Texts of one base with some words changed: only few link, most are on the brink."""
    draw = random.Random(seed)
    base = [f"b{i}" for i in range(size)]
    out = []
    for i in range(n):
        row = list(base)
        for _ in range(draw.randint(*edits)):
            row[draw.randrange(size)] = f"x{draw.randrange(10**9)}"
        out.append((i, " ".join(row)))
    return out


def test_near_copies_on_the_brink_equal_all_pairs(docs):
    for pairs in (near_copies(300), near_copies(120, 2, (1, 6), 60)):
        rule = ngram_join.Similarity()
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(docs(pairs), rule).collect()}
        assert got == brute(pairs, rule)


def test_pairs_verified_grow_with_the_members(docs, monkeypatch):
    sizes = {}
    plain = ngram_join.verified

    def counting(pairs, *rest):
        sizes[n] = sizes.get(n, 0) + pairs.count()
        return plain(pairs, *rest)

    monkeypatch.setattr(ngram_join, "verified", counting)
    for n in (300, 1500):
        ngram_join.ngram_components(docs(near_copies(n)), ngram_join.Similarity()).count()
    assert sizes[1500] < 10 * sizes[300]


def test_all_pairs_and_their_counts(docs):
    rule = ngram_join.Similarity(3, 80, 100, 2, 4)
    pairs = corpus(7) + [(None, "a b c d e f g h i j"), (9000, "a b c d e f g h i j")]
    sets = sets_of([p for p in pairs if p[0] is not None], rule.k)
    want = {}
    for x, one in sets.items():
        others = {frozenset(o) for y, o in sets.items() if o != one and rule.den * len(one & o) >= rule.num * len(one | o) and one & o}
        want[x] = (len(one), len(others))
    found = ngram_join.link_counts(*ngram_join.similar_pairs(docs(pairs), rule)).collect()
    assert {r.doc_id: (r.n_shingles, r.n_links) for r in found} == {x: v for x, v in want.items() if v[0]}


def test_ids_with_several_texts_do_not_depend_on_row_order(docs):
    one = " ".join(f"a{i}" for i in range(100))
    other = " ".join(f"b{i}" for i in range(150))
    rows = [(5, one), (5, other), (9, one + " more"), (7, other + " more"), (8, "x y z"), (8, one)]
    for given in (rows, rows[::-1], rows + rows):
        found = ngram_join.ngram_components(docs(given), ngram_join.Similarity()).collect()
        assert {(r.doc_id, r.component_id) for r in found} == {(5, 5), (9, 5), (7, 5), (8, 5)}


def test_many_rows_of_one_id_and_text(docs):
    text = " ".join(f"a{i}" for i in range(100))
    found = ngram_join.ngram_components(docs([(4, text)] * 500 + [(6, text + " z")] * 300), ngram_join.Similarity()).collect()
    assert {(r.doc_id, r.component_id) for r in found} == {(4, 4), (6, 4)} and len(found) == 800


def test_one_of_each_with_map_columns(spark, docs):
    docs([])
    text = " ".join(map(str, range(40)))
    rows = [(3, text, {"a": 1}, b"x"), (3, text, {"b": 2}, b"x"), (2, text + " more", None, b"x"), (9, None, {}, None)]
    given = spark.createDataFrame(rows, "doc_id long, text string, tags map<string,int>, raw binary")
    kept = ngram_join.one_of_each(given, ngram_join.Similarity())
    assert kept.schema == given.schema and sorted(r.doc_id for r in kept.collect()) == [2, 9]
