import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from boardwalk.llm import attention_lm, fit, quality, toxicity
from boardwalk.llm.common import remainder
from boardwalk.llm.queries import REGISTRY

FOLDER = "/root/testdata/sf0.01"
PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def test_toxic_documents_are_found(spark):
    scored = REGISTRY["op6_toxicity"](spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    rows = scored.join(labels, "doc_id").groupBy("label", "toxic").count().collect()
    n = {(r.label, r.toxic): r["count"] for r in rows}
    assert n.get((0, True), 0) <= 5 and n[1, True] >= 0.95 * (n[1, True] + n.get((1, False), 0))


def test_toxic_documents_held_out_of_the_fit_are_found(spark):
    """A third of the labelled documents, by their id, is left out of the fit; the others alone are scored."""
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    seen = remainder("doc_id", 3) != 1
    scored = toxicity.score(docs.where(~seen), toxicity.fit(docs, labels, seen=seen))
    rows = scored.join(labels.select("doc_id", F.col("toxic").alias("label")), "doc_id").groupBy("label", "toxic").count().collect()
    n = {(r.label, r.toxic): r["count"] for r in rows}
    # Some labelled toxic have no word that any other toxic document has: 128 of 144 are found, and 1 of 1,200 others.
    assert n.get((0, True), 0) <= 3 and n[1, True] >= 0.85 * (n[1, True] + n.get((1, False), 0)) and n[1, True] > 100


def test_severity_by_hand(docs):
    """The cumulative link written out: grades' chances, their sum, and the expected grade."""
    words = np.sort(np.concatenate([toxicity.terms(pa.array([w]))[0] for w in ("foul", "vile", "nice")]))
    weights, thresholds = np.array([0.7, -0.4, 1.1]), np.array([0.5, 1.0, 2.5])
    model = toxicity.Model(words, weights, thresholds)
    texts = [(1, "foul foul vile x"), (2, "Nice"), (3, None), (4, ""), (5, "nice foul " * 50)]
    for r in toxicity.score(docs(texts), model).collect():
        found = Counter(toxicity.terms(pa.array([dict(texts)[r.doc_id] or ""]))[0].tolist())
        linear = sum(weights[i] * (1 + np.log(found[int(w)])) for i, w in enumerate(words) if int(w) in found)
        above = [1 / (1 + np.exp(t - linear)) for t in thresholds]
        chances = -np.diff([1, *above, 0])
        assert chances.min() >= 0 and chances.sum() == pytest.approx(1)
        assert r.p_toxic == pytest.approx(above[0]) and r.severity == pytest.approx(sum(g * c for g, c in enumerate(chances)))
        assert r.toxic == (above[0] >= 0.5)


def test_severity_grows_with_toxic_words(docs, spark):
    clean = [(i, f"plain text number {i} of many words") for i in range(200)]
    bad = [(1000 + i, "plain text " + "foul " * (1 + i % 5) + f"word {i}") for i in range(60)]
    table = docs(clean + bad)
    labels = spark.createDataFrame([(i, int(i >= 1000)) for i, _ in clean + bad] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(table, labels)
    assert np.all(np.diff(model.thresholds) > 0)
    got = {r.doc_id: r for r in toxicity.score(docs([(1, "some foul text"), (2, "foul foul foul foul foul"), (3, None), (4, "fine"), (5, "")]), model).collect()}
    assert got[2].severity > got[1].severity > got[4].severity and got[1].toxic and not (got[3].toxic or got[4].toxic or got[5].toxic)
    assert {r.doc_id for r in toxicity.accepted(table, model).collect()} == {i for i, _ in clean}
    nothing = toxicity.fit(table, labels.limit(0))
    assert not any(r.toxic for r in toxicity.score(table, nothing).collect())


def test_quality_of_held_out_documents(spark):
    rows = REGISTRY["op7_quality"](spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.98
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


def attention_by_hand(w, x, bags, slots, n):
    """The score of each bag, passage by passage and without any array work over passages."""
    out, at, word = [], 0, 0
    for size in bags:
        z, a = [], []
        for j in range(at, at + size):
            encoded = x[j] @ w["encode"] + w["shift"]
            for slot in slots[word : word + n[j]]:
                encoded = encoded + w["word"][slot] / n[j]
            word += n[j]
            z.append(np.maximum(encoded, 0))
            a.append((np.tanh(z[-1] @ w["tanh"]) / (1 + np.exp(-(z[-1] @ w["gate"])))) @ w["attend"])
        at += size
        share = np.exp(a) / np.sum(np.exp(a))
        out.append(1 / (1 + np.exp(-(sum(s * v for s, v in zip(share, z, strict=True)) @ w["score"] + w["bias"][0]))))
    return out


def small_bags():
    random = np.random.RandomState(0)
    h = 4
    w = {"word": random.randn(quality.N_WORDS, h), "encode": random.randn(quality.WIDTH, h) * 0.3, "shift": random.randn(h) * 0.1 + 0.5, "tanh": random.randn(h, h), "gate": random.randn(h, h), "attend": random.randn(h), "score": random.randn(h), "bias": np.zeros(1)}
    n = np.array([3, 0, 2, 1, 4, 0, 2])
    return w, (random.randn(7, quality.WIDTH), np.array([3, 1, 3]), random.randint(0, 5, n.sum()).astype(np.int32), n)


def test_attention_scores_by_hand():
    w, given = small_bags()
    assert np.allclose(quality._forward(w, *given)[-1], attention_by_hand(w, *given))


def test_attention_gradient():
    w, given = small_bags()
    y = np.array([1.0, 0.0, 1.0])

    def loss(w):
        p = quality._forward(w, *given)[-1]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)) + 5e-5 * sum((v**2).sum() for v in w.values())

    gradient = quality._gradient(w, (*given, y))
    for name, value in w.items():
        at = (int(given[2][0]), 0) if name == "word" else tuple(0 for _ in value.shape)
        up, down = {k: v.copy() for k, v in w.items()}, {k: v.copy() for k, v in w.items()}
        up[name][at] += 1e-5
        down[name][at] -= 1e-5
        assert gradient[name][at] == pytest.approx((loss(up) - loss(down)) / 2e-5, abs=1e-5)


def test_scores_of_the_query_by_hand(docs, spark):
    """Whole documents through the query's path against passages cut and encoded one by one."""
    texts = [(i, " ".join(f"w{(i * j) % 97}" for j in range(5 + 40 * i))) for i in range(12)]
    model = quality.fit(docs(texts), spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int"))
    got = {r.doc_id: r.score for r in quality.score(docs(texts), model).collect()}
    for i, text in texts:
        words = text.split()
        cut = [" ".join(words[j : j + model.passage]) for j in range(0, len(words), model.passage)]
        parts = [quality.passages(pa.array([c]), model.passage) for c in cut]
        x = (quality.passages(pa.array([text]), model.passage)[0] - model.mean) / model.spread
        slots, n = np.concatenate([p[2] for p in parts]), np.array([len(c.split()) for c in cut])
        assert got[i] == pytest.approx(attention_by_hand(model.weights, x, [len(cut)], slots, n)[0])


def test_quality_of_odd_texts(docs, spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    table = docs([(i, "good words of prose, all fine." if i % 2 else "BAD!! BAD!! BAD!!") for i in range(40)])
    model = quality.fit(table, labels)
    got = quality.score(docs([(1, None), (2, ""), (None, "x"), (4, "BAD!! " * 30_000), (5, "good words of prose, all fine.")]), model).collect()
    assert all(0 <= r.score <= 1 for r in got) and len(got) == 5
    by = {r.doc_id: r.predicted for r in got}
    assert by[4] == 0 and by[5] == 1
    assert quality.score(docs([(1, "a")]), quality.fit(table, labels.limit(0))).first().score == 0.5


def words_of(text):
    return re.findall(r"[^ \t-\r]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")) + ["\n"]


def test_language_model_counts_and_base(docs):
    texts = [(i, f"the Cat {i % 3} sat on word{i % 11} the mat") for i in range(60)] + [(100, None), (101, ""), (102, "unseen thing " * 300), (103, "É é")]
    rule = attention_lm.Rule(steps=20, listed=8)
    rows = {r.doc_id: r for r in attention_lm.score(docs(texts), remainder("doc_id", 10) != 0, PATH, PATTERN, rule).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in texts}
    c = Counter(w for i, t in texts if not held[i] for w in words_of(t))
    n, v = sum(c.values()), len(c)
    assert len(rows) == len(texts)
    for i, t in texts:
        own = words_of(t)
        assert (rows[i].n_tokens, rows[i].n_known, rows[i].train_tokens) == (len(own), sum(c[w] > 0 for w in own), n)
        assert rows[i].base_score == pytest.approx(sum(np.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own))
        assert rows[i].score < 0


def test_the_network_scores_each_token_once_and_sums_to_one():
    rule = attention_lm.Rule(classes=5, window=8, fresh=5, width=4, inner=6)
    start = attention_lm.Network.start(np.full(5, 0.2), rule)
    net = attention_lm.Network({k: v + 0.3 * np.random.RandomState(1).randn(*v.shape) for k, v in start.items()}, rule)
    random = np.random.RandomState(2)
    counts = np.array([1, 13, 5, 6])
    flat = random.randint(0, 5, counts.sum())
    _, _, real, row = net.windows(flat, counts)
    assert np.bincount(row, real[:, 3:].sum(1)).astype(int).tolist() == counts.tolist()
    prefix = flat[1:13]
    total = sum(10 ** net.score(np.append(prefix, x), np.array([13]))[0] for x in range(5))
    assert total == pytest.approx(10 ** net.score(prefix, np.array([12]))[0], rel=1e-3)
    assert net.score(flat, counts).sum() == pytest.approx(sum(net.score(p, np.array([len(p)]))[0] for p in np.split(flat, np.cumsum(counts)[:-1])), rel=1e-4)


def test_network_gradient():
    rule = attention_lm.Rule(classes=4, window=6, fresh=4, width=3, inner=4)
    random = np.random.RandomState(3)
    w = {k: (v + 0.2 * random.randn(*v.shape)).astype(np.float64) for k, v in attention_lm.Network.start(np.full(4, 0.25), rule).items()}
    net = attention_lm.Network(w, rule)
    ids, target, real, _ = net.windows(random.randint(0, 4, 20), np.array([7, 13]))

    def loss(w):
        f = attention_lm.Network.forward(w, ids, 5)[-1]
        z = f @ w["out"] + w["bias"]
        z -= np.log(np.exp(z).sum(2, keepdims=True))
        return -(np.take_along_axis(z, target[:, :, None], 2)[:, :, 0] * real).sum() / real.sum()

    gradient = attention_lm.Network.gradient(w, (ids, target, real), rule)
    for name in w:
        at = tuple(s // 2 for s in w[name].shape)
        up, down = {k: v.copy() for k, v in w.items()}, {k: v.copy() for k, v in w.items()}
        up[name][at] += 1e-4
        down[name][at] -= 1e-4
        assert gradient[name][at] == pytest.approx((loss(up) - loss(down)) / 2e-4, abs=2e-3)


def test_the_network_learns_from_all_training_texts(docs):
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0][:2]
    texts = {i: "red blue " * 40 for i in range(400)} | {held[0]: "red blue " * 30, held[1]: "red " * 30 + "blue " * 30}
    rule = attention_lm.Rule(steps=0, sample=1, batch=2, task_words=2000)
    rows = {r.doc_id: r.score for r in attention_lm.score(docs(list(texts.items())), remainder("doc_id", 10) != 0, PATH, PATTERN, rule).collect()}
    assert rows[held[0]] > rows[held[1]] + 0.1


def small_subwords():
    rule = attention_lm.Rule(classes=6, window=8, fresh=5, width=4, inner=6)
    counts = np.array([3, 0, 9, 5, 1, 7, 2, 2, 0, 4, 1, 6])
    layout = attention_lm.Layout(counts, rule)
    random = np.random.RandomState(4)
    w = {k: v + (0.3 * random.randn(*v.shape) if k != "leaf_bias" else 0) for k, v in attention_lm.Subwords.begin(counts, layout, rule).items()}
    return attention_lm.Subwords(w, layout, rule), {k: v.astype(np.float64) for k, v in w.items()}


def test_every_subword_is_scored_and_context():
    net, _ = small_subwords()
    prefix = np.array([2, 1, 8, 0, 11, 4, 10, 7, 3])
    total = sum(10 ** net.score(np.append(prefix, x), np.array([10]))[0] for x in range(12))
    assert total == pytest.approx(10 ** net.score(prefix, np.array([9]))[0], rel=1e-3)
    of = lambda before: net.score(np.array([before, 2]), np.array([2]))[0] - net.score(np.array([before]), np.array([1]))[0]
    assert len({round(of(x), 6) for x in range(12)}) == 12
    flat, counts = np.concatenate([prefix, prefix[:4]]), np.array([9, 4])
    assert net.score(flat, counts) == pytest.approx([net.score(prefix, np.array([9]))[0], net.score(prefix[:4], np.array([4]))[0]], rel=1e-4)


def test_subword_gradient():
    net, w = small_subwords()
    batch = net.windows(np.random.RandomState(5).randint(0, 12, 30), np.array([11, 19]))[:3]

    def loss(w):
        ids, target, real = batch
        f, layout = attention_lm.Network.forward(w, ids, 13)[-1], net.layout
        z = f @ w["out"] + w["bias"]
        total = np.take_along_axis(z, layout.kind[target][:, :, None], 2)[:, :, 0] - np.log(np.exp(z).sum(2))
        for at in np.argwhere(layout.kind[target] >= layout.singles):
            c = layout.kind[target[tuple(at)]] - layout.singles
            z = w["leaf"][c] @ f[tuple(at)] + w["leaf_bias"][c]
            total[tuple(at)] += z[layout.leaf[target[tuple(at)]]] - np.log(np.exp(z).sum())
        return -(total * real).sum() / real.sum()

    gradient = attention_lm.Subwords.slope(w, batch, net.rule, net.layout)
    for name in w:
        at = tuple(s // 2 for s in w[name].shape)
        up, down = {k: v.copy() for k, v in w.items()}, {k: v.copy() for k, v in w.items()}
        up[name][at] += 1e-4
        down[name][at] -= 1e-4
        assert gradient[name][at] == pytest.approx((loss(up) - loss(down)) / 2e-4, abs=2e-3)


def test_pipeline_equals_its_stages_by_hand(spark, docs):
    from boardwalk.llm import decontaminate, ngram_join

    docs([])
    before = spark.read.parquet(f"{FOLDER}/documents.parquet")
    toxic = corpus_pipeline.toxicity_stage(spark, before, FOLDER)
    assert toxic.columns == before.columns
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    good = toxic.join(labels.where("toxic = 0 and quality = 1").select("doc_id"), "doc_id", "leftsemi").count()
    assert good >= 0.97 * labels.where("toxic = 0 and quality = 1").count()
    second = corpus_pipeline.quality_stage(spark, toxic, FOLDER)
    third = corpus_pipeline.near_copies_stage(spark, second, FOLDER)
    found = ngram_join.ngram_components(second, ngram_join.Similarity(5, 80, 100))
    assert {r.doc_id for r in third.collect()} == {r.component_id for r in found.collect()}
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    leaked = {r.doc_id for r in decontaminate.leaks(third, items).collect()}
    fourth = corpus_pipeline.decontamination_stage(spark, third, FOLDER)
    assert {r.doc_id for r in fourth.collect()} == {r.doc_id for r in third.collect()} - leaked
    last = corpus_pipeline.encoding_stage(spark, fourth, FOLDER).collect()
    assert sorted(r.doc_id for r in last) == sorted(r.doc_id for r in fourth.collect())


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_every_row_of_the_table_is_there(spark, name):
    table = {"op5_chat": "conversations", "op10_top_k": "embeddings"}.get(name, "documents")
    got = REGISTRY[name](spark, "/root/testdata/sf0.001")
    if name in ("op1_ngram_join", "op3_token_counts", "op4_language", "op6_toxicity", "op7_quality", "op8_attention_lm", "op9_byte_bpe"):
        assert got.count() == spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").count()
    else:
        assert got.count() > 0


def test_class_shares_of_a_batch_are_never_held_at_once():
    """The softmax goes by rows that fit the cache; the gradients are those of the whole batch, padding left out."""
    random = np.random.RandomState(4)
    w = {"out": random.randn(16, 256).astype(np.float32), "bias": random.randn(256).astype(np.float32)}
    f, target, counted = random.randn(96, 64, 16).astype(np.float32), random.randint(0, 256, (96, 64)), random.rand(96, 64) < 0.9
    tracemalloc.start()
    out, df = attention_lm.Network.head(w, f, target, counted)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < f.shape[0] * f.shape[1] * 256 * 4
    z = f.astype(np.float64) @ w["out"] + w["bias"]
    p = np.exp(z - z.max(2, keepdims=True))
    p = (p / p.sum(2, keepdims=True) - np.eye(256)[target]) * counted[:, :, None] / counted.sum()
    assert np.allclose(df, p @ w["out"].T, atol=1e-6) and np.allclose(out["bias"], p.sum((0, 1)), atol=1e-6)
    assert np.allclose(out["out"], np.einsum("nld,nlk->dk", f, p), atol=1e-6)


def test_a_step_holds_and_moves_only_what_its_batch_touches():
    rule = attention_lm.Rule(window=8, fresh=5, width=4, inner=6)
    counts = np.arange(5000, 0, -1.0)
    layout = attention_lm.Layout(counts, rule)
    net = attention_lm.Subwords(attention_lm.Subwords.begin(counts, layout, rule), layout, rule)
    batch = net.windows(np.array([3, 4000, 3, 70, 4900, 1]), np.array([2, 4]))[:3]
    part, full = attention_lm.Subwords.touched(net.w, batch, layout), attention_lm.Subwords.slope(net.w, batch, rule, layout)
    assert {k for k, g in part.items() if isinstance(g, fit.Rows)} == {"token", "leaf", "leaf_bias"}
    assert set(part["token"].at) == set(np.unique(batch[0])) and len(part["leaf"].at) == 2 * layout.size
    for name, g in full.items():
        assert g.shape == net.w[name].shape and np.array_equal(fit.whole(part[name], net.w[name]), g)
    before = {k: v.copy() for k, v in net.w.items()}
    moved = fit.adam(net.w, lambda w, b: attention_lm.Subwords.touched(w, b, layout), iter([batch, net.windows(np.array([9, 8]), np.array([2]))[:3]]), 0.01)
    assert all(np.array_equal(net.w[k], before[k]) for k in before)
    one = fit.adam(net.w, lambda w, b: attention_lm.Subwords.touched(w, b, layout), iter([batch]), 0.01)
    assert np.array_equal(moved["token"][70], one["token"][70]) and not np.array_equal(one["token"][70], before["token"][70])


def test_context_alone_gets_no_state_and_masks_no_block():
    """Positions that are context only are neither queries nor outputs; the others are as when all are computed."""
    rule = attention_lm.Rule(classes=6, window=50, fresh=29, width=4, inner=6)
    net = attention_lm.Network(attention_lm.Network.start(np.full(6, 1 / 6), rule), rule)
    ids, _, _, _ = net.windows(np.random.RandomState(6).randint(0, 6, 170), np.array([1, 33, 136]))
    every, late = attention_lm.Network.forward(net.w, ids, 7), attention_lm.Network.forward(net.w, ids, 7, 21)
    assert late[-1].shape == (len(ids), 29, 4) and np.allclose(every[-1][:, 21:], late[-1], atol=1e-6)
    assert max(part.shape[2] for part in late[4]) == 50 and late[4][0].shape[2] < 50


def test_a_text_is_cut_into_ids_once_and_kept_as_the_vocabulary_has_them(docs, monkeypatch):
    texts = {1: "The cat, the CAT's hat", 2: None, 3: "", 4: "É naïve 東京 x" * 30}
    end = attention_lm._end(PATH, PATTERN)
    rows = attention_lm._cut(docs(list(texts.items())), F.col("doc_id") != 4, PATH, PATTERN).collect()
    own = attention_lm.vocabulary(PATH, PATTERN)
    ids_of = lambda word: [x for part in own.pattern.findall(" " + word) for x in own.merged(part)]
    for r in rows:
        flat, counts = attention_lm._symbols(pa.array([r.symbols], pa.binary()), end)
        assert flat.tolist() == [x for w in words_of(texts[r.doc_id])[:-1] for x in ids_of(w)] + [end] and counts.tolist() == [len(flat)]
        assert r.learn == (r.doc_id != 4) and r.text == texts[r.doc_id] and len(r.symbols) == 2 * len(flat)
    monkeypatch.setattr(attention_lm, "IDS_KEPT", 3)
    for text in ("a bb ccc", "ccc dddd a", "eeeee é a bb"):
        _, kinds, back, flat, sizes = attention_lm.tokens(pa.array([text]), PATH, PATTERN)
        cut = np.split(flat, np.cumsum(sizes)[:-1])
        assert [x for i in back for x in cut[i]] == [x for w in text.split() for x in ids_of(w)]


def test_logits_too_large_for_a_plain_exponential_lose_nothing():
    w = {"out": np.eye(4, dtype=np.float32) * 300, "bias": np.zeros(4, np.float32)}
    out, df = attention_lm.Network.head(w, np.eye(4, dtype=np.float32)[None], np.array([[0, 1, 2, 0]]), np.ones((1, 4), bool))
    assert np.isfinite(df).all() and np.allclose(out["bias"], [-0.25, 0, 0, 0.25], atol=1e-6)
    assert np.allclose(attention_lm.Subwords._own(np.eye(4, dtype=np.float32), w["out"], w["bias"], np.array([0, 1, 2, 0])), [0, 0, 0, -300])
