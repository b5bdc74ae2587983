import base64
import hashlib
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from boardwalk.llm import bpe, chat, decontaminate, language, topk

RANKS, JSON, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
ODD = [None, "", " ", "a" * 5000, "it's we'll 'S", "日本語 👩‍👩‍👧 ½", "x<|endoftext|>y", "\n\n\n  z \x1c \x85", "The end. " * 400]


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_round_trip_as_the_library(docs, library):
    rows = {r.doc_id: r for r in bpe.round_trip(docs(list(enumerate(ODD))), RANKS, PATTERN).collect()}
    for i, text in enumerate(ODD):
        ids = library.encode_ordinary(text or "")
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_offsets_and_split_characters(docs, library):
    encoded = bpe.encode(docs([(1, "é日x 👩")]), RANKS, PATTERN)
    row = encoded.first()
    assert row.ids == library.encode_ordinary("é日x 👩")
    text, at = "é日x 👩", 0
    for i, start in zip(row.ids, row.starts, strict=True):
        assert len(text[:start].encode()) <= at < len(text[: start + 1].encode())
        at += len(library.decode_single_token_bytes(i))
    cut = encoded.selectExpr("doc_id", "slice(ids, 1, size(ids) - 1) as ids")
    back = bpe.decode(cut, RANKS, PATTERN).first()
    assert bytes(back.bytes) == library.decode_bytes(row.ids[:-1]) and back.text.endswith("�")
    assert bpe.decode(bpe.encode(docs([(2, None)]), RANKS, PATTERN), RANKS, PATTERN).first().text == ""
    none = bpe.decode(encoded.selectExpr("doc_id", "cast(null as array<int>) as ids", "1 as text"), RANKS, PATTERN).first()
    assert none.bytes is None and none.text is None
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode(encoded.selectExpr("doc_id", "array(99999) as ids"), RANKS, PATTERN).collect()


def test_a_worker_forgets_pre_tokens_beyond_its_bound(library, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 20)
    own = bpe.ByteBPE(RANKS, PATTERN)
    for i in range(8):
        texts = [f"unheard{i}x{j} éword{j} the" for j in range(9)] + [""]
        flat, n = own.spots.ids(own.pre_tokens(texts))
        want = [library.encode_ordinary(t) for t in texts]
        assert flat.tolist() == sum(want, []) and n.tolist() == [len(w) for w in want]
        assert len(own.spots) <= 20 + 3 * 9 * 5


def test_the_query_encodes_then_decodes(docs):
    pairs = [(None, "é日x 👩 cut"), (7, "same"), (7, "same"), (8, "other " * 300), *enumerate(f"w{i} é{i}" for i in range(400))]
    rows = bpe.round_trip(docs(pairs), RANKS, PATTERN)
    assert rows._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 2
    assert sorted((r.doc_id or -1, r.decoded_sha256) for r in rows.collect()) == sorted((i or -1, hashlib.sha256(t.encode()).hexdigest()) for i, t in pairs)
    assert bpe.round_trip(docs([]), RANKS, PATTERN).count() == 0


@pytest.mark.parametrize("path", [RANKS, JSON, public_tokenizers.path("byte_bpe_multi_50k.tiktoken")])
def test_the_byte_table_in_reverse(path):
    own = bpe.ByteBPE(path, PATTERN)
    assert all(b"".join([own.bytes_of[i]]) for i in own.bytes_of)
    for text in ("é", "日", "👩", " \x00\x7f", "ÿ"):
        assert b"".join(own.bytes_of[i] for i in own.merged(text)).decode() == text


def test_whole_table_as_the_libraries(spark, docs, library):
    docs([])
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in table.collect()}
    own = Tokenizer.from_file(JSON)
    for r in bpe.round_trip(table, RANKS, PATTERN).collect():
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    for r in bpe.token_counts(table, JSON, PATTERN).collect():
        assert r.n_tokens == len(own.encode(texts[r.doc_id], add_special_tokens=False).ids)


def test_token_counts_as_the_library(docs):
    own = Tokenizer.from_file(JSON)
    rows = {r.doc_id: r for r in bpe.token_counts(docs(list(enumerate(ODD))), JSON, PATTERN, limit=512).collect()}
    for i, text in enumerate(ODD):
        n = len(own.encode(text or "", add_special_tokens=False).ids)
        assert (rows[i].n_tokens, rows[i].n_bytes, rows[i].over_limit) == (n, len((text or "").encode()), n > 512)
    assert bpe.token_counts(docs([]), JSON, PATTERN).count() == 0


def test_whole_tokens_are_proved():
    own = bpe.ByteBPE(JSON, PATTERN)
    known = own.prove_whole_tokens()
    assert len(known) > 40_000 and "<|endoftext|>" not in known
    assert all(own.merged(t) == ids for t, ids in list(known.items())[:2000])


def brute_leaks(docs, items, k=5, like=0.8):
    words = lambda t: re.findall(r"[^ \t-\r]+", (t or "").lower())
    cut = lambda w: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    sets = {i: (cut(words(t)), len(words(t))) for i, t in items if i is not None and words(t)}
    held = {}
    for s, _ in sets.values():
        for x in s:
            held[x] = held.get(x, 0) + 1
    weight = lambda s: sum(1 + np.log(len(sets) / held[x]) if x in held else 1 + np.log(len(sets)) for x in s)
    found = set()
    for d, t in docs:
        w = words(t)
        for i, (s, n) in sets.items():
            for at in range(len(w) - n + 1):
                own = cut(w[at : at + n])
                if weight(own & s) >= like * weight(own | s):
                    found.add((d, i))
    return found


def test_leaks_equal_all_windows(docs, spark):
    draw = np.random.RandomState(2)
    text = lambda n: " ".join(f"v{x}" for x in draw.randint(0, 3000, n))
    items = [(i, text(draw.randint(12, 60))) for i in range(30)] + [(40, None), (41, " "), (42, "Two words"), (None, text(9))]
    pairs = [(0, None), (1, ""), (2, text(400))]
    for i in range(3, 40):
        item = items[draw.randint(30)][1].split()
        if i % 3 == 0:
            item[-1] = "changed"
        pairs.append((i, text(draw.randint(0, 80)) + " " + " ".join(item).upper() + "\n" + text(30)))
    pairs.append((50, "xx two WORDS yy"))
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs(pairs), table).collect()}
    assert got == brute_leaks(pairs, items)
    in_blocks = decontaminate.leaks(docs(pairs), table, decontaminate.Rule(items_at_once=7)).collect()
    assert {(r.doc_id, r.item_id) for r in in_blocks} >= {(d, i) for d, i in got if d % 3}
    clean = decontaminate.clean(docs(pairs), table)
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in pairs} - {d for d, _ in got}
    assert decontaminate.leaks(docs(pairs), table.limit(0)).count() == 0


def test_blocks_of_items_change_no_result(docs, spark):
    draw = np.random.RandomState(6)
    text = lambda n: " ".join(f"v{x}" for x in draw.randint(0, 3000, n))
    common = [text(12) for _ in range(4)]
    items = [(i, f"{text(12)} {common[i % 4]} {text(8)}") for i in range(40)] + [(3, text(20)), (3, text(20))]
    pairs = []
    for i in range(120):
        item = items[i % len(items)][1].split()
        for at in draw.choice(len(item), i % 4, replace=False):
            item[at] = "changed"
        pairs.append((i, f"{text(30)} {' '.join(item)} {common[i % 3]} {text(20)}"))
    pairs.append((500, items[40][1] + " and " + items[41][1]))
    table = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(decontaminate.leaks(docs(pairs), table).collect())
    assert len({r.similarity for r in whole}) > 3
    for n in (7, 25):
        assert sorted(decontaminate.leaks(docs(pairs), table, decontaminate.Rule(items_at_once=n)).collect()) == whole


def test_all_fingerprints_within_the_radius_are_found():
    rule = decontaminate.Rule()
    draw = np.random.RandomState(4)
    items = decontaminate.Items(list(range(200)), [" ".join(map(str, draw.randint(0, 999, 20))) for _ in range(200)], rule)
    some = items.prints[:80].copy()
    for i in range(80):
        for bit in draw.choice(128, i % 40, replace=False).tolist():
            some[i, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    window, item = items.candidates(some, 20)
    ones = lambda x: sum(bin(int(v)).count("1") for v in x)
    want = {(w, i) for w in range(80) for i in range(200) if ones(some[w] ^ items.prints[i]) <= rule.radius}
    assert set(zip(window.tolist(), item.tolist(), strict=True)) == want


def test_the_index_leaves_most_items_out():
    """Of windows and items without anything in common fewer than a fifth are compared at all."""
    rule = decontaminate.Rule()
    draw = np.random.RandomState(8)
    text = lambda: " ".join(map(str, draw.randint(0, 10**6, 30)))
    items = decontaminate.Items(list(range(300)), [text() for _ in range(300)], rule)
    others = decontaminate.Items(list(range(300)), [text() for _ in range(300)], rule)
    window, _ = items.looked_up(others.prints, 30)
    assert len(window) < 0.2 * 300 * 300


def test_recall_on_the_brink_of_similarity():
    """Windows just similar enough: the radius loses at most one in a hundred of them."""
    rule = decontaminate.Rule()
    draw = np.random.RandomState(9)
    ids = np.array([draw.randint(1, 2**62, 40) for _ in range(2000)]).astype(np.uint64)
    near = ids.copy()
    near[:, :4] = draw.randint(1, 2**62, (2000, 4)).astype(np.uint64)  # 36 of 44 in common: 0.818
    prints = [decontaminate.packed(np.array([decontaminate.signs(row).sum(0) for row in rows])) for rows in (ids, near)]
    assert (decontaminate.differing(*prints) <= rule.radius).mean() >= 0.99


def test_language_profiles(docs, spark):
    from pyspark.sql import functions as F

    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr"), (None, "en"), ("xx", None)] * 5)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = language.profiles(table, F.lit(True), 50)
    assert sorted(known) == ["en", "fr"]
    got = language.identify(docs([(1, "the dog and cat"), (2, "le chien"), (3, None), (4, "12 ..."), (None, "THE"), (6, "the " * 50_000)]), known, 50).collect()
    assert [(r.doc_id, r.lang_pred) for r in sorted(got, key=lambda r: r.doc_id or 5)] == [(1, "en"), (2, "fr"), (3, "und"), (4, "und"), (None, "en"), (6, "en")]
    assert all(0 <= r.score <= 1 for r in got)
    assert language.identify(docs([(1, "a")]), {}).first().lang_pred == "und"
    assert list(language.profiles(table.limit(0), F.lit(True))) == []


def test_out_of_place_distance_by_hand(docs):
    """Every language and document by the distance written out, over several texts and profiles."""
    texts = [(1, "ab ab b"), (2, "the quick brown fox and the lazy dog"), (3, "le renard brun et le chien"), (4, "zz zz zz zq"), (5, "Ab bA")]
    size = 12
    known = {n: language.ranked([t], size)[1] for n, t in (("x", "ab ab b"), ("y", "the dog and the fox"), ("z", "le chien et le renard"))}
    for row in language.identify(docs(texts), known, size).collect():
        _, own, place, _ = language.ranked([dict(texts)[row.doc_id]], size)
        away = {}
        for name, profile in known.items():
            order = {g: i for i, g in enumerate(profile.tolist())}
            away[name] = sum(min(abs(order[g] - p), size) if g in order else size for g, p in zip(own.tolist(), place.tolist(), strict=True))
        best = sorted(away, key=lambda n: (away[n], n))
        assert row.lang_pred == best[0]
        assert row.score == pytest.approx((away[best[1]] - away[best[0]]) / away[best[1]] if away[best[1]] else 0.0)


def test_equally_near_languages_and_odd_tables(docs, spark):
    from pyspark.sql import functions as F

    profile = language.ranked(["same words"], 20)[1]
    tied = language.identify(docs([(1, "same words"), (None, "same"), (1, "same words")]), {"b": profile, "a": profile}, 20).collect()
    assert {(r.lang_pred, r.score) for r in tied} == {("a", 0.0)} and len(tied) == 3
    assert language.identify(docs([]), {"a": profile}).count() == 0
    nulls = spark.createDataFrame([(1, "text", None), (None, None, "en"), (2, "other text", "en")], "doc_id long, text string, lang string")
    assert list(language.profiles(nulls, F.lit(True))) == ["en"]


def test_most_frequent_grams_by_counting():
    from collections import Counter

    text = "Banana band, BAN! été 12 été"
    grams, place = language.ranked([text], 400)[1:3]
    words = ["banana", "band", "ban", "été", "été"]
    counted = Counter()
    for w in words:
        for n in (1, 2, 3):
            counted.update(w[i : i + n] for i in range(len(w) - n + 1))
    assert len(grams) == len(counted) or len(grams) > len(counted)  # borders of words may count as letters
    assert place.tolist() == list(range(len(grams)))


def test_held_out_documents_of_the_table(spark, docs):
    """Against the languages the table names, on rows the profiles did not learn from."""
    from boardwalk.llm.queries import REGISTRY

    docs([])
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = REGISTRY["op4_language"](spark, "/root/testdata/sf0.01").join(table, "doc_id").where("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert len(rows) > 200 and sum(r.lang == r.lang_pred for r in rows) >= 0.99 * len(rows)


def test_rotation_of_odd_turns(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "bob", None), (1, 130, "ann", "bye"), (2, 0, "system", "x"), (None, 0, "a", "b"), (3, None, "a", "b"), (4, 0, "a", "x" * 100_000)]
    given = spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn int, role string, text string, part int")
    got = {(r.conv_id, r.perspective, r.part): r for r in chat.rotate(given).collect()}
    assert set(got) == {(1, p, n) for p in ("ann", "bob") for n in (0, 2)} | {(4, "a", 0)}
    first = got[1, "ann", 0]
    assert first.rendered == "<|im_start|>system\ns<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n<|im_start|>user name=bob\n<|im_end|>\n"
    assert [first.rendered[m.begin : m.end] for m in first["mask"]] == ["hi<|im_end|>\n"]
    assert got[1, "bob", 2]["mask"] == []
    crowd = spark.createDataFrame([(1, 0, "a", f"t{i}") for i in range(3000)], "conv_id long, turn int, role string, text string")
    parts = chat.rotate(crowd).collect()
    assert sum(r.n_turns for r in parts) == 3000 and max(r.n_turns for r in parts) <= 1024
    assert chat.rotate(given.limit(0)).count() == 0


def test_a_crowded_part_is_one_dialogue(spark, tmp_path):
    import duckdb

    rows = [(1, i % 3, "ann" if i % 2 else "bob", f"t{i} é") for i in range(3000)] + [(1, 70, "ann", "later"), (2, 0, "ann", "hi"), (2, 1, "bob", "ho")]
    given = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    pieces = sorted(chat.rotate(given).where("conv_id = 1 and part = 0 and perspective = 'ann'").collect(), key=lambda r: r.piece)
    assert [r.piece for r in pieces] == list(range(6)) and {r.pieces for r in pieces} == {6}
    message = lambda r: f"<|im_start|>{'assistant' if r[2] == 'ann' else 'user name=bob'}\n{r[3]}<|im_end|>\n"
    text = "".join(r.rendered for r in pieces)
    assert text == "".join(map(message, sorted(rows[:3000])))
    assert [text[m.begin : m.end] for r in pieces for m in r["mask"]] == [f"{r[3]}<|im_end|>\n" for r in sorted(rows[:3000]) if r[2] == "ann"]
    given.write.parquet(f"{tmp_path}/turns")
    db = duckdb.connect()
    db.execute(f"create table conversations as select * from '{tmp_path}/turns/*.parquet'")
    assert sorted(map(tuple, chat.digest(chat.rotate(given)).collect())) == sorted(db.execute(chat.ROTATE_SQL).fetchall())


def test_top_k_equals_all_products(spark, docs):
    docs([])
    draw = np.random.RandomState(1)
    vectors = [(i, [float(x) for x in v]) for i, v in enumerate(draw.randn(300, 8).round(2))]
    vectors += [(50, vectors[50][1]), (301, None), (302, [None] * 8), (303, [float("nan")] * 8), (None, [1.0] * 8), (304, [0.5] * 3), (350, [0.25] * 3), (400, [0.0] * 8), (401, vectors[7][1])]
    table = spark.createDataFrame([(i, v, 3) for i, v in vectors], "vec_id long, embedding array<float>, score int")
    good = {(i, tuple(int(np.floor(256 * float(np.float32(x)))) for x in v)) for i, v in vectors if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    want = {}
    for q, v in good:
        if q % 50 == 0:
            scored = sorted({(-sum(a * b for a, b in zip(v, w, strict=True)), c) for c, w in good if c != q and len(w) == len(v)})[:5]
            want[q] = [(c, -s) for s, c in scored]
    got = {}
    for r in sorted(topk.top_k(table, block=3, shard=40).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    assert got == {q: w for q, w in want.items() if w}
    assert topk.top_k(table.limit(0)).count() == 0
