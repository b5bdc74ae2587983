import hashlib
import re

from boardwalk.llm import fill_middle
from boardwalk.llm.fill_middle import Rule


def brute(doc_id, text, rule=Rule()):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    draw = hashlib.sha256(f"{rule.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(draw[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rule.rate:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < rule.spm:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = ["", None, "\n", "\n\n\n", "one line", "two\nlines\n", "a\r\nb c\x0bd\n", "é\nß\n漢字\n" * 50, "x" * 1000, "<P>", "a\n<M> b\n", "a <\nP> b <\n", "<\n<\nS>\nM>\n", "tail\n" * 700 + "end"]
PAIRS = [(i * 13 - 5, t) for i, t in enumerate(TEXTS * 4)] + [(None, "no\nid\n"), (77, "same\nrow\n"), (77, "same\nrow\n"), (77, "other\n")]


def order(rows):
    return sorted(rows, key=str)


def test_outputs_digests_and_texts(docs):
    hexed = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    for rule in (Rule(), Rule(chunk=8), Rule(rate=60, spm=20, seed=3)):
        want = [brute(i, t, rule) for i, t in PAIRS]
        made = fill_middle.transform(docs(PAIRS), rule)
        assert order(map(tuple, made.collect())) == order(want)
        got = fill_middle.digests(docs(PAIRS), rule, parts=3).collect()
        assert order(map(tuple, got)) == order((*w[:5], hexed(w[5]), hexed(t)) for w, (_, t) in zip(want, PAIRS, strict=True))
        back = fill_middle.restore(made.select("doc_id", "form", "output"), rule)
        assert order(map(tuple, back.collect())) == order((i, t or "") for i, t in PAIRS)


def test_a_long_text_streams_in_chunks(docs):
    long = "".join(f"line {i}\n" for i in range(60_000)) + "y" * 200_000
    (row,) = fill_middle.transform(docs([(4, long)])).collect()
    assert tuple(row) == brute(4, long)
    assert all(len(c) <= 1 << 15 for c in fill_middle.chunks(long.encode(), 1 << 15))


def test_empty_table(docs):
    assert fill_middle.digests(docs([])).count() == 0
    assert fill_middle.restore(fill_middle.transform(docs([]))).count() == 0


def test_one_shuffle_for_both_sorts(docs):
    found = fill_middle.digests(docs(PAIRS), parts=4).rdd
    lineage = found.toDebugString().decode()
    assert lineage.count("ShuffledRDD") == 1
