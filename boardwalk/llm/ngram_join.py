"""Similarity join of documents on word n-grams, with prefixes of token combinations.

A document is the set of its word shingles. All sets order their shingles alike: first those that few documents
hold, then the frequent ones. If two sets are similar enough, the part at the front of each holds common shingles.
Rare shingles are signatures alone. Frequent ones fall into classes, and only pairs of one class are signatures, so
a phrase of many documents makes no large bucket; the front part is made longer for it. With ``n_c`` shingles of
class c in the front part, losing every signature takes ``n_1 + sum(max(0, n_c - 1))`` shingles, and the part ends
where this exceeds what a similar set may lack. Hence two similar sets always share a signature, and candidates
are then verified on their whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardwalk.llm.common import Scratch, bitmap, giving_back, id_text, over_texts, pieces, ragged, raw, rows_maybe_in, within
from boardwalk.llm.components import components
from boardwalk.llm.words import mix, shingle_rows, words

ALL_COUNTED = 128


@dataclass(frozen=True)
class Similarity:
    """Shingles of ``k`` words; linked when ``den * intersection >= num * union``.

    A shingle that ``common`` rows hold comes after rarer ones, and from ``frequent`` rows on it signs in pairs
    only; both change the work, never the result.
    """

    k: int = 5
    num: int = 80
    den: int = 100
    common: int = 4
    frequent: int = 24

    def lack(self, n: int) -> int:
        """How many of its n shingles a set may lack in a similar one."""
        return n - -(-self.num * n // self.den)

    @property
    def lone(self) -> int:
        """Sets up to this size are similar to equal sets only."""
        return (self.num - 1) // (self.den - self.num)

    def levels(self, n: int) -> list[int]:
        """Sizes fall into levels by powers of two; a set also signs at the next level if a similar one may be there."""
        level = n.bit_length()
        return [level, level + 1] if n * self.den >= self.num << level else [level]

    def classes(self, level: int) -> int:
        smallest = 1 << (level - 1)
        share = (self.den - self.num) / self.den
        return max(1, min(self.num * smallest // self.den // 2, int(share * smallest / 4)))

    def counted(self, level: int) -> np.uint64:
        """Shingle keys below this are counted: all for short sets, else twice what a prefix takes."""
        share = 1.0 if 1 << (level - 1) < ALL_COUNTED else min(1.0, 2 * (self.den - self.num) / self.den)
        return np.uint64(min(2**64 - 1, int(share * 2**64)))


def _keys(row: np.ndarray, level: int) -> np.ndarray:
    return mix(row + np.uint64(level * 0x9E3779B97F4A7C15 % 2**64))


def signatures(row: np.ndarray, level: int, rule: Similarity, common: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The signatures of one set of distinct shingle hashes at a level.

    The order of all sets: counted shingles that few rows hold, counted ones that more hold, then the frequent and
    the uncounted ones; by hash within each.
    """
    keys = _keys(row, level)
    need = rule.lack(len(row)) + 1
    front = keys[keys < rule.counted(level)]
    front.sort()
    many = within(common, front)
    single = front[~many][:need]
    if len(single) == need:
        return single
    front = front[many]
    often = within(frequent, front)
    single = np.concatenate([single, front[~often][: need - len(single)]])
    if len(single) == need:
        return single
    rest = np.concatenate([front[often], keys[keys >= rule.counted(level)]])
    rest.sort()
    kind = (rest >> np.uint64(20)) % np.uint64(rule.classes(level))
    first = np.zeros(len(rest), np.int64)
    first[np.unique(kind, return_index=True)[1]] = 1
    gained = np.arange(1, len(rest) + 1) - np.cumsum(first)
    end = int(np.searchsorted(gained, need - len(single))) + 1
    rest, kind = rest[:end], kind[:end]
    order = np.argsort(kind, kind="stable")
    rest, kind = rest[order], kind[order]
    found = [single]
    for step in range(1, len(rest)):
        same = kind[step:] == kind[:-step]
        if not same.any():
            break
        found.append(mix(mix(rest[:-step][same]) * np.uint64(3) + rest[step:][same]))
    return np.unique(np.concatenate(found))


def _counted(docs: DataFrame, rule: Similarity) -> DataFrame:
    """Keys of the counted shingles that at least ``common`` rows hold, with their number; tasks add up their own first."""

    def loop(batches):
        held, size = [], 0
        for batch in pieces(batches):
            flat, counts = words(*raw(batch.column("text")))
            for row in shingle_rows(flat, counts, rule.k):
                if len(row) > rule.lone - 1:
                    for level in rule.levels(len(row)):
                        keys = _keys(row, level)
                        held.append(keys[keys < rule.counted(level)])
                        size += len(held[-1])
            if size > 4_000_000:
                yield total(held)
                held, size = [], 0
        if held:
            yield total(held)

    def total(held):
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int32))], ["key", "n"])

    counted = docs.mapInArrow(giving_back(loop), "key long, n int").groupBy("key").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= rule.common)


PARITIES = 1024


def _signed(docs: DataFrame, rule: Similarity, common, frequent) -> DataFrame:
    """Per row: doc_id, n (distinct shingles), two sums that stand for the set, its signatures, how many of its counted
    shingles few rows hold, and its parities: for each of ``PARITIES`` hash values, whether an odd number of the shingles has it."""

    def work(batch):
        flat, counts = words(*raw(batch.column("text")))
        found, sizes, sums = [np.zeros(0, np.uint64)], [], np.zeros((4, len(counts)), np.int64)
        odd = np.zeros((len(counts), PARITIES // 64), np.int64)
        for i, row in enumerate(shingle_rows(flat, counts, rule.k)):
            own = [np.zeros(0, np.uint64)]
            if len(row) > rule.lone - 1:
                own = [signatures(row, level, rule, common.value, frequent.value) for level in rule.levels(len(row))]
                keys = _keys(row, rule.levels(len(row))[0])
                sums[3, i] = (~within(common.value, keys[keys < rule.counted(rule.levels(len(row))[0])])).sum()
            found += own
            sizes.append(sum(map(len, own)))
            odd[i] = np.packbits((np.bincount((row & np.uint64(PARITIES - 1)).astype(np.int64), minlength=PARITIES) & 1).astype(np.uint8)).view(np.int64)
            sums[:3, i] = len(row), row.sum().view(np.int64), mix(row).sum().view(np.int64)
        flat = np.concatenate(found).view(np.int64)
        parities = ragged(odd.ravel(), np.full(len(counts), PARITIES // 64), pa.int64())
        return {"doc_id": batch.column("doc_id"), "n": sums[0], "f1": sums[1], "f2": sums[2], "signs": ragged(flat, np.array(sizes), pa.int64()), "rare": sums[3], "odd": parities}

    return over_texts(docs, work, "doc_id long, n long, f1 long, f2 long, signs array<long>, rare long, odd array<long>")


def _may_link(rule: Similarity, n: str, odd: str, other_n: str, other_odd: str):
    """False only for sets too different: each shingle of just one of them flips one parity, so as many parities as
    differ, as many shingles at least are not shared; and their sizes bound what they can share."""
    differ = F.aggregate(F.zip_with(odd, other_odd, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    few = differ * (rule.den + rule.num) <= (F.col(n) + F.col(other_n)) * (rule.den - rule.num)
    return few & (F.least(n, other_n) * rule.den >= F.greatest(n, other_n) * rule.num)


def _shared(signed: DataFrame) -> DataFrame:
    """Signatures that more than one row holds; each task adds up its own first."""

    def loop(batches):
        for batch in batches:
            found, n = np.unique(batch.column(0).flatten().to_numpy(zero_copy_only=False), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n > 1)], ["sign", "twice"])

    own = signed.select("signs").mapInArrow(giving_back(loop), "sign long, twice boolean")
    return own.groupBy("sign").agg((F.max("twice") | (F.count(F.lit(1)) > 1)).alias("twice")).where("twice").select("sign")


def _signs_in(signed: DataFrame, marks) -> DataFrame:
    """(sign, node) for the signatures in the bitmap."""

    def loop(batches):
        for batch in batches:
            signs = batch.column("signs")
            flat = signs.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(signs)), signs.value_lengths().to_numpy(zero_copy_only=False))
            kept = within(marks.value, flat)
            yield pa.RecordBatch.from_arrays([pa.array(flat[kept]), batch.column("node").take(pa.array(row[kept]))], ["sign", "node"])

    return signed.select("node", "signs").mapInArrow(giving_back(loop), "sign long, node long")


@dataclass(frozen=True)
class Classes:
    """``sets``: doc_id, n, f1, f2 of every row. ``classes``: a node for each different set with shingles, with n, f1, f2, the
    smallest id that has it (class_id) and the number of that id's rows that do (times)."""

    sets: DataFrame
    classes: DataFrame


def _classes(signed: DataFrame, scratch: Scratch) -> Classes:
    sets = scratch.write(signed.select("doc_id", "n", "f1", "f2"), "sets")
    by_id = sets.where(F.col("doc_id").isNotNull() & (F.col("n") > 0)).groupBy("n", "f1", "f2", "doc_id").agg(F.count(F.lit(1)).alias("times"))
    least = by_id.groupBy("n", "f1", "f2").agg(F.min(F.struct("doc_id", "times")).alias("least"))
    found = least.select("n", "f1", "f2", F.col("least.doc_id").alias("class_id"), F.col("least.times").alias("times"))
    return Classes(sets, scratch.write(found.withColumn("node", F.monotonically_increasing_id()), "classes"))


def _one_each(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """The signatures of each class once. Only where the class's id has the set in several rows are rows put together."""
    wanted = classes.select("n", "f1", "f2", F.col("class_id").alias("doc_id"), "times", "node")
    rows = signed.join(wanted, ["n", "f1", "f2", "doc_id"]).select("node", "n", "signs", "rare", "odd", "times")
    again = rows.where("times > 1").drop("times").groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "signs", "rare", "odd")])
    return rows.where("times = 1").drop("times").unionByName(again)


def _texts(nodes: DataFrame, classes: DataFrame, docs: DataFrame, rule: Similarity) -> DataFrame:
    """node and text, one row a node: a bitmap of their ids leaves the other documents out at the scan."""
    wanted = classes.join(nodes, "node", "leftsemi").select(F.col("class_id").alias("doc_id"), "f1", "node")
    near = rows_maybe_in(docs, "doc_id", bitmap(wanted.select("doc_id")))

    def work(batch):
        sums = [int(row.sum().view(np.int64)) for row in shingle_rows(*words(*raw(batch.column("text"))), rule.k)]
        return {"doc_id": batch.column("doc_id"), "f1": sums, "text": batch.column("text")}

    rows = over_texts(near, work, "doc_id long, f1 long, text string").join(wanted, ["doc_id", "f1"])
    return rows.groupBy("node").agg(F.first("text").alias("text"))


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, rule: Similarity) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose whole texts are similar enough, with shared and union sizes."""
    nodes = pairs.select("a").union(pairs.select("b")).distinct().toDF("node")
    texts = _texts(nodes, classes, docs, rule)
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))

    def loop(batches):
        seen = (None, None)
        for batch in pieces(batches, "text_b"):
            a, b = batch.column("a"), batch.column("b")
            sets_b = shingle_rows(*words(*raw(batch.column("text_b"))), rule.k)
            kept, common, union = [], [], []
            for i, (x, set_b) in enumerate(zip(a.to_pylist(), sets_b, strict=True)):
                if seen[0] != x:
                    seen = (x, next(shingle_rows(*words(*raw(batch.column("text_a").slice(i, 1))), rule.k)))
                shared = len(np.intersect1d(seen[1], set_b, assume_unique=True))
                both = len(seen[1]) + len(set_b) - shared
                if rule.den * shared >= rule.num * both and both:
                    kept.append(i)
                    common.append(shared)
                    union.append(both)
            rows = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([a.take(rows), b.take(rows), pa.array(common, pa.int64()), pa.array(union, pa.int64())], ["a", "b", "shared", "union_size"])

    both = pairs.select("a", "b").join(right, "b").join(left, "a")
    return both.mapInArrow(giving_back(loop), "a long, b long, shared long, union_size long")


BLOCK = 512
SHARES = 8
AT_ONCE = 1 << 17


def _held_against(members: DataFrame, rule: Similarity, best: bool) -> DataFrame:
    """(a, b, differ): pairs of members (sign, hub, node, n, odd, component) of one bucket but of different components that
    may link, with the parities in which they differ. Buckets with one hub are dealt to ``SHARES`` tasks (large ones to more,
    by their blocks), as they hold much the same pairs, and a pair comes once a task.

    ``best``: for each member of a task only the pair that differs least. Large buckets fall into blocks of about ``BLOCK``
    members, and each pair of blocks is held against each other on its own, as arrays: no row is made for a pair that
    cannot link, and no task gets a whole bucket.
    """
    sizes = members.groupBy("sign").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("blocks"))
    own = members.join(sizes, "sign").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    share = F.pmod(F.xxhash64("sign"), F.lit(SHARES)).alias("share")
    dealt = dealt.select("hub", share, "sign", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "component", "n", "odd")
    dealt = dealt.repartition("hub", "share", "low", "high").sortWithinPartitions("sign", "low", "high").drop("hub", "share")

    def pairs_of(rows):
        """Of complete groups: the pairs that may link, some rows at a time."""
        key, block, node, component, n, odd = rows
        new = np.ones(len(node) + 1, bool)
        new[1:-1] = (key[1:] != key[:-1]).any(axis=1)
        border = np.flatnonzero(new)
        end = np.repeat(border[1:], np.diff(border))
        later = end - np.arange(len(node)) - 1
        start, total = 0, np.cumsum(later)
        while start < len(node):
            stop = max(start + 1, int(np.searchsorted(total, total[start] - later[start] + AT_ONCE, "right")))
            counts = later[start:stop]
            x = np.repeat(np.arange(start, stop), counts)
            y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(counts) - counts, counts)
            small, large = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
            good = (component[x] != component[y]) & (small * rule.den >= large * rule.num)
            good &= (block[x] != block[y]) | (key[x, 1] == key[x, 2])
            x, y = x[good], y[good]
            differ = np.zeros(len(x), np.int64)
            for word in range(odd.shape[1]):
                differ += np.bitwise_count(odd[x, word] ^ odd[y, word])
            good = differ * (rule.den + rule.num) <= (n[x] + n[y]) * (rule.den - rule.num)
            yield node[x[good]], node[y[good]], differ[good]
            start = stop

    def few(found):
        """Each pair once, or each member's nearest; a pair comes up in every bucket that it shares."""
        a, b, differ = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((b, differ, a) if best else (b, a))
        a, b, differ = a[order], b[order], differ[order]
        first = np.ones(len(a), bool)
        first[1:] = (a[1:] != a[:-1]) | ((b[1:] != b[:-1]) & (not best))
        return a[first], b[first], differ[first]

    def out(found):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in few(found)], ["a", "b", "differ"])

    def columns(batch):
        key = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("sign", "low", "high")])
        odd = batch.column("odd").flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(batch.num_rows, -1)
        return key, *[batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "node", "component", "n")], odd

    def groups(batches):
        """Rows of complete groups, as many as a batch brings."""
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = columns(batch)
            if held is not None:
                rows = tuple(np.concatenate(c) for c in zip(held, rows, strict=True))
            whole = int(np.flatnonzero((rows[0] == rows[0][-1]).all(axis=1))[0])  # the last group may go on
            if whole:
                yield [c[:whole] for c in rows]
            held = tuple(c[whole:] for c in rows)
        if held is not None:
            yield held

    def loop(batches):
        found, size = [], 0
        for rows in groups(batches):
            for a, b, differ in pairs_of(rows):
                found += [(a, b, differ), (b, a, differ)] if best else [(np.minimum(a, b), np.maximum(a, b), differ)]
                size += len(a)
            if size > AT_ONCE:
                found = [few(found)]
                size = 0
                if len(found[0][0]) > 16 * AT_ONCE:
                    yield out(found)
                    found = []
        if found:
            yield out(found)

    return dealt.mapInArrow(giving_back(loop), "a long, b long, differ long")


def _bucketed(docs: DataFrame, rule: Similarity, scratch: Scratch) -> tuple[Classes, DataFrame, DataFrame]:
    """The classes of the documents, (sign, node) for signatures that several classes hold, and the forms: node, n, rare, odd."""
    counted = scratch.write(_counted(docs, rule), "counted")
    common, frequent = bitmap(counted.select("key")), bitmap(counted.where(F.col("n") >= rule.frequent).select("key"))
    scratch.drop("counted")
    signed = scratch.write(_signed(docs, rule, common, frequent), "signed")
    known = _classes(signed, scratch)
    once = _one_each(signed.where(F.col("n") >= rule.lone), known.classes.where(F.col("n") >= rule.lone))
    signed = scratch.write(once, "signed-once")
    scratch.drop("signed")
    shared = scratch.write(_shared(signed), "shared")
    rows = scratch.write(_signs_in(signed, bitmap(shared)), "rows")
    forms = scratch.write(signed.select("node", "n", "rare", "odd"), "forms")
    scratch.drop("signed-once", "shared")
    return known, rows, forms


def _same_id(known: Classes) -> DataFrame:
    """Links (a, b) between the different sets of one id."""
    rows = known.sets.where(F.col("doc_id").isNotNull() & (F.col("n") > 0)).distinct().join(known.classes.select("n", "f1", "f2", "node"), ["n", "f1", "f2"])
    least = rows.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("doc_id", "a")
    return rows.join(least, "doc_id").where("a < node").select("a", F.col("node").alias("b"))


def similar_pairs(docs: DataFrame, rule: Similarity, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The whole join: every pair of different texts that link, and who has which text.

    First (class_a, class_b, shared, union_size), classes being sets of shingles named by a number, each pair once, then
    (class, doc_id, n_shingles) for every row with words and an id. Copies are members of one class and make no pairs.
    The pairs are as many as there are links, so a group of near copies gives the square of its size; components, which do
    not need them all, come from ``ngram_components``.
    """
    docs = id_text(docs, key, text)
    scratch = Scratch(docs.sparkSession, "similar-pairs")
    known, rows, forms = _bucketed(docs, rule, scratch)
    several = rows.groupBy("sign").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    members = rows.join(several.select("sign", F.col("low").alias("hub")), "sign").join(forms, "node").withColumn("component", F.col("node"))
    pairs = _held_against(members, rule, best=False).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = verified(scratch.write(pairs, "pairs"), known.classes, docs, rule).toDF("class_a", "class_b", "shared", "union_size")
    owned = known.sets.join(known.classes, ["n", "f1", "f2"]).where("doc_id is not null")
    return scratch.write(links, "links"), owned.select(F.col("node").alias("class"), "doc_id", F.col("n").alias("n_shingles"))


def link_counts(links: DataFrame, members: DataFrame) -> DataFrame:
    """Of what ``similar_pairs`` returns: per row doc_id, n_shingles, class, and the number of other texts that it links to."""
    both = links.select(F.explode(F.array("class_a", "class_b")).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("n_links"))
    return members.join(both, "class", "left").select("doc_id", "n_shingles", "class", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def ngram_components(docs: DataFrame, rule: Similarity, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles (set size), class_id (smallest id with the same set) and component_id
    (smallest id reachable by links).

    Equal sets are one class first, so copies are never paired. Then every bucket of a signature is verified against the
    member with the fewest rare shingles, the one most likely to link. What stays apart is held against the members of
    other components by parities: first each member tries the pair that differs least, and once components have grown by
    that, every pair that is left is verified. So a large group of near copies costs a few pairs a member, and only texts
    on the brink of similarity cost more. Links between members already known to be connected are not listed;
    ``similar_pairs`` lists all.

    Null or empty texts and texts without words have n_shingles 0 and are linked with nothing; they and rows without
    an id are their own component. Rows of one id are one document: they are linked if any of their texts is.
    Repeated rows are returned as often as they come. Other columns are not read.
    """
    docs = id_text(docs, key, text)
    scratch = Scratch(docs.sparkSession, "ngram-join")
    known, rows, forms = _bucketed(docs, rule, scratch)
    placed = rows.join(forms.select("node", "rare"), "node")
    hubs = placed.groupBy("sign").agg(F.min(F.struct("rare", "node")).alias("hub"), F.min("node").alias("low"), F.max("node").alias("high"))
    members = scratch.write(rows.join(hubs.where("low < high").select("sign", F.col("hub.node").alias("hub")), "sign"), "members")
    scratch.drop("rows")
    stars = members.where(F.col("node") != F.col("hub")).select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    stars = stars.join(forms.select(F.col("node").alias("b"), F.col("n").alias("b_n"), F.col("odd").alias("b_odd")), "b")
    stars = stars.join(forms.select(F.col("node").alias("a"), F.col("n").alias("a_n"), F.col("odd").alias("a_odd")), "a")
    tried = scratch.write(stars.where(_may_link(rule, "a_n", "a_odd", "b_n", "b_odd")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "stars")
    links = scratch.write(verified(tried, known.classes, docs, rule).select("a", "b").union(_same_id(known)), "links")
    label = scratch.write(components(links, scratch, "first"), "label")
    for turn, best in (("best", True), ("rest", False)):
        apart = scratch.write(_apart(members, forms, label, tried, rule, best), f"apart-{turn}")
        if apart.isEmpty():
            break
        more = scratch.write(verified(apart, known.classes, docs, rule).select("a", "b"), f"more-{turn}")
        tried = tried.union(apart)
        label = _joined(label, more, scratch, turn)
    scratch.drop("members", "forms", "stars", "apart-best", "apart-rest")
    by_class = known.classes.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = by_class.groupBy("component").agg(F.min("class_id").alias("component_id"))
    by_class = scratch.write(by_class.join(least, "component").select("n", "f1", "f2", "class_id", "component_id"), "by-class")
    usable = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    linked = known.sets.where(usable).join(by_class, ["n", "f1", "f2"])
    alone = known.sets.where(~usable)
    return linked.select("doc_id", F.col("n").alias("n_shingles"), "class_id", "component_id").union(
        alone.select("doc_id", "n", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"))
    )


def _joined(label: DataFrame, more: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The components after more links: only components that a link joins are looked at."""
    own = label.select("node", "component")
    ends = [own.select(F.col("node").alias(end), F.col("component").alias(f"c{end}")) for end in ("a", "b")]
    edges = more.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    edges = scratch.write(edges.where("a <> b").distinct(), f"edges-{name}")
    if edges.isEmpty():
        return label
    moved = components(edges, scratch, name).withColumnRenamed("component", "to")
    known = own.join(moved.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    alone = moved.join(own, "node", "leftanti").join(own.select(F.col("component").alias("node")), "node", "leftanti").select("node", F.col("to").alias("component"))
    return scratch.write(known.union(alone), f"label-{name}")


def _apart(members: DataFrame, forms: DataFrame, label: DataFrame, tried: DataFrame, rule: Similarity, best: bool) -> DataFrame:
    """Pairs (a, b) of one bucket, of different components, that may link and were not tried."""
    placed = members.select("sign", "hub", "node").join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    split = placed.groupBy("sign").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("sign")
    rows = placed.join(split, "sign").join(forms.select("node", "n", "odd"), "node")
    pairs = _held_against(rows, rule, best)
    if best:
        pairs = pairs.groupBy("a").agg(F.min(F.struct("differ", "b")).alias("first")).select("a", F.col("first.b").alias("b"))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs.join(tried, ["a", "b"], "leftanti")


def one_of_each(docs: DataFrame, rule: Similarity) -> DataFrame:
    """Rows of ``docs``, all columns: of each group of linked documents the one with the smallest id.

    Documents without words and rows without an id stay. Of several rows with one id, one stays (the first by text, then by
    the other columns as JSON). Only documents that a bitmap marks as possibly dropped or repeated are shuffled.
    """
    scratch = Scratch(docs.sparkSession, "one-of-each")
    found = scratch.write(ngram_components(docs, rule), "found")
    dropped = found.where("doc_id <> component_id").select("doc_id").distinct()
    twice = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    twice = scratch.write(twice, "twice")
    marks = bitmap(dropped.union(twice))
    rows = rows_maybe_in(docs, "doc_id", marks).join(dropped, "doc_id", "leftanti").select(docs.columns)
    again = rows_maybe_in(rows, "doc_id", bitmap(twice))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    least = again.groupBy("doc_id").agg(F.min_by(whole, F.struct("text", F.to_json(whole))).alias("row"))
    least = least.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
    plain = rows_maybe_in(rows, "doc_id", bitmap(twice), inside=False)
    return rows_maybe_in(docs, "doc_id", marks, inside=False).union(plain).union(least)
