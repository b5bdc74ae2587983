"""Chat formatting by perspective rotation: each participant in turn is the assistant, all others are named users.

A dialogue is rendered in parts of at most ``part_turns`` turn numbers, as a conversation may hold any number of turns
and none is gathered whole. Parts in order make the dialogue. The mask of a part lists the spans of characters to train on:
what the participant of the perspective said, with the end mark.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardwalk.llm.common import giving_back
from boardwalk.operators.joins import join_small
from boardwalk.operators.slices import place
from boardwalk.session import materialise

CROWD, PIECE = 1024, 512
START, END = "<|im_start|>", "<|im_end|>\n"


def rotate(turns: DataFrame, part_turns: int = 64, narrator: str = "system") -> DataFrame:
    """Turns (conv_id, turn, role, text) to one row per conversation, perspective, part and piece: conv_id, perspective,
    part, piece, pieces, n_turns, rendered, and mask: an array of (begin, end) from 0 at the start of the part, end excluded.

    Every distinct role but ``narrator`` is a participant and a perspective; turns of the narrator stay system turns
    in all. Turns are in order of turn, then role and text; rows equal in all four columns count once, whatever the
    other columns hold. A null text is an empty message. Rows without conversation, turn or role are left out, and
    a conversation of only the narrator has no perspective. Dialogue parts hold at most ``part_turns`` distinct turn
    numbers. A part of more than 1,024 messages comes in ``pieces`` of 512 messages that follow each other, numbered
    from 0; all other parts are one piece.
    """
    given = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    given = given.where("conv_id is not null and turn is not null and role is not null").distinct()
    cast = given.where(F.col("role") != narrator).select("conv_id", F.col("role").alias("perspective")).distinct()
    given = given.withColumn("part", F.floor(F.col("turn") / part_turns).cast("long"))
    one = [F.lit(0).cast("long").alias("piece"), F.lit(1).cast("long").alias("pieces")]
    sizes = given.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    crowded = materialise(sizes.where(F.col("n") > CROWD).select("conv_id", "part", F.ceil(F.col("n") / PIECE).cast("long").alias("pieces")))
    if crowded.isEmpty():
        return _rendered(given.select("*", *one), cast, narrator)
    found = join_small(given, crowded, ["conv_id", "part"])
    calm = found.where("pieces is null").drop("pieces").select("*", *one)
    ranked = place(found.where("pieces is not null"), ["conv_id", "part"], [F.col(c) for c in ("turn", "role", "text")], "rank")
    cut = _rendered(ranked.withColumn("piece", F.floor((F.col("rank") - 1) / PIECE).cast("long")), cast, narrator)
    keys = ["conv_id", "perspective", "part"]
    earlier = Window.partitionBy(*keys).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    lengths = cut.select(*keys, "piece", F.length("rendered").cast("long").alias("n"))
    shifts = lengths.select(*keys, "piece", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shift"))
    moved = F.transform("mask", lambda m: F.struct((m["begin"] + F.col("shift")).alias("begin"), (m["end"] + F.col("shift")).alias("end")))
    cut = cut.join(shifts, [*keys, "piece"]).withColumn("mask", moved).drop("shift")
    return _rendered(calm, cast, narrator).unionByName(cut)


def _rendered(placed: DataFrame, cast: DataFrame, narrator: str) -> DataFrame:
    """The pieces as text from each perspective, with the mask from the start of the piece."""
    parts = placed.groupBy("conv_id", "part", "piece", "pieces").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    out = parts.join(cast, "conv_id").withColumn("messages", F.transform("turns", lambda t: _message(t, F.col("perspective"), narrator)))
    ends = F.aggregate("messages", F.array().cast("array<long>"), lambda a, m: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + m["head"] + m["body"])))
    out = out.withColumn("ends", ends)
    spans = F.transform(F.arrays_zip("messages", "ends"), lambda x: F.struct((x["ends"] - x["messages"]["body"]).alias("begin"), x["ends"].alias("end"), x["messages"]["own"].alias("own")))
    mask = F.transform(F.filter(spans, lambda x: x["own"]), lambda x: F.struct(x["begin"].alias("begin"), x["end"].alias("end")))
    rendered = F.concat_ws("", F.transform("messages", lambda m: m["text"]))
    return out.select("conv_id", "perspective", "part", "piece", "pieces", F.size("turns").cast("long").alias("n_turns"), rendered.alias("rendered"), mask.alias("mask"))


def _message(turn: Column, perspective: Column, narrator: str) -> Column:
    own = turn["role"] == perspective
    role = F.when(own, F.lit("assistant")).when(turn["role"] == narrator, F.lit("system")).otherwise(F.concat(F.lit("user name="), turn["role"]))
    head = F.concat(F.lit(START), role, F.lit("\n"))
    body = F.concat(turn["text"], F.lit(END))
    return F.struct(F.concat(head, body).alias("text"), F.length(head).cast("long").alias("head"), F.length(body).cast("long").alias("body"), own.alias("own"))


def digest(rotated: DataFrame) -> DataFrame:
    """One row a part: the rotation with its texts as MD5, and the mask as text and as a number of characters.

    Pieces of a part are sorted and digested one after the other, so that no part is held whole.
    """
    mask = F.array_join(F.transform("mask", lambda m: F.concat(m["begin"].cast("string"), F.lit("-"), m["end"].cast("string"))), ",")
    trained = F.aggregate("mask", F.lit(0).cast("long"), lambda a, m: a + m["end"] - m["begin"])
    keys, figures = ["conv_id", "perspective", "part"], ["n_turns", F.length("rendered").cast("long").alias("n_chars"), trained.alias("trained_chars")]
    whole = rotated.where("pieces = 1").select(*keys, *figures, F.md5(F.col("rendered").cast("binary")).alias("rendered_md5"), F.md5(mask.cast("binary")).alias("mask_md5"))
    cut = rotated.where("pieces > 1").select(*keys, "piece", *figures, "rendered", mask.alias("spans"))
    cut = cut.repartition(*keys).sortWithinPartitions(*keys, "piece")
    return whole.union(cut.mapInArrow(giving_back(_digests), whole.schema))


def _digests(batches):
    """One row for each run of rows of one part."""
    now, sums, texts, spans, bare = None, [0, 0, 0], None, None, True

    def row():
        kinds = [pa.int64(), pa.string(), pa.int64(), *[pa.int64()] * 3, pa.string(), pa.string()]
        names = ["conv_id", "perspective", "part", "n_turns", "n_chars", "trained_chars", "rendered_md5", "mask_md5"]
        values = [*now, *sums, texts.hexdigest(), spans.hexdigest()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names)

    for batch in batches:
        for i in range(batch.num_rows):
            *key, _, n, chars, trained, text, span = (c[i].as_py() for c in batch.columns)
            if key != now:
                if now is not None:
                    yield row()
                now, sums, texts, spans, bare = key, [0, 0, 0], hashlib.md5(), hashlib.md5(), True
            sums = [a + b for a, b in zip(sums, (n, chars, trained), strict=True)]
            texts.update(text.encode())
            if span:
                spans.update(span.encode() if bare else b"," + span.encode())
                bare = False
    if now is not None:
        yield row()


ROTATE_SQL = """
with given as (
  select distinct conv_id, cast(turn as bigint) as turn, role, coalesce(text, '') as text from conversations
  where conv_id is not null and turn is not null and role is not null),
persons as (select distinct conv_id, role as perspective from given where role <> 'system'),
messages as (
  select g.conv_id, p.perspective, cast(floor(turn / 64.0) as bigint) as part, turn, role, text,
    '<|im_start|>' || case when role = perspective then 'assistant' when role = 'system' then 'system' else 'user name=' || role end || chr(10) as head,
    text || '<|im_end|>' || chr(10) as body
  from given g join persons p on g.conv_id = p.conv_id),
placed as (
  select *, sum(length(head) + length(body)) over (partition by conv_id, perspective, part order by turn, role, text) as ending from messages)
select conv_id, perspective, part, count(*) as n_turns,
  cast(sum(length(head) + length(body)) as bigint) as n_chars,
  cast(coalesce(sum(case when role = perspective then length(body) end), 0) as bigint) as trained_chars,
  md5(string_agg(head || body, '' order by turn, role, text)) as rendered_md5,
  md5(coalesce(string_agg(case when role = perspective then cast(ending - length(body) as varchar) || '-' || cast(ending as varchar) end, ',' order by turn, role, text), '')) as mask_md5
from placed group by conv_id, perspective, part
"""
