"""Fill-in-middle texts by secondary sort.

A text is cut into lines; two of the borders, drawn from a digest of the id, part it into prefix, middle and suffix,
which are rearranged under markers. No task builds a text: the scan emits chunks of whole lines, keyed by document and by
place in the output; ``repartitionAndSortWithinPartitions`` brings each document's chunks together in output order, and
they stream into its digest one by one. Restoration reads the markers off that stream, keys each chunk by its place in the
text, and sorts once more. Both sorts have one partitioner, so the second stays within its partition and shuffles nothing.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardwalk.llm.common import id_text

PLAIN, PSM, SPM = "plain", "psm", "spm"
HEAD = -1
PART_BYTES = 1 << 25
_SECTION = 1 << 40  # places of one section


@dataclass(frozen=True)
class Rule:
    """``rate`` percent of the documents are rearranged, ``spm`` percent of those suffix first; the rest stay plain.

    ``chunk``: bytes of whole lines that a record carries; a longer line is cut.
    """

    seed: int = 7
    rate: int = 100
    spm: int = 50
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    chunk: int = 1 << 15

    @property
    def markers(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle

    def order(self, form: str) -> tuple[str, ...]:
        """The markers in the order of the output."""
        return {PSM: (self.prefix, self.suffix, self.middle), SPM: (self.suffix, self.prefix, self.middle)}.get(form, ())

    def home(self) -> list[tuple[bytes, int]]:
        """For each marker, the section's place in the text."""
        return [(m.encode(), i) for i, m in enumerate((self.prefix, self.middle, self.suffix))]


def split(doc_id: int | None, text: str, rule: Rule) -> tuple[int, str, int, int]:
    """Number of lines, form, and the two borders in code points (0, 0 if plain)."""
    n = text.count("\n") + (text != "" and not text.endswith("\n"))
    draw = hashlib.sha256(f"{rule.seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    h = [int.from_bytes(draw[4 * i : 4 * i + 4], "big") for i in range(4)]
    if not text or any(m in text for m in rule.markers) or h[2] % 100 >= rule.rate:
        return n, PLAIN, 0, 0
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    borders, at, line = [], 0, 0
    for want in (low, high):
        while line < want:
            at = text.find("\n", at) + 1 or len(text)
            line += 1
        borders.append(at)
    return n, SPM if h[3] % 100 < rule.spm else PSM, *borders


def chunks(data: bytes, size: int):
    """Runs of whole lines of at most ``size`` bytes; a longer line is cut. Empty data is one empty run."""
    start = 0
    while start < len(data) or not start:
        end = start + size
        if end < len(data):
            end = data.rfind(b"\n", start, end) + 1 or end
        yield data[start:end]
        start = end


def dealt(key: tuple[int, int]) -> int:
    """All records of a row go to one partition, whatever their place; rows of one id go to many."""
    return (key[0] * 0x9E3779B97F4A7C15 >> 24) & 0xFFFFFFFF


def _emitted(docs: DataFrame, rule: Rule) -> RDD:
    """((row, place in the output), chunk); at place ``HEAD`` what the row says of itself."""

    def emit(part, rows):
        for at, (doc_id, text) in enumerate(rows):
            row, text = part << 40 | at, text or ""
            n, form, a, b = split(doc_id, text, rule)
            sections = {"": text} if form == PLAIN else {rule.prefix: text[:a], rule.middle: text[a:b], rule.suffix: text[b:]}
            yield (row, HEAD), (doc_id, n, form, None if form == PLAIN else a, None if form == PLAIN else b - a)
            for i, marker in enumerate(rule.order(form) or ("",)):
                for j, chunk in enumerate(chunks((marker + sections[marker]).encode(), rule.chunk)):
                    yield (row, i * _SECTION + j), chunk

    return docs.rdd.mapPartitionsWithIndex(emit)


def _sorted(records: RDD, parts: int) -> RDD:
    return records.repartitionAndSortWithinPartitions(parts, dealt)


def _gathered(records: RDD, start, add, end) -> RDD:
    """Streams the sorted records of each row through ``start(head)``, ``add(state, row, chunk)`` and ``end(state, row)``.

    ``add`` and ``end`` yield what they emit; keys keep their row, so the partitioner stays valid.
    """

    def loop(rows):
        row = state = None
        for (row, place), value in rows:
            if place == HEAD:
                if state is not None:
                    yield from end(state, last)
                state, last = start(value), row
            else:
                yield from add(state, row, value)
        if state is not None:
            yield from end(state, last)

    return records.mapPartitions(loop, preservesPartitioning=True)


def _restored(records: RDD, rule: Rule, parts: int) -> RDD:
    """Chunks in output order to chunks in text order, by the markers alone; the head is extended by the output's digest."""
    home = rule.home()

    def start(head):
        return {"head": head, "digest": hashlib.sha256(), "section": 0, "at": 0}

    def add(state, row, chunk):
        state["digest"].update(chunk)
        if state["head"][2] != PLAIN:
            for marker, section in home:
                if chunk.startswith(marker):
                    state["section"], state["at"], chunk = section, 0, chunk[len(marker) :]
                    break
        yield (row, state["section"] * _SECTION + state["at"]), chunk
        state["at"] += 1

    def end(state, row):
        yield (row, HEAD), (*state["head"], state["digest"].hexdigest())

    return _sorted(_gathered(records, start, add, end), parts)


def _parts(docs: DataFrame, text: str, parts: int | None) -> int:
    """The session's shuffle partitions, or more, so that one holds about ``PART_BYTES`` of text and sorts in memory."""
    if parts:
        return parts
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`").cast("string")))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))


DIGESTS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"


def digests(docs: DataFrame, rule: Rule = Rule(), key: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """Per row: doc_id, n lines, form, length of prefix and middle in code points (null if plain), and the digests of the
    output and of the text restored from it.

    Memory follows a partition's share of the texts, and beyond the workers' limit the sort spills; no text is ever
    built whole after the scan. Null and empty texts are plain, of 0 lines, with the digest of nothing; so is a text that
    holds a marker, as it stands. A null id draws as the empty text. Repeated rows are returned as often as they come.
    Other columns are not read. ``parts``: partitions; by default their number follows the bytes of the texts.
    """
    docs, parts = id_text(docs, key, text), _parts(docs, text, parts)

    def start(head):
        return head, hashlib.sha256()

    def add(state, row, chunk):
        state[1].update(chunk)
        return ()

    def end(state, row):
        yield (*state[0], state[1].hexdigest())

    ordered = _restored(_sorted(_emitted(docs, rule), parts), rule, parts)
    return docs.sparkSession.createDataFrame(_gathered(ordered, start, add, end), DIGESTS, verifySchema=False)


TEXTS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def transform(docs: DataFrame, rule: Rule = Rule(), key: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """As ``digests``, with the output itself: the training text of each row."""
    docs, parts = id_text(docs, key, text), _parts(docs, text, parts)

    def add(state, row, chunk):
        state[1].append(chunk)
        return ()

    def end(state, row):
        yield (*state[0], b"".join(state[1]).decode())

    rows = _gathered(_sorted(_emitted(docs, rule), parts), lambda head: (head, []), add, end)
    return docs.sparkSession.createDataFrame(rows, TEXTS, verifySchema=False)


def restore(outputs: DataFrame, rule: Rule = Rule(), key: str = "doc_id", output: str = "output", form: str = "form", parts: int | None = None) -> DataFrame:
    """doc_id and text, rebuilt from outputs and their forms alone. A null output is an empty text, a null form plain."""
    parts = _parts(outputs, output, parts)
    given = outputs.select(outputs[key].cast("long"), outputs[output].cast("string"), outputs[form].cast("string"))

    def emit(part, rows):
        for at, (doc_id, whole, form) in enumerate(rows):
            row, form, whole = part << 40 | at, form or PLAIN, whole or ""
            yield (row, HEAD), (doc_id, 0, form)
            begins = sorted(whole.find(m) for m in rule.markers) if form != PLAIN else [0]
            for i, (begin, stop) in enumerate(zip(begins, [*begins[1:], len(whole)], strict=True)):
                for j, chunk in enumerate(chunks(whole[begin:stop].encode(), rule.chunk)):
                    yield (row, i * _SECTION + j), chunk

    def add(state, row, chunk):
        state[1].append(chunk)
        return ()

    def end(state, row):
        yield state[0][0], b"".join(state[1]).decode()

    ordered = _restored(_sorted(given.rdd.mapPartitionsWithIndex(emit), parts), rule, parts)
    rows = _gathered(ordered, lambda head: (head, []), add, end)
    return outputs.sparkSession.createDataFrame(rows, "doc_id long, text string", verifySchema=False)


FILL_MIDDLE_SQL = r"""
with lines as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as unit,
    sha256('7:' || cast(doc_id as varchar)) as draw from documents),
drawn as (
  select doc_id, text, unit, cast(len(unit) as bigint) as n,
    cast('0x' || substr(draw, 1, 8) as bigint) % (len(unit) + 1) as h1,
    cast('0x' || substr(draw, 9, 8) as bigint) % (len(unit) + 1) as h2,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>')
           or cast('0x' || substr(draw, 17, 8) as bigint) % 100 >= 100 then 'plain'
         when cast('0x' || substr(draw, 25, 8) as bigint) % 100 < 50 then 'spm' else 'psm' end as form from lines),
parts as (
  select doc_id, text, n, form, array_to_string(unit[1:least(h1, h2)], '') as prefix,
    array_to_string(unit[least(h1, h2) + 1:greatest(h1, h2)], '') as middle,
    array_to_string(unit[greatest(h1, h2) + 1:], '') as suffix from drawn)
select doc_id, n, form,
  case when form <> 'plain' then cast(length(prefix) as bigint) end as prefix_chars,
  case when form <> 'plain' then cast(length(middle) as bigint) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
         else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(case form when 'plain' then text else prefix || middle || suffix end) as restored_sha256
from parts
"""
