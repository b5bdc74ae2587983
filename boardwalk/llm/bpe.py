"""Byte-level BPE: encoding with character offsets, decoding, and token counts, over Arrow batches.

The library splits a text into pre-tokens and merges bytes within each. So each distinct pre-token of a batch is
encoded once, and a worker keeps the results of as many pre-tokens as ``KEPT``.
"""

from __future__ import annotations

import base64
import os
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boardwalk.llm.common import giving_back, id_text, over_texts, ragged, raw

KEPT = 100_000
_OPEN: dict = {}


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself where printable, else from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(other)) for b in range(256)]


class ByteBPE:
    """One vocabulary: a tokenizers ``.json`` file, or a ``.tiktoken`` file of ranks with the pattern that splits.

    Rank files become a tokenizers model: their bytes as characters, and the merges that the ranks imply.
    """

    def __init__(self, path: str, pattern: str):
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.pattern = regex.compile(pattern)
        names = byte_characters()
        self.names = dict(enumerate(names))
        back = {c: b for b, c in enumerate(names)}
        self.path = path
        if path.endswith(".json"):
            self.library = Tokenizer.from_file(path)
            self.special = [x.content for x in self.library.get_added_tokens_decoder().values()]
        else:
            self.library = _from_ranks(_ranks(path), names)
            self.special = []
        # The byte table in reverse, over the library's own token strings.
        tokens = self.library.get_vocab(with_added_tokens=False)
        self.bytes_of = {i: bytes(map(back.__getitem__, token)) for token, i in tokens.items() if all(c in back for c in token)}
        self.bytes_of |= {self.library.token_to_id(text): text.encode() for text in self.special}
        self.spots = _Spots(self)
        self.table: tuple | None = None
        self.known: dict[str, tuple] = {}
        self.found: dict[str, tuple] = {}

    def prove_whole_tokens(self) -> dict[str, int]:
        """The vocabulary strings that are one pre-token and encode alone as one token, as the library says.

        A pre-token equal to one of them counts 1 without any merge.
        """
        if not self.known:
            texts = []
            for token in self.bytes_of.values():
                try:
                    text = token.decode("utf-8")
                except UnicodeDecodeError:
                    continue
                if text not in self.special and self.pattern.findall(text) == [text]:
                    texts.append(text)
            encoded = self.library.encode_batch_fast(texts, add_special_tokens=False)
            self.known = {t: tuple(e.ids) for t, e in zip(texts, encoded, strict=True) if len(e.ids) == 1}
        return self.known

    def pre_tokens(self, texts: list[str]) -> list[list[str]]:
        return [self.pattern.findall(text) for text in texts]

    def ids(self, split: list[list[str]]) -> dict[str, tuple]:
        """The ids of every pre-token in ``split``: whole tokens as proved, the others merged by the library."""
        known = self.prove_whole_tokens()
        if len(self.found) > KEPT:
            self.found.clear()
        for text in set(chain.from_iterable(split)):
            if text not in known and text not in self.found:
                self.found[text] = self.merged(text)
        return _Both(known, self.found)

    def token_bytes(self) -> tuple[np.ndarray, np.ndarray]:
        """How many bytes each id stands for (0 if it is none), and the bytes of all, in order of the ids."""
        if self.table is None:
            given = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)]
            self.table = np.array([len(x) for x in given], np.int64), np.frombuffer(b"".join(given), np.uint8)
        return self.table

    def merged(self, text: str) -> tuple:
        """The ids of one pre-token by the library's merges."""
        characters = text.encode("utf-8").decode("latin-1").translate(self.names)
        return tuple(token.id for token in self.library.model.tokenize(characters))

    def piece(self, part: bytes) -> list[int] | tuple:
        """The same of a pre-token's bytes; for rank files by the library that reads them itself."""
        return self.merged(part.decode("utf-8")) if self.core is None else self.core.encode_single_piece(part)

    @cached_property
    def core(self):
        if self.path.endswith(".json"):
            return None
        import tiktoken

        return tiktoken.Encoding(self.path, pat_str=self.pattern.pattern, mergeable_ranks=_ranks(self.path), special_tokens={})._core_bpe


class _Spots(dict):
    """A number for each pre-token met, in order, and under it the ids; forgets all when there are more than ``KEPT``."""

    def __init__(self, own: ByteBPE):
        super().__init__()
        self.own = own
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.met = []
        self.flat, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def __missing__(self, text: str) -> int:
        spot = self[text] = len(self)
        self.met.append(self.own.known.get(text) or self.own.merged(text))
        return spot

    def ids(self, split: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts one after the other, and how many each has."""
        if len(self) > KEPT:
            self.forget()
        self.own.prove_whole_tokens()
        spots = np.fromiter(map(self.__getitem__, chain.from_iterable(split)), np.int64)
        if self.met:
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(self.met), np.int32)])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum([len(x) for x in self.met])])
            self.met = []
        begin = self.ends[spots]
        n = self.ends[spots + 1] - begin
        total = np.concatenate([[0], np.cumsum(n)])
        flat = self.flat[np.repeat(begin - total[:-1], n) + np.arange(total[-1])]
        last = np.cumsum([len(x) for x in split])
        return flat, np.diff(np.concatenate([[0], total[last]]))


class _Both(dict):
    """Looks up the second mapping, then the first."""

    def __init__(self, first, second):
        super().__init__()
        self.first, self.get_second = first, second.get

    def __getitem__(self, key):
        got = self.get_second(key)
        return self.first[key] if got is None else got


def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def _from_ranks(ranks: dict[bytes, int], names: list[str]):
    """A tokenizers model with the same result: a token's merge joins the two parts that lower ranks leave of it."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    def parts(token: bytes, limit: int) -> list[bytes]:
        now = [bytes([b]) for b in token]
        while len(now) > 2:
            joined = [ranks.get(a + b, limit) for a, b in zip(now, now[1:])]
            low = min(joined)
            if low >= limit:
                break
            i = joined.index(low)
            now[i : i + 2] = [now[i] + now[i + 1]]
        return now

    text = lambda token: "".join(names[b] for b in token)
    merges = [tuple(map(text, p)) for token, rank in sorted(ranks.items(), key=lambda x: x[1]) if len(token) > 1 and len(p := parts(token, rank)) == 2]
    library = Tokenizer(models.BPE({text(t): r for t, r in ranks.items()}, merges))
    library.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return library


def vocabulary(path: str, pattern: str) -> ByteBPE:
    """One a worker process."""
    if (path, pattern) not in _OPEN:
        _OPEN[path, pattern] = ByteBPE(path, pattern)
    return _OPEN[path, pattern]


def token_counts(docs: DataFrame, path: str, pattern: str, limit: int = 512, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens as the tokenizers library counts them, over_limit (n_tokens > limit).

    Pre-tokens that are proved whole tokens count one; only the others are merged. A text with the string of a special
    token is encoded by the library as it is. Nulls count as empty texts; ids may be null or repeated.
    """

    def work(batch):
        own = vocabulary(path, pattern)
        texts = batch.column("text").fill_null("").to_pylist()
        plain = [t if not any(s in t for s in own.special) else "" for t in texts]
        split = own.pre_tokens(plain)
        ids = own.ids(split)
        sizes = _Sizes(ids)
        n = [sum(map(sizes.__getitem__, s)) for s in split]
        for i, (t, p) in enumerate(zip(texts, plain, strict=True)):
            if t and not p:
                n[i] = len(own.library.encode(t, add_special_tokens=False).ids)
        n = np.array(n, np.int64)
        return {"doc_id": batch.column("doc_id"), "n_bytes": np.diff(raw(batch.column("text"))[1]), "n_tokens": n, "over_limit": n > limit}

    return over_texts(id_text(docs, key, text), work, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


class _Sizes(dict):
    def __init__(self, ids):
        super().__init__()
        self.ids = ids

    def __missing__(self, key):
        n = self[key] = len(self.ids[key])
        return n


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, ids, and starts: the place of each token's first character in the text, from 0.

    A token that begins inside a character starts at that character. Special strings are ordinary text. Nulls
    are encoded as empty texts.
    """

    def work(batch):
        own = vocabulary(path, pattern)
        flat, n = own.spots.ids(own.pre_tokens(batch.column("text").fill_null("").to_pylist()))
        lengths, _ = own.token_bytes()
        data, offsets = raw(batch.column("text"))
        sizes = lengths[flat]
        begin = np.cumsum(sizes) - sizes
        character = np.cumsum((data & 0xC0) != 0x80) - 1
        row = np.repeat(np.arange(len(n)), n)
        starts = character[begin] - character[offsets[:-1][row]] if len(flat) else np.zeros(0, np.int64)
        return {"doc_id": batch.column("doc_id"), "ids": ragged(flat, n, pa.int32()), "starts": ragged(starts.astype(np.int32), n, pa.int32())}

    return over_texts(id_text(docs, key, text), work, "doc_id long, ids array<int>, starts array<int>")


def decode(encoded: DataFrame, path: str, pattern: str, ids: str = "ids", as_text: bool = True) -> DataFrame:
    """The rows with ``bytes`` (the tokens' bytes, exact) and, unless ``as_text`` is off, ``text`` (the same, with U+FFFD
    where they are not UTF-8, as when ids cut a character). Null ids give nulls; an id that the vocabulary lacks is an
    error. Columns of these names are replaced."""
    kept = encoded.drop("bytes", *["text"] * as_text)
    place = kept.columns.index(ids)

    def loop(batches):
        own = vocabulary(path, pattern)
        lengths, buffer = own.token_bytes()
        first = np.cumsum(lengths) - lengths
        for batch in batches:
            for rows in _runs(batch, place):
                column = rows.column(place)
                flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                if len(flat) and (flat.min() < 0 or flat.max() >= len(lengths) or (lengths[flat] == 0).any()):
                    raise ValueError("an id is not in the vocabulary")
                n = lengths[flat]
                data = buffer[np.repeat(first[flat] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                each = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                ends = np.concatenate([[0], np.cumsum(n)])[np.cumsum(each)]
                offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32)).buffers()[1]
                whole = pa.Array.from_buffers(pa.binary(), len(rows), [None, offsets, pa.py_buffer(np.ascontiguousarray(data))])
                whole = pc.if_else(column.is_valid(), whole, pa.scalar(None, pa.binary()))
                out = [*rows.columns, whole]
                if as_text:
                    out.append(pa.array([None if x is None else x.decode("utf-8", "replace") for x in whole.to_pylist()], pa.string()))
                yield pa.RecordBatch.from_arrays(out, names)

    added = [T.StructField("bytes", T.BinaryType()), T.StructField("text", T.StringType())]
    kinds = T.StructType([*kept.schema.fields, *added[: 1 + as_text]])
    names = kinds.names
    return kept.mapInArrow(giving_back(loop), kinds)


def _runs(batch: pa.RecordBatch, place: int, size: int = 1 << 18):
    """The batch cut into runs of rows with about ``size`` ids."""
    lengths = batch.column(place).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(lengths.tolist()):
        if total and total + n > size:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if batch.num_rows > start:
        yield batch.slice(start)


def round_trip(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, and the SHA-256 of the ids (decimal, joined by spaces) and of the bytes that they
    decode to: of what ``encode`` gives, and of what ``decode`` makes of it. Nulls are empty texts."""
    back = decode(encode(docs, path, pattern, key, text), path, pattern, as_text=False)
    decimal = F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")
    return back.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimal.cast("binary"), 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256")
    )
