"""Byte-level BPE encoding and decoding by forced-boundary splitting.

A merge joins two neighbouring symbols into a token of the vocabulary, so the two bytes that
meet in it stand side by side inside that token. Byte pairs inside no token at all therefore
mark certain cuts: nothing is ever merged across them. Texts are cut there, the fragments are
encoded on their own (each distinct one once per cache), and the ids are put together.

The cut must not disturb the pattern that splits texts before merging either. It is made only
before a full character, after one that isn't white space (so no look-ahead over white space
is pending) and not before an apostrophe (so no contraction starts there). Everything else in
a fragment is left to the pattern and the merges. Strings of special tokens are cut out first
and stand for their ids, as the vocabulary file asks.

Null text is the empty text and gives no ids. Very long texts are handled in pieces that end
at certain cuts; a fragment without any cut is merged with a heap, in n log n steps.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from featloom.llm.common import give_back
from featloom.session import small_batches

PIECE = 1 << 20  # bytes of a text handled at once
CACHE = 150_000  # fragments kept, and as many older ones; some 130 bytes each
#: The pattern that splits texts before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens as bytes, merge ranks, special tokens and the byte pairs found inside tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        self.tokens: dict[int, bytes] = {i: raw(t) for t, i in data["model"]["vocab"].items()}
        self.ids = {t: i for i, t in self.tokens.items()}
        merges = (m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"])
        self.ranks = {}
        for rank, (a, b) in enumerate(merges):
            a, b = raw(a), raw(b)
            self.ranks[self.ids[a], self.ids[b]] = (rank, self.ids[a + b])
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.tokens |= {i: t.encode() for t, i in self.special.items()}
        self.inside = np.zeros((256, 256), bool)
        for token in self.ids:
            self.inside[list(token[:-1]), list(token[1:])] = True

    def parts(self) -> dict:
        """What tasks need, a few MB to broadcast; workers unpack it once, not for every task."""
        return {"ids": self.ids, "ranks": self.ranks, "special": self.special, "inside": self.inside, "cache": (Fragments(), {})}


class Fragments(dict):
    """Fragment to packed ids (int32); what is missing comes from the encoder at work."""

    encoder: Encoder

    def __missing__(self, fragment: bytes) -> bytes:
        return self.encoder.missing(fragment)


class Encoder:
    """Encodes texts fragment by fragment.

    ``parts["cache"]`` lives as long as the worker that holds the broadcast: a younger half, and
    an older one that is asked before merging again. A full younger half becomes the older one.
    """

    def __init__(self, parts: dict, pattern: str = PATTERN):
        self.young, self.old = parts["cache"]
        self.young.encoder = self
        self.parts, self.ids, self.ranks, self.special, self.inside = parts, *(parts[k] for k in ("ids", "ranks", "special", "inside"))
        self.single = [self.ids[bytes([b])] for b in range(256)]
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = regex.compile(pattern)
        byte = np.arange(256)
        self.starts = (byte & 0xC0) != 0x80  # first byte of a character
        self.starts[0x27] = False
        self.ends = (byte < 0x80) & (byte > 0x20) & (byte != 0x7F)  # ASCII, not white space or control
        self.two = (byte >= 0xC3) & (byte <= 0xDF)  # two-byte characters without white space among them

    def missing(self, fragment: bytes) -> bytes:
        out = self.old.get(fragment)
        if out is None:
            out = np.array(self.fresh(fragment), np.int32).tobytes()
        if len(self.young) >= CACHE:
            self.old, self.young = self.young, Fragments()
            self.young.encoder = self
            self.parts["cache"] = self.young, self.old
        self.young[fragment] = out
        return out

    def fresh(self, fragment: bytes) -> list[int]:
        if fragment[fragment[:1] == b" ":].isalpha():  # ASCII letters after a blank or none: one word
            return self.merge(fragment)
        return [i for word in self.words.findall(fragment.decode()) for i in self.merge(word.encode())]

    def merge(self, word: bytes) -> list[int]:
        """Merges of lowest rank first, leftmost first among equals."""
        symbols = [self.single[b] for b in word]
        return self.merge_short(symbols) if len(symbols) <= 32 else self.merge_long(symbols)

    def merge_short(self, symbols: list[int]) -> list[int]:
        ranks, none = self.ranks, (1 << 30, 0)
        found = [ranks.get(pair, none) for pair in zip(symbols, symbols[1:])]
        while found and (best := min(found)) is not none:
            i = found.index(best)
            symbols[i:i + 2] = [best[1]]
            del found[i]
            if i < len(found):
                found[i] = ranks.get((best[1], symbols[i + 1]), none)
            if i:
                found[i - 1] = ranks.get((symbols[i - 1], best[1]), none)
        return symbols

    def merge_long(self, symbols: list[int]) -> list[int]:
        """The same with a heap of the possible merges, in n log n steps."""
        ranks, n = self.ranks, len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(found[0], i, symbols[i], symbols[i + 1], found[1]) for i in range(n - 1)
                if (found := ranks.get((symbols[i], symbols[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, joined = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue  # one of the two has been merged meanwhile
            symbols[i], symbols[j], after[i] = joined, None, after[j]
            if after[j] < n:
                before[after[j]] = i
                if found := ranks.get((joined, symbols[after[i]])):
                    heapq.heappush(heap, (found[0], i, joined, symbols[after[i]], found[1]))
            if (k := before[i]) >= 0 and (found := ranks.get((symbols[k], joined))):
                heapq.heappush(heap, (found[0], k, symbols[k], joined, found[1]))
        return [s for s in symbols if s is not None]

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """Places where a fragment may certainly end."""
        left, right = data[:-1], data[1:]
        end = self.ends[left]
        end[1:] |= self.two[left[:-1]] & (left[1:] >= 0x80)
        return np.flatnonzero(end & self.starts[right] & ~self.inside[left, right]) + 1

    def fragments(self, text: bytes) -> Iterator[list[bytes]]:
        start = 0
        while start < len(text):
            size = PIECE
            while True:
                stop = min(len(text), start + size)
                piece = text[start:stop]
                places = self.cuts(np.frombuffer(piece, np.uint8)).tolist()
                if stop == len(text):
                    places.append(len(piece))
                if places:
                    break
                size *= 2  # no certain cut so far
            yield [piece[a:b] for a, b in zip([0, *places], places)]
            start += places[-1]

    def encode(self, text: str) -> np.ndarray:
        out = []
        for part in self.split.split(text) if self.split else [text]:
            if part in self.special:
                out.append(np.array([self.special[part]], np.int32).tobytes())
            elif part:
                for group in self.fragments(part.encode("utf-8", "replace")):
                    out.extend(map(self.young.__getitem__, group))
        return np.frombuffer(b"".join(out), np.int32)


def encode(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", ids_col: str = "ids",
           carry: list[str] | None = None, pattern: str = PATTERN) -> DataFrame:
    """``docs`` (or its columns ``carry``) with the token ids of the text, ``array<int>``.

    A column called like the output is replaced, other names never clash. An empty table gives
    an empty result.
    """
    carried = [c for c in (carry if carry is not None else docs.columns) if c != ids_col]
    names = [f"c{i}" for i in range(len(carried))]
    frame = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), *[F.col(c).alias(n) for c, n in zip(carried, names)])
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary.parts())
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        encoder = Encoder(shared.value, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                block = batch.slice(at, 256)
                found = [encoder.encode(t) for t in block.column(0).to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([*block.columns[1:], ids], names=[*names, "ids"])

    fields = "".join(f"{n} {docs.schema[c].dataType.simpleString()}, " for c, n in zip(carried, names))
    return frame.mapInArrow(run, f"{fields}ids array<int>").toDF(*carried, ids_col)


def decode(ids: Column, vocabulary: Vocabulary, spark) -> Column:
    """The text of an id array; bytes that are no UTF-8 become U+FFFD, unknown ids nothing."""
    width = max(vocabulary.tokens, default=-1) + 1
    shared = spark.sparkContext.broadcast([vocabulary.tokens.get(i, b"") for i in range(width + 1)])  # the last one stands for unknown ids
    small_batches(spark)

    @arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        give_back()
        tokens, out = pa.array(shared.value, pa.binary()), []
        for at in range(0, len(column), 256):
            rows = column.slice(at, 256)
            ids = pc.fill_null(rows.flatten(), width).to_numpy(zero_copy_only=False)
            known = tokens.take(pa.array(np.where((ids >= 0) & (ids < width), ids, width)))
            lengths = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
            offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
            joined = pc.if_else(rows.is_valid(), pc.binary_join(pa.ListArray.from_arrays(offsets, known), b""), None)
            try:
                out.append(joined.cast(pa.string()))
            except pa.ArrowInvalid:  # some text isn't UTF-8
                out.append(pa.array([None if t is None else t.decode("utf-8", "replace") for t in joined.to_pylist()], pa.string()))
        return pa.concat_arrays(out) if out else pa.array([], pa.string())

    return run(ids)
