"""Spelling variants: words one edit apart, and the frequent form each one leads to.

Words are found by a bit-sliced position index. For every position and letter a bitset tells
which words of a block have that letter there. A query word is followed letter by letter, for
all words of the block at once: one set holds the words that agree so far, three more those
with one letter replaced, one more in the query (its letters meet the position before) and one
more in the word (they meet the position after). Their last states, cut with the sets of words
of the fitting length, are exactly the words one edit away.

Blocks are small because near words meet by what an edit leaves alone: with the edit in one
half, the other half is equal. A word goes to the groups of its halves, for its own length and
the length of a partner with a letter less. A group with more than ``LARGE`` words is told
apart by more letters: its edit window is halved again and again, down to one letter. Groups
are dealt to blocks by hash; words that meet there by chance do no harm, as the index is exact.

Null text has no words; repeated rows count each time; a null id is read as the empty text.
Empty tables give no rows. Other columns of the documents are ignored, whatever their names.
Words that need no form have a null one and are their own root.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featloom.llm.common import join_groups
from featloom.session import cut_lineage

LETTERS = "A-Za-zÀ-ÿ"
UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
HELD = 1 << 18  # words counted in a task before they are sent on
BLOCK = 512  # words of a block, about
LARGE = 2_048  # a group of more words is told apart further


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 6, least: int = 5, slip: int | None = 199) -> DataFrame:
    """(word, n): runs of letters, A-Z lower-cased, with at least ``shortest`` letters and ``least`` occurrences.

    With ``slip``, a run loses one letter where the crc32 ``h`` of ``id:run`` is divisible by
    it, the one at ``h`` modulo its length, before lengths are judged.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, held = re.compile(f"[{LETTERS}]{{{shortest},}}"), Counter()

        def out():
            return pa.record_batch({"word": pa.array(held.keys(), pa.string()), "n": pa.array(held.values(), pa.int64())})

        for batch in batches:
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not text.is_valid:
                    continue
                found = Counter(runs.findall(text.as_py().encode("utf-8", "replace").translate(UPPER).decode()))
                if slip:
                    start = zlib.crc32(f"{id_ or ''}:".encode())
                    hit = [(w, h) for w in found if not (h := zlib.crc32(w.encode(), start)) % slip]
                    for w, h in hit:
                        n, at = found.pop(w), h % len(w)
                        if len(w) > shortest:
                            held[w[:at] + w[at + 1:]] += n
                held.update(found)
                if len(held) >= HELD:
                    yield out()
                    held.clear()
        yield out()

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInArrow(count, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class PositionIndex:
    """Bitsets of the words that have a letter at a position; built position by position."""

    def __init__(self, words: list[str]):
        self.words = sorted(words, key=len, reverse=True)  # those still running come first
        self.length = np.array([len(w) for w in self.words])
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer("".join(self.words).encode("utf-32-le"), np.uint32)
        self.width = -(-len(words) // 64)

    def running(self, position: int) -> int:
        """How many words have a letter at the position."""
        return int(np.searchsorted(-self.length, -position, "left"))

    def pack(self, marks: np.ndarray) -> np.ndarray:
        bits = np.zeros((len(marks), self.width * 8), np.uint8)
        packed = np.packbits(marks, axis=1, bitorder="little")
        bits[:, :packed.shape[1]] = packed
        return bits.view(np.uint64)

    def letters(self, position: int) -> np.ndarray:
        return self.flat[self.start[:self.running(position)] + position]

    def slice(self, position: int) -> tuple[np.ndarray, np.ndarray]:
        """The letters at a position, and a bitset for each; the last bitset is empty."""
        there = self.letters(position) if position >= 0 else self.flat[:0]
        known, which = np.unique(there, return_inverse=True)
        marks = np.zeros((len(known) + 1, len(self.words)), bool)
        marks[which, np.arange(len(there))] = True
        return known, self.pack(marks)

    @staticmethod
    def having(part: tuple[np.ndarray, np.ndarray], letters: np.ndarray) -> np.ndarray:
        known, bits = part
        at = np.searchsorted(known, letters)
        at[at < len(known)] = np.where(known[at[at < len(known)]] == letters[at < len(known)], at[at < len(known)], len(known))
        return bits[at]

    def of_length(self, n: int) -> np.ndarray:
        return self.pack((self.length == n)[None, :])[0]

    def near(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, word) of places in ``words``, one edit apart, both ways round."""
        every = self.pack(np.ones((1, len(self.words)), bool))[0]
        n = len(self.words)
        equal, extra = np.tile(every, (n, 1)), np.tile(every, (n, 1))  # extra: one letter more in the word
        replaced, missing = np.zeros_like(equal), np.zeros_like(equal)  # missing: one letter less in the word
        before, here, after = self.slice(-1), self.slice(0), self.slice(1)
        at = 0
        while n:
            letters = self.letters(at)
            same = self.having(here, letters)
            missing = (missing & self.having(before, letters)) | equal
            replaced = (replaced & same) | (equal & ~same)
            equal &= same
            extra = (extra & self.having(after, letters)) | equal
            at += 1
            left = self.running(at)
            if left < n:  # the shortest of the words still running end here, all of one length
                found = ((replaced[left:] & self.of_length(at)) | (missing[left:] & self.of_length(at - 1)) | (extra[left:] & self.of_length(at + 1)))
                query, word = np.nonzero(np.unpackbits(found.view(np.uint8), axis=1, bitorder="little"))
                yield query + left, word
                equal, extra, replaced, missing = equal[:left], extra[:left], replaced[:left], missing[:left]
                n = left
            before, here, after = here, after, self.slice(at + 1)


def _keyed(rows: DataFrame) -> DataFrame:
    """``key``: the letters outside the edit window [lo, hi) of words of ``size`` letters, or one more."""
    after = F.col("size") - F.col("hi")
    head = F.substring("word", F.lit(1), F.col("lo"))
    tail = F.substring("word", F.length("word") - after + 1, after)
    return rows.withColumn("key", F.xxhash64("size", "lo", "hi", head, tail))


def groups(words: DataFrame, shortest: int, large: int = LARGE) -> DataFrame:
    """(word, n, size, lo, hi, key): near words share a key, and no key has more than ``large`` words."""
    size = F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("size")
    half = F.floor(F.col("size") / 2).cast("int")
    window = F.explode(F.array(F.struct(half.alias("lo"), F.col("size").alias("hi")), F.struct(F.lit(0).alias("lo"), half.alias("hi"))))
    rows = words.select("word", "n", size).where(F.col("size") >= shortest).withColumn("w", window).select("word", "n", "size", "w.lo", "w.hi")
    rows = cut_lineage(_keyed(rows))
    while True:
        sizes = rows.where(F.col("hi") - F.col("lo") > 1).groupBy("key").agg(F.count("*").alias("k"))
        many = cut_lineage(sizes.where(F.col("k") > large))
        if many.isEmpty():
            return rows
        marked = join_groups(rows, many, ["key"], "k", "left")
        middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        halves = F.explode(F.array(F.struct("lo", middle.alias("hi")), F.struct(middle.alias("lo"), "hi")))
        told = marked.where(F.col("k").isNotNull()).withColumn("w", halves).select("word", "n", "size", "w.lo", "w.hi")
        rows = cut_lineage(marked.where(F.col("k").isNull()).drop("k").unionByName(_keyed(told), allowMissingColumns=False))


def near_words(words: DataFrame, shortest: int = 6, large: int = LARGE) -> DataFrame:
    """(word, near, near_n): all pairs of different words one inserted, deleted or replaced letter apart, both ways."""
    rows = groups(words, shortest, large)
    blocks = max(1, rows.count() // BLOCK)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            index = PositionIndex(list(held))
            for query, word in index.near():
                yield pa.record_batch({"word": pa.array([index.words[i] for i in query], pa.string()),
                                       "near": pa.array([index.words[i] for i in word], pa.string()),
                                       "near_n": pa.array([held[index.words[i]] for i in word], pa.int64())})

        at, held = None, {}
        for batch in batches:
            for block, word, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if block != at:
                    if len(held) > 1:
                        yield from out()
                    at, held = block, {}
                held[word] = n
        if len(held) > 1:
            yield from out()

    dealt = rows.select(F.pmod("key", F.lit(blocks)).alias("block"), "word", "n").repartition("block").sortWithinPartitions("block")
    return dealt.mapInArrow(search, "word string, near string, near_n long").distinct()


def variants(words: DataFrame, shortest: int = 6, times: int = 5) -> DataFrame:
    """Per word of (word, n): word, form, root, n, n_near, form_n.

    The form is the near word of largest n, the least one of several, if that has ``times`` the
    word's own n or more. The root is where the forms lead to; n grows at every step, so there are no circles.
    """
    words = cut_lineage(words)
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))).alias("best")
    found = near_words(words, shortest).groupBy("word").agg(F.count("*").alias("n_near"), best)
    joined = words.join(found, "word", "left").withColumn("enough", -F.col("best.n") >= times * F.col("n"))
    held = cut_lineage(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                                     F.when(F.col("enough"), F.col("best.word")).alias("form"),
                                     F.when(F.col("enough"), -F.col("best.n")).alias("form_n")))
    # Pointers are doubled until all of them lead to a root.
    lead = held.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    while True:
        onward = lead.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = cut_lineage(lead.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        lead = step.select("word", "root")
        if step.where("moved").isEmpty():
            break
    return held.join(lead, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
