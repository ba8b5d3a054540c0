"""Benchmark decontamination with a generalised suffix automaton.

The automaton holds every run of words of every test item. A document's words stream through
it; the state tells the longest run ending at the current word that some item contains. Where
that length reaches a window (13 words, or the whole of a shorter item), the window's words
are hit and its items noted.

Words are runs of digits, letters a-z (A-Z lower-cased) and non-ASCII characters. Null or
wordless texts have no words and no hits; null or wordless items have no window. Rows with the
same item_id count as one item, a null item_id as the item "". Repeated documents are judged
each on its own. An empty benchmark leaves everything clean.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 13
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def folding() -> bytes:
    """Byte table: A-Z to lower case, other ASCII outside 0-9 and a-z to a blank."""
    word = lambda b: b > 0x7F or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A
    return bytes(b + 32 if 0x41 <= b <= 0x5A else b if word(b) else 32 for b in range(256))


def words(text: str | None, table: bytes) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(table).split()


class Automaton:
    """Suffix automaton over the word numbers of several items.

    Almost every state has one transition and at most one item, so these stand in arrays of
    32-bit numbers; only states with more of them have a dictionary.
    """

    def __init__(self, window: int = WINDOW):
        self.window, self.vocab = window, {}
        self.word, self.to = array("i", [-1]), array("i", [-1])  # the first transition of a state
        self.more: dict[int, dict[int, int]] = {}  # all further ones
        self.link, self.length = array("i", [-1]), array("i", [0])
        self.names: list[str] = []  # item ids; items are numbers elsewhere
        self.owner = array("i")  # item of a full window, by state
        self.owners: dict[int, set[int]] = {}  # all further ones
        self.shorts: dict[int, list[tuple[int, int]]] = {}  # state of a whole short item: its length and number
        self.at_window, self.short_above = array("i"), array("i")
        self.least = window

    def step(self, state: int, w: int) -> int:
        """The state after one more word, -1 where there is none."""
        if self.word[state] == w:
            return self.to[state]
        others = self.more.get(state)
        return others.get(w, -1) if others else -1

    def _set(self, state: int, w: int, to: int) -> None:
        if self.word[state] in (-1, w):
            self.word[state], self.to[state] = w, to
        else:
            self.more.setdefault(state, {})[w] = to

    def _add(self, length: int) -> int:
        for values, value in ((self.word, -1), (self.to, -1), (self.link, 0), (self.length, length)):
            values.append(value)
        return len(self.link) - 1

    def _clone(self, p: int, w: int, q: int) -> int:
        clone = self._add(self.length[p] + 1)
        self.word[clone], self.to[clone], self.link[clone] = self.word[q], self.to[q], self.link[q]
        if q in self.more:
            self.more[clone] = dict(self.more[q])
        self.link[q] = clone
        while p >= 0 and self.step(p, w) == q:
            self._set(p, w, clone)
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int) -> int:
        q = self.step(last, w)
        if q >= 0:  # another item has this run already
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, w, q)
        new, p = self._add(self.length[last] + 1), last
        while p >= 0 and self.step(p, w) < 0:
            self._set(p, w, new)
            p = self.link[p]
        if p >= 0:
            q = self.step(p, w)
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, w, q)
        return new

    def build(self, items: list[tuple[str, list[bytes]]]) -> "Automaton":
        numbered, known = [], {}
        for name, text in items:
            if text:
                run = array("i", [self.vocab.setdefault(w, len(self.vocab)) for w in text])
                numbered.append((known.setdefault(name, len(known)), run))
                last = 0
                for w in run:
                    last = self._extend(last, w)
        self.names, self.owner = list(known), array("i", [-1]) * len(self.link)
        for item, run in numbered:
            n, state = min(self.window, len(run)), 0
            for i, w in enumerate(run):
                state = self.step(state, w)
                while self.length[self.link[state]] >= n:
                    state = self.link[state]
                if i + 1 >= n:
                    if n == self.window:
                        if self.owner[state] < 0:
                            self.owner[state] = item
                        elif self.owner[state] != item:
                            self.owners.setdefault(state, set()).add(item)
                    else:
                        self.shorts.setdefault(state, []).append((n, item))
                        self.least = min(self.least, n)
        order = np.argsort(np.frombuffer(self.length, np.int32), kind="stable")
        self.at_window, self.short_above = array("i", [0]) * len(order), array("i", [-1]) * len(order)
        for s in map(int, order[1:]):
            above = self.link[s]
            self.at_window[s] = self.at_window[above] if self.length[above] >= self.window else s
            self.short_above[s] = s if s in self.shorts else self.short_above[above]
        return self

    def match(self, run: list[int], at: int, ranges: list[tuple[int, int]], items: set[int]) -> None:
        """Adds the hit word ranges and items of a run of known words that starts at word ``at``."""
        state, size = 0, 0
        for i, w in enumerate(run, at + 1):
            while (after := self.step(state, w)) < 0 and state:
                state = self.link[state]
                size = self.length[state]
            if after >= 0:
                state, size = after, size + 1
            if size >= self.window and (found := self.owner[self.at_window[state]]) >= 0:
                ranges.append((i - self.window, i))
                items.add(found)
                items |= self.owners.get(self.at_window[state], set())
            s = self.short_above[state]
            while s > 0:
                for n, item in self.shorts[s]:
                    if n <= size:
                        ranges.append((i - n, i))
                        items.add(item)
                s = self.short_above[self.link[s]]

    def scan(self, text: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit word ranges (disjoint, in order) and items of one document."""
        ranges, items = [], set()
        if len(text) < self.least or not self.vocab:
            return ranges, items
        get = self.vocab.get
        ids = np.fromiter((get(w, -1) for w in text), np.int32, len(text))
        breaks = np.flatnonzero(ids < 0)
        edges = np.concatenate([[-1], breaks, [len(ids)]])
        for k in np.flatnonzero(np.diff(edges) > self.least):
            self.match(ids[edges[k] + 1:edges[k + 1]].tolist(), int(edges[k]) + 1, ranges, items)
        return joined(ranges), {self.names[i] for i in items}


def joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def automata(items: DataFrame, id_col: str, text_col: str, window: int, block_bytes: int) -> Iterator[Automaton]:
    """Automata of blocks of items, each of about ``block_bytes`` of text; blocks go by the hash of the text."""
    total = items.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    blocks, table = -(-total // block_bytes), folding()
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64(text_col), F.lit(blocks)) == block)
        rows = part.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col)).collect()
        yield Automaton(window).build([(i, words(t, table)) for i, t in rows if t is not None])


def find(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id",
         item_text_col: str = "text", window: int = WINDOW, block_bytes: int = 1 << 23,
         carry: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``carry``) with the finds.

    Adds ``n_words``, ``n_hit`` (words inside windows), ``items`` (their ids, sorted) and
    ``spans`` (hit passages as code point ranges of the text). Documents never shuffle.
    Benchmarks larger than ``block_bytes`` are matched block after block in the same pass.
    Columns called like the four are replaced unless ``carry`` names them, other names never clash.
    """
    carried = list(carry) if carry is not None else [c for c in docs.columns if c not in ("n_words", "n_hit", "items", "spans")]
    # Positional names inside: any column names may come in, even these.
    names = [f"c{i}" for i in range(len(carried))]
    frame = docs.select(F.col(text_col).alias("text"), *[F.col(c).alias(n) for c, n in zip(carried, names)],
                        F.array().cast("array<int>").alias("edges"), F.array().cast("array<string>").alias("items"),
                        F.lit(None).cast("long").alias("n"))
    kinds = "".join(f"{n} {docs.schema[c].dataType.simpleString()}, " for c, n in zip(carried, names))
    table = folding()
    context = docs.sparkSession.sparkContext
    for automaton in automata(items, item_col, item_text_col, window, block_bytes):
        shared = context.broadcast(vars(automaton))

        def look(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            machine = Automaton()
            vars(machine).update(shared.value)
            for batch in batches:
                edges, found, counts = batch.column("edges").to_pylist(), batch.column("items").to_pylist(), []
                for i, text in enumerate(batch.column("text")):
                    run = words(text.as_py(), table)
                    counts.append(len(run))
                    ranges, items = machine.scan(run)
                    if ranges:
                        before = edges[i]
                        every = joined([*zip(before[::2], before[1::2]), *ranges])
                        edges[i] = [x for r in every for x in r]
                        found[i] = sorted({*found[i], *items})
                kept = [batch.column(c) for c in ["text", *names]]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(edges, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.string())), pa.array(counts, pa.int64())],
                    names=["text", *names, "edges", "items", "n"])

        frame = frame.mapInArrow(look, f"text string, {kinds}edges array<int>, items array<string>, n long")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lower, word = str.maketrans(UPPER, UPPER.lower()), re.compile(WORD)
        for batch in batches:
            counts, hits, spans = [], [], []
            for text, edges, n in zip(batch.column("text"), batch.column("edges").to_pylist(), batch.column("n").to_pylist()):
                counts.append(len(words(text.as_py(), table)) if n is None else n)  # no item, no count so far
                hits.append(sum(edges[1::2]) - sum(edges[::2]))
                places = [m.span() for m in word.finditer(text.as_py().translate(lower))] if edges else []
                spans.append([{"start": places[a][0], "end": places[b - 1][1]} for a, b in zip(edges[::2], edges[1::2])])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in names], pa.array(counts, pa.int64()), pa.array(hits, pa.int64()), batch.column("items"),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                names=[*names, "n_words", "n_hit", "items", "spans"])

    out = frame.mapInArrow(measure, f"{kinds}n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>")
    return out.toDF(*carried, "n_words", "n_hit", "items", "spans")


def contaminated(coverage_in: int = 20) -> Column:
    """At least one hit, and one hit word in ``coverage_in``."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * coverage_in >= F.col("n_words"))


def cut_spans(text: Column, spans: Column) -> Column:
    """The text without its spans."""
    return F.aggregate(F.reverse(spans), F.coalesce(text, F.lit("")), lambda rest, s: F.concat(
        F.substring(rest, F.lit(1), s["start"]), F.substring(rest, s["end"] + 1, F.length(rest))))


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", coverage_in: int = 20,
                  span_words: int | None = None, **names) -> DataFrame:
    """Documents without those covered beyond the limit; same columns.

    ``span_words`` also cuts the passages of at least so many words out of the others;
    None leaves documents below the coverage limit as they are.
    """
    own = [f"d{i}" for i in range(len(docs.columns))]
    at = own[docs.columns.index(text_col)]
    found = find(docs.toDF(*own), items, text_col=at, **names).where(~contaminated(coverage_in))
    if span_words is not None:
        long = F.filter("spans", lambda s: F.size(F.regexp_extract_all(
            F.substring(F.col(at), s["start"] + 1, s["end"] - s["start"]), F.lit("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"), F.lit(0))) >= span_words)
        found = found.withColumn(at, F.when(F.size("spans") > 0, cut_spans(F.col(at), long)).otherwise(F.col(at)))
    return found.select(*[F.col(a).alias(b) for a, b in zip(own, docs.columns)])
