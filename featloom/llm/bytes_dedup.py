"""Removal of repeated byte strings with suffix arrays.

Every byte covered by a string of ``LEAST`` bytes that starts earlier too (in a smaller doc_id,
or earlier in the same document) is removed; strings are judged on the input.

All strings of that length are dealt to shards by the least hash among their grams: equal
strings always meet in one shard, and neighbouring strings mostly share it, so that one passage
of text stands for a run of them. Grams that occur once are found by counting hashes, and their
passages never travel. A shard sorts its passages' suffixes by Larsson-Sadakane refinement (each
round sorts what is still tied by the ranks half-way), Kasai's recurrence gives the common
prefixes of neighbours, and neighbours that share the full length are one string. One gram's
passages that are too many for one suffix array make several shards; later ones look their
strings up in the earlier ones' by binary search on hashes, compare the bytes, and add what is
new: of a string only its hash and place are kept beside the passages. Equal
passages are told off in the task that finds them, so copies by the million travel once per task.

Texts are UTF-8 bytes, null is empty; texts shorter than ``LEAST`` lose nothing. Rows that share
doc_id and text are one document; of one doc_id with several texts any fixed order holds; a
null doc_id comes after all others. Long texts are worked on in pieces. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featloom.session import cut_lineage

LEAST = 100
GRAM = 32
REACH = LEAST - GRAM + 1  # grams inside one string
PIECE = 1 << 20  # string starts handled at once
PLACE_BITS = 21
SHARD = 1 << 20  # bytes of passages in one suffix array
ROWS = 1 << 12  # passages of a batch sent on
COMPARED = 1 << 16  # strings whose bytes are compared at once
MAX_FILTER_BITS = 29  # 64 MB
MAX_COPIES = 200_000  # texts with copies that tasks are told of
LAST = (1 << 63) - 1
U = np.uint64


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each place on."""
    h = (data.astype(U) + U(1)) * U(0x9E3779B97F4A7C15)
    width = 1
    while width < GRAM:
        h = (h[:-width] ^ (h[:-width] >> U(31))) * U(0xD6E8FEB86659FD93) + h[width:]
        width *= 2
    h = (h ^ (h >> U(32))) * U(0xFF51AFD7ED558CCD)
    return h ^ (h >> U(29))


def runs(data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(gram hash, first start, last start) of runs of strings with the same least gram."""
    for at in range(0, max(0, len(data) - LEAST + 1), PIECE):
        h = gram_hashes(data[at:at + PIECE + LEAST - 1])
        low = (U(1) << U(PLACE_BITS)) - U(1)
        key = (h & ~low) | np.arange(len(h), dtype=U)
        width, least = 1, key
        while width * 2 <= REACH:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        rest = REACH - width
        least = np.minimum(least[:len(least) - rest], least[rest:]) if rest else least
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        last = np.concatenate([first[1:], [len(least)]]) - 1
        # Least hashes are small; mixed again they spread over buckets and filter bits.
        grams = h[(least[first] & low).astype(np.int64)] * U(0xC4CEB9FE1A85EC53)
        yield grams ^ (grams >> U(32)), first + at, last + at


def refine(text: np.ndarray, depth: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order by the first ``depth`` bytes, and ranks that are equal where these are equal.

    Larsson-Sadakane: after sorting by eight bytes only groups that are still tied are sorted
    again, by the ranks found so far ``h`` places on. The last step reaches ``depth`` exactly.
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(U)
    key, width = padded, 1
    while width < 8:
        key = (key[:-width] << U(8 * width)) | key[width:]
        width *= 2
    key = key[:n]
    order = np.argsort(key)
    fresh = np.concatenate([[True], key[order[1:]] != key[order[:-1]]])
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    h = 8
    while h < depth:
        step = min(h, depth - h)
        starts = np.flatnonzero(fresh)
        sizes = np.diff(np.append(starts, n))
        tied = np.flatnonzero(np.repeat(sizes > 1, sizes))
        if not len(tied):
            break
        at = order[tied]
        ahead = np.where(at + step < n, rank[np.minimum(at + step, n - 1)] + 1, 0)
        pair = (rank[at] << 32) | ahead
        sub = np.argsort(pair)
        order[tied], pair = at[sub], pair[sub]
        new = np.concatenate([[True], pair[1:] != pair[:-1]])
        fresh[tied] = new
        rank[order[tied]] = tied[np.flatnonzero(new)][np.cumsum(new) - 1]
        h += step
    return order, rank


def common_prefixes(text: np.ndarray, rank: np.ndarray, before: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Kasai: bytes (LEAST at most) that each string shares with the one before it in order.

    ``before`` holds that string's place for the ``counts`` strings of each passage, -1 for none.
    The recurrence (one byte on, at most one byte less) runs through all passages side by side.
    """
    out = np.zeros(len(text), np.int64)
    inside = np.zeros(len(text) + 1, bool)
    for_all = np.repeat(starts, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    inside[for_all] = True
    lanes = np.arange(len(starts))
    k = np.zeros(len(starts), np.int64)
    ahead = np.full(len(starts), -2)
    for step in range(int(counts.max(initial=0))):
        lanes = lanes[counts[lanes] > step]
        p = starts[lanes] + step
        q = before[p]
        # The bound holds if the neighbour's next string is in the order as well, and before this
        # one: sure if the two differed, or if the ranks say that these two are tied again.
        known = (q >= 0) & (ahead[lanes] >= 0) & inside[ahead[lanes] + 1] & ((k[lanes] < LEAST) | (rank[p] == rank[q]))
        k[lanes] = np.where(known, np.maximum(k[lanes] - 1, 0), 0)
        live = np.flatnonzero((q >= 0) & (k[lanes] < LEAST))
        while len(live):
            lane = lanes[live]
            same = text[p[live] + k[lane]] == text[q[live] + k[lane]]
            live = live[same]
            k[lanes[live]] += 1
            live = live[k[lanes[live]] < LEAST]
        out[p] = k[lanes]
        ahead[lanes] = q
    return out


def string_hashes(text: np.ndarray) -> np.ndarray:
    """Hash of the LEAST bytes from each place on, from those of the grams that cover them."""
    grams, n = gram_hashes(text), len(text) - LEAST + 1
    out = grams[:n]
    for at in (GRAM, 2 * GRAM, LEAST - GRAM):
        out = (out ^ (out >> U(31))) * U(0xD6E8FEB86659FD93) + grams[at:at + n]
    return out


class Earlier:
    """The different strings of a gram's shards so far: passages, and in order of hash where each string starts in them."""

    def __init__(self):
        self.text, self.hashes, self.starts = np.empty(0, np.uint8), np.empty(0, U), np.empty(0, np.int64)

    def holds(self, text: np.ndarray, starts: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Which strings are among them; where hashes are equal, bytes are compared."""
        if not len(self.hashes):
            return np.zeros(len(starts), bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        out = self.hashes[at] == hashes
        found = np.flatnonzero(out)
        view, own = (np.lib.stride_tricks.sliding_window_view(t, LEAST) for t in (text, self.text))
        for i in range(0, len(found), COMPARED):
            some = found[i:i + COMPARED]
            out[some] = (view[starts[some]] == own[self.starts[at[some]]]).all(axis=1)
        return out

    def add(self, text: np.ndarray, starts: np.ndarray, hashes: np.ndarray) -> None:
        by = np.argsort(hashes)
        at = np.searchsorted(self.hashes, hashes[by])
        self.hashes = np.insert(self.hashes, at, hashes[by])
        self.starts = np.insert(self.starts, at, starts[by] + len(self.text))
        if len(starts):
            self.text = np.concatenate([self.text, text])


class Shards:
    """The passages of one task, in order of gram and place; yields removed ranges (id, mark, start, end)."""

    def __init__(self):
        self.held: list[tuple] = []
        self.size = 0
        self.gram = None
        self.earlier: Earlier | None = None  # of this gram's shards so far
        self.out: list[tuple[int, int, int, int]] = []

    def add(self, gram: int, doc: int, mark: int, start: int, data: bytes) -> None:
        if gram != self.gram:
            if self.size >= SHARD // 2 or self.earlier is not None:
                self.settle(False)
            self.gram = gram
        elif self.size >= SHARD:
            # Only the running gram goes on; whatever came before it is complete.
            self.settle(True)
        self.held.append((gram, doc, mark, start, data))
        self.size += len(data)

    def settle(self, goes_on: bool) -> None:
        held, self.held, self.size = self.held, [], 0
        if not held:
            return
        seen: dict[bytes, int] = {}
        first = []
        for row in held:  # in order of place within a gram, so the first one seen is the earliest
            if row[4] in seen and first[seen[row[4]]][0] == row[0]:
                old = first[seen[row[4]]]
                if old[1:4] == row[1:4]:
                    continue  # the same place, from a repeated row
                early, late = (old, row) if old[1:4] <= row[1:4] else (row, old)
                first[seen[row[4]]] = early
                self.out.append((late[1], late[2], late[3], late[3] + len(late[4])))
            else:
                seen[row[4]] = len(first)
                first.append(row)
        text = np.frombuffer(b"".join(r[4] for r in first), np.uint8)
        lengths = np.array([len(r[4]) for r in first])
        starts = np.cumsum(lengths) - lengths
        counts = lengths - LEAST + 1
        order, rank = refine(text)
        passage = np.repeat(np.arange(len(first)), lengths)
        offset = np.arange(len(text)) - starts[passage]
        strings = order[offset[order] < counts[passage[order]]]  # strings only, in suffix order
        before = np.full(len(text), -1)
        before[strings[1:]] = strings[:-1]
        shared = common_prefixes(text, rank, before, starts, counts)
        group = np.cumsum(shared[strings] < LEAST)
        doc, mark, place = (np.array([r[i] for r in first], np.int64)[passage[strings]] for i in (1, 2, 3))
        place = place + offset[strings]
        by = np.lexsort((place, mark, doc, group))
        again = np.ones(len(strings), bool)
        again[by[np.flatnonzero(np.concatenate([[True], group[by][1:] != group[by][:-1]]))]] = False
        if self.earlier is not None or goes_on:
            own = np.array([r[0] == self.gram for r in first])[passage[strings]]
            hashes = string_hashes(text)[strings]
            if self.earlier is not None:
                again |= self.earlier.holds(text, strings, hashes)
            if goes_on:
                fresh = own & ~again
                self.earlier = self.earlier or Earlier()
                self.earlier.add(text, strings[fresh], hashes[fresh])
            else:
                self.earlier = None
        gone = np.zeros(len(text), bool)
        gone[strings[again]] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (gone).astype(np.int8), [0]])))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            # Passages end LEAST - 1 places after their last string, so no stretch crosses into the next.
            r, o = first[passage[a]], int(offset[a])
            self.out.append((r[1], r[2], r[3] + o, r[3] + o + (b - a) + LEAST - 1))

    def flush(self) -> pa.RecordBatch:
        rows, self.out = self.out, []
        columns = list(zip(*rows)) or [[], [], [], []]
        return pa.record_batch({n: pa.array(c, pa.int64()) for n, c in zip(("id", "mark", "start", "end"), columns)})


def joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal ranges; touching ones become one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _documents(batches: Iterator[pa.RecordBatch], copies: dict[bytes, int]) -> Iterator[tuple[int, int, np.ndarray, bytes]]:
    """(id, mark, bytes) of documents long enough, of copies the first one only."""
    for batch in batches:
        for text, doc in zip(batch.column(0), batch.column(1).to_pylist()):
            data = (text.as_py() or "").encode("utf-8", "replace")
            doc = LAST if doc is None else doc
            if len(data) >= LEAST:
                digest = xxhash.xxh3_128_digest(data)
                if copies.get(digest, doc) == doc:
                    yield doc, int.from_bytes(digest[:8], "big", signed=True), np.frombuffer(data, np.uint8), data


def copied_texts(texts: DataFrame) -> dict[bytes, int]:
    """Digest and least id of texts that occur in several documents; none if they are too many to tell."""
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [(t.as_py() or "").encode("utf-8", "replace") for t in batch.column(0)]
            keep = [i for i, d in enumerate(data) if len(d) >= LEAST]
            ids = batch.column(1).to_pylist()
            yield pa.record_batch({"digest": pa.array([xxhash.xxh3_128_digest(data[i]) for i in keep], pa.binary()),
                                   "id": pa.array([LAST if ids[i] is None else ids[i] for i in keep], pa.int64())})

    groups = (texts.mapInArrow(digest, "digest binary, id long").groupBy("digest")
              .agg(F.min("id").alias("id"), F.max("id").alias("high")).where(F.col("id") < F.col("high")))
    rows = groups.select("digest", "id").limit(MAX_COPIES + 1).collect()
    return {} if len(rows) > MAX_COPIES else {bytes(r.digest): r.id for r in rows}


def repeated_grams(texts: DataFrame, copies, bucket_bits: int) -> DataFrame:
    """(bucket, grams): hashes of least grams that head two runs or more."""
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            every = np.sort(np.concatenate(held))
            buckets = (every >> U(64 - bucket_bits)).astype(np.int64)
            edges = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1], [True]]))
            return pa.record_batch({"bucket": pa.array(buckets[edges[:-1]]),
                                    "grams": pa.array([every[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])], pa.binary())})

        held, size = [], 0
        for _, _, data, _ in _documents(batches, copies.value):
            for grams, _, _ in runs(data):
                held.append(grams)
                size += len(grams)
            if size > 1 << 20:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            grams, counts = np.unique(np.concatenate(held), return_counts=True)
            return pa.record_batch({"bucket": pa.array([at]), "n": pa.array([int((counts > 1).sum())], pa.int64()),
                                    "grams": pa.array([grams[counts > 1].tobytes()], pa.binary())})

        at, held = None, []
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if bucket != at:
                    if held:
                        yield out()
                    at, held = bucket, []
                held.append(np.frombuffer(blob, U))
        if held:
            yield out()

    return (texts.mapInArrow(spread, "bucket long, grams binary").repartition("bucket").sortWithinPartitions("bucket")
            .mapInArrow(gather, "bucket long, n long, grams binary"))


def gram_filter(grams: DataFrame, part: int, parts: int, bits: int) -> np.ndarray:
    """Packed bit array of the repeated grams of one of several parts."""
    stretch = min(bits, 20)

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        for batch in batches:
            for blob in batch.column("grams").to_pylist():
                mine = np.frombuffer(blob, U)
                places = (mine[mine % U(parts) == U(part)] >> U(64 - bits)).astype(np.int64)
                for s in np.unique(places >> stretch).tolist():
                    if s != at:
                        if at is not None:
                            yield pa.record_batch({"at": pa.array([at]), "bits": pa.array([np.packbits(held).tobytes()], pa.binary())})
                        at, held = s, np.zeros(1 << stretch, bool)
                    held[places[places >> stretch == s] & ((1 << stretch) - 1)] = True
        if at is not None:
            yield pa.record_batch({"at": pa.array([at]), "bits": pa.array([np.packbits(held).tobytes()], pa.binary())})

    array = np.zeros(max(1, (1 << bits) // 8), np.uint8)
    width = (1 << stretch) // 8
    for row in grams.sortWithinPartitions("bucket").mapInArrow(marks, "at long, bits binary").collect():  # bounded by the array's size
        array[row.at * width:(row.at + 1) * width] |= np.frombuffer(row.bits, np.uint8)
    return array


def passages(texts: DataFrame, copies, array: np.ndarray, part: int, parts: int, bits: int) -> DataFrame:
    """(gram, id, mark, start, data, end): passages for the shards, or with null ``data`` ranges already known to repeat."""
    shared = texts.sparkSession.sparkContext.broadcast(array)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            rows = known + [(g, *place, data, place[2] + len(data)) for (g, data), place in first.items()]
            columns = list(zip(*rows)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
            whole = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["gram", "id", "mark", "start", "data", "end"])
            for at in range(0, whole.num_rows, ROWS):  # the JVM holds one batch a task beside its heap
                yield whole.slice(at, ROWS)

        marks, first, known, size = shared.value, {}, [], 0
        for doc, mark, data, raw in _documents(batches, copies.value):
            for grams, a, b in runs(data):
                at = (grams >> U(64 - bits)).astype(np.int64)
                hit = (marks[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0
                if parts > 1:
                    hit &= grams % U(parts) == U(part)
                for i in np.flatnonzero(hit).tolist():
                    key = int(grams[i].view(np.int64)), raw[a[i]:b[i] + LEAST]
                    place = doc, mark, int(a[i])
                    old = first.get(key)
                    if old is None:
                        first[key] = place
                        size += len(key[1])
                    elif old != place:  # not a repeated row
                        early, late = (old, place) if old <= place else (place, old)
                        first[key] = early
                        known.append((None, *late, None, late[2] + len(key[1])))
            if size > 1 << 24 or len(known) > 100_000:
                yield from out()
                first, known, size = {}, [], 0
        yield from out()

    return texts.mapInArrow(run, "gram long, id long, mark long, start long, data binary, end long")


def repeated_ranges(texts: DataFrame, copies) -> DataFrame:
    """(id, mark, start, end): removed ranges, not yet joined."""
    spark = texts.sparkSession
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bucket_bits = max(6, int(np.ceil(np.log2(max(1, total / (REACH / 2) / (1 << 18))))))
    grams = cut_lineage(repeated_grams(texts, copies, bucket_bits))
    n = grams.agg(F.sum("n")).first()[0] or 0
    bits = max(13, min(MAX_FILTER_BITS, int(np.ceil(np.log2(max(1, n) * 16)))))
    parts = max(1, -(-n * 4 // (1 << bits)))  # at least four bits a gram; more grams take more passes
    found = None
    for part in range(parts):
        one = passages(texts, copies, gram_filter(grams, part, parts, bits), part, parts, bits)
        found = one if found is None else found.unionByName(one)
    # Known ranges have no gram; spread by place they take the same way through.
    found = found.withColumn("deal", F.coalesce("gram", F.xxhash64("id", "start")))

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = Shards()
        for batch in batches:
            for gram, doc, mark, start, data, end in zip(*(batch.column(c).to_pylist() for c in ("gram", "id", "mark", "start", "data", "end"))):
                if data is None:
                    shards.out.append((doc, mark, start, end))
                else:
                    shards.add(gram, doc, mark, start, data)
            if len(shards.out) > 20_000:
                yield shards.flush()
        shards.settle(False)
        yield shards.flush()

    return (found.repartition("deal").sortWithinPartitions("gram", "id", "mark", "start").drop("deal")
            .mapInArrow(sort, "id long, mark long, start long, end long"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``id_col``, n_bytes, spans (removed byte ranges, maximal), kept (remaining bytes).

    ``id_col`` is an integer column.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("id"))
    copies = spark.sparkContext.broadcast(copied_texts(texts))
    ranges = cut_lineage(repeated_ranges(texts, copies).groupBy("id").agg(
        F.collect_set(F.struct("mark", "start", "end")).alias("ranges")))
    known = F.coalesce(F.col("id"), F.lit(LAST))
    lookup = ranges.withColumnRenamed("id", "own")
    size = ranges.agg(F.sum(F.size("ranges"))).first()[0] or 0
    lookup = F.broadcast(lookup) if size <= 1 << 20 else lookup  # 24 MB; a larger one is joined by shuffling
    frame = texts.withColumn("known", known).join(lookup, F.col("known") == F.col("own"), "left").select("text", "id", "ranges")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, spans, kept = [], [], []
            for text, doc, held in zip(batch.column("text"), batch.column("id").to_pylist(), batch.column("ranges").to_pylist()):
                data = (text.as_py() or "").encode("utf-8", "replace")
                found = []
                if len(data) >= LEAST and (held or copies.value):
                    digest = xxhash.xxh3_128_digest(data)
                    doc = LAST if doc is None else doc
                    if copies.value.get(digest, doc) != doc:
                        found = [(0, len(data))]
                    elif held:
                        mark = int.from_bytes(digest[:8], "big", signed=True)
                        found = joined([(r["start"], r["end"]) for r in held if r["mark"] == mark])
                sizes.append(len(data))
                spans.append([{"start": a, "end": b} for a, b in found])
                edges = [0, *(x for r in found for x in r), len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
            yield pa.record_batch({"id": batch.column("id"), "n_bytes": pa.array(sizes, pa.int64()),
                                   "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                                   "kept": pa.array(kept, pa.binary())})

    out = frame.mapInArrow(cut, "id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    return out.withColumnRenamed("id", id_col)
