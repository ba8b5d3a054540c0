"""Near duplicates by a grouped prefix join on word shingles.

A document's set holds its distinct five-word shingles. Sets of similarity 3/4 or more must
share a token among the first n - ceil(3n/4) + 1 of a common order, the prefix. The order puts
tokens that many prefixes hold last, the others by hash. Documents with identical prefix and
size form one group; tokens are joined on groups, and group pairs are filtered by size and by
how many prefix tokens they share, before members are expanded and verified on whole sets.

Classes are wanted, not pairs, so links inside a class needn't all be looked at. First every
group is verified against one leader, the most central group of the lists it is in; then all
pairs that share a token and still belong to different classes are. Sets with a common leader,
however far from it, differ from each other in what they differ from it, but for what both do:
these differences are compared in blocks of sets, and no pairs are listed. No link between
classes can be missed that way; copies near their leader cost one comparison each.

Words are runs without ASCII white space, A-Z lower-cased. With fewer than five words the whole
sequence is one shingle; without any (null, empty or blank text) the set is empty and the
document is alone. Rows with equal sets are linked. A null doc_id never names a class unless
all of its rows have none. Hashes: 64 bits a shingle, 128 bits a set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featloom.llm import bloom
from featloom.llm.common import give_back, join_groups, remove_path, squeeze, unsqueeze
from featloom.llm.components import connected_components
from featloom.session import cut_lineage, lean, scratch_path

WORDS = 5
SPREAD = 0xC4CEB9FE1A85EC53  # odd
SIMILAR = (75, 100)  # intersection >= 75/100 of the union
PER_BUCKET = 1 << 18  # tokens counted together, about
OFTEN = 24  # a token of so many prefixes goes to the end of the order
MAX_OFTEN = 1 << 20  # at most so many, the most frequent; 8 MB to broadcast
MAX_FILTER_BITS = 29  # 64 MB
LOT = 1024  # sets with a common leader that a task compares with as many others
COLUMNS = 4096  # tokens counted at once in that
PIECE = 1 << 18  # bytes of a text whose words are hashed at once
UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


class Words:
    """Hashes of the words of a text, all at once.

    A word's hash is a polynomial of its bytes, the difference of two running sums over the
    text, moved to a common place; texts are handled in pieces that end between words.
    """

    def __init__(self):
        draw = np.random.Generator(np.random.PCG64(20))
        self.value = draw.integers(0, 1 << 64, 256, np.uint64, endpoint=False)
        self.base = 0x9E3779B97F4A7C15
        self.white = np.zeros(256, bool)
        self.white[[0x20, *range(0x09, 0x0E)]] = True
        self.grow(PIECE)

    def grow(self, n: int) -> None:
        self.power = np.full(n + 1, self.base, np.uint64)
        self.power[0] = 1
        np.multiply.accumulate(self.power, out=self.power)
        self.back = np.full(n + 1, pow(self.base, -1, 1 << 64), np.uint64)
        self.back[0] = 1
        np.multiply.accumulate(self.back, out=self.back)

    def __call__(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every word, and where it begins."""
        out, begins, start = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
        while start < len(text):
            size = PIECE
            while True:
                data = np.frombuffer(text, np.uint8, min(size, len(text) - start), start)
                white = self.white[data]
                last = start + size >= len(text)
                if last or white.any():
                    break
                size *= 2  # one word so far
            if not last:
                end = len(data) - int(np.argmax(white[::-1]))  # after the last white space
                data, white = data[:end], white[:end]
            if len(data) > len(self.power) - 1:
                self.grow(2 * len(data))
            edges = np.flatnonzero(np.diff(np.concatenate([[True], white, [True]])))
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(self.value[data] * self.power[:len(data)], out=sums[1:])
            begin = edges[::2]
            h = (sums[edges[1::2]] - sums[begin]) * self.back[begin]
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            out.append(h ^ (h >> np.uint64(32)))
            begins.append(begin + start)
            start += len(data)
        return np.concatenate(out), np.concatenate(begins)


def mixed(w: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` words in a row."""
    out = np.full(max(0, len(w) - n + 1), n, np.uint64)
    for i in range(n):
        out = (out ^ w[i:len(w) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def distinct(tokens: np.ndarray) -> np.ndarray:
    tokens = np.sort(tokens)
    return tokens[np.concatenate([[True], tokens[1:] != tokens[:-1]])] if len(tokens) else tokens


def shingles(texts: list[bytes | None], words: Words) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; texts are hashed together, with a line break between them."""
    raw = [t or b"" for t in texts]
    hashes, begins = words(b"\n".join(raw).translate(UPPER))
    ends = np.cumsum([len(t) + 1 for t in raw])
    edges = [0, *np.searchsorted(begins, ends).tolist()]
    every = mixed(hashes, WORDS)
    return [distinct(every[a:b - WORDS + 1]) if b - a >= WORDS else mixed(hashes[a:b], b - a) if b > a else hashes[:0]
            for a, b in zip(edges, edges[1:])]


def signature(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def spread_out(tokens: np.ndarray) -> np.ndarray:
    """Another hash, one to one: prefixes hold the small hashes, which would crowd few ranges."""
    out = tokens * np.uint64(SPREAD)
    return out ^ (out >> np.uint64(32))


def drawn_back(spread: np.ndarray) -> np.ndarray:
    """The tokens whose other hash is ``spread``."""
    return (spread ^ (spread >> np.uint64(32))) * np.uint64(pow(SPREAD, -1, 1 << 64))


def prefix_size(n):
    """Tokens of a prefix (works on columns, too)."""
    return n - _ceil(SIMILAR[0] * n, SIMILAR[1]) + 1


def index_size(n):
    """Tokens of the smaller set that must be looked at in a pair: enough for a shared one even if
    the other is no larger, and 3 % more so that several must be shared (works on columns, too)."""
    return n - _ceil(2 * SIMILAR[0] * n, SIMILAR[0] + SIMILAR[1]) + 1 + _floor(3 * n, 100)


def _floor(a, b):
    return F.floor(a / b).cast("int") if isinstance(a, Column) else a // b


def _ceil(a, b):
    return F.ceil(a / b).cast("int") if isinstance(a, Column) else -(-a // b)


class Order:
    """Tokens by hash, those of many prefixes last; and which tokens may be shared at all."""

    def __init__(self, often: np.ndarray, bits: np.ndarray):
        self.often, self.bits = often, bits
        self.shift = np.uint64(64 - (len(bits) * 8).bit_length() + 1)

    def prefix(self, tokens: np.ndarray) -> np.ndarray:
        late = np.zeros(len(tokens), bool)
        if len(self.often):
            at = np.minimum(np.searchsorted(self.often, tokens), len(self.often) - 1)
            late = self.often[at] == tokens
        return np.concatenate([tokens[~late], tokens[late]])[:prefix_size(len(tokens))]

    def shared(self, tokens: np.ndarray) -> np.ndarray:
        at = (spread_out(tokens) >> self.shift).astype(np.int64)
        return tokens[(self.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0]


def _sets(batches: Iterator[pa.RecordBatch], words: Words) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Short stretches of rows with the sets of their texts."""
    for whole in batches:
        for at in range(0, whole.num_rows, 128):
            batch = whole.slice(at, 128)
            yield batch, shingles(batch.column(0).to_pylist(), words)


def _longs(tokens: np.ndarray) -> pa.Array:
    return pa.array(tokens.view(np.int64))


def token_counts(texts: DataFrame, filter_bits: int, bucket_bits: int, often: np.ndarray, exact: bool) -> DataFrame:
    """Per range of tokens: a bit array of tokens in two prefixes or more, and the frequent ones if ``exact``.

    The prefixes are those of the order with ``often`` last. Tokens travel as differences of their
    sorted hashes; without ``exact`` 48 bits of each, so that few tokens of one prefix pass the array.
    """
    kept = 64 if exact else 48
    low = max(3, filter_bits - bucket_bits)
    shared = texts.sparkSession.sparkContext.broadcast(often)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        hashes, order, seen, held, size = Words(), Order(shared.value, np.zeros(1, np.uint8)), set(), [], 0

        def out():
            every = np.concatenate(held)
            held.clear()
            every = spread_out(every)  # one copy, from here on changed in place
            every >>= np.uint64(64 - kept)
            every.sort()
            ends = np.searchsorted(every, np.arange(1, 1 << bucket_bits, dtype=np.uint64) << np.uint64(kept - bucket_bits))
            edges = np.concatenate([[0], ends, [len(every)]])
            used = np.flatnonzero(np.diff(edges))
            parts = [squeeze(np.diff(every[edges[i]:edges[i + 1]], prepend=np.uint64(0))) for i in used]
            return pa.record_batch({"bucket": pa.array(used), "k": pa.array(np.diff(edges)[used].astype(np.int64)), "tokens": pa.array(parts, pa.binary())})

        for _, sets in _sets(batches, hashes):
            for tokens in sets:
                own = signature(tokens)
                if len(tokens) and own not in seen:  # copies in one task count once
                    seen.add(own)
                    held.append(order.prefix(tokens))
                    size += len(held[-1])
            if size > 1 << 19:
                yield out()
                size = 0
        if size:
            yield out()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            again = tokens[counts > 1]
            bits = np.zeros(1 << low, bool)
            bits[((again >> np.uint64(kept - filter_bits)) & np.uint64((1 << low) - 1)).astype(np.int64)] = True
            frequent = counts >= OFTEN if exact else np.zeros(len(counts), bool)
            return pa.record_batch({"bucket": pa.array([at]), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary()),
                                    "often": pa.array([drawn_back(tokens[frequent]).tobytes()], pa.binary()),
                                    "counts": pa.array([counts[frequent].astype(np.int64).tobytes()], pa.binary())})

        give_back()
        at, held = None, []
        for batch in batches:
            for bucket, k, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != at:
                    if held:
                        yield out()
                    at, held = bucket, []
                held.append(np.cumsum(unsqueeze(blob, k, np.uint64), dtype=np.uint64))
        if held:
            yield out()

    return (texts.mapInArrow(spread, "bucket long, k long, tokens binary").repartition("bucket").sortWithinPartitions("bucket")
            .mapInArrow(gather, "bucket long, bits binary, often binary, counts binary"))


def token_order(texts: DataFrame, tokens: int) -> Order:
    """The common order; what reaches the driver is bounded by the filter's and the list's sizes.

    Prefixes by hash alone tell which tokens are frequent. With these last the prefixes are
    others, so they are counted once more to see which tokens can be shared at all.
    """
    buckets = max(6, int(np.ceil(np.log2(max(1, tokens / 4 / PER_BUCKET)))))  # a quarter of the tokens are in prefixes
    bits = max(buckets + 3, min(MAX_FILTER_BITS, int(np.ceil(np.log2(max(1, tokens))))))  # four to eight for a token of a prefix

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.record_batch({"token": _longs(np.frombuffer(a, np.uint64)), "n": pa.array(np.frombuffer(b, np.int64))})

    rows = cut_lineage(token_counts(texts, bits, buckets, np.empty(0, np.uint64), True))
    top = rows.select("often", "counts").mapInArrow(listed, "token long, n long").orderBy(F.desc("n"), "token").limit(MAX_OFTEN).collect()
    often = np.sort(np.array([r.token for r in top], np.int64).view(np.uint64))
    if len(often):
        rows = token_counts(texts, bits, buckets, often, False)
    array = np.zeros((1 << bits) // 8, np.uint8)
    width = len(array) >> buckets
    for row in rows.select("bucket", "bits").collect():
        array[row.bucket * width:(row.bucket + 1) * width] = np.frombuffer(row.bits, np.uint8)
    return Order(often, array)


def postings(texts: DataFrame, order: Order) -> DataFrame:
    """(token, early, grp, n, sig, id): a row per document with ``token`` null, and one per shared
    prefix token of each group; ``early`` tokens are among the first ``index_size(n)``."""
    shared = texts.sparkSession.sparkContext.broadcast((order.often, order.bits))
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        own, hashes, groups = Order(*shared.value), Words(), set()
        for batch, sets in _sets(batches, hashes):
            tokens, early, grps, sizes, sigs = [], [], [], [], []
            for every in sets:
                grp, sig, rows, first = None, None, every[:0], 0
                if len(every):
                    prefix, sig = own.prefix(every), signature(every)
                    grp = xxhash.xxh3_64_intdigest(prefix.tobytes(), seed=len(every)) - (1 << 63)
                    if grp not in groups:  # alike documents of one task send their prefix once
                        groups.add(grp)
                        first = own.shared(prefix[:index_size(len(every))])
                        rows, first = np.concatenate([first, own.shared(prefix[index_size(len(every)):])]), len(first)
                tokens += [np.zeros(1, np.uint64), rows]
                early.append(np.arange(-1, len(rows)) < first)
                grps.append(grp)
                sizes.append(len(every))
                sigs.append(sig)
            counts = np.array([len(e) for e in early])
            doc = np.repeat(np.arange(len(counts)), counts)
            head = np.concatenate([[True], doc[1:] != doc[:-1]])
            heads = pa.array(doc, mask=~head)
            yield pa.record_batch({
                "token": pa.array(np.concatenate(tokens).view(np.int64), mask=head), "early": pa.array(np.concatenate(early)),
                "grp": pa.array(grps, pa.int64()).take(pa.array(doc)), "n": pa.array(np.array(sizes, np.int32)[doc]),
                "sig": pa.array(sigs, pa.binary()).take(heads), "id": batch.column(1).take(heads)})

    return texts.mapInArrow(run, f"token long, early boolean, grp long, n int, sig binary, id {kind}")


def whole_sets(texts: DataFrame, made: DataFrame, asked: DataFrame) -> DataFrame:
    """(sig, n, tokens): the sets of the signatures ``asked``, of one document each.

    A Bloom filter of these documents' ids (64 MB at most) picks the texts to be looked at again;
    what it lets through by chance goes in the join.
    """
    spark = texts.sparkSession
    chosen = cut_lineage(made.where(F.col("sig").isNotNull()).join(asked, "sig").groupBy("sig").agg(F.min("id").alias("id")))
    prints = chosen.select(F.xxhash64("id").alias("h"))
    bits = bloom.repeated_bits(prints.unionAll(prints), chosen.count())  # each comes twice, so its bits are set

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        hashes = Words()
        for _, found in _sets(batches, hashes):
            yield pa.record_batch({"sig": pa.array(map(signature, found), pa.binary()), "n": pa.array(map(len, found), pa.int32()),
                                   "tokens": pa.array([squeeze(np.diff(t, prepend=np.uint64(0))) for t in found], pa.binary())})

    picked = texts.where(bloom.may_repeat(F.xxhash64("id"), bits, spark))
    return picked.mapInArrow(sets, "sig binary, n int, tokens binary").join(chosen.select("sig"), "sig").dropDuplicates(["sig"])


def differences(leader: np.ndarray, tokens: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, int]:
    """The tokens that are in one of the two sets only, and how many of them are early; ``found``: which of ``tokens`` the leader has.

    Let d(s) be the tokens in which s differs from the leader l. Near sets s and t differ from
    each other in (|s| + |t|) / 7 tokens at most, and t, if not near l, from l in more than
    (|t| + |l|) / 7. So d(s) and d(t) share more than (|d(s)| + (|l| - |s|) / 7) / 2 tokens; in
    any common order all but so many, and one more, hold a shared one: d(s)'s early ones.
    The order puts first what the leader lacks, as several sets seldom have the same of that.
    """
    own = tokens[~found]
    gone = np.ones(len(leader), bool)
    gone[np.searchsorted(leader, tokens[found])] = False
    every = np.concatenate([own, leader[gone]])
    return every, len(every) - (7 * len(every) + len(leader) - len(tokens)) // 14


def verify(texts: DataFrame, made: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, both, union, n, k, apart) for pairs (a, b) of set signatures: sizes of intersection and union, counted on
    whole sets, and of b; the tokens in which b differs from a, packed, and their number.

    Each left set is sent once for a few hundred partners, so a leader of thousands is shared out.
    Where each set goes is settled first, on signatures; the sets themselves travel twice, to
    their signature's task and from there to all leaders.
    """
    wanted = cut_lineage(pairs.groupBy("a").agg(F.count("*").alias("k")))
    lots = F.ceil(F.col("k") / 256).cast("int")
    left = wanted.select(F.col("a").alias("sig"), "a", F.explode(F.sequence(F.lit(0), lots - 1)).alias("lot"), F.lit(None).cast("binary").alias("b"))
    right = join_groups(pairs, wanted, ["a"], "k").select(F.col("b").alias("sig"), "a", F.pmod(F.xxhash64("b"), lots).cast("int").alias("lot"), "b")
    asked = wanted.select(F.col("a").alias("sig")).unionByName(pairs.select(F.col("b").alias("sig"))).distinct()
    sent = whole_sets(texts, made, asked).join(left.unionByName(right), "sig").select("a", "lot", "b", "n", "tokens")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        leader, own = None, np.empty(0, np.uint64)
        for batch in batches:
            out = ([], [], [], [], [], [], [])
            for a, b, n, blob in zip(*(batch.column(c) for c in ("a", "b", "n", "tokens"))):
                tokens = np.cumsum(unsqueeze(blob.as_py(), n.as_py(), np.uint64), dtype=np.uint64)
                if not b.is_valid:
                    leader, own = a.as_py(), tokens
                    continue
                at = np.minimum(np.searchsorted(own, tokens), len(own) - 1)
                found = own[at] == tokens
                both = int(found.sum())
                union = len(own) + len(tokens) - both
                apart = np.sort(differences(own, tokens, found)[0])
                for column, value in zip(out, (leader, b.as_py(), both, union, len(tokens), len(apart), squeeze(np.diff(apart, prepend=np.uint64(0))))):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["a", "b", "both", "union", "n", "k", "apart"])

    kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return (sent.repartition("a", "lot").sortWithinPartitions("a", "lot", F.col("b").asc_nulls_first())
            .mapInArrow(judge, "a binary, b binary, both long, union long, n int, k int, apart binary"))


def similar() -> Column:
    return SIMILAR[1] * F.col("both") >= SIMILAR[0] * F.col("union")


def links(texts: DataFrame, made: DataFrame) -> DataFrame:
    """Links (a, b) between set signatures that connect the same sets as all links do; ``made`` are the postings."""
    members = cut_lineage(made.where(F.col("sig").isNotNull()).select("grp", "n", "sig").distinct())
    shared = made.where(F.col("token").isNotNull()).select("token", "early", "grp", "n").dropDuplicates(["token", "grp"])
    sized = shared.groupBy("token").agg(F.count("*").alias("m")).where(F.col("m") > 1)
    # How central a group is: how many others its prefix tokens have, on average. Of a family of
    # altered copies the original has the most, and is near all of them, while two copies needn't be near.
    counted = join_groups(shared, cut_lineage(sized), ["token"], "m")
    path = scratch_path(made.sparkSession, "jaccard-lists")
    counted.write.parquet(path)
    try:
        return _links(texts, made, members, made.sparkSession.read.parquet(path))
    finally:
        remove_path(made.sparkSession, path)


def _links(texts: DataFrame, made: DataFrame, members: DataFrame, lists: DataFrame) -> DataFrame:
    n, n2 = F.col("n"), F.col("n2")
    central = cut_lineage(lists.groupBy("grp").agg(F.sum("m").alias("m"), F.first("n").alias("n")).select("grp", (F.col("m") / prefix_size(n)).alias("score")))
    first = members.groupBy("grp").agg(F.min("sig").alias("first"))
    # Members of one group against its first.
    inside = members.join(first, "grp").where(F.col("first") != F.col("sig")).select(F.col("first").alias("a"), F.col("sig").alias("b"))
    band = F.floor(F.log(n.cast("double")) / np.log(SIMILAR[1] / SIMILAR[0])).cast("int")
    at = lists.join(central, "grp").withColumn("band", band)
    leaders = at.groupBy("token", "band").agg(F.max(F.struct("score", "grp")).alias("lead"), F.count("*").alias("k")).where(F.col("k") > 1)
    met = join_groups(at, cut_lineage(leaders), ["token", "band"], "k").where(F.col("lead.grp") != F.col("grp"))
    voted = met.groupBy("grp", "n", F.col("lead.grp").alias("lead"), F.col("lead.score").alias("score")).agg(F.count("*").alias("c"))
    # Far ones, too: comparing differences in blocks costs less than pairs of all that share a token.
    best = voted.where(F.col("c") * 100 >= n).groupBy("grp").agg(F.max(F.struct("c", "score", "lead")).alias("best")).select("grp", F.col("best.lead").alias("lead"))
    pairs = (cut_lineage(best).join(first.select(F.col("grp").alias("lead"), F.col("first").alias("a")), "lead")
             .join(members.select("grp", F.col("sig").alias("b")), "grp").select("a", "b").unionByName(inside).distinct())
    tested = cut_lineage(verify(texts, made, cut_lineage(pairs)))
    linked = tested.where(similar()).select("a", "b")
    # One label per set, and per group if its sets agree; which leader a set was verified against.
    labels = cut_lineage(connected_components(linked))
    led = tested.groupBy(F.col("b").alias("sig")).agg(F.max(F.struct(1 - F.col("both") / F.col("union"), "a")).alias("x")).select("sig", F.col("x.a").alias("lead"))  # an own group's first and a leader: either will do
    split = cut_lineage(members.join(labels, members.sig == labels.node, "left").join(led, "sig", "left")
                        .select("grp", "sig", F.coalesce("label", "sig").alias("label"), F.coalesce("lead", "sig").alias("lead")))
    label, lead = F.xxhash64("label"), F.xxhash64("lead")
    whole = split.groupBy("grp").agg(F.min(label).alias("label"), F.max(label).alias("other"), F.min(lead).alias("lead"), F.max(lead).alias("lead2"))
    agreed = F.col("label") == F.col("other")
    state = cut_lineage(whole.select("grp", F.when(agreed, F.col("label")).otherwise(F.col("grp")).alias("label"), F.when(F.col("lead") == F.col("lead2"), F.col("lead")).alias("lead"),
                                     (~agreed).alias("torn")))
    beside = _beside(tested, split)
    # All pairs that share enough prefix tokens and are still apart, members and all.
    at = lists.drop("m").join(state, "grp")
    mixed_ = at.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("k")).where(F.col("low") != F.col("high")).select("token", "k")
    apart = join_groups(at, cut_lineage(mixed_), ["token"], "k").drop("k")
    # The smaller set's early tokens against all prefix tokens of larger ones. With at least
    # ``need`` common tokens, the first n - need + j of both share j of them, for every j. Those with
    # a common leader have been compared by their differences from it.
    other = apart.select("token", *[F.col(c).alias(f"{c}2") for c in ("grp", "n", "label", "lead")])
    least, most = SIMILAR
    met = apart.where("early").join(other, "token").where(
        (F.struct("n", "grp") < F.struct(n2.alias("n"), F.col("grp2").alias("grp"))) & (F.col("label") != F.col("label2")) & (n * most >= n2 * least)
        & ~F.coalesce(F.col("lead") == F.col("lead2"), F.lit(False)))
    counted = met.groupBy("grp", "grp2", "n", "n2").agg(F.count("*").alias("c"))
    need = _ceil((n + n2) * least, least + most)
    common = F.greatest(F.lit(1), F.least(index_size(n) - n, 1 - _ceil(n2 * least, most)) + need)
    close = counted.where(F.col("c") >= common).select("grp", "grp2")
    # A group whose members ended up in several classes counts as apart from itself, too.
    close = close.unionByName(state.where("torn").select("grp", F.col("grp").alias("grp2")))
    held = split.select("grp", "sig", "label", "lead")
    pairs = (close.join(held.toDF("grp", "a", "la", "ha"), "grp").join(held.toDF("grp2", "b", "lb", "hb"), "grp2")
             .where((F.col("la") != F.col("lb")) & (F.col("ha") != F.col("hb")))
             .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    known = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = cut_lineage(pairs.join(known, ["a", "b"], "left_anti"))
    # The set of more pairs leads: a set is then sent to no more leaders than the root of twice all pairs.
    ends = cut_lineage(rest.select(F.explode(F.array("a", "b")).alias("sig")).groupBy("sig").agg(F.count("*").alias("k")))
    rest = join_groups(rest, ends.toDF("a", "ka"), ["a"], "ka")
    rest = join_groups(rest, ends.toDF("b", "kb"), ["b"], "kb")
    turned = F.col("ka") < F.col("kb")
    rest = cut_lineage(rest.select(F.when(turned, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("b")))
    linked = linked.unionByName(beside)
    return linked if rest.isEmpty() else linked.unionByName(cut_lineage(verify(texts, made, rest)).where(similar()).select("a", "b"))


def _beside(tested: DataFrame, split: DataFrame) -> DataFrame:
    """Links (a, b) between sets of different classes that were verified against one leader, enough to connect what all such links do.

    Two sets near their leader are in its class, so one of a pair is alone. The sets of a leader
    are dealt to lots; a task compares the alone ones of one lot with all of another. From a large
    family each set goes to as many tasks as there are lots of alone ones.
    """
    of = split.select(F.col("sig").alias("b"), F.col("lead").alias("a"), "label")
    seen = tested.withColumn("alone", ~similar()).join(of, ["a", "b"])
    torn = cut_lineage(seen.groupBy("a").agg(F.count("*").alias("m"), F.sum(F.col("alone").cast("int")).alias("lots2"), F.min("label").alias("low"), F.max("label").alias("high"))
                       .where((F.col("lots2") > 0) & (F.col("low") != F.col("high"))).select("a", "m", F.ceil(F.col("m") / LOT).cast("int").alias("lots"), F.ceil(F.col("lots2") / LOT).cast("int").alias("lots2")))
    rows = cut_lineage(join_groups(seen, torn, ["a"], "m").select("a", "b", F.xxhash64("label").alias("label"), "alone", "n", "k", "apart", "lots", "lots2"))
    lot, spread = F.pmod(F.xxhash64("b"), F.col("lots")).cast("int"), lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["a", "left", "right", "asks", "b", "label", "n", "k", "apart"]
    asking = rows.where("alone").select("*", F.pmod(F.xxhash64("b"), F.col("lots2")).cast("int").alias("left"), spread("lots").alias("right"), F.lit(True).alias("asks"))
    asked = rows.select("*", spread("lots2").alias("left"), lot.alias("right"), F.lit(False).alias("asks"))
    sent = asking.select(columns).unionByName(asked.select(columns))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        at, held = None, ([], [])
        for batch in batches:
            for *cell, asks, b, label, n, k, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if cell != at:
                    yield from near_pairs(*held)
                    at, held = cell, ([], [])
                held[asks].append((b, label, n, np.cumsum(unsqueeze(blob, k, np.uint64), dtype=np.uint64)))
        yield from near_pairs(*held)

    return cut_lineage(sent.repartition("a", "left", "right").sortWithinPartitions("a", "left", "right").mapInArrow(compare, "a binary, b binary"))


def near_pairs(asked: list[tuple], asking: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of near sets (signature, label, size, differences from a common set) that connect the same labels as all near pairs do."""
    if not asked or not asking:
        return
    sides = [np.unique(np.concatenate([row[3] for row in side])) for side in (asked, asking)]
    tokens = np.intersect1d(*sides, assume_unique=True)
    both = np.zeros((len(asking), len(asked)), np.float32)
    places = [[np.searchsorted(tokens, row[3][np.isin(row[3], tokens, assume_unique=True)]) for row in side] for side in (asking, asked)]
    for start in range(0, len(tokens), COLUMNS):
        marks = []
        for side in places:
            marks.append(np.zeros((len(side), min(COLUMNS, len(tokens) - start)), np.float32))
            for i, place in enumerate(side):
                marks[-1][i, place[slice(*np.searchsorted(place, (start, start + COLUMNS)))] - start] = 1
        both += marks[0] @ marks[1].T
    size, apart = ([np.array([f(row) for row in side]) for side in (asking, asked)] for f in (lambda row: row[2], lambda row: len(row[3])))
    near = 7 * (apart[0][:, None] + apart[1] - 2 * both) <= size[0][:, None] + size[1]
    _, root = np.unique([row[1] for row in asking + asked], return_inverse=True)
    out = ([], [])
    for i in range(len(asking)):
        while len(apart_ := np.flatnonzero(near[i] & (root[len(asking):] != root[i]))):
            j = int(apart_[0])
            out[0].append(asking[i][0])
            out[1].append(asked[j][0])
            root[root == root[len(asking) + j]] = root[i]
    yield pa.record_batch({"a": pa.array(out[0], pa.binary()), "b": pa.array(out[1], pa.binary())})


@lean
def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``id_col``, n_shingles, component_id (least id linked to it, directly or not).

    An empty table gives no rows; repeated rows are linked like any equal texts; of the other columns none is
    read, whatever their names.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).cast("binary").alias("text"), F.col(id_col).alias("id"))
    bytes_ = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    path = scratch_path(spark, "jaccard")
    try:
        postings(texts, token_order(texts, bytes_ // 6)).write.parquet(path)  # about six bytes a word
        return cut_lineage(_classes(texts, spark.read.parquet(path))).toDF(id_col, "n_shingles", "component_id")
    finally:
        remove_path(spark, path)


def _classes(texts: DataFrame, made: DataFrame) -> DataFrame:
    rows = made.where(F.col("token").isNull()).select("id", F.col("n").cast("long").alias("n"), "sig")
    alone = rows.where(F.col("sig").isNull()).select("id", "n", F.col("id").alias("component_id"))
    labels = connected_components(links(texts, made))
    groups = rows.where(F.col("sig").isNotNull()).groupBy("sig").agg(F.min("id").alias("least"), F.count("*").alias("k"))
    named = cut_lineage(groups.join(labels, groups.sig == labels.node, "left").select("sig", "least", "k", F.coalesce("label", "sig").alias("label")))
    classes = named.groupBy("label").agg(F.min("least").alias("component_id"))
    known = cut_lineage(named.join(classes, "label").select("sig", "k", "component_id"))
    return alone.unionByName(join_groups(rows.where(F.col("sig").isNotNull()), known, ["sig"], "k").select("id", "n", "component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents of ``docs`` without near duplicates: of each class the least id stays.

    Ids are expected to be unique; rows that share one go together. Rows without an id stay.
    """
    gone = cut_lineage(near_duplicates(docs, id_col, text_col).where(F.col("component_id") != F.col(id_col)).select(F.col(id_col).alias("__gone")).distinct())
    small = gone.count() <= 1 << 20  # 8 MB; more are joined by shuffling
    return docs.join(F.broadcast(gone) if small else gone, F.col(id_col) == F.col("__gone"), "left_anti")
