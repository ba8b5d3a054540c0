"""Two-pass Bloom filtering of 64-bit fingerprints: which of them may occur twice?

Tasks turn their fingerprints into bit positions; each stretch of the bit array is put
together by one reducer, which keeps a position's bit if it was hit at least twice. A
fingerprint all of whose bits are set may be repeated; one with a bit unset occurs once.
Shuffled data is four bytes per position, and the finished array never exceeds
``max_bytes``: beyond the rows that fit it, more unique fingerprints pass as "maybe",
never the other way round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.functions import arrow_udf

STRETCH = 20  # bits of a position inside one reducer's stretch
CHUNK = 1 << 20  # fingerprints handled at once in a task
HASHES = 2


def positions(prints: np.ndarray, bits: int) -> list[np.ndarray]:
    """Bit positions of each fingerprint, by double hashing."""
    h = prints.astype(np.uint64)
    a = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    b = ((h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)) | np.uint64(1)
    shift = np.uint64(64 - bits)
    return [(a + np.uint64(i) * b) >> shift for i in range(HASHES)]


def _emit(prints: np.ndarray, bits: int) -> pa.RecordBatch:
    unique, counts = np.unique(prints, return_counts=True)
    every = np.unique(np.concatenate(positions(unique, bits)))
    again = np.unique(np.concatenate(positions(unique[counts > 1], bits)))
    stretches = np.arange((1 << max(0, bits - STRETCH)) + 1, dtype=np.uint64) << np.uint64(STRETCH)
    a, b = np.searchsorted(every, stretches), np.searchsorted(again, stretches)
    used = np.flatnonzero(np.diff(a))
    low = np.uint64((1 << STRETCH) - 1)
    once, twice = (every & low).astype(np.uint32), (again & low).astype(np.uint32)
    return pa.record_batch({
        "stretch": pa.array(used.astype(np.int32)),
        "once": pa.array([once[a[i]:a[i + 1]].tobytes() for i in used], pa.binary()),
        "twice": pa.array([twice[b[i]:b[i + 1]].tobytes() for i in used], pa.binary()),
    })


def repeated_bits(prints: DataFrame, n: int, bits_per_row: int = 16, max_bytes: int = 1 << 26) -> np.ndarray:
    """Packed bit array of positions hit twice, for the single long column of ``prints``."""
    bits = max(STRETCH, min(int(np.ceil(np.log2(max(1, n) * bits_per_row))), int(np.log2(max_bytes * 8))))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False))
            size += len(held[-1])
            if size >= CHUNK:
                yield _emit(np.concatenate(held), bits)
                held, size = [], 0
        if size:
            yield _emit(np.concatenate(held), bits)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done():
            return pa.record_batch({"stretch": pa.array([at], pa.int32()),
                                    "bits": pa.array([np.packbits(twice).tobytes()], pa.binary())})

        at, once, twice = None, None, None
        for batch in batches:
            for stretch, a, b in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if stretch != at:
                    if at is not None:
                        yield done()
                    at, once, twice = stretch, np.zeros(1 << STRETCH, bool), np.zeros(1 << STRETCH, bool)
                hit = np.frombuffer(a, np.uint32)
                twice[hit[once[hit]]] = True
                twice[np.frombuffer(b, np.uint32)] = True
                once[hit] = True
        if at is not None:
            yield done()

    found = (prints.mapInArrow(spread, "stretch int, once binary, twice binary")
             .repartition("stretch").sortWithinPartitions("stretch")
             .mapInArrow(gather, "stretch int, bits binary").collect())  # bounded by max_bytes
    array = np.zeros((1 << bits) // 8, np.uint8)
    width = (1 << STRETCH) // 8
    for row in found:
        array[row.stretch * width:(row.stretch + 1) * width] = np.frombuffer(row.bits, np.uint8)
    return array


def may_repeat(prints: Column, array: np.ndarray, spark) -> Column:
    """True where all bits of a fingerprint are set in ``array``."""
    shared = spark.sparkContext.broadcast(array)

    @arrow_udf("boolean")
    def test(column: pa.Array) -> pa.Array:
        bits = shared.value
        n = (len(bits) * 8).bit_length() - 1
        hit = np.ones(len(column), bool)
        for p in positions(column.to_numpy(zero_copy_only=False), n):
            hit &= (bits[(p >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (p & np.uint64(7)).astype(np.uint8))) & 1 > 0
        return pa.array(hit)

    return test(prints)
