"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1/-1 entries, drawn from a seed and its code point. An
n-gram's vector binds (multiplies) its letters' vectors, each rotated by its place; a text's
vector bundles (adds) those of its n-grams; a language's profile bundles the unit vectors of
its learning texts. The prediction is the profile of highest cosine, after the mean of all
profiles is taken off, as it says nothing about the language.

Letters are compared in lower case, and every stretch of other characters reads as one blank.
A null text, or one without a letter, gives ``und`` with score 0; so does any text if there is
nothing to learn from. Learning rows with null text, null language or no letter are ignored.
Ties go to the language first in order. The score is (1 + cosine) / 2.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 512
N = 3
PIECE = 1 << 18  # code points handled at once, so long texts need no more memory
UNKNOWN = "und"


def folded(point: int) -> int:
    """A letter's lower case as code point; 0 for any other character."""
    if not chr(point).isalpha():
        return 0
    low = chr(point).lower()
    return ord(low) if len(low) == 1 else point


class Letters:
    """``folded`` for arrays: a table for the common alphabets, the distinct rest one by one."""

    TABLE = 0x3000

    def __init__(self):
        self.table = np.array([folded(c) for c in range(self.TABLE)], np.int64)

    def __call__(self, points: np.ndarray) -> np.ndarray:
        out = self.table[np.minimum(points, self.TABLE - 1)]
        high = np.flatnonzero(points >= self.TABLE)
        if len(high):
            unique, where = np.unique(points[high], return_inverse=True)
            out[high] = np.array([folded(int(c)) for c in unique], np.int64)[where]
        return out


def grams(text: str, letters: Letters) -> Iterator[np.ndarray]:
    """The packed letter n-grams of a text (21 bits a letter, blank 0), piece by piece."""
    tail = np.zeros(1, np.int64)
    for at in range(0, len(text), PIECE):
        piece = np.frombuffer(text[at:at + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        points = letters(piece)
        run = np.concatenate([tail, points, np.zeros(int(at + PIECE >= len(text)), np.int64)])
        keep = np.ones(len(run), bool)
        keep[1:] = (run[1:] > 0) | (run[:-1] > 0)
        run = run[keep]
        if len(run) >= N:
            out = np.zeros(len(run) - N + 1, np.int64)
            for i in range(N):
                out = (out << 21) | run[i:len(run) - N + 1 + i]
            yield out
        tail = run[-(N - 1):]


class Space:
    """Vectors of letters and n-grams, the same in every process for one seed."""

    def __init__(self, dimensions: int, seed: int, limit: int = 20_000):
        self.dimensions, self.seed, self.limit = dimensions, seed, limit
        self.letter: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.vectors = np.empty((1024, dimensions), np.float32)

    def of_letter(self, point: int) -> np.ndarray:
        if point not in self.letter:
            draw = np.random.Generator(np.random.PCG64([self.seed, point]))
            self.letter[point] = (draw.integers(0, 2, self.dimensions) * 2 - 1).astype(np.float32)
        return self.letter[point]

    def bind(self, gram: int) -> np.ndarray:
        out = np.ones(self.dimensions, np.float32)
        for place in range(N):
            out = out * np.roll(self.of_letter((gram >> (21 * place)) & 0x1FFFFF), place)
        return out

    def place(self, unique: np.ndarray) -> np.ndarray:
        """Rows of ``vectors`` for packed n-grams; new ones are bound and kept up to the limit."""
        if len(self.rows) + len(unique) > self.limit:
            self.rows = {}
        for gram in unique.tolist():
            if gram not in self.rows:
                if len(self.rows) == len(self.vectors):
                    self.vectors = np.vstack([self.vectors, np.empty_like(self.vectors)])
                self.vectors[len(self.rows)] = self.bind(gram)
                self.rows[gram] = len(self.rows)
        return np.fromiter((self.rows[g] for g in unique.tolist()), np.int64, len(unique))

    def bundle(self, counts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """One vector per text, from its distinct n-grams and their counts."""
        out = np.zeros((len(counts), self.dimensions), np.float32)
        if not counts:
            return out
        unique = np.unique(np.concatenate([g for g, _ in counts]))
        for at in range(0, len(unique), self.limit):
            part = unique[at:at + self.limit]
            used = self.place(part)
            matrix = np.zeros((len(counts), len(part)), np.float32)
            for i, (g, n) in enumerate(counts):
                j = np.minimum(np.searchsorted(part, g), len(part) - 1)
                here = part[j] == g
                matrix[i, j[here]] = n[here]
            out += matrix @ self.vectors[used]
        return out


def count(text: str | None, letters: Letters) -> tuple[np.ndarray, np.ndarray] | None:
    """Distinct n-grams and counts; None for a text without a letter."""
    parts = [np.unique(g, return_counts=True) for g in grams(text or "", letters)]
    if not parts:
        return None
    if len(parts) == 1:
        found = parts[0]
    else:
        every, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        found = every, np.bincount(where, np.concatenate([p[1] for p in parts])).astype(np.int64)
    return found if found[0].any() else None


def _blocks(batches: Iterator[pa.RecordBatch], rows: int = 32) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", dimensions: int = DIMENSIONS,
          seed: int = 7, max_languages: int = 2_000) -> dict[str, np.ndarray]:
    """Profiles by language: unit length, the mean taken off.

    Each task sends one vector per language it has seen; ``max_languages`` bounds what
    reaches the driver, more are refused.
    """

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Bundling is linear, so a language's weighted n-grams are added up before any is bound.
        # A text weighs 1 / (length of its counts): up to noise the length of its vector, since
        # vectors of different n-grams are nearly orthogonal.
        space, letters, held, sizes, sums = Space(dimensions, seed), Letters(), {}, {}, {}

        def settle(lang: str, most: int) -> None:
            grams_, where = np.unique(np.concatenate([g for g, _ in held[lang]]), return_inverse=True)
            weights = np.bincount(where, np.concatenate([w for _, w in held[lang]]))
            held[lang], sizes[lang] = [(grams_, weights)], len(grams_)
            if len(grams_) > most:
                sums[lang] = sums.get(lang, 0) + space.bundle(held.pop(lang))[0].astype(np.float64)

        for block in _blocks(batches):
            for text, lang in zip(block.column(0).to_pylist(), block.column(1).to_pylist()):
                found = count(text, letters) if lang is not None else None
                if found is not None:
                    held.setdefault(lang, []).append((found[0], found[1] / np.sqrt((found[1] ** 2.0).sum())))
                    sizes[lang] = sizes.get(lang, 0) + len(found[0])
                    if sizes[lang] > 1 << 19:
                        settle(lang, 1 << 18)
        for lang in list(held):
            settle(lang, 0)
        for lang, vector in sums.items():
            yield pa.record_batch({"lang": pa.array([lang] * dimensions), "d": pa.array(np.arange(dimensions, dtype=np.int32)),
                                   "v": pa.array(vector)})

    sums = (labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
            .mapInArrow(bundle, "lang string, d int, v double").groupBy("lang", "d").agg(F.sum("v").alias("v")))
    found = (sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("d", "v"))).alias("v"))
             .limit(max_languages + 1).collect())
    if len(found) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    profiles = {r.lang: np.array([x.v for x in r.v]) for r in sorted(found, key=lambda r: r.lang)}
    profiles = {k: v / max(np.linalg.norm(v), 1e-9) for k, v in profiles.items()}
    if len(profiles) > 1:
        mean = np.mean(list(profiles.values()), axis=0)
        profiles = {k: (v - mean) / max(np.linalg.norm(v - mean), 1e-9) for k, v in profiles.items()}
    return profiles


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], text_col: str = "text", dimensions: int = DIMENSIONS,
            seed: int = 7, lang_out: str = "lang_pred", score_out: str = "score", carry: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``carry``) with the predicted language and score.

    Columns called like the two outputs are replaced, other names never clash. An empty table
    gives an empty result; equal cosines go to the language first in order.
    """
    carried = [c for c in (carry if carry is not None else docs.columns) if c not in (lang_out, score_out)]
    inner = [f"c{i}" for i in range(len(carried))]
    frame = docs.select(F.col(text_col).alias("text"), *[F.col(c).alias(n) for c, n in zip(carried, inner)])
    names = list(profiles)
    shared = docs.sparkSession.sparkContext.broadcast(
        np.stack([profiles[n] for n in names]).astype(np.float32) if names else np.zeros((0, dimensions), np.float32))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, letters, matrix = Space(dimensions, seed), Letters(), shared.value
        for block in _blocks(batches):
            counts = [count(t, letters) for t in block.column(0).to_pylist()]
            known = [i for i, c in enumerate(counts) if c is not None]
            langs, scores = [UNKNOWN] * len(counts), np.zeros(len(counts))
            if known and names:
                vectors = space.bundle([counts[i] for i in known])
                norms = np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
                cosine = (vectors @ matrix.T) / norms
                for i, best, value in zip(known, cosine.argmax(1), cosine.max(1)):
                    langs[i], scores[i] = names[best], min(1.0, max(0.0, (1 + float(value)) / 2))
            yield pa.RecordBatch.from_arrays(
                block.columns[1:] + [pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=inner + ["lang", "score"])

    fields = "".join(f"{n} {docs.schema[c].dataType.simpleString()}, " for c, n in zip(carried, inner))
    return frame.mapInArrow(judge, f"{fields}lang string, score double").toDF(*carried, lang_out, score_out)


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """The part never learnt from: crc32 of the id as text leaves no remainder."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))
