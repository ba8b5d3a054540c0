"""Secrets in texts: fixed patterns, and random strings by token efficiency.

The fixed kinds are ``assign`` (a named value), ``access`` (cloud access keys) and ``hex``
(long hexadecimal runs). On top, kind ``random`` marks strings that a token vocabulary
compresses badly: few characters per token mean that the string is made of nothing the
vocabulary has ever seen. Known digests (plain hex of a digest's length), UUIDs and numbers
are excluded first, and so is what a fixed kind covers already. Words and names of code have no
form that random letters couldn't have: only their tokens tell, with and without separators. A
random string that is glued to readable ones (a path, a setting's name) is marked on its own, and
so is what a fixed kind leaves of a longer one.

Offsets are code points, the end is exclusive. Null and empty texts have no spans. Whole texts
are searched, whatever their length, in time that grows with it; repeated rows are searched each
on its own. Kinds may overlap each other; spans of one kind never do, the leftmost wins. An empty
table gives an empty result. A column called like the output is replaced, other names never clash.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "random")
#: The patterns of the contract, and the least length of what they must find.
ASSIGN = r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
NAMES = ("passw", "secret", "token", "apikey", "api_key")
LEAST_VALUE = 6
#: A string of these is tested for token efficiency.
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
UUID = r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"
NUMBER = r"[0-9+/_=-]+"
#: The least length of a candidate, and of a part of one.
LEAST_RANDOM = 16
RATIO = 2.0
STRETCH = 1 << 12  # characters tokenised at once


class Scanner:
    def __init__(self, ranks: bytes, pattern: str, ratio: float = RATIO):
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, special_tokens={}, mergeable_ranks={
            base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())})
        self.assign, self.access, self.hex, self.candidate = map(re.compile, (ASSIGN, ACCESS, HEX, CANDIDATE))
        self.known = [re.compile(p) for p in (UUID, NUMBER)]
        self.digest = re.compile(r"[0-9a-f]+|[0-9A-F]+")
        self.between = re.compile(r"[/=+_-]+")
        self.word = re.compile(r"[A-Za-z0-9]+")
        digests = "|".join(f"[0-9A-F]{{{n}}}" for n in DIGEST_LENGTHS)
        self.form = re.compile(rf"(?<![A-Za-z0-9])(?:{UUID}|{digests}|[0-9][0-9/_=+-]{{7,}})(?![A-Za-z0-9])")
        self.lengths = {int(b): len(base64.b64decode(a)) for a, b in map(bytes.split, ranks.splitlines())}
        self.ratio = ratio

    def is_random(self, string: str) -> bool:
        """Few characters a token, and no known form."""
        bare = string.strip("=/+_-")
        if any(p.fullmatch(bare) for p in self.known) or (len(bare) in DIGEST_LENGTHS and self.digest.fullmatch(bare)):
            return False
        # The words of a joined name, or the whole with its separators, are readable.
        return self.badly([string]) and self.badly(self.between.split(bare))

    def badly(self, pieces: list[str]) -> bool:
        tokens = sum(len(self.encoding.encode_ordinary(p[i:i + STRETCH])) for p in pieces for i in range(0, len(p), STRETCH))
        return sum(map(len, pieces)) < self.ratio * tokens

    def base(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind number, end) of the fixed kinds, in order."""
        found = [(m.start(), 1, m.end()) for m in self.access.finditer(text)]
        found += [(m.start(), 2, m.end()) for m in self.hex.finditer(text)]
        low = text.lower()
        if any(n in low for n in NAMES):
            found += [(m.start(), 0, m.end()) for m in self.assign.finditer(text) if len(m[2]) >= LEAST_VALUE]
        return sorted(found)

    def dense(self, string: str) -> list[tuple[int, int]]:
        """Maximal stretches with few characters a token (Ruzzo-Tompa); separators weigh nothing."""
        kept: list[tuple[int, int, float, float, int]] = []  # start, end, sums before and after, the one before with a smaller sum
        total, at = 0.0, 0
        for i in range(0, len(string), STRETCH):
            for token in self.encoding.encode_ordinary(string[i:i + STRETCH]):
                end = at + self.lengths[token]
                weight = 0.0 if self.between.fullmatch(string, at, end) else self.ratio - (end - at)
                start, low, total = at, total, total + weight
                while weight > 0:
                    j = len(kept) - 1
                    while j >= 0 and kept[j][2] >= low:
                        j = kept[j][4]
                    if j < 0 or kept[j][3] >= total:
                        kept.append((start, end, low, total, j))
                        break
                    start, low = kept[j][0], kept[j][2]
                    del kept[j:]
                at = end
        return [k[:2] for k in kept]

    def random_parts(self, string: str) -> list[tuple[int, int]]:
        """Ranges of the random strings in a candidate: the whole, else parts that readable ones are glued to."""
        if self.is_random(string):
            return [(0, len(string))]
        found: list[tuple[int, int]] = []
        edges = [0, *(x for m in self.form.finditer(string) for x in m.span()), len(string)]
        for at, to in zip(edges[::2], edges[1::2]):
            if to - at < LEAST_RANDOM:
                continue
            part = string[at:to]
            words = [m.span() for m in self.word.finditer(part)]
            left, right = 0, 0
            # Stretches lie apart, so those of one long piece follow each other: it is judged once for all of them.
            judged, verdict = (-1, -1), False
            for a, b in self.dense(part):
                while words[left][1] <= a:
                    left += 1
                right = max(right, left)
                while words[right][1] < b:
                    right += 1
                # The whole pieces it touches, else the stretch itself.
                for x, y in ((words[left][0], words[right][1]), (a, b)):
                    if y - x < LEAST_RANDOM:
                        continue
                    if (x, y) != judged:
                        random = self.is_random(part[x:y])
                        if (x, y) != (a, b):
                            judged, verdict = (x, y), random
                    else:
                        random = verdict
                    if random:
                        if found and at + x < found[-1][1]:
                            found[-1] = min(found[-1][0], at + x), max(found[-1][1], at + y)
                        else:
                            found.append((at + x, at + y))
                        break
        return found

    def scan(self, text: str) -> list[tuple[int, int, int]]:
        base = self.base(text)
        added, covered, taken = [], [], 0
        for a, _, b in base:
            if covered and a <= covered[-1][1]:
                covered[-1] = covered[-1][0], max(covered[-1][1], b)
            else:
                covered.append((a, b))
        for m in self.candidate.finditer(text):
            a, b = m.span()
            while taken < len(covered) and covered[taken][1] <= a:
                taken += 1
            # What the fixed kinds leave of it.
            edges, i = [a], taken
            while i < len(covered) and covered[i][0] < b:
                edges += covered[i]
                i += 1
            edges.append(b)
            for x, y in zip(edges[::2], edges[1::2]):
                if y - x >= LEAST_RANDOM:
                    added += [(x + p, 3, x + q) for p, q in self.random_parts(text[x:y])]
        return sorted(base + added)


def find(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", out_col: str = "secrets",
         ratio: float = RATIO, carry: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``carry``) with the spans found, in order of start and kind.

    ``ranks_path`` is a tiktoken rank file on the driver (a few MB at most, it is broadcast),
    ``pattern`` its splitting pattern, ``ratio`` the characters per token below which a string
    counts as random.
    """
    carried = list(carry if carry is not None else [c for c in docs.columns if c != out_col])
    names = [f"c{i}" for i in range(len(carried))]
    frame = docs.select(F.col(text_col).alias("text"), *[F.col(c).alias(n) for c, n in zip(carried, names)])
    with open(ranks_path, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(shared.value, pattern, ratio)
        for batch in batches:
            found = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in scanner.scan(t.as_py() or "")] for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, span)], names=[*names, "found"])

    kinds = "".join(f"{n} {docs.schema[c].dataType.simpleString()}, " for c, n in zip(carried, names))
    return frame.mapInArrow(run, f"{kinds}found array<struct<kind:string,start:int,end:int>>").toDF(*carried, out_col)
