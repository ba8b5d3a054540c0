"""Exact, line, byte and near duplicates against brute force, with the odd cases."""

import hashlib
import random
import re
import tracemalloc

import numpy as np
import pytest

from featloom.llm import bloom, bytes_dedup, exact_dedup, jaccard, line_dedup

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "ab"), (5, "ab"), (None, "a  b"), (6, "é b"), (7, "x" * 300_000)]


def test_exact_dedup_marks_and_ties(docs_of):
    rows = exact_dedup.mark_duplicates(docs_of(ODD)).collect()
    got = {(r.doc_id, r.kept): (r.keep_id, r.group_size) for r in rows}
    assert len(rows) == len(ODD)
    assert got[3, True] == (3, 3) and got[1, False] == (3, 3) and got[2, False] == (3, 3)  # most code points
    assert got[None, True] == (None, 4)  # "a  b" is the longest of its group
    assert sum(r.kept for r in rows) == 4
    assert got[6, True] == (6, 1) and got[7, True] == (7, 1)


def test_exact_dedup_drops_and_keeps_columns(docs_of):
    docs = docs_of(ODD)
    kept = exact_dedup.drop_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 3), (False, 6), (False, 7), (True, 0)]


def test_exact_dedup_empty_table(docs_of):
    assert exact_dedup.mark_duplicates(docs_of([])).count() == 0
    assert exact_dedup.drop_duplicates(docs_of([])).count() == 0


def test_bloom_never_misses_a_repeat(spark):
    rng = np.random.default_rng(3)
    prints = rng.integers(-2**62, 2**62, 20_000).tolist()
    frame = spark.createDataFrame([(p,) for p in prints + prints[:500]], "p long").repartition(7)
    bits = bloom.repeated_bits(frame, 20_500)
    n = (len(bits) * 8).bit_length() - 1
    hit = np.ones(20_000, bool)
    for p in bloom.positions(np.array(prints), n):
        hit &= np.unpackbits(bits)[p.astype(np.int64)] > 0
    assert hit[:500].all() and hit[500:].mean() < 0.01


def brute_lines(rows, least=20, min_docs=3):
    held = {}
    key = lambda line: line.strip(" \t\n\x0b\f\r").translate(LOW)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least:
                held.setdefault(key(line), set()).add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        gone = [k in held and len(held[k]) >= min_docs and i != max(held[k]) for k in map(key, lines)]
        out.append((i, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return sorted(out)


def test_line_dedup_against_brute_force(docs_of):
    rng = random.Random(5)
    lines = [f"a line that is long enough number {i}" for i in range(12)] + ["short", "", "  Ärger über zwanzig Zeichen lang ", "ÄRGER über zwanzig zeichen LANG"]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 9)))) for i in range(40)] + [(40, None), (41, lines[0] + "\n" * 5000)]
    got = sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.dedup_lines(docs_of(rows)).collect())
    assert got == brute_lines(rows)


def test_line_dedup_batches_and_fanout_do_not_matter(docs_of):
    rows = [(i, f"common line of twenty and more\nown line of document {i} here") for i in range(9)]
    base = sorted(map(tuple, line_dedup.dedup_lines(docs_of(rows, False), batches=1).collect()))
    assert base == sorted(map(tuple, line_dedup.dedup_lines(docs_of(rows, False), batches=5, fanout=3).collect()))


def test_line_dedup_null_ids_and_empty_table(docs_of):
    line = "a line of at least twenty characters"
    rows = [(None, line), (1, line), (2, line), (2, line)]
    got = {(r.doc_id, r.n_dropped) for r in line_dedup.dedup_lines(docs_of(rows)).collect()}
    assert got == {(None, 1), (1, 1), (2, 0)}
    assert line_dedup.dedup_lines(docs_of([])).count() == 0


def test_line_dedup_plan_has_no_python(docs_of):
    frame = line_dedup.dedup_lines(docs_of([(1, "x")], False))
    assert not re.search("Python|Pandas|Arrow", frame._jdf.queryExecution().executedPlan().toString())


def brute_bytes(rows, least=100):
    seen, out = set(), []
    for i, text in sorted(rows):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - least + 1):
            w = data[s:s + least]
            if w in seen:
                gone[s:s + least] = True
            seen.add(w)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        out.append((i, len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def byte_rows():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdé ") for _ in range(rng.randint(2, 9)))
    shared = [" ".join(word() for _ in range(40)) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [rng.choice(shared)[rng.randint(0, 60):] if rng.random() < 0.5 else " ".join(word() for _ in range(20)) for _ in range(rng.randint(0, 4))]
        rows.append((i, "".join(parts)))
    rows += [(60, "=" * 700), (61, "ab" * 400), (62, rows[3][1]), (63, rows[3][1]), (64, None), (65, "x" * 99), (66, "\0" * 250)]
    return rows


@pytest.mark.parametrize("shard", [1 << 21, 1 << 9])
def test_bytes_dedup_against_brute_force(docs_of, monkeypatch, shard):
    monkeypatch.setattr(bytes_dedup, "SHARD", shard)  # a small one makes many shards per gram
    rows = byte_rows()
    got = sorted((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest())
                 for r in bytes_dedup.remove_repeats(docs_of(rows)).collect())
    assert got == brute_bytes(rows)


def test_bytes_dedup_without_the_list_of_copies(docs_of, monkeypatch):
    monkeypatch.setattr(bytes_dedup, "MAX_COPIES", 0)
    rows = byte_rows()
    got = sorted((r.doc_id, sum(s.end - s.start for s in r.spans)) for r in bytes_dedup.remove_repeats(docs_of(rows)).collect())
    assert got == [(r[0], r[2]) for r in brute_bytes(rows)]


def test_bytes_dedup_null_and_repeated_ids(docs_of):
    text = "".join(chr(97 + i * 7 % 26) + str(i) for i in range(80))
    got = sorted((r.doc_id or 99, len(r.spans)) for r in bytes_dedup.remove_repeats(docs_of([(None, text), (4, text), (4, text), (9, text + "!")])).collect())
    assert got == [(4, 0), (4, 0), (9, 1), (99, 1)]
    assert bytes_dedup.remove_repeats(docs_of([])).count() == 0


def test_strings_of_one_gram_take_little_memory(monkeypatch):
    monkeypatch.setattr(bytes_dedup, "SHARD", 1 << 16)
    rng = np.random.default_rng(5)
    gram = bytes(range(65, 97))
    passages = [rng.integers(97, 123, 68).astype(np.uint8).tobytes() + gram + rng.integers(97, 123, 68).astype(np.uint8).tobytes() for _ in range(3_000)]
    shards = bytes_dedup.Shards()
    tracemalloc.start()
    for i, data in enumerate([*passages, passages[7][:120], b"?" + passages[7]]):
        shards.add(1, i, 0, 0, data)
    shards.settle(False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert shards.out == [(3_000, 0, 0, 120), (3_001, 0, 1, 169)]
    assert peak < 80 * 3_000 * bytes_dedup.REACH  # with 100 bytes a string, and copies of them, far more


def test_strings_of_one_gram_may_end_in_zero_bytes(monkeypatch):
    monkeypatch.setattr(bytes_dedup, "SHARD", 1 << 8)
    head = bytes(range(1, 100))
    shards = bytes_dedup.Shards()
    for i, data in enumerate([head + b"a" * 200, head + b"\0", head[:-1] + b"\0\0", head + b"\0"]):
        shards.add(1, i, 0, 0, data)
    shards.settle(False)
    assert [x for x in shards.out if x[0]] == [(3, 0, 0, 100)]


def test_suffix_ranks_and_common_prefixes():
    rng = np.random.default_rng(2)
    text = rng.integers(97, 99, 400).astype(np.uint8)
    text[200:330] = text[20:150]
    order, rank = bytes_dedup.refine(text)
    data = text.tobytes()
    key = [data[i:i + 100] for i in range(400)]
    inner = [i for i in range(301)]
    assert sorted(inner, key=lambda i: (rank[i], i)) == sorted(inner, key=lambda i: (key[i], i))
    assert all((rank[a] == rank[b]) == (key[a] == key[b]) for a in range(0, 300, 7) for b in range(300))


def test_pieces_do_not_matter(monkeypatch):
    data = np.random.default_rng(1).integers(0, 4, 5000).astype(np.uint8)

    def strings():
        return sorted((int(h), s) for g, a, b in bytes_dedup.runs(data) for h, x, y in zip(g, a, b) for s in range(x, y + 1))

    whole = strings()
    monkeypatch.setattr(bytes_dedup, "PIECE", 333)
    assert strings() == whole and len(whole) == 4901


def brute_classes(rows):
    sets = []
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
        sets.append((i, frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()))
    label = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                old, new = label[a], label[b]
                label = [new if v == old else v for v in label]
    least = {}
    for (i, _), v in zip(sets, label):
        least[v] = min(least.get(v, i), i)
    return sorted((i, len(s), least[v]) for (i, s), v in zip(sets, label))


def jaccard_rows():
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(400)]
    common = rng.choices(vocab, k=30)
    rows = [(0, None), (1, ""), (2, "one two"), (3, "One  two"), (4, "one two three")]
    for base in range(12):
        text = rng.choices(vocab, k=rng.choice([6, 20, 60, 150])) + common * (base % 3 > 0)
        for _ in range(rng.choice([1, 2, 6, 25])):
            copy = list(text)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            rows.append((len(rows), " ".join(copy)))
    return rows


@pytest.mark.parametrize("often", [24, 3])
def test_jaccard_against_brute_force(docs_of, monkeypatch, often):
    monkeypatch.setattr(jaccard, "OFTEN", often)
    rows = jaccard_rows()
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs_of(rows)).collect())
    assert got == brute_classes(rows)


def test_jaccard_keeps_one_and_handles_empty(docs_of):
    docs = docs_of([(5, "a b c d e f"), (3, "A b c d e f"), (None, "zz"), (7, None), (8, None)])
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 3, 7, 8]
    assert jaccard.near_duplicates(docs_of([])).count() == 0


def test_prefix_sizes_lose_no_link():
    assert all(jaccard.prefix_size(n) >= n - int(np.ceil(0.75 * n)) + 1 for n in range(1, 3000))


def test_jaccard_sets_travel_without_checkpoints(docs_of, monkeypatch):
    """Sets of shingles were stored between two shuffles; a set in many pairs leads them."""
    stored, cut = [], jaccard.cut_lineage
    monkeypatch.setattr(jaccard, "cut_lineage", lambda df: stored.append(df.columns) or cut(df))
    asked, verify = [], jaccard.verify
    monkeypatch.setattr(jaccard, "verify", lambda texts, made, pairs: asked.append(pairs) or verify(texts, made, pairs))
    rows = jaccard_rows()
    got = sorted((r.doc_id, r.component_id) for r in jaccard.near_duplicates(docs_of(rows)).collect())
    assert len(got) == len(rows) and asked
    assert not any("tokens" in columns for columns in stored if "often" not in columns)


def test_jaccard_hashes_are_drawn_back():
    tokens = np.random.default_rng(3).integers(0, 1 << 63, 1000, np.uint64) * np.uint64(2)
    assert (jaccard.drawn_back(jaccard.spread_out(tokens)) == tokens).all()


def test_jaccard_differences_lose_no_link():
    draw = np.random.default_rng(7)
    for _ in range(3000):
        leader = np.unique(draw.integers(0, 1 << 62, draw.integers(4, 60), dtype=np.uint64))
        pool = draw.integers(0, 1 << 62, 8, dtype=np.uint64)
        sets = []
        for _ in range(2):
            kept = leader[draw.random(len(leader)) > draw.random() * 0.4]
            sets.append(np.unique(np.concatenate([kept, pool[draw.random(8) > 0.5], draw.integers(0, 1 << 62, draw.integers(0, 4), dtype=np.uint64)])))
        near = lambda x, y: 4 * len(np.intersect1d(x, y)) >= 3 * len(np.union1d(x, y))
        if len(np.union1d(*sets)) and near(*sets):
            (a, early_a), (b, early_b) = (jaccard.differences(leader, s, np.isin(s, leader)) for s in sets)
            if not near(leader, sets[1]):
                assert np.isin(a[:early_a], b).any()
            if not near(leader, sets[0]):
                assert np.isin(b[:early_b], a).any()


def test_jaccard_family_of_copies_far_from_each_other(docs_of, monkeypatch):
    """Copies of one text, each altered too much to be near it or another one: their pairs aren't listed."""
    draw = random.Random(9)
    base = [f"w{i}" for i in range(400)]
    rows = [(0, " ".join(base))]
    for i in range(1, 121):
        words = list(base)
        for k, j in enumerate(draw.sample(range(0, 400, 5), 20 if i % 2 else 10)):
            words[j] = f"x{i}-{k}"
        rows.append((i, " ".join(words)))
    rows += [(1000, rows[1][1] + " more"), (1001, rows[3][1].replace("w7 ", "v7 "))]  # near a far copy only
    pairs, verify = [], jaccard.verify
    monkeypatch.setattr(jaccard, "verify", lambda texts, made, asked: pairs.append(asked.count()) or verify(texts, made, asked))
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs_of(rows)).collect()}
    assert got == {i: 0 if i % 2 == 0 else i for i in range(121)} | {1000: 1, 1001: 3}
    assert sum(pairs) < 1000  # of 7,503


def test_jaccard_copies_with_few_own_words(docs_of, monkeypatch):
    """Copies that differ from their leader and each other in words of a small pool, at common places: their pairs were listed."""
    draw = random.Random(12)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(150):
        words = list(base)
        for j in draw.sample(range(150), draw.choice([2, 4, 6, 9])):
            words[j] = f"x{draw.randrange(6)}"
        rows.append((i, " ".join(words)))
    pairs, verify = [], jaccard.verify
    monkeypatch.setattr(jaccard, "verify", lambda texts, made, asked: pairs.append(asked.count()) or verify(texts, made, asked))
    monkeypatch.setattr(jaccard, "LOT", 32)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs_of(rows)).collect())
    assert got == brute_classes(rows)
    assert sum(pairs) < 1500  # of 11,175


def test_near_pairs_connect_what_all_pairs_do(monkeypatch):
    monkeypatch.setattr(jaccard, "COLUMNS", 7)
    draw = np.random.default_rng(8)
    for _ in range(40):
        common = np.unique(draw.integers(0, 1 << 62, 40, dtype=np.uint64))
        pool = np.unique(draw.integers(0, 1 << 62, 30, dtype=np.uint64))
        sets = [np.sort(np.concatenate([common[draw.random(len(common)) > 0.2], pool[draw.random(len(pool)) > 0.8]])) for _ in range(30)]
        rows = [(bytes([i]), i // 2, len(s), np.setxor1d(s, common)) for i, s in enumerate(sets)]
        near = {(i, j) for i in range(12) for j in range(30) if 4 * len(np.intersect1d(sets[i], sets[j])) >= 3 * len(np.union1d(sets[i], sets[j]))}
        found = [(a[0], b[0]) for batch in jaccard.near_pairs(rows, rows[:12]) for a, b in zip(*(c.to_pylist() for c in batch.columns))]
        assert set(found) <= near and len(found) < 15

        def classes(links):
            label = [i // 2 for i in range(30)]
            for i, j in links:
                label = [label[i] if v == label[j] else v for v in label]
            return [label.index(v) for v in label]

        assert classes(found) == classes(near)
