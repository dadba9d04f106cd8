"""The set join behind the near-dedup stage loses no link: against brute force on templates, chains, hot shingles and small blocks."""

import random
import re

import pytest

from pagewright.llm import near_copies

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def groups_of(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    where = {}
    for i in ids:
        for s in sets[i] or {None}:
            where.setdefault(s, []).append(i)
    for i in ids:
        both = {}
        for s in sets[i] or {None}:
            for j in where[s]:
                both[j] = both.get(j, 0) + 1
        for j, n in both.items():
            if j < i and (not sets[i] or 9 * n >= 4 * (len(sets[i]) + len(sets[j]))):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {frozenset(j for j in ids if find(j) == r) for r in {find(i) for i in ids}}


def found(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    least = {(r["node"]): r["root"] for r in near_copies.near_copies(docs).collect()}
    node = {i: near_copies.node_of(near_copies.shingle_set([hash_of(w) for w in re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))])) for i, t in rows}
    by = {}
    for i, n in node.items():
        by.setdefault(least[n], set()).add(i)
    return {frozenset(x) for x in by.values()}


def hash_of(word):
    import xxhash

    h = xxhash.xxh64(word.encode(), seed=42).intdigest()
    return h - 2**64 if h >= 2**63 else h


def template(n, pairs, seed=1):
    """n texts of 1,000 words that differ from a template in 24 places of their own (similarity 0.786 among each other), and `pairs` of them with a copy (0.837 and more)."""
    rng = random.Random(seed)
    base = [f"b{k}" for k in range(1000)]
    spots = [20 + 40 * k for k in range(24)]
    rows = []
    for i in range(n):
        text = list(base)
        for k, at in enumerate(spots):
            text[at] = f"t{i}x{k}"
        rows.append(text)
    for i in range(pairs):
        copy = list(rows[i])
        for k in range(17):
            copy[spots[k] + 20] = f"c{i}x{k}"
        rows.append(copy)
    rng.shuffle(rows)
    return [(i, " ".join(t)) for i, t in enumerate(rows)]


def test_pairs_on_one_template_are_all_found(spark):
    rows = template(600, 14)
    want = groups_of(rows)
    assert sum(len(g) > 1 for g in want) == 14
    assert found(spark, rows) == want


@pytest.mark.parametrize("block", [1 << 20, 2000])
def test_chains_copies_and_hot_passages(spark, monkeypatch, block):
    monkeypatch.setattr(near_copies, "BLOCK", block)
    monkeypatch.setattr(near_copies, "LARGE", 20)
    monkeypatch.setattr(near_copies, "HERE", 5)
    monkeypatch.setattr(near_copies, "COUNTED", 5000)
    monkeypatch.setattr(near_copies, "DEALT", 3000)
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(10**6)}"
    rows, passage = [], [word() for _ in range(60)]
    for _ in range(60):  # a passage in texts that have nothing else in common, some of little else
        rows.append(passage + [word() for _ in range(rng.choice([2, 8, 15, 40, 200]))])
    base = [word() for _ in range(150)]
    for _ in range(80):  # copies of one text with a few words changed
        copy = list(base)
        for _ in range(rng.randrange(5)):
            copy[rng.randrange(len(copy))] = word()
        rows.append(copy)
    chain = [word() for _ in range(120)]
    for k in range(12):  # each near the next only
        chain = chain[:]
        chain[10 * k % 115] = word()
        rows.append(chain)
    rows += [[word() for _ in range(rng.randrange(1, 9))] for _ in range(20)] + [["a"], ["a", "b"], [], [], ["a"]]
    rows += rows[:5]
    rows = [(i, " ".join(t)) for i, t in enumerate(rows)] + [(10_000, None)]
    assert found(spark, rows) == groups_of(rows)


def test_empty_table_and_repeated_rows(spark):
    assert found(spark, [(1, "one two three four five six")] * 40) == {frozenset([1])}
    assert near_copies.near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0
