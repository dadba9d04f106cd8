"""Winnowing against plain Python loops, and what it guarantees."""

import hashlib
import random
import re
from collections import Counter

import pytest
import xxhash
from conftest import SF
from pyspark.sql import functions as F

from pagewright.llm import winnowing

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
NAMES = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def grams(text):
    t = [xxhash.xxh64(w.encode(), seed=42).intdigest() for w in re.findall(r"[^\x20\x09-\x0D]{1,16}", text.translate(LOWER))]
    t = [(x - 2**64 if x >= 2**63 else x) % (2**48 - 59) for x in t]
    out = []
    for i in range(max(1, len(t) - 4) if t else 0):
        h = 0
        for x in t[i : i + 5]:
            h = (h * 10_007 + x) % (2**48 - 59)
        out.append(h)
    return out


def picked(text, window=8):
    """One window after another; of equal hashes the rightmost."""
    h, found = grams(text), []
    for i in range(max(1, len(h) - window + 1) if h else 0):
        part = h[i : i + window]
        least = min(x >> 15 for x in part)
        at = i + max(j for j, x in enumerate(part) if x >> 15 == least)
        if not found or found[-1][1] != at:
            found.append((h[at], at))
    return found


def alike(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def named(found):
    return hashlib.sha256(",".join(f"{h}:{p}" for h, p in found).encode()).hexdigest()


def plain(rows):
    docs = sorted({(i, t) for i, t in rows}, key=lambda r: -r[0])
    out = {}
    for (i, t), (_, after) in zip(docs, [*docs[1:], docs[0]], strict=True):
        t, after = t or "", after or ""
        m = len(t) // 3
        edited = t[: len(t) - m] + after[:m]
        own, other = picked(t), picked(edited)
        out[i, t] = (i, len(t), hashlib.sha256(edited.encode()).hexdigest(), named(own), named(other), round(alike(own, other), 9), round(alike(own, picked(after)), 9))
    return Counter(out[i, t or ""] for i, t in rows)


def digests(found):
    found = found.select("doc_id", "n_chars", "edited_sha256", winnowing.digest(F.col("fingerprint")).alias("fingerprint"), winnowing.digest(F.col("edited_fingerprint")).alias("edited_fingerprint"), "near_edited", "near_next")
    return Counter(tuple(round(r[c], 9) if isinstance(r[c], float) else r[c] for c in NAMES) for r in found.collect())


def found(spark, rows):
    return digests(winnowing.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")))


def test_query_matches_plain_loops(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = winnowing.op13_fingerprints(spark, SF).collect()
    assert Counter(tuple(round(r[c], 9) if isinstance(r[c], float) else r[c] for c in NAMES) for r in got) == plain(docs)
    long = [r for r in got if r["n_chars"] >= 600]
    assert sum(r["near_edited"] > r["near_next"] for r in long) >= 0.98 * len(long)


def test_ranges_join_up(spark, monkeypatch):
    from pagewright.llm import common

    monkeypatch.setattr(common, "ROWS_A_RANGE", 7)
    rng = random.Random(1)
    rows = [(i * 3 % 101, " ".join(f"W{rng.randrange(50)}" for _ in range(rng.randrange(60)))) for i in range(101)]
    assert found(spark, rows) == plain(rows)


def test_empty_short_and_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "Two words"), (6, "one two three four five"), (7, "é😀" * 100), (8, "x" * 1000), (9, "a b " * 40), (10, "same " * 300)]
    assert found(spark, rows) == plain(rows)
    assert found(spark, rows[:1]) == plain(rows[:1])
    assert found(spark, rows[9:]) == plain(rows[9:])
    assert not found(spark, [])


def test_repeated_rows_and_null_ids(spark):
    rows = [(5, "a b c d e f g h")] * 3 + [(4, "other words here")]
    assert found(spark, rows) == plain(rows)
    got = found(spark, [(None, "last one of all"), (None, None), (2, "first text of them"), (1, "second text of them")])
    assert sorted(((r[0], r[1]) for r in got.elements()), key=str) == [(1, 19), (2, 18), (None, 0), (None, 15)]


def test_extra_columns_with_clashing_names(spark):
    rows = [(i, f"some words of text {i} and more") for i in range(5)]
    df = spark.createDataFrame([(i, t, 1, "k", 2, [3]) for i, t in rows], "doc_id long, text string, n int, k1 string, copies int, next array<int>")
    assert digests(winnowing.edited_fingerprints(df)) == plain(rows)


def test_shared_words_share_a_gram(spark):
    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(10**6)}"
    run = winnowing.GRAM + winnowing.WINDOW - 1
    rows = []
    for _ in range(50):
        shared = [word() for _ in range(run)]
        rows.append([" ".join([word() for _ in range(rng.randrange(40))] + shared + [word() for _ in range(rng.randrange(40))]) for _ in range(2)])
    df = spark.createDataFrame(rows, "a string, b string").select(winnowing.winnowed(F.col("a")).alias("x"), winnowing.winnowed(F.col("b")).alias("y"))
    assert df.where(F.size(F.array_intersect("x.hash", "y.hash")) == 0).count() == 0


@pytest.mark.parametrize("n", [200_000])
def test_very_long_text_is_linear(spark, n):
    rng = random.Random(3)
    rows = [(1, " ".join(f"w{rng.randrange(1000)}" for _ in range(n))), (2, "same " * n)]
    assert found(spark, rows) == plain(rows)
