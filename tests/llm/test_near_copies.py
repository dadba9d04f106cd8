"""The pipeline's near-dedup stage: near copies by 5-word shingles and a similarity of 0.8 or more."""

import random
import re
from collections import Counter

import corpus_pipeline
from conftest import SF

from pagewright.llm import near_copies

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def words(seed, n=200):
    rng = random.Random(seed)
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def kept(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], DOCS)
    return Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicate_texts(spark, docs, SF).collect())


def test_links_match_brute_force(spark):
    path = SF.replace("0.001", "0.01")
    docs = {r["doc_id"]: shingles(r["text"]) for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(docs)
    for i in ids:
        for j in ids:
            a, b = docs[i], docs[j]
            if i < j and (a == b or 9 * min(len(a), len(b)) >= 4 * (len(a) + len(b)) and 9 * len(a & b) >= 4 * (len(a) + len(b))):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    found = corpus_pipeline.near_duplicate_texts(spark, spark.read.parquet(f"{path}/documents.parquet"), path)
    assert sorted(r["doc_id"] for r in found.collect()) == sorted({find(i) for i in ids})


def test_similarity_bound_is_exact(spark):
    base = words(1, 104)  # 100 shingles; k new words at the end make k new shingles
    rows = [(1, " ".join(base)), (2, " ".join(base[:-11] + words(2, 11))), (3, " ".join(words(3, 104)))]
    assert kept(spark, rows) == Counter([rows[0], rows[2]])  # 89 of 111 are shared
    rows[1] = (2, " ".join(base[:-12] + words(2, 12)))  # 88 of 112 are shared
    assert kept(spark, rows) == Counter(rows)


def test_large_cells_are_joined(spark):
    base = words(4)
    rows = [(i, " ".join(base[:i] + [f"new{i}"] + base[i + 1 :])) for i in range(64)]
    assert kept(spark, rows) == Counter(rows[:1])
