"""The whole pipeline against the same chain in plain Python."""

import hashlib
import re
from collections import Counter, defaultdict

from conftest import SF
from test_near_copies import shingles

from pagewright.llm import quality

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def good_ones(spark, docs):
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit_quality(frame, spark.read.parquet(f"{SF}/labels.parquet"))
    return [d for d in docs if model.score([d["text"] or ""])[0] >= 0.7]


def first_of_near_copies(docs):
    sets = {d["doc_id"]: shingles(d["text"]) for d in docs}
    left, kept = set(sets), set()
    while left:
        front = [min(left)]
        kept.add(front[0])
        left -= set(front)
        while front:
            a = sets[front.pop()]
            near = {y for y in left if a == sets[y] or 9 * len(a & sets[y]) >= 4 * (len(a) + len(sets[y]))}
            left -= near
            front += near
    return [d for d in docs if d["doc_id"] in kept]


def without_passages(docs, items):
    windows = set()
    for item in items:
        w = WORD.findall((item["text"] or "").translate(LOWER))
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}

    def clean(d):
        w = WORD.findall((d["text"] or "").translate(LOWER))
        return not any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))

    return [d for d in docs if clean(d)]


def mixture(docs):
    """The texts that each document gives to the mix: whole ones, and the first words of one."""
    size = {d["doc_id"]: len(SPACED.findall(d["text"] or "")) for d in docs}
    by_source = defaultdict(list)
    for d in docs:
        by_source[d["source"]].append(d)
    names = sorted(by_source, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total = {s: sum(size[d["doc_id"]] for d in by_source[s]) for s in names}
    target, rest = {}, 1.5 * sum(total.values())
    while True:
        free = [s for s in names if s not in target]
        level = rest / sum(weight[s] for s in free) if free else 0
        above = [s for s in free if level * weight[s] >= 2 * total[s]]
        for s in above:
            target[s] = 2 * total[s]
            rest -= target[s]
        if not above:
            target |= {s: level * weight[s] for s in free}
            break
    out = Counter()
    for s in names:
        start, budget = 0, int(target[s] + 0.5)
        passes = budget // total[s] if total[s] else 0
        for d in sorted(by_source[s], key=lambda d: hashlib.md5(str(d["doc_id"]).encode()).hexdigest()):
            n = size[d["doc_id"]]
            part = max(0, min(n, budget - passes * total[s] - start))
            start += n
            if n:
                out[d["doc_id"], d["text"]] += passes
            if part:
                ends = [m.end() for m in SPACED.finditer(d["text"])]
                out[d["doc_id"], d["text"] if part == n else d["text"][: ends[part - 1]]] += 1
    return +out


def test_pipeline_matches_brute_force(spark):
    import corpus_pipeline

    docs = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    good = good_ones(spark, docs)
    single = first_of_near_copies(good)
    clean = without_passages(single, items)
    assert len(docs) > len(good) > len(single) > len(clean) > 0  # every stage drops something
    rows = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r["doc_id"], r["text"]) for r in rows) == mixture(clean)
    shards = Counter(r["shard"] for r in rows)
    assert set(shards) == set(range(24)) and max(shards.values()) - min(shards.values()) <= 1
    for shard, n in shards.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(n))
    assert all(r["size"] == len((r["text"] or "").encode()) + 8 and r["law"] == "rows" for r in rows)
