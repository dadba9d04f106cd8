"""SimHash fingerprints and near-duplicates by a covering code (operator 8)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import ascii_lower, components, cut, space_words

#: Shingles summed before lanes of 16 bits are taken apart; the top lane is signed, so it holds 32,767 at most.
CHUNK = 16_384
LANES = [f"l{i}" for i in range(16)]
#: Bit b of a fingerprint is lane b // 16 of the sum l{b % 16}.
ONE_A_LANE = 0x0001000100010001


def fingerprints(docs: DataFrame, words_a_shingle: int = 3) -> DataFrame:
    """(doc_id, _text, fp) of docs (doc_id, text): a bit is set if it is in over half of the shingles' XXH64 (seed 42).

    The shingles are exploded in place and their hashes summed without a shuffle of texts: the 64 counters of a
    document are 16 longs of four 16-bit lanes. A long document is summed in chunks of CHUNK shingles, so lanes don't
    run over. Null, empty and blank texts have fingerprint 0. Each row, repeated or not, has its own; other columns are left out.
    """
    k = words_a_shingle
    rows = docs.select("doc_id", F.xxhash64("text").alias("_text"), space_words(ascii_lower(F.col("text"))).alias("words"), F.monotonically_increasing_id().alias("row"))
    rows = rows.select("*", F.size("words").alias("n")).select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("n") - k))).alias("pos"))
    shingle = F.when(F.col("n") >= k, F.concat_ws(" ", *[F.get("words", F.col("pos") + i) for i in range(k)])).otherwise(F.array_join("words", " "))
    rows = rows.select("row", "doc_id", "_text", F.expr(f"pos div {CHUNK}").alias("chunk"), F.when(F.col("n") > 0, F.xxhash64(shingle)).alias("h"))
    one = F.lit(ONE_A_LANE).cast("long")
    sums = rows.groupBy("row", "doc_id", "_text", "chunk").agg(F.count("h").alias("n"), *[F.sum(F.shiftrightunsigned("h", i).bitwiseAND(one)).alias(c) for i, c in enumerate(LANES)])
    lane = lambda b: F.shiftrightunsigned(LANES[b % 16], 16 * (b // 16)).bitwiseAND(0xFFFF)
    sums = sums.groupBy("row", "doc_id", "_text").agg(F.sum("n").alias("n"), F.array(*[F.sum(lane(b)) for b in range(64)]).alias("c"))
    fp = F.lit(0).cast("long")
    for b in range(64):
        fp = fp.bitwiseOR(F.when(F.coalesce(F.get("c", F.lit(b)), F.lit(0)) * 2 > F.col("n"), F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))
    return sums.select("doc_id", "_text", fp.alias("fp"))


def anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The anchors within distance 2 of each fingerprint: (anchor, fp).

    Anchors are the words of the perfect Hamming code on bits 0 to 62, each with bit 63 free: every 64-bit word is
    within 1 of one (covering radius 1). The syndrome of a word is the xor of the numbers 1 to 63 of its set bits; a
    word with syndrome s != 0 has the anchor at bit s, those at 31 pairs of bits whose numbers xor to s, and the first
    with bit 63 turned.
    """
    numbers = np.arange(1, 64)
    pairs = {s: [(i, i ^ s) for i in range(1, 64) if i < i ^ s] for s in numbers}
    masks = np.zeros((64, 33), np.uint64)
    one = np.uint64(1)
    top = one << np.uint64(63)
    masks[0] = top
    masks[0, 0] = 0
    for s in numbers:
        near = one << np.uint64(s - 1)
        masks[s] = [near, near | top, *[(one << np.uint64(i - 1)) | (one << np.uint64(j - 1)) for i, j in pairs[s]]]
    for pdf in batches:
        fp = pdf["fp"].to_numpy().astype(np.int64).view(np.uint64)
        syndrome = np.zeros(len(fp), np.int64)
        for number in numbers:
            syndrome ^= np.where((fp >> np.uint64(number - 1)) & one, number, 0)
        for at in range(0, len(fp), 8192):
            part, s = fp[at : at + 8192], syndrome[at : at + 8192]
            out = part[:, None] ^ masks[s]
            keep = np.ones(out.shape, bool)
            keep[s == 0, 2:] = False
            yield pd.DataFrame({"anchor": out[keep].view(np.int64), "fp": np.repeat(part, keep.sum(1)).view(np.int64)})


def cell_links(batches: Iterator[pd.DataFrame], threshold: int = 2) -> Iterator[pd.DataFrame]:
    """Compares the fingerprints of each anchor: (a, b), a forest of links within the threshold that spans what the cell links.

    A cell holds fingerprints within 2 of its anchor, 2,081 at most, whatever the input.
    """
    for pdf in batches:
        a, b = [], []
        for cell in pdf["fps"]:
            fps = np.unique(np.asarray(cell, np.int64))
            near = np.bitwise_count(fps.view(np.uint64)[:, None] ^ fps.view(np.uint64)[None]) <= threshold
            left = np.ones(len(fps), bool)
            while left.any():
                at = int(left.argmax())
                left[at] = False
                front = [at]
                while front:
                    x = front.pop()
                    new = np.flatnonzero(near[x] & left)
                    left[new] = False
                    front += new.tolist()
                    a += [fps[x]] * len(new)
                    b += fps[new].tolist()
        yield pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) of distinct fingerprints (fp) that span the same components as all pairs at 2 or fewer differing bits.

    Two within 2 bits have a word between them that is within 1 of both, and an anchor within the covering radius 1 of
    that word: so it is enough to copy each fingerprint to every anchor within the covering radius plus half the
    threshold of either side, 33 at most. Only anchors with two fingerprints are compared. No cell grows with the input
    and no link between different fingerprints is lost.
    """
    cells = distinct.select("fp").mapInPandas(anchors, "anchor long, fp long").groupBy("anchor").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    return cells.select("fps").mapInPandas(cell_links, "a long, b long").distinct()


def near_duplicates(prints: DataFrame) -> DataFrame:
    """(doc_id, _text, fp, component_id) of fingerprints: documents link at 2 or fewer differing bits; component_id is the smallest doc_id reachable (null if all are null).

    Equal fingerprints are one row before anything is compared.
    """
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = components(fingerprint_links(distinct))
    roots = distinct.join(linked, distinct["fp"] == linked["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = roots.join(least, "root").select(F.col("fp").alias("_fp"), "component_id")
    return prints.join(labels, F.col("fp") == F.col("_fp")).drop("_fp")


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = near_duplicates(cut(fingerprints(docs)))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
