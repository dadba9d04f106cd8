"""Near copies by exact Jaccard similarity of word shingles: a prefix-filtered set join (the pipeline's near-dedup stage).

Operator 8's fingerprints and anchors link the nearest texts first; a similarity of 0.8 leaves fingerprints 5 to 10 bits
apart, beyond any covering that cells could hold, so the other links come from the set join, which loses none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import ascii_lower, components, cut, join_spread, space_words, whole_row_key
from pagewright.llm.simhash import fingerprint_links
from pagewright.session import shuffles_dropped

WORDS_A_SHINGLE = 5
#: Two texts are near copies if 5 * |A and B| >= 4 * |A or B|: similarity 0.8 or more, in whole numbers.
PART, WHOLE = 4, 5
#: Shingles of a part of the hash space, which one group counts, and of a batch of texts that a task deals out at once.
COUNTED, DEALT = 1 << 21, 1 << 21
#: A shingle in more texts of a batch than this is dealt out once, with its number.
HERE = 256
#: Nodes from which a component is compared with its visitors as a whole, and shingles of a block of nodes that are compared.
LARGE, BLOCK = 256, 1 << 22
#: Classes of shingles whose counts bound what two sets have in common; counts of FULL or more bound nothing.
CLASSES, FULL = 512, 255
#: Counts of a shingle over all documents are told apart up to here.
COUNTS = 65_535


def mixed_bits(x: np.ndarray) -> np.ndarray:
    """The SplitMix64 finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(words: np.ndarray) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the shingles of a text's word hashes; fewer words are one shingle, none are none."""
    w = np.asarray(words, np.int64).view(np.uint64)
    k = min(WORDS_A_SHINGLE, len(w))
    if not k:
        return np.zeros(0, np.uint64)
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = mixed_bits(h * np.uint64(0x9E3779B97F4A7C15) + w[i : len(w) - k + 1 + i])
    return np.unique(h)


def node_of(found: np.ndarray) -> int:
    """64 bits that name a set of shingles."""
    return int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=8).digest(), "little", signed=True)


def fingerprint_of(found: np.ndarray) -> int:
    """The set's SimHash: a bit is set if it is in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(found), 65_536):
        ones += np.unpackbits(found[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(found), bitorder="little").view(np.int64)[0])


def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        sets = [shingle_set(w) for w in pdf["words"]]
        out = pdf[["doc_id", "_k1", "_k2"]].copy()
        out["node"], out["n"], out["fp"] = [node_of(s) for s in sets], [len(s) for s in sets], [fingerprint_of(s) for s in sets]
        yield out


def with_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each node's set, and how many of its shingles are in each class."""
    for pdf in batches:
        sets = [shingle_set(w) for w in pdf["words"]]
        sketches = [np.bincount((s & np.uint64(CLASSES - 1)).astype(np.int64), minlength=CLASSES).clip(max=FULL).astype(np.uint8).tobytes() for s in sets]
        yield pd.DataFrame({"node": pdf["node"], "shingles": [s.view(np.int64) for s in sets], "sketch": sketches})


def word_hashes(text: str = "text"):
    return F.transform(space_words(ascii_lower(F.col(text))), lambda w: F.xxhash64(w)).alias("words")


PARCEL = "part long, batch long, kind int, a binary, b binary, c binary, d binary"


def parcels(parts: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Deals the shingles of texts out to the parts of the hash space that count them, a batch of texts at a time (PARCEL).

    To a part go the batch's shingles there (their lower 32 bits, b), text by text, with the number of each text's (a);
    one that many texts of the batch have goes once (c), with their number (d). What tells the batch's texts stays with
    the batch, in a part of its own: their nodes (a), sizes (b), and who has the shingles that went once (c, d).
    """

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 32
        for pdf in batches:
            sets: dict[int, np.ndarray] = {}
            size = 0
            for w in pdf["words"]:
                found = shingle_set(w)
                if len(found) and (node := node_of(found)) not in sets:
                    sets[node] = found
                    size += len(found)
                if size >= DEALT:
                    yield parcel(sets, number)
                    sets, size, number = {}, 0, number + 1
            if sets:
                yield parcel(sets, number)
                number += 1

    def parcel(sets: dict[int, np.ndarray], batch: int) -> pd.DataFrame:
        sizes = np.array([len(s) for s in sets.values()], np.int32)
        every, owner = np.concatenate(list(sets.values())), np.repeat(np.arange(len(sets), dtype=np.uint32), sizes)
        part = ((every >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        token, owner, part = (every[order] & np.uint64(2**32 - 1)).astype(np.uint32), owner[order], part[order]
        out, hot_owner, hot_token = [], [], []
        for first, last in zip(starts := np.flatnonzero(np.diff(part, prepend=-1)), [*starts[1:], len(part)], strict=True):
            t, o, p = token[first:last], owner[first:last], int(part[first])
            same, at, n = np.unique(t, return_inverse=True, return_counts=True)
            hot = n > HERE
            if hot.any():
                there = hot[at]
                hot_owner.append(o[there])
                hot_token.append(t[there].astype(np.int64) | p << 32)
                t, o = t[~there], o[~there]
            counts = np.bincount(o, minlength=len(sets)).astype(np.uint32)
            out.append((p, batch, 1, counts.tobytes(), t.tobytes(), same[hot].tobytes(), n[hot].astype(np.uint32).tobytes()))
        none = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        out.append((-1 - batch, batch, 0, np.array(list(sets), np.int64).tobytes(), sizes.tobytes(), np.concatenate(hot_owner or none[0]).tobytes(), np.concatenate(hot_token or none[1]).tobytes()))
        return pd.DataFrame(out, columns=["part", "batch", "kind", "a", "b", "c", "d"])

    return deal


def counted(pdf: pd.DataFrame) -> pd.DataFrame:
    """Counts the shingles of one part over all batches. To each batch go back the texts (a), shingles (b) and counts (c) of those that come twice or more; for those that went once, shingles and counts (kind 2)."""
    part = int(pdf["part"].iat[0])
    if part < 0:
        return pdf
    tokens, hot, times = ([np.frombuffer(x, np.uint32) for x in pdf[c]] for c in ("b", "c", "d"))
    _, at, n = np.unique(np.concatenate(tokens + hot), return_inverse=True, return_counts=True)
    single = sum(map(len, tokens))
    np.add.at(n, at[single:], np.concatenate(times).astype(np.int64) - 1)
    df, place, out = n[at].clip(max=COUNTS).astype(np.uint16), 0, []
    for batch, counts, t in zip(pdf["batch"], pdf["a"], tokens, strict=True):
        here = df[place : place + len(t)]
        place += len(t)
        keep = here > 1
        if keep.any():
            counts = np.frombuffer(counts, np.uint32)
            owner = np.repeat(np.arange(len(counts), dtype=np.uint32), counts)[keep]
            out.append((part, batch, 1, owner.tobytes(), t[keep].tobytes(), here[keep].tobytes(), b""))
    for batch, t in zip(pdf["batch"], hot, strict=True):
        if len(t):
            out.append((part, batch, 2, b"", t.tobytes(), df[place : place + len(t)].tobytes(), b""))
        place += len(t)
    return pd.DataFrame(out, columns=list(pdf.columns))


def prefixes(pdf: pd.DataFrame) -> pd.DataFrame:
    """The necessary prefix of each text of a batch, without the shingles that no other text has: (token, node, n, alone: how many those are).

    Shingles are ordered by their count over all documents, rarest first. Sets of similarity 0.8 share 0.8 * n or more of
    a set's n shingles, so one of its first n - 0.8 * n + 1 must be among the other's first ones.
    """
    own = pdf[pdf["kind"] == 0].iloc[0]
    nodes, sizes = np.frombuffer(own["a"], np.int64), np.frombuffer(own["b"], np.int32).astype(np.int64)
    read = lambda kind, column, dtype: np.concatenate([np.zeros(0, dtype), *[np.frombuffer(x, dtype) for x in pdf.loc[pdf["kind"] == kind, column]]])
    named = lambda kind: np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(x, np.uint32).astype(np.int64) | int(p) << 32 for x, p in pdf.loc[pdf["kind"] == kind, ["b", "part"]].itertuples(index=False)]])
    owner, token, df = read(1, "a", np.uint32), named(1), read(1, "c", np.uint16)
    hot, times = named(2), read(2, "c", np.uint16)
    hot_owner, hot_token = np.frombuffer(own["c"], np.uint32), np.frombuffer(own["d"], np.int64)
    by = np.argsort(hot)
    owner, token = np.concatenate([owner, hot_owner]), np.concatenate([token, hot_token])
    df = np.concatenate([df, times[by][np.searchsorted(hot[by], hot_token)]])
    order = np.lexsort((token, df, owner))
    owner, token = owner[order].astype(np.int64), token[order]
    shared = np.bincount(owner, minlength=len(nodes))
    rank = np.arange(len(owner)) - (np.cumsum(shared) - shared)[owner]
    alone = sizes - shared
    keep = rank < (sizes + 1 - -(-PART * sizes // WHOLE) - alone)[owner]
    at = owner[keep]
    return pd.DataFrame({"token": token[keep], "node": nodes[at], "n": sizes[at], "alone": alone[at]})


def verified(pairs: DataFrame, sets: DataFrame, total: int) -> DataFrame:
    """The pairs (a, b), about total, whose sets of shingles have similarity 0.8 or more. A node a that is in very many pairs is dealt over many tasks."""
    counts = pairs.groupBy("a").agg(F.count("*").alias("pairs"))
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("s")).join(counts, "a")
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("t"))
    both = F.size(F.array_intersect("s", "t"))
    met = join_spread(pairs, left, ["a"], "pairs", total, F.xxhash64("b")).join(right, "b")
    return met.where(both * (PART + WHOLE) >= PART * (F.size("s") + F.size("t"))).select("a", "b")


def fits() -> Column:
    """Whether sets of n and m shingles can have a similarity of 0.8."""
    return F.least("n", "m") * WHOLE >= F.greatest("n", "m") * PART


def fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes that operator 8 brings together: each node of a fingerprint with the first one, and the first ones of fingerprints within 2 bits."""
    heads = cut(nodes.where("n > 0").groupBy("fp").agg(F.min(F.struct("node", "n")).alias("h"), F.count("*").alias("size")).select("fp", F.col("h.node").alias("head"), F.col("h.n").alias("m"), "size"))
    same = join_spread(nodes.where("n > 0").select("node", "n", "fp"), heads.where("size > 1"), ["fp"], "size", nodes.count(), F.col("node")).where(F.col("node") != F.col("head"))
    left = heads.select(F.col("fp").alias("a"), F.col("head").alias("node"), F.col("m").alias("n"))
    right = heads.select(F.col("fp").alias("b"), "head", "m")
    across = fingerprint_links(heads).join(left, "a").join(right, "b")
    both = same.select("node", "n", "head", "m").union(across.select("node", "n", "head", "m"))
    return both.where(fits()).select(F.col("head").alias("a"), F.col("node").alias("b"))


def sides(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Places of the two sides of a group; of a block alone both are all of it."""
    second = pdf["second"].to_numpy()
    alone = pdf["i"].iat[0] == pdf["j"].iat[0] and not pdf["apart"].iat[0]
    return (np.arange(len(pdf)),) * 2 if alone else (np.flatnonzero(~second), np.flatnonzero(second))


def possible(pdf: pd.DataFrame) -> pd.DataFrame:
    """The nodes of a group (place, node, second) that may be near a node of the other side and another component: two sets have no more in common than either shares with any text, nor than, class by class, the smaller of their counts."""
    left, right = sides(pdf)
    root, n, shared = pdf["root"].to_numpy(), pdf["n"].to_numpy(), (pdf["n"] - pdf["alone"]).to_numpy()
    counts = np.stack([np.frombuffer(x, np.uint8) for x in pdf["sketch"]])
    full = (counts == FULL).any(1)
    keep = np.zeros(len(pdf), bool)
    if len(left) and len(right) and len(np.unique(root)) > 1:
        for x in left:
            least = PART * (n[right] + n[x])
            fit = right[(root[right] != root[x]) & (np.minimum(n[right], n[x]) * WHOLE >= np.maximum(n[right], n[x]) * PART) & (np.minimum(shared[right], shared[x]) * (PART + WHOLE) >= least)]
            fit = fit[full[fit] | full[x] | (np.minimum(counts[fit], counts[x]).sum(1, dtype=np.int64) * (PART + WHOLE) >= PART * (n[fit] + n[x]))]
            keep[fit] = True
            keep[x] |= len(fit) > 0
    return pdf.loc[keep, ["place", "node", "second"]]


def compared(pdf: pd.DataFrame) -> pd.DataFrame:
    """Compares the two sides of a group whole set by whole set, but for nodes of one component: links (a, b), one for each two components."""
    none = pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})
    root, node = pdf["root"].to_numpy(), pdf["node"].to_numpy()
    left, right = sides(pdf)
    if not len(left) or not len(right) or len(np.unique(root)) < 2:
        return none
    sets = [np.sort(np.asarray(s, np.int64)) for s in pdf["shingles"]]
    n = np.array([len(s) for s in sets])
    tokens, owner = np.concatenate([sets[i] for i in right]), np.repeat(right, n[right])
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    seen, out = set(), []
    for x in left:
        first, last = np.searchsorted(tokens, sets[x], "left"), np.searchsorted(tokens, sets[x], "right")
        many = last - first
        places = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
        both = np.bincount(owner[places], minlength=len(pdf))
        for y in np.flatnonzero((both * (PART + WHOLE) >= PART * (n[x] + n)) & (both > 0) & (root != root[x])):
            key = (min(root[x], root[y]), max(root[x], root[y]))
            if key not in seen:
                seen.add(key)
                out.append((node[x], node[y]))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64") if out else none


def paired(members: DataFrame) -> DataFrame:
    """The members (place, node, root, n, alone) of each place in blocks of about BLOCK shingles, once for each block they meet: place, i and j, second (the member is of block j), apart."""
    blocks = members.groupBy("place").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    rows = members.join(blocks, "place").withColumn("at", F.pmod(F.xxhash64("node"), "blocks").cast("int")).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select("place", F.least("at", "k").alias("i"), F.greatest("at", "k").alias("j"), (F.col("at") > F.col("k")).alias("second"), F.lit(False).alias("apart"), "node", "root", "n", "alone")


def facing(members: DataFrame) -> DataFrame:
    """The same for members with a side (second): blocks of one side meet those of the other."""
    sizes = members.groupBy("place").agg(*[F.greatest(F.lit(1), F.ceil(F.sum(F.when(F.col("second") == s, F.col("n"))) / BLOCK)).cast("int").alias(c) for c, s in (("rows", False), ("cols", True))])
    at = lambda c: F.pmod(F.xxhash64("node"), c).cast("int")
    rows = members.join(sizes, "place").withColumn("k", F.explode(F.sequence(F.lit(0), F.when(F.col("second"), F.col("rows")).otherwise(F.col("cols")) - 1)))
    i, j = F.when(F.col("second"), F.col("k")).otherwise(at("rows")), F.when(F.col("second"), at("cols")).otherwise(F.col("k"))
    return rows.select("place", i.alias("i"), j.alias("j"), "second", F.lit(True).alias("apart"), "node", "root", "n", "alone")


def links_across(members: DataFrame, deal: Callable[[DataFrame], DataFrame], sets: DataFrame) -> DataFrame:
    """Links (a, b) between the members (place, node, root, n, alone, second) of each place: sketches rule members out first, and only those left bring their sets."""
    sketched = deal(members).join(sets.select("node", "sketch"), "node")
    left = sketched.groupBy("place", "i", "j").applyInPandas(possible, "place long, node long, second boolean")
    left = left.select("place", "node", *(["second"] if deal is facing else [])).distinct()
    kept = cut(members.join(left, left.columns))
    return deal(kept).join(sets.select("node", "shingles"), "node").groupBy("place", "i", "j").applyInPandas(compared, "a long, b long")


def led_tokens(tokens: DataFrame) -> DataFrame:
    """The tokens (token, node, n, alone) that several nodes have, with how many these are (many), and of each token's nodes that with most in common with others (a, of size m; it is its own root r)."""
    leader = F.struct(F.col("alone") / F.col("n"), F.xxhash64("node"), F.col("node").alias("a"), F.col("n").alias("m"), F.col("node").alias("r"))
    led = tokens.groupBy("token").agg(F.count("*").alias("many"), F.min(leader).alias("l")).where("many > 1").select("token", "many", "l.a", "l.m", "l.r")
    return cut(tokens.join(cut(led), "token"))


def mixed_tokens(tokens: DataFrame, linked: DataFrame) -> DataFrame:
    """The tokens (token, node, n, alone, many) that still hold several components, with the root of each node, and a node (a, of size m and root r) of each token by chance."""
    rooted = tokens.join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    leader = F.struct(F.xxhash64(F.lit(1), "node"), F.col("node").alias("a"), F.col("n").alias("m"), F.col("root").alias("r"))
    mixed = rooted.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min(leader).alias("l")).where("low < high").select("token", "l.a", "l.m", "l.r")
    return cut(rooted.join(cut(mixed), "token"))


def meetings(rooted: DataFrame) -> DataFrame:
    """Pairs (a, b): each node b with the leader of the commonest of its tokens that another component leads."""
    return rooted.where((F.col("root") != F.col("r")) & fits()).groupBy("node").agg(F.max(F.struct("many", F.xxhash64("token"), "a")).alias("x")).select("x.a", F.col("node").alias("b"))


def near_copies(docs: DataFrame) -> DataFrame:
    """copy_groups() of docs; of the many small exchanges only what its last frame needs stays on disk."""
    with shuffles_dropped(docs.sparkSession):
        return copy_groups(docs)


def copy_groups(docs: DataFrame) -> DataFrame:
    """(node, root, first) of docs (doc_id, text): near copies and what they link share a root; first is (none, doc_id, _k1, _k2) of the node's smallest doc_id (null last), then row key.

    Texts with equal sets of shingles are one node. The links are exact:

    1. Operator 8's anchors bring fingerprints within 2 bits together; those pairs are verified.
    2. All shingles are counted over all documents. Each node's necessary prefix of its rarest shingles is what it is found
       by; shingles that no other text has find nothing, so most texts drop out here.
    3. Nodes that share a prefix shingle are candidates. Twice each node whose shingles hold several components meets one
       other: of its commonest such shingle the node that has most in common with others, then one by chance. This
       joins large groups with a pair a node; it only saves work, as what it leaves is compared in full.
    4. What still shares a prefix shingle across components is compared in full: within each shingle, and where a
       component is large, its visitors with all of it, in blocks of bounded size. Counts by class, which bound what two
       sets share, rule most out before whole sets move. No pairs are emitted, only links.

    Every link is verified on the whole sets. The comparisons of step 4 grow with the candidates that are no near copies
    of each other though they share a rare shingle.
    """
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", *whole_row_key(docs), word_hashes())
    prints = cut(rows.mapInPandas(signed, f"doc_id {kind}, _k1 long, _k2 long, node long, n long, fp long"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_k1", "_k2"))
    nodes = cut(prints.groupBy("node").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), least.alias("first")))
    parts = max(1, -(-(prints.agg(F.sum("n")).first()[0] or 0) // COUNTED))
    dealt = docs.select(word_hashes()).mapInPandas(parcels(parts), PARCEL)
    tokens = dealt.groupBy("part").applyInPandas(counted, PARCEL).groupBy("batch").applyInPandas(prefixes, "token long, node long, n long, alone long")
    led = led_tokens(cut(tokens.distinct()))
    tokens = led.drop("a", "m", "r")
    nearest = cut(fingerprint_pairs(nodes).distinct())
    wanted = tokens.select("node").union(nearest.select(F.explode(F.array("a", "b")))).distinct().join(nodes, "node").select("node", "first._k1", "first._k2")
    texts = docs.select("text", *whole_row_key(docs)).join(wanted, ["_k1", "_k2"]).select("node", word_hashes())
    sets = cut(texts.mapInPandas(with_sets, "node long, shingles array<long>, sketch binary").dropDuplicates(["node"]))

    total = nodes.count()
    # the first leaders are those with most in common with others, the second ones by chance
    met = meetings(led.withColumn("root", F.col("node")))
    linked = cut(components(verified(nearest.union(met).distinct(), sets, total)))
    rooted = mixed_tokens(tokens, linked)
    linked = cut(components(linked.select(F.col("node").alias("a"), F.col("root").alias("b")).union(verified(meetings(rooted), sets, total))))
    rooted = mixed_tokens(rooted.select(*tokens.columns), linked)
    rest = rooted.select("token", "node", "n", "alone", "root")
    if not rest.isEmpty():
        of = linked.select(F.col("node").alias("_node"), "root")
        own = nodes.join(of, F.col("node") == F.col("_node")).select("node", "root", "n")
        large = own.groupBy("root").agg(F.count("*").alias("size")).where(F.col("size") >= LARGE)
        rest = cut(rest.join(F.broadcast(large) if large.count() < 10_000 else large, "root", "left"))
        small = rest.where("size is null")
        # shingles of the same nodes would compare them again
        several = small.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"), *[F.bit_xor(F.xxhash64(F.lit(k), "node")).alias(k) for k in ("s", "t")]).where("low < high")
        several = several.groupBy("n", "s", "t").agg(F.min("token").alias("token")).select("token")
        hosts = rest.where("size is not null").select("token", F.col("root").alias("to"), F.col("size").alias("theirs")).distinct()
        smaller = F.coalesce("size", F.lit(0)) < F.col("theirs")
        visits = cut(rest.join(hosts, "token").where((F.col("root") != F.col("to")) & (smaller | (F.col("size") == F.col("theirs")) & (F.col("root") < F.col("to")))).select("to", "node", "root", "n", "alone").distinct())
        hosted = own.join(visits.select(F.col("to").alias("root")).distinct(), "root").select(F.col("root").alias("place"), "node", "root", "n", F.lit(0).cast("long").alias("alone"), F.lit(False).alias("second"))
        visiting = visits.select(F.col("to").alias("place"), "node", "root", "n", "alone", F.lit(True).alias("second"))
        within = small.join(several, "token").select(F.col("token").alias("place"), "node", "root", "n", "alone")
        found = links_across(within, paired, sets).union(links_across(hosted.union(visiting), facing, sets))
        linked = cut(components(linked.select(F.col("node").alias("a"), F.col("root").alias("b")).union(found)))
    roots = linked.select(F.col("node").alias("_node"), "root")
    return nodes.join(roots, F.col("node") == F.col("_node"), "left").select("node", F.coalesce("root", "node").alias("root"), "first")
