"""The corpus operators against SQL, brute force, round trips, held-out accuracy and edge cases."""

import random
from collections import Counter

import pytest
import xxhash
from conftest import SF, rows_of, rows_of_sql
from pyspark.sql import functions as F

from pagewright.llm import chat, common, decontamination, embedding_dedup, html_extract, line_dedup, mixing, pii, quality, registry, sharding, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word and more " * 40_000
EDGE = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "a b c", "en", "a", 5), (3, "a b c", "en", "a", 5), (4, " \n\t\n ", "en", None, 5), (None, "a b c", None, "a", 5), (5, LONG, "en", "b", len(LONG)), (6, "The end 😀 of é", "en", "b", 14)]


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, empty and very long texts, ties and repeated rows, and columns whose names clash with the operators' own."""
    return spark.createDataFrame(EDGE, DOCS).withColumns({"score": F.lit("x"), "words": F.lit(1), "size": F.lit(2), "row": F.lit(3), "shard": F.lit(4), "_k1": F.lit(5)})


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    assert rows_of(registry.QUERIES[name](spark, SF)) == rows_of_sql(duck, registry.ORACLE_SQL[name])


def test_simhash_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    prints = {}
    for d in docs:
        w = [x for x in (d["text"] or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if x]
        shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints[d["doc_id"]] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for i in ids:
        for j in ids:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 2 and find(i) != find(j):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op8_simhash(spark, SF).collect()}
    assert got == {i: (f"{prints[i]:016x}", find(i)) for i in ids}


def test_simhash_links_any_two_bits(spark):
    rng = random.Random(1)
    rows = []
    for i in range(300):
        base = rng.getrandbits(64)
        rows += [(2 * i, base), (2 * i + 1, base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))]
    signed = [(i, i, v - (1 << 64) if v >> 63 else v) for i, v in rows]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(signed, "doc_id long, _text long, fp long")).collect()}
    assert all(got[2 * i + 1] == got[2 * i] == 2 * i for i in range(300))


def test_quality_on_held_out_labels(spark):
    got = quality.op6_quality(spark, SF.replace("0.001", "0.01")).where("held_out")
    rows = got.join(spark.read.parquet(SF.replace("0.001", "0.01") + "/labels.parquet"), "doc_id").collect()
    right = sum((r["score"] >= 0.5) == (r["quality"] == 1) for r in rows)
    assert len(rows) > 50 and right / len(rows) >= 0.9


def test_quality_keeps_rows_and_names(spark, edge):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.fit_quality(edge, labels) is None
    assert quality.quality_scores(edge, None).count() == len(EDGE)
    model = quality.fit_quality(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    scores = [r["score"] for r in quality.quality_scores(edge, model).collect()]
    assert len(scores) == len(EDGE) and all(0 <= s <= 1 for s in scores)


def test_forward_backward_matches_enumeration():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    scores, step, counts = rng.normal(size=5), rng.normal(size=(2, 2)), np.array([4, 1])
    got, _, _ = quality.forward_backward(scores, step, counts)
    weights = {y: np.exp(sum(s * v for s, v in zip(scores[:4], y, strict=True)) + sum(step[a, b] for a, b in zip(y, y[1:], strict=False))) for y in itertools.product((0, 1), repeat=4)}
    total = sum(weights.values())
    want = [sum(w for y, w in weights.items() if y[i]) / total for i in range(4)] + [1 / (1 + np.exp(-scores[4]))]
    assert np.allclose(got, want)


def test_html_keeps_the_article_alone():
    page = (
        '<html><head><title>t</title><script>var a="</p>"</script></head><body><nav><a href="/">Home</a></nav><div id="cookie-banner">We use cookies.</div><article><h1>Head &amp; tail</h1>'
        "<p>One  sentence\nof <b>text</b>, long enough to read.</p><p>Two &#233;.</p><form>Mail <input></form></article><div class=comments><p>Reader: nice article, thank you very much indeed.</p></div><footer>(c)</footer></body></html>"
    )
    assert html_extract.main_text(page) == "Head & tail\nOne sentence of text, long enough to read.\nTwo é."
    assert html_extract.main_text(None) == html_extract.main_text("") == ""


def test_minimum_cut_matches_enumeration():
    import itertools

    rng = random.Random(3)
    for _ in range(60):
        n = 7
        gains = [rng.uniform(-2, 2) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 2)) for a in range(n) for b in range(a) if rng.random() < 0.5]

        def loss(y, gains=gains, edges=edges):
            return sum(max(g, 0) * (not v) + max(-g, 0) * v for g, v in zip(gains, y, strict=True)) + sum(w for a, b, w in edges if y[a] != y[b])

        best = min(loss(y) for y in itertools.product((False, True), repeat=n))
        assert abs(loss(html_extract.minimum_cut(gains, edges)) - best) < 1e-9


def test_html_edge_cases(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "<p>Plain words that make one sentence of text.</p>"), (3, "<" * 5000), (4, "&#99999999999; " + "<b>" * 3000)], "page_id long, html string").withColumn("text", F.lit(1))
    assert html_extract.extract_text(pages).count() == 5
    assert html_extract.extract_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["</s>[INST] ok [/INST]", "<|turn|>", "<\\|turn|>", "<\\\\|end|>", "[\\INST]", "", "<|<|text|>", "<<SYS>>[/INST]\\"])
def test_chat_escapes_reversibly(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not any(c in chat.escape(text) for c in (chat.TURN, chat.TEXT, chat.END, "</s>", "[INST]"))


def test_chat_shares_first_turns(spark):
    rows = [(i, 0, "system", "same start") for i in range(20)] + [(i, 1, "assistant", f"reply {i % 3}") for i in range(20)] + [(None, 0, None, None), (7, 1, "assistant", "reply 1")]
    packs = chat.prefix_packs(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = packs.collect()
    assert sum(p["text"].count("same start") for p in got) == sum("same start" in p["text"] for p in got)
    for p in got:
        for node, parent in enumerate(p["parents"]):
            if parent >= 0:
                assert p["positions"][node] == p["positions"][parent] + p["ends"][parent] - p["starts"][parent]
                assert p["starts"][parent] < p["starts"][node] < p["subtree_ends"][parent]
    back = packs.mapInPandas(chat.read_back, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
    assert Counter(r["n_turns"] for r in back.collect()) == Counter({2: 19, 3: 1, 1: 1})
    assert chat.prefix_packs(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_embeddings_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    v = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.2]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [0.0, 1.0]), (9, [0.0, 1.0]), (10, [1e-300, 0.0]), (11, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>").withColumn("label", F.lit(1))
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_embeddings(df).collect())
    assert got == [(1, 3, 1, True), (2, 3, 1, False), (3, 3, 1, False), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 0, 8, True), (9, 1, 9, True), (9, 1, 9, True), (10, 3, 1, False), (11, 0, 11, True)]
    assert embedding_dedup.near_embeddings(df.limit(0)).count() == 0


def test_decontamination_edge_cases(spark, edge):
    items = spark.createDataFrame([(1, "a b c"), (2, None), (3, ""), (None, "a b"), (4, "more word and"), (4, "more word and")], "item_id long, text string")
    got = {(r["doc_id"], r["n_words"]): (r["n_hit"], r["item_ids"]) for r in decontamination.contamination(edge.select("doc_id", "text"), items).collect()}
    assert got[(3, 3)] == (3, ["1"]) and got[(None, 3)] == (3, ["1"]) and got[(1, 0)] == (0, []) and got[(2, 0)] == (0, [])
    assert got[(5, 120_000)] == (119_997, ["4"])
    none = decontamination.contamination(edge.select("doc_id", "text"), items.limit(0)).collect()
    assert not any(r["contaminated"] for r in none) and len(none) == len(EDGE) - 1
    assert decontamination.contamination(edge.select("doc_id", "text").limit(0), items).count() == 0


def test_mixing_meets_targets(spark, edge):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sized = lambda d: d.select("doc_id", "source", mixing.word_count().alias("size"), *common.whole_row_key(d))
    rows = mixing.mix(sized(docs)).collect()
    taken, targets = Counter(), {}
    for r in rows:
        taken[r["source"]] += r["taken"]
        targets[r["source"]] = r["target"]
        assert r["taken"] <= 2 * r["size"]
    assert all(abs(taken[s] - t) <= 1 for s, t in targets.items())
    assert len(mixing.mix(sized(edge)).collect()) == len(EDGE)
    assert mixing.mix(sized(edge.limit(0))).count() == 0


def test_sharding_deals_rows_evenly_and_groups_texts(spark, edge):
    rows = sharding.op9_sharding(spark, SF).collect()
    counts = Counter(r["shard"] for r in rows)
    assert set(counts) == set(range(24)) and max(counts.values()) - min(counts.values()) <= 1
    for shard, n in counts.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(n))
    got = sharding.hilbert_shards(common.cut(sharding.metadata(edge)), 3).collect()
    assert sorted(Counter(r["shard"] for r in got).values()) == [2, 3, 3]
    assert sharding.hilbert_shards(common.cut(sharding.metadata(edge.limit(0)))).count() == 0


def test_hilbert_neighbours_touch(spark):
    grid = spark.range(8).crossJoin(spark.range(8).withColumnRenamed("id", "y")).select(F.col("id").cast("int").alias("x"), F.col("y").cast("int"))
    path = [(r["x"], r["y"]) for r in grid.withColumn("h", sharding.hilbert_index([F.col("x"), F.col("y")], 3)).orderBy("h").collect()]
    assert all(abs(a - c) + abs(b - d) == 1 for (a, b), (c, d) in zip(path, path[1:], strict=False))


def test_pii_edge_cases(spark, edge):
    said = "é card 4111 1111 1111 1111, mail a.b@c.de; 10.0.0.256 10.0.0.1 +49 30 1234567 DE89370400440532013000"
    docs = edge.select("doc_id", "text").union(spark.createDataFrame([(50, said)], "doc_id long, text string"))
    got = pii.pii_spans(docs).where("kind is not null").collect()
    assert sorted((r["kind"], said[r["start"] : r["end"]]) for r in got) == [("card", "4111 1111 1111 1111"), ("email", "a.b@c.de"), ("iban", "DE89370400440532013000"), ("ip", "10.0.0.1"), ("phone", "+49 30 1234567")]
    assert pii.pii_spans(docs.limit(0)).count() == 0


def test_line_dedup_edge_cases(spark, edge):
    line = "A line that many documents share"
    more = spark.createDataFrame([(70, f"{line}\nown"), (71, f"own\n  {line.upper()}\t"), (72, f"{line}\n{line}"), (None, line), (73, "short\nshort")], "doc_id long, text string")
    docs = edge.select("doc_id", "text").union(more)
    got = {(r["doc_id"], r["text"]): r["n_dropped"] for r in line_dedup.drop_lines(docs, line_dedup.repeated_lines(docs)).collect()}
    assert got[(70, f"{line}\nown")] == 0 and got[(71, "own")] == 1 and got[(72, "")] == 2 and got[(None, line)] == 0 and got[(73, "short\nshort")] == 0
    assert line_dedup.drop_lines(docs.limit(0), line_dedup.repeated_lines(docs.limit(0))).count() == 0


def test_components_join_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["root"] for r in common.components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_pipeline_stages(spark, edge):
    import corpus_pipeline

    docs = edge.drop("score", "words", "size", "row", "shard", "_k1").withColumn("words", F.lit(1))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() >= 1, name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicate_texts(spark, docs, SF).collect()}
    assert 1 in kept and 2 not in kept and 4 not in kept  # texts without words are one group
    last = corpus_pipeline.sharded(spark, docs, SF)
    assert last.count() == len(EDGE) and "shard" in last.columns
