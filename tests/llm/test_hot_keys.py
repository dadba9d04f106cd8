"""One key on most rows: equal ids, texts, lines and whole rows."""

from collections import Counter

import pytest
from conftest import SF
from pyspark.sql import functions as F

import corpus_pipeline
from pagewright.llm import common, decontamination, line_dedup, mixing, pii, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


def planned(docs):
    plan = mixing.mix(docs.select("doc_id", "source", mixing.word_count().alias("size"), *common.whole_row_key(docs))).collect()
    out = Counter()
    for r in plan:
        out[r["source"]] += r["taken"]
    return out


@pytest.mark.parametrize("doc_id", [7, None])
def test_the_mix_takes_what_it_plans_from_rows_of_one_id_and_text(spark, doc_id):
    rows = [(doc_id, "w " * 6, "A")] * 20 + [(doc_id, "w " * 6, "B")] * 20 + [(i, "x " * 6, "C") for i in range(4)]
    docs = frame(spark, rows)
    taken = Counter()
    for r in corpus_pipeline.mixed(spark, docs, SF).collect():
        taken[r["source"]] += len(r["text"].split())
    assert taken == planned(docs) == Counter({"A": 240, "B": 108, "C": 48})  # 396 words by 3, 1 and 2, at most twice the source


def test_shards_follow_each_row_of_one_id_and_text(spark):
    rows = [(7, "same text", s) for s in "ABCDEFGH" for _ in range(30)]
    docs = frame(spark, rows)
    out = corpus_pipeline.sharded(spark, docs, SF).collect()
    counts = Counter(r["shard"] for r in out)
    assert Counter(r["source"] for r in out) == Counter(s for _, _, s in rows) and max(counts.values()) - min(counts.values()) <= 1


def test_ranges_part_one_id(spark, monkeypatch):
    monkeypatch.setattr(common, "ROWS_A_RANGE", 50)
    docs = frame(spark, [(None, f"text {i % 3}", "A") for i in range(1000)])
    ranged = common.ranged(docs, F.col("doc_id"), F.col("text"))
    sizes = [r["count"] for r in ranged.groupBy("_cell").count().collect()]
    assert sum(sizes) == 1000 and max(sizes) < 250  # of 20 ranges none holds all rows of an id or a text
    assert planned(docs)["A"] == 2 * 2000 * 0.75


def test_hot_keys_meet_in_parts(spark):
    rows = spark.range(10_000).select(F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id")).alias("k"), "id")
    groups = rows.groupBy("k").agg(F.count("*").alias("n"))
    met = common.join_spread(rows, groups, ["k"], "n", 10_000, F.xxhash64("id")).collect()
    assert Counter(r["id"] for r in met) == Counter(range(10_000)) and all(r["n"] == (6667 if r["k"] == 1 else 1) or r["k"] == 1 for r in met)


def test_a_line_in_every_document(spark):
    line = "a line that stands in every document"
    docs = spark.createDataFrame([(i, f"{line}\nown {i} and no other\n{line}") for i in range(3000)], "doc_id long, text string")
    dropped = {r["doc_id"]: r["n_dropped"] for r in line_dedup.drop_lines(docs, line_dedup.repeated_lines(docs)).collect()}
    assert dropped == {i: 2 * (i > 0) for i in range(3000)}


def test_texts_of_one_hash_stand_together(spark):
    docs = frame(spark, [(i, f"text {i % 5}" if i % 3 else "hot", "AB"[i % 2]) for i in range(3000)])
    out = sharding.hilbert_shards(common.cut(sharding.metadata(docs)), 7).select("_rank", "_text").orderBy("_rank").collect()
    runs = 1 + sum(a["_text"] != b["_text"] for a, b in zip(out, out[1:], strict=False))
    assert [r["_rank"] for r in out] == list(range(3000)) and runs == len({r["_text"] for r in out})


def test_windows_of_items_without_an_id_hit(spark):
    items = spark.createDataFrame([(None, "one two three"), (5, "four five"), (6, "four five")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "zero one two three"), (2, "one two three four five")] + [(3, "four five")] * 50, "doc_id long, text string").withColumn("words", F.lit(1)).withColumn("items", F.lit(2))
    got = {r["doc_id"]: (r["n_hit"], r["item_ids"], r["contaminated"]) for r in decontamination.contamination(docs, items).collect()}
    assert got == {1: (3, [], True), 2: (5, ["5", "6"], True), 3: (2, ["5", "6"], True)}


def test_repeated_rows_of_personal_data_count_once(spark):
    said = "mail a@b.de, token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" and DE89 3704 0044 0532 0130 00."
    docs = spark.createDataFrame([(1, said)] * 200 + [(None, said)], "doc_id long, text string").withColumn("kind", F.lit("x")).withColumn("at", F.lit(1))
    got = Counter((r["doc_id"], r["kind"]) for r in pii.pii_spans(docs).where("kind is not null").collect())
    assert got == Counter({(i, k): 1 for i in (1, None) for k in ("email", "iban", "secret")})
