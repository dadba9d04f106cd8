"""Fingerprints of texts with more equal shingles than a lane holds."""

import pytest
import xxhash

from pagewright.llm import simhash


@pytest.mark.parametrize("word", ["a", "b", "word"])
def test_fingerprint_of_many_equal_words(spark, word):
    docs = spark.createDataFrame([(1, f"{word} " * 40_000)], "doc_id long, text string")
    want = xxhash.xxh64_intdigest(f"{word} {word} {word}".encode(), 42)
    assert simhash.fingerprints(docs).first()["fp"] % 2**64 == want
