"""Documents are dealt over tasks before their lines and words are told, and what is dear is told of few of them."""

import pytest
from conftest import SF
from pyspark.sql import functions as F

from pagewright.operators import checker
from pagewright.plans import checker as plans
from pagewright.session import dealt_texts


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_are_dealt_by_their_length(spark):
    docs = spark.createDataFrame([(k, "x" * 1000) for k in range(100)] + [(None, None)], "doc_id long, text string")
    dealt = dealt_texts(docs)
    assert dealt.rdd.getNumPartitions() == 3 * spark.sparkContext.defaultParallelism
    assert sorted(map(tuple, dealt.collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)


@pytest.mark.parametrize("name", ["checker_lines", "risk_dates", "analyze"])
def test_checked_documents_are_dealt(spark, name):
    assert "REPARTITION_BY_NUM" in plan(plans.QUERIES[name](spark, SF))


def test_headings_upper_case_only_what_is_short(spark):
    segs = [("EXPERIENCE",), ("Education",), ("X" * 41 + " EXPERIENCE",), (" CAREER  OBJECTIVE ",), ("",), (None,)]
    rows = spark.createDataFrame([([s],) for s in segs] + [([("Skills",), ("SKILLS",)],)], "segs array<struct<s string>>")
    found = rows.select(checker.headings(F.col("segs")).alias("h"))
    assert [[tuple(h) for h in r["h"]] for r in found.collect()] == [[("experience", False, "EXPERIENCE")], [("education", False, "Education")], [], [("summary", True, "CAREER  OBJECTIVE")], [], [], [("skills", False, "SKILLS")]]
    # the filter of short segments stands inside all that upper-cases
    told = rows.select(checker.headings(F.col("segs")).alias("h"))._jdf.queryExecution().optimizedPlan().toString()
    assert told.index("upper(") > told.index("<= 40")


def test_keywords_are_hit_as_by_their_patterns(spark):
    said = ["RESTful APIs", "a rest", "arrest", "LLMs", "Large Language Models", "gen ai", "Generative  AI", "GENAI", "AI agents", "orchestrating", "evaluations", "RAG", "retrieval-augmented", "fragment", "MCP", "Model Context Protocol", "NoSQL", "T-SQL", "UI path", "uipath", "python3 Python", "Node.js", "C++", "C#", "İ", ""]
    words = [*checker.KEYWORDS, "Node.js", "C++", "C#", "kafka"]
    assert set(checker.STEMS) == set(checker.ALIASES)
    rows = spark.createDataFrame([(s,) for s in said], "text string").withColumn("low", F.lower("text"))
    hits = rows.select(*[checker.keyword_hit(F.col("text"), F.col("low"), k).alias(f"h{i}") for i, k in enumerate(words)]).collect()
    assert hits == rows.select(*[F.col("text").rlike(checker.keyword_pattern(k)).alias(f"h{i}") for i, k in enumerate(words)]).collect()
    assert sum(sum(map(int, r)) for r in hits) > 20
