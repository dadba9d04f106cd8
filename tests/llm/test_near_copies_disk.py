"""What the near-dedup stage leaves on disk and joins: a large group of near copies makes no token meet its rows again and again, and spent shuffles go."""

import glob

from pagewright.llm import near_copies
from pagewright.session import shuffles_dropped

KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shuffle_files(spark):
    return set(glob.glob(f"{spark.conf.get('spark.local.dir')}/blockmgr-*/*/shuffle_*"))


def group(spark, n):
    base = [f"b{k}" for k in range(60)]
    return spark.createDataFrame([(i, " ".join(base[:40] + [f"own{i}"] + base[41:])) for i in range(n)] + [(n, "a text of its own that stays alone")], "doc_id long, text string")


def test_spent_shuffles_go(spark):
    docs = group(spark, 300)
    before = shuffle_files(spark)
    out = near_copies.near_copies(docs)
    assert not shuffle_files(spark) - before
    assert spark.conf.get(KEY) == "false"
    assert sorted(r["count"] for r in out.groupBy("root").count().collect()) == [1, 300]


def test_the_setting_is_put_back_after_an_error(spark):
    try:
        with shuffles_dropped(spark):
            assert spark.conf.get(KEY) == "true"
            raise ValueError
    except ValueError:
        pass
    assert spark.conf.get(KEY) == "false"


def test_rows_of_tokens_are_not_joined_with_hot_ones(spark, monkeypatch):
    keys, join = [], near_copies.join_spread
    monkeypatch.setattr(near_copies, "join_spread", lambda rows, groups, key, *rest: keys.append(key) or join(rows, groups, key, *rest))
    near_copies.near_copies(group(spark, 50))
    assert keys and ["token"] not in keys


def test_led_tokens(spark):
    tokens = spark.createDataFrame([(1, i, 10, 9 if i else 1) for i in range(2000)] + [(2, 5, 10, 0), (2, 6, 10, 3), (3, 7, 10, 0)], "token long, node long, n long, alone long")
    got = {(r["token"], r["node"]): (r["many"], r["a"], r["m"], r["r"]) for r in near_copies.led_tokens(tokens).collect()}
    assert got == {(1, i): (2000, 0, 10, 0) for i in range(2000)} | {(2, 5): (2, 5, 10, 5), (2, 6): (2, 5, 10, 5)}
