"""The queries of trees, on each customer's orders as a tree, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.operators import trees
from pagewright.plans.catalog import longs, read


def order_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders of a customer numbered from 1; each is a kid of the one of half its number."""
    i = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), i.alias("node"), F.col("o_orderkey").alias("key"))
    return rows.select("doc", "node", F.when(F.col("node") > 1, F.floor(F.col("node") / 2).cast("int")).alias("parent"), (F.col("node") % 2).alias("at"), "key")


def named_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = order_trees(spark, sf_dir)
    names = nodes.select("doc", "node", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"), "key").select("doc", "node", F.col("k").alias("at"), F.concat(F.lit("n"), (F.col("key") + 3 * F.col("k")) % 10).alias("key"), F.col("node").alias("page"))
    return longs(trees.named_places(nodes, names))


def kept_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A link on each node: to a page, by name or by key; every fifth page is removed."""
    nodes = order_trees(spark, sf_dir)
    k = F.col("node") % 3
    links = nodes.select("doc", F.col("key").alias("link"), F.when(k == 0, F.col("node") + 1).alias("page"), F.when(k == 1, F.concat(F.lit("n"), F.col("key") % 13)).alias("name"), F.when(k == 2, F.concat(F.lit("n"), F.col("key") % 11)).alias("key"), F.col("node").alias("on"))
    tree = trees.named_places(nodes, nodes.select("doc", "node", F.lit(0).alias("at"), F.concat(F.lit("n"), F.col("key") % 10).alias("key"), F.col("node").alias("page")))
    table = nodes.where("node <= 3").select("doc", F.concat(F.lit("n"), F.col("node")).alias("key"), (F.col("node") + 100).alias("page"))
    removed = nodes.where("node % 5 = 0").select("doc", F.col("node").alias("page"))
    return longs(trees.kept_links(trees.link_targets(links, tree, table), removed).select("doc", "link", "target"))


def living_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with kids are groups; orders divisible by 3 were on removed pages."""
    nodes = order_trees(spark, sf_dir)
    parents = nodes.select("doc", F.col("parent").alias("node")).distinct().withColumn("group", F.lit(True))
    fields = nodes.join(parents, ["doc", "node"], "left").select("doc", "node", "parent", F.coalesce("group", F.lit(False)).alias("group"), "key")
    return longs(trees.living_fields(fields, fields.where("key % 3 = 0").select("doc", "node")).select("doc", "node", "group"))


QUERIES = {"named_places": named_places, "kept_links": kept_links, "living_fields": living_fields}
TREE = """o AS (SELECT o_custkey AS doc, o_orderkey AS key, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS node FROM orders),
t AS (SELECT doc, node, [0::BIGINT] AS path FROM o WHERE node = 1 UNION ALL SELECT o.doc, o.node, list_append(t.path, o.node % 2) FROM t JOIN o ON o.doc = t.doc AND o.node // 2 = t.node AND o.node > 1)"""
ORACLE_SQL = {
    "named_places": f"""WITH RECURSIVE {TREE}, n AS (SELECT doc, node, key, unnest([0, 1]) AS k FROM o)
SELECT doc, 'n' || ((key + 3 * k) % 10) AS key, arg_min(node, list_concat(path, [-1, k])) AS page FROM n JOIN t USING (doc, node) GROUP BY ALL""",
    "kept_links": f"""WITH RECURSIVE {TREE}, tree AS (SELECT doc, 'n' || key % 10 AS k, arg_min(node, list_concat(path, [-1])) AS page FROM o JOIN t USING (doc, node) GROUP BY ALL),
dict AS (SELECT doc, 'n' || node AS k, node + 100 AS page FROM o WHERE node <= 3),
l AS (SELECT o.*, CASE node % 3 WHEN 1 THEN 'n' || key % 13 WHEN 2 THEN 'n' || key % 11 END AS k FROM o),
m AS (SELECT l.doc, l.key AS link, l.node, CASE node % 3 WHEN 0 THEN node + 1 WHEN 1 THEN coalesce(d.page, t2.page) ELSE coalesce(t2.page, d.page) END AS target FROM l LEFT JOIN tree t2 ON t2.doc = l.doc AND t2.k = l.k LEFT JOIN dict d ON d.doc = l.doc AND d.k = l.k)
SELECT doc, link, target FROM m WHERE node % 5 <> 0 AND NOT EXISTS (SELECT 1 FROM o WHERE o.doc = m.doc AND o.node = m.target AND o.node % 5 = 0)""",
    "living_fields": """WITH RECURSIVE o AS (SELECT o_custkey AS doc, o_orderkey AS key, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS node FROM orders),
g AS (SELECT *, 2 * node <= max(node) OVER (PARTITION BY doc) AS grp FROM o), up AS (SELECT doc, node FROM g WHERE NOT grp AND key % 3 <> 0 UNION SELECT doc, node // 2 FROM up WHERE node > 1)
SELECT doc, node, grp AS "group" FROM g WHERE EXISTS (SELECT 1 FROM up WHERE up.doc = g.doc AND up.node = g.node)""",
}
