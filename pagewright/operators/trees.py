"""Trees of names and fields: destinations looked up by name, fields and links that go with removed pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.session import cut

#: Levels below the root that a name tree is searched.
DEEPEST = 32


def paths(nodes: DataFrame) -> DataFrame:
    """(doc, node, path) of trees (doc, node, parent or null, at): a node's path is the places of its ancestors and itself among their siblings. A level is a join; nodes deeper than DEEPEST and those of cycles aren't reached."""
    front = found = cut(nodes.where("parent is null").select("doc", "node", F.array(F.col("at").cast("long")).alias("path")))
    for _ in range(DEEPEST):
        kids = nodes.select("doc", F.col("node").alias("kid"), F.col("parent").alias("node"), F.col("at").cast("long").alias("_at"))
        front = cut(front.join(kids, ["doc", "node"]).select("doc", F.col("kid").alias("node"), F.array_append("path", F.col("_at")).alias("path")))
        if front.isEmpty():
            break
        found = found.union(front)
    return found


def named_places(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """(doc, key, page) of names (doc, node, at, key, page) in trees of nodes: of equal keys the first that a search meets, a node's own names before those of its kids."""
    met = names.join(paths(nodes), ["doc", "node"]).withColumn("place", F.concat("path", F.array(F.lit(-1).cast("long"), F.col("at").cast("long"))))
    return met.groupBy("doc", "key").agg(F.min_by("page", "place").alias("page"))


def link_targets(links: DataFrame, tree: DataFrame, table: DataFrame) -> DataFrame:
    """links (doc, link, page, name, key) with target: the page itself, a name looked up in the table (doc, key, page) first and the tree (named_places) then, or a key in the tree first; null where nothing is found."""
    said = links.withColumn("_k", F.coalesce("name", "key"))
    in_tree = tree.select("doc", F.col("key").alias("_k"), F.col("page").alias("_t"))
    in_table = table.select("doc", F.col("key").alias("_k"), F.col("page").alias("_d"))
    met = said.join(in_tree, ["doc", "_k"], "left").join(in_table, ["doc", "_k"], "left")
    found = F.when(F.col("page").isNotNull(), F.col("page")).when(F.col("name").isNotNull(), F.coalesce("_d", "_t")).otherwise(F.coalesce("_t", "_d"))
    return met.withColumn("target", found).select(*links.columns, "target")


def living_fields(fields: DataFrame, gone: DataFrame) -> DataFrame:
    """The fields (doc, node, parent or null, group: it has a list of kids) that stay when the widgets `gone` (doc, node) go with their pages: leaves that aren't gone, and groups with a leaf that stays; an empty group goes. Told from the leaves upwards, a level at a time."""
    leaves = fields.where("not group").join(gone.select("doc", "node"), ["doc", "node"], "left_anti").select("doc", "node")
    alive = front = cut(leaves)
    while not front.isEmpty():
        up = fields.join(front, ["doc", "node"], "left_semi").where("parent is not null").select("doc", F.col("parent").alias("node")).distinct()
        front = cut(up.join(alive, ["doc", "node"], "left_anti"))
        alive = cut(alive.union(front))
    return fields.join(alive, ["doc", "node"], "left_semi")


def kept_links(targets: DataFrame, removed: DataFrame) -> DataFrame:
    """The links (link_targets, with on: the page they stand on) that stay: neither on a removed page (doc, page) nor to one."""
    at = lambda c: removed.select("doc", F.col("page").alias(c))
    return targets.join(at("on"), ["doc", "on"], "left_anti").join(at("target"), ["doc", "target"], "left_anti")
