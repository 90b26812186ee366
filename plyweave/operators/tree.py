"""Trees as tables of nodes, one tree for each ``content_id``.

Columns: content_id, node_id (pre-order), parent_id, end_id (last id in the subtree), depth, tag, text,
is_named, is_leaf, and ``ancestors``, the ids from the root to the parent.  Walking up a tree is an
explode of that array followed by an equi-join, so no operator needs a range join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def number_nodes(nodes: DataFrame) -> DataFrame:
    """Node tables from rows (content_id, path, tag, text, is_named), ``path`` being the positions from the root.

    Pre-order is the order of paths, a prefix first.  Every prefix of a path must be a node's path too.
    """
    order = W.partitionBy("content_id").orderBy("path")
    ids = nodes.withColumn("node_id", F.row_number().over(order) - 1)
    above = ids.select("content_id", "node_id", F.explode(F.sequence(F.lit(1), F.size("path"))).alias("n"), "path")
    above = above.select("content_id", "node_id", F.slice("path", F.lit(1), F.col("n")).alias("path"))
    named = ids.select("content_id", "path", F.col("node_id").alias("up"))
    linked = above.join(named, ["content_id", "path"])
    chains = linked.groupBy("content_id", "node_id").agg(F.sort_array(F.collect_list("up")).alias("chain"))
    sizes = linked.groupBy("content_id", F.col("up").alias("node_id")).agg(F.max("node_id").alias("end_id"))
    out = ids.join(chains, ["content_id", "node_id"]).join(sizes, ["content_id", "node_id"])
    up = F.slice("chain", F.lit(1), F.size("chain") - 1)
    return out.select(
        "content_id", "node_id", F.when(F.size(up) > 0, F.element_at(up, -1)).alias("parent_id"), "end_id", F.size(up).alias("depth"), "tag", "text", "is_named",
        (F.col("end_id") == F.col("node_id")).alias("is_leaf"), up.alias("ancestors"),
    )


def edges(nodes: DataFrame) -> DataFrame:
    """(content_id, parent_id, node_id): parents with their children."""
    return nodes.filter("parent_id IS NOT NULL").select("content_id", "parent_id", "node_id")


def roots(nodes: DataFrame) -> DataFrame:
    return nodes.filter("parent_id IS NULL")


def leaves(nodes: DataFrame) -> DataFrame:
    """Leaves with their position among the leaves of the tree."""
    order = W.partitionBy("content_id").orderBy("node_id")
    return nodes.filter("is_leaf").withColumn("leaf_pos", F.row_number().over(order) - 1)


def ancestors(nodes: DataFrame) -> DataFrame:
    """(content_id, node_id, ancestor_id, distance), the parent at distance 1."""
    rows = nodes.select("content_id", "node_id", F.posexplode(F.reverse("ancestors")).alias("at", "ancestor_id"))
    return rows.select("content_id", "node_id", "ancestor_id", (F.col("at") + 1).alias("distance"))


def leaves_below(nodes: DataFrame) -> DataFrame:
    """(content_id, node_id, leaf_id): the leaves of each node's subtree; a leaf has itself."""
    own = F.explode(F.concat("ancestors", F.array("node_id")))
    return nodes.filter("is_leaf").select("content_id", own.alias("node_id"), F.col("node_id").alias("leaf_id"))


def leaf_sets(nodes: DataFrame) -> DataFrame:
    """(content_id, node_id, texts): the distinct leaf texts of each subtree, sorted."""
    text = nodes.filter("is_leaf").select("content_id", F.explode(F.concat("ancestors", F.array("node_id"))).alias("node_id"), "text")
    return text.groupBy("content_id", "node_id").agg(F.sort_array(F.collect_set("text")).alias("texts"))


def leaf_weights(nodes: DataFrame) -> DataFrame:
    """(content_id, node_id, weight): summed over the leaves of each subtree; identifiers count 3, other named leaves 2, the rest 1."""
    weight = F.when(F.col("tag") == "identifier", 3).when(F.col("is_named"), 2).otherwise(1)
    rows = nodes.filter("is_leaf").select("content_id", F.explode(F.concat("ancestors", F.array("node_id"))).alias("node_id"), weight.alias("w"))
    return rows.groupBy("content_id", "node_id").agg(F.sum("w").alias("weight"))


def child_by_tag(nodes: DataFrame, tag: str) -> DataFrame:
    """(content_id, node_id, child_id, child_text): the first child with a tag, for nodes that have one."""
    children = nodes.filter((F.col("tag") == tag) & F.col("parent_id").isNotNull())
    first = children.groupBy("content_id", F.col("parent_id").alias("node_id")).agg(F.min_by(F.struct("node_id", "text"), "node_id").alias("c"))
    return first.select("content_id", "node_id", F.col("c.node_id").alias("child_id"), F.col("c.text").alias("child_text"))


def representation() -> Column:
    """A leaf's text, another node's tag."""
    return F.when(F.col("is_leaf"), F.col("text")).otherwise(F.col("tag"))


def subtree_hashes(nodes: DataFrame) -> DataFrame:
    """(content_id, node_id, digest): equal subtrees have equal digests.

    The digest covers the subtree's nodes in pre-order: depth below its root, tag and leaf text, with separators.
    """
    text = F.when(F.col("is_leaf"), F.coalesce("text", F.lit(""))).otherwise("")
    own = nodes.select("content_id", F.posexplode(F.concat("ancestors", F.array("node_id"))).alias("up_depth", "up"), F.col("node_id").alias("at"), "depth", "tag", text.alias("text"))
    line = F.concat_ws("\x01", (F.col("depth") - F.col("up_depth")).cast("string"), "tag", "text")
    grouped = own.groupBy("content_id", F.col("up").alias("node_id")).agg(F.sort_array(F.collect_list(F.struct("at", line.alias("line")))).alias("lines"))
    return grouped.select("content_id", "node_id", F.md5(F.array_join(F.transform("lines", lambda x: x.line), "\x02").cast("binary")).alias("digest"))


def collapse(nodes: DataFrame, atomic: list[str]) -> DataFrame:
    """(content_id, node_id, parent_id, tag, text, is_leaf) after nodes with an atomic tag became leaves with all their text."""
    tops = nodes.filter(F.col("tag").isin(atomic)).select("content_id", F.col("node_id").alias("top_id"))
    up = ancestors(nodes).select("content_id", "node_id", F.col("ancestor_id").alias("top_id"))
    gone = up.join(tops, ["content_id", "top_id"], "left_semi").select("content_id", "node_id").distinct()
    below = leaves_below(nodes).join(nodes.select("content_id", F.col("node_id").alias("leaf_id"), "text"), ["content_id", "leaf_id"])
    below = below.join(tops.withColumnRenamed("top_id", "node_id"), ["content_id", "node_id"], "left_semi")
    full = below.groupBy("content_id", "node_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("leaf_id", "text"))), lambda x: x.text), " ").alias("full"))
    kept = nodes.join(gone, ["content_id", "node_id"], "left_anti").join(full, ["content_id", "node_id"], "left")
    flat = F.col("tag").isin(atomic)
    return kept.select("content_id", "node_id", "parent_id", "tag", F.when(flat, F.col("full")).otherwise(F.col("text")).alias("text"), (F.col("is_leaf") | flat).alias("is_leaf"))


def inside_marked(nodes: DataFrame, marked: DataFrame) -> DataFrame:
    """Nodes that are marked or lie below a marked one; ``marked`` has (content_id, node_id)."""
    own = nodes.select("content_id", F.col("node_id").alias("of"), F.explode(F.concat("ancestors", F.array("node_id"))).alias("node_id"))
    hit = own.join(marked, ["content_id", "node_id"], "left_semi").select("content_id", F.col("of").alias("node_id")).distinct()
    return nodes.join(hit, ["content_id", "node_id"], "left_semi")


def unmarked_subtrees(nodes: DataFrame, marked: DataFrame) -> DataFrame:
    """Roots of the largest subtrees in which nothing is marked."""
    touched = nodes.join(marked, ["content_id", "node_id"], "left_semi").select("content_id", F.explode(F.concat("ancestors", F.array("node_id"))).alias("node_id")).distinct()
    clean = nodes.join(touched, ["content_id", "node_id"], "left_anti")
    parents = clean.select("content_id", F.col("node_id").alias("parent_id"))
    return clean.join(parents, ["content_id", "parent_id"], "left_anti")


def proximity(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(content_id, a, b, proximity): steps to the first two ancestors with one tag, the first node's chain outermost; null without any.

    ``pairs`` has (content_id, a, b).  Only the chains of the nodes in pairs are built, and only inner nodes, which alone are
    ancestors, lend their tags.  Sizes of compressed files promise small tables, so the joins are told to sort: none is sent to the driver.
    """
    asked = pairs.select("content_id", F.explode(F.array("a", "b")).alias("node_id")).distinct()
    tags = nodes.filter(~F.col("is_leaf")).select("content_id", F.col("node_id").alias("ancestor_id"), "tag")
    above = ancestors(nodes.join(asked.hint("merge"), ["content_id", "node_id"], "left_semi"))
    chain = above.join(tags.hint("merge"), ["content_id", "ancestor_id"]).select("content_id", "node_id", "tag", (F.col("distance") - 1).alias("d"))
    one = pairs.join(chain.select("content_id", F.col("node_id").alias("a"), "tag", F.col("d").alias("i")).hint("merge"), ["content_id", "a"])
    both = one.join(chain.select("content_id", F.col("node_id").alias("b"), "tag", F.col("d").alias("j")).hint("merge"), ["content_id", "b", "tag"])
    found = both.groupBy("content_id", "a", "b").agg(F.min_by(F.col("i") + F.col("j"), F.struct("i", "j")).alias("proximity"))
    return pairs.join(found.hint("merge"), ["content_id", "a", "b"], "left")


def relative_position(a: str, b: str) -> Column:
    """``before``, ``after`` or ``overlapping``, from columns ``<name>_id``, ``_end``, ``_line`` and ``_col`` of two nodes of one tree."""
    c = lambda n, x: F.col(f"{n}_{x}")
    overlap = ((c(a, "id") <= c(b, "id")) & (c(b, "id") <= c(a, "end"))) | ((c(b, "id") <= c(a, "id")) & (c(a, "id") <= c(b, "end")))
    earlier = F.when(c(a, "line") == c(b, "line"), c(a, "col") < c(b, "col")).otherwise(c(a, "line") < c(b, "line"))
    return F.when(overlap, "overlapping").when(earlier, "before").otherwise("after")


def indented() -> Column:
    """A node as a line of an outline."""
    return F.concat(F.repeat(F.lit("  "), F.col("depth")), "tag")


def same_place(a: Column, b: Column) -> Column:
    """Whether two structs (file, start_line, start_col, end_line, end_col) are one place; nulls are equal."""
    return a.eqNullSafe(b)


def starts_before(a: Column, b: Column) -> Column:
    """Order of places by their starts only."""
    start = lambda p: F.struct(p["start_line"], p["start_col"])
    return start(a) < start(b)
