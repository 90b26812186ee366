"""Queries on the trees of web pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tree as T
from ..session import settled
from ..sources import syntax as X
from .registry import query


def page_trees(spark, sf_dir):
    """Every page's tree; equal pages are parsed once."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").filter("html IS NOT NULL").select(F.sha2("html", 256).alias("content_id"), "html")
    return X.parse_contents(pages, "html", content_col="html")[0]


@query()
def html_tree(spark, sf_dir):
    """All nodes of all pages."""
    return page_trees(spark, sf_dir).drop("ancestors")


@query()
def html_duplicate_subtrees(spark, sf_dir):
    """Subtrees that occur more than once, over all pages."""
    nodes = page_trees(spark, sf_dir).filter("NOT is_leaf")
    return nodes.groupBy("subtree_hash", "tag").agg(F.count("*").alias("n"), F.countDistinct("content_id").alias("pages")).filter("n > 1")


@query()
def html_leaf_weights(spark, sf_dir):
    """Leaf weights summed up every page."""
    return T.leaf_weights(settled(page_trees(spark, sf_dir)))
