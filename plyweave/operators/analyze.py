"""From aligned source files to feature traces and a view: what the two programs do from end to end."""

from __future__ import annotations

from importlib.resources import files as resources

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settled
from ..sources import files as S
from ..sources import matrix as M
from ..sources import syntax as X
from . import align as A
from . import presence as P
from . import traces as R
from . import tree as T


def align_sources(spark: SparkSession, root: str, language: str, atomic: list[str] | None = None, strategy: str = "progressive", n: int = A.N_GRAM) -> dict[str, DataFrame]:
    """Tables ``files``, ``nodes``, ``errors``, ``variants`` and ``cells`` of all variants below ``root``.

    ``cells`` carries the node of every token.  A file that cannot be parsed is in ``errors`` and has no cells.
    """
    found = settled(S.discover(spark, root, language))
    nodes, errors = X.parse_contents(found, language, S.ATOMIC[language] if atomic is None else atomic)
    nodes = settled(nodes)
    variants = settled(X.variants_of(found, nodes))
    numbered = T.leaves(nodes).select("content_id", F.col("leaf_pos").alias("pos"), "node_id")
    owner = variants.select("family", "variant_idx", "variant", "content_id")
    cells = A.align(variants, strategy, n).join(owner, ["family", "variant_idx"]).join(numbered, ["content_id", "pos"], "left")
    return {"files": found, "nodes": nodes, "errors": errors, "variants": variants, "cells": settled(cells)}


def read_alignment(spark: SparkSession, path: str, language: str, atomic: list[str] | None = None) -> dict[str, DataFrame]:
    """Tables ``nodes``, ``errors`` and ``cells`` of an alignment that was written before: a matrix file or a folder of them.

    The source files that it names are parsed again, and the n-th 1 of a row is the n-th leaf of its file.  A file that
    cannot be parsed is in ``errors``; bits beyond a file's leaves are left out.
    """
    rows = settled(M.read_matrix(spark, path))
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    paths = [r.source for r in rows.select("source").distinct().collect()]  # names alone: the driver lists files anyhow
    if not paths:
        raise ValueError(f"no alignment in {path}")
    files = settled(spark.read.format("binaryFile").load(paths).select(plain(F.col("path")).alias("source"), F.sha2("content", 256).alias("content_id"), "content"))
    nodes, errors = X.parse_contents(files, language, S.ATOMIC[language] if atomic is None else atomic)
    nodes = settled(nodes)
    leaves = T.leaves(nodes).select("content_id", "leaf_pos", "node_id")
    bits = P.bit_cells(rows.withColumn("source", plain(F.col("source"))), ["family", "system", "source"]).filter("is_node")
    placed = bits.join(files.select("source", "content_id"), "source").join(leaves, ["content_id", "leaf_pos"])
    return {"nodes": nodes, "errors": errors, "cells": settled(placed.select("family", F.col("system").cast("string").alias("variant"), "content_id", "node_id", "col"))}


def system_keys(cells: DataFrame) -> DataFrame:
    """(systems_key): the sets of systems that some column has, for which features are to be told."""
    return P.present_systems(cells, ["family", "col"], "variant", "node_id").select("systems_key").distinct()


def cell_features(cells: DataFrame, features: DataFrame, mode: str = "compat") -> DataFrame:
    """(family, variant, content_id, node_id, col, feature): every token with the features of its column's systems."""
    keys = P.present_systems(cells, ["family", "col"], "variant", "node_id")
    named = P.labelled(P.look_up(keys, features), mode).select("family", "col", "feature")
    return cells.filter("node_id IS NOT NULL").select("family", "variant", "content_id", "node_id", "col").join(named, ["family", "col"])


def analyze(nodes: DataFrame, cells: DataFrame, features: DataFrame, mode: str = "compat") -> DataFrame:
    """(feature, rank, line): the lines of every feature over all files and systems.

    Inclusion is decided within each system's own tree; lines are pruned after they were united.
    """
    tokens = cell_features(cells, features, mode).select("content_id", "node_id", "family", "variant", "feature").distinct()
    lines = R.traces(nodes, tokens).select("feature", *R.LINE).distinct()
    return R.rendered(R.prune(lines, "feature")).select("feature", "rank", "class_fqn", "method_fqn", "line")


def trace_texts(lines: DataFrame) -> DataFrame:
    """(feature, content): one text a feature, its name fit for a file."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("rank", "class_fqn", "method_fqn", "line"))), lambda x: x.line)
    grouped = lines.groupBy("feature").agg(F.array_join(parts, "\n").alias("body"))
    return grouped.select(F.replace("feature", F.lit(" "), F.lit("_")).alias("feature"), F.concat("body", F.lit("\n")).alias("content"))


def view(nodes: DataFrame, cells: DataFrame, features: DataFrame, family: str) -> str:
    """A page that shows every system's file of one family, its tokens coloured by feature."""
    own = cells.filter(F.col("family") == family)
    first = cell_features(own, features).groupBy("content_id", "variant", "node_id", "col").agg(F.min("feature").alias("feature"))
    placed = first.join(nodes.select("content_id", "node_id", "text", "start_line", "start_col", "end_line", "end_col"), ["content_id", "node_id"])
    spans = P.laid_out(placed, ["variant"])
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("col", "html"))), lambda x: x.html), "")
    blocks = spans.groupBy("variant").agg(body.alias("body")).orderBy(*S.variant_order()).collect()  # one row a system of one file
    code = "".join(f"<pre>{r.body}</pre><hr>" for r in blocks)
    names = [r.feature.replace(" ", "_") for r in P.feature_list(first).orderBy("rank", "feature").collect() if r.feature]
    page = resources("plyweave.operators").joinpath("view.html").read_text("utf-8")
    return page.replace("___code___", code, 1).replace("___features___", ",".join(names), 1)
