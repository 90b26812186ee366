"""Which classes and methods a feature consists of, wholly or in part.

Nodes are tables of :mod:`plyweave.operators.tree` with Java tags; trees with other tags have no lines.
``included`` has (content_id, node_id) and any further key columns, such as system and feature: lines are
found for each of these keys by itself.

Names and lines are used several times by what follows, so they are kept in the shared folder once found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settled
from .tree import ancestors, child_by_tag

METHODS = ("method_declaration", "constructor_declaration")
CLASSES = ("class_declaration", "interface_declaration")
IMPORT = "import_declaration"
COMMENTS = ("block_comment", "line_comment")
LINE = ("kind", "class_fqn", "method_fqn")


def _or_self(nodes: DataFrame, tags: tuple[str, ...]) -> DataFrame:
    """(content_id, node_id, up_id, up_depth): each node with its ancestors-or-self that have one of ``tags``."""
    rows = nodes.select("content_id", "node_id", F.posexplode(F.concat("ancestors", F.array("node_id"))).alias("up_depth", "up_id"))
    wanted = nodes.filter(F.col("tag").isin(*tags)).select("content_id", F.col("node_id").alias("up_id"))
    return rows.join(wanted, ["content_id", "up_id"])


def packages(nodes: DataFrame) -> DataFrame:
    """(content_id, package): the name in the package declaration, taken from its text if it is a leaf."""
    first = nodes.filter((F.col("tag") == "package_declaration") & (F.col("depth") == 1)).groupBy("content_id").agg(F.min_by(F.struct("node_id", "text", "is_leaf"), "node_id").alias("p"))
    names = nodes.filter("tag = 'identifier'").select("content_id", "node_id", "text", F.explode("ancestors").alias("up"))
    parts = first.select("content_id", F.col("p.node_id").alias("up")).join(names, ["content_id", "up"]).groupBy("content_id").agg(F.sort_array(F.collect_list(F.struct("node_id", "text"))).alias("n"))
    parts = parts.select("content_id", F.array_join(F.transform("n", lambda x: x.text), ".").alias("inner"))
    plain = F.regexp_replace(F.regexp_replace("p.text", r"^\s*package\s+", ""), r"[;\s]", "")
    return first.join(parts, "content_id", "left").select("content_id", F.when(F.col("p.is_leaf"), plain).otherwise(F.coalesce("inner", F.lit(""))).alias("package"))


def class_fqns(nodes: DataFrame) -> DataFrame:
    """(content_id, node_id, class_fqn) for every class: package and the names of the classes around it, joined by dots."""
    names = child_by_tag(nodes, "identifier").select("content_id", F.col("node_id").alias("up_id"), "child_text")
    chain = _or_self(nodes.filter(F.col("tag").isin(*CLASSES)), CLASSES).join(names, ["content_id", "up_id"], "left")
    joined = chain.groupBy("content_id", "node_id").agg(F.sort_array(F.collect_list(F.struct("up_depth", F.coalesce("child_text", F.lit("")).alias("name")))).alias("c"))
    nested = joined.select("content_id", "node_id", F.array_join(F.transform("c", lambda x: x["name"]), ".").alias("nested"))
    full = nested.join(packages(nodes), "content_id", "left")
    return settled(full.select("content_id", "node_id", F.when(F.coalesce("package", F.lit("")) != "", F.concat_ws(".", "package", "nested")).otherwise(F.col("nested")).alias("class_fqn")))


def _type_of_text(text: Column) -> Column:
    """The type in a parameter's own text: without annotations, modifiers and the name at its end."""
    bare = F.regexp_replace(text, r"^(?:\s*(?:@[\w.]+(?:\([^)]*\))?|final)\s+)*", "")
    return F.regexp_replace(bare, r"\s*[\w$]+\s*$", "")


def method_fqns(nodes: DataFrame) -> DataFrame:
    """(content_id, node_id, method_fqn) for every method: name and parameter types; variable-arity parameters are left out."""
    methods = nodes.filter(F.col("tag").isin(*METHODS)).select("content_id", "node_id")
    names = child_by_tag(nodes, "identifier").select("content_id", "node_id", "child_text")
    lists = child_by_tag(nodes, "formal_parameters").select("content_id", "node_id", F.col("child_id").alias("list_id"))
    params = nodes.filter("tag = 'formal_parameter'").select("content_id", F.col("parent_id").alias("list_id"), F.col("node_id").alias("param_id"), F.col("text").alias("param_text"), "is_leaf")
    kids = nodes.select("content_id", F.col("parent_id").alias("param_id"), F.struct("node_id", "tag", "text").alias("kid"))
    first = kids.filter("kid.tag <> 'modifiers'").groupBy("content_id", "param_id").agg(F.min(F.col("kid")).alias("t"))
    typed = params.join(first, ["content_id", "param_id"], "left")
    typed = typed.select("content_id", "list_id", "param_id", F.replace(F.when(F.col("is_leaf"), _type_of_text(F.col("param_text"))).otherwise(F.coalesce("t.text", F.lit(""))), F.lit(" "), F.lit("")).alias("type"))
    types = lists.join(typed, ["content_id", "list_id"]).groupBy("content_id", "node_id").agg(F.sort_array(F.collect_list(F.struct("param_id", "type"))).alias("p"))
    types = types.select("content_id", "node_id", F.array_join(F.transform("p", lambda x: x["type"]), ",").alias("types"))
    out = methods.join(names, ["content_id", "node_id"], "left").join(types, ["content_id", "node_id"], "left")
    return settled(out.select("content_id", "node_id", F.concat(F.coalesce("child_text", F.lit("")), F.lit("("), F.coalesce("types", F.lit("")), F.lit(")")).alias("method_fqn")))


def enclosing(nodes: DataFrame, classes: DataFrame | None = None, methods: DataFrame | None = None) -> DataFrame:
    """(content_id, node_id, class_fqn, method_fqn): the innermost class and the outermost method around each node, or ''."""
    inner = _or_self(nodes, CLASSES).groupBy("content_id", "node_id").agg(F.max_by("up_id", "up_depth").alias("class_id"))
    outer = _or_self(nodes, METHODS).groupBy("content_id", "node_id").agg(F.min_by("up_id", "up_depth").alias("method_id"))
    classes = (classes or class_fqns(nodes)).select("content_id", F.col("node_id").alias("class_id"), "class_fqn")
    methods = (methods or method_fqns(nodes)).select("content_id", F.col("node_id").alias("method_id"), "method_fqn")
    out = nodes.select("content_id", "node_id").join(inner, ["content_id", "node_id"], "left").join(outer, ["content_id", "node_id"], "left")
    out = out.join(classes, ["content_id", "class_id"], "left").join(methods, ["content_id", "method_id"], "left")
    return settled(out.select("content_id", "node_id", *(F.coalesce(c, F.lit("")).alias(c) for c in ("class_fqn", "method_fqn"))))


def top_level_classes(nodes: DataFrame) -> DataFrame:
    """(content_id, node_id): classes that are in no other class."""
    classes = nodes.filter(F.col("tag").isin(*CLASSES)).select("content_id", "node_id")
    around = classes.select("content_id", F.col("node_id").alias("ancestor_id"))
    inner = ancestors(nodes).join(around, ["content_id", "ancestor_id"], "left_semi").select("content_id", "node_id").distinct()
    return classes.join(inner, ["content_id", "node_id"], "left_anti")


def _names(nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    classes, methods = class_fqns(nodes), method_fqns(nodes)
    return classes, methods, enclosing(nodes, classes, methods)


def full_traces(nodes: DataFrame, included: DataFrame, names: tuple[DataFrame, ...] | None = None) -> DataFrame:
    """Lines of classes in which a class name is included, theirs or a nested class's, and of methods of a class whose own name is."""
    keys = [c for c in included.columns if c not in ("content_id", "node_id")]
    class_names, method_names, around_all = names or _names(nodes)
    leaf = nodes.filter("is_leaf AND tag = 'identifier'").select("content_id", "node_id", "parent_id", "ancestors")
    named = included.join(leaf, ["content_id", "node_id"])
    kinds = nodes.select("content_id", F.col("node_id").alias("parent_id"), F.col("tag").alias("parent_tag"), F.col("parent_id").alias("body_id"))
    named = named.join(kinds, ["content_id", "parent_id"])
    in_class = named.filter(F.col("parent_tag").isin(*CLASSES)).select(*keys, "content_id", F.explode("ancestors").alias("node_id"))
    classes = in_class.join(class_names, ["content_id", "node_id"]).select(*keys, F.lit("class").alias("kind"), "class_fqn", F.lit("").alias("method_fqn"))
    bodies = nodes.select("content_id", F.col("node_id").alias("body_id"), F.col("parent_id").alias("class_id"))
    owners = nodes.filter(F.col("tag").isin(*CLASSES)).select("content_id", F.col("node_id").alias("class_id"))
    own = named.filter(F.col("parent_tag").isin(*METHODS)).join(bodies, ["content_id", "body_id"]).join(owners, ["content_id", "class_id"], "left_semi")
    own = own.select(*keys, "content_id", F.col("parent_id").alias("node_id"))
    around = around_all.select("content_id", "node_id", "class_fqn")
    methods = own.join(around, ["content_id", "node_id"]).join(method_names, ["content_id", "node_id"]).select(*keys, F.lit("method").alias("kind"), "class_fqn", "method_fqn")
    return classes.union(methods).distinct()


def refinement_traces(nodes: DataFrame, included: DataFrame, names: tuple[DataFrame, ...] | None = None) -> DataFrame:
    """Refinement lines: of every top-level class of a tree with an included import, and of what is around each included token but comments."""
    keys = [c for c in included.columns if c not in ("content_id", "node_id")]
    class_names, _, around_all = names or _names(nodes)
    above = nodes.filter("is_leaf").select("content_id", "node_id", F.explode(F.concat("ancestors", F.array("node_id"))).alias("up"))
    imports = nodes.filter(F.col("tag") == IMPORT).select("content_id", F.col("node_id").alias("up"))
    touched = included.join(above.join(imports, ["content_id", "up"], "left_semi").select("content_id", "node_id").distinct(), ["content_id", "node_id"], "left_semi")
    tops = top_level_classes(nodes).join(class_names, ["content_id", "node_id"]).select("content_id", "class_fqn")
    by_import = touched.select(*keys, "content_id").distinct().join(tops, "content_id").select(*keys, F.lit("refinement").alias("kind"), "class_fqn", F.lit("").alias("method_fqn"))
    tokens = nodes.filter(~F.col("tag").isin(*COMMENTS)).select("content_id", "node_id")
    around = included.join(tokens, ["content_id", "node_id"], "left_semi").join(around_all, ["content_id", "node_id"])
    by_token = around.filter("class_fqn <> '' OR method_fqn <> ''").select(*keys, F.lit("refinement").alias("kind"), "class_fqn", "method_fqn")
    return by_import.union(by_token).distinct()


def traces(nodes: DataFrame, included: DataFrame) -> DataFrame:
    """Full and refinement lines of each key."""
    names = _names(nodes)
    return full_traces(nodes, included, names).union(refinement_traces(nodes, included, names)).distinct()


def _prefixes(fqn: Column) -> Column:
    """All proper dotted prefixes of a name."""
    parts = F.split(fqn, r"\.")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))


def prune(lines: DataFrame, *keys: str) -> DataFrame:
    """Lines that no other line covers, for each of ``keys``.

    Gone are classes nested in a listed one, methods and refinements of or below a listed class, and refinements of
    listed methods.  The prefix tests are equi-joins on exploded prefixes.
    """
    lines = settled(lines)
    classes = lines.filter("kind = 'class'").select(*keys, F.col("class_fqn").alias("prefix")).distinct()
    own = [*keys, *LINE]
    exploded = lines.select(*own, F.explode(_prefixes(F.col("class_fqn"))).alias("prefix")).filter("prefix <> ''")
    nested = exploded.join(classes, [*keys, "prefix"], "left_semi").select(*own).distinct()
    left = lines.join(nested, own, "left_anti")
    left = settled(left)
    same = left.filter("kind = 'class'").select(*keys, "class_fqn").distinct()
    kept_class = left.filter("kind = 'class'").select(*own)
    rest = left.filter("kind <> 'class'").join(same, [*keys, "class_fqn"], "left_anti").select(*own)
    methods = rest.filter("kind = 'method'").select(*keys, "class_fqn", "method_fqn").distinct()
    refined = rest.filter("kind = 'refinement'").join(methods, [*keys, "class_fqn", "method_fqn"], "left_anti").select(*own)
    return kept_class.union(rest.filter("kind = 'method'")).union(refined).distinct()


def rendered(lines: DataFrame) -> DataFrame:
    """Adds ``rank`` and ``line``: classes, then methods, then refinements, as text."""
    rank = F.when(F.col("kind") == "class", 1).when(F.col("kind") == "method", 2).otherwise(3)
    refinement = F.concat(F.col("class_fqn"), F.when(F.col("method_fqn") == "", "").otherwise(F.concat(F.lit(" "), "method_fqn")), F.lit(" Refinement"))
    line = F.when(F.col("kind") == "class", F.col("class_fqn")).when(F.col("kind") == "method", F.concat_ws(" ", "class_fqn", "method_fqn")).otherwise(refinement)
    return lines.withColumn("rank", rank).withColumn("line", line)


def extent(nodes: DataFrame, others: DataFrame) -> DataFrame:
    """(content_id, node_id, extent): ``none`` for nodes in or below one of ``others``, ``refinement`` above one, else ``full``."""
    own = nodes.select("content_id", F.col("node_id").alias("of"), F.explode(F.concat("ancestors", F.array("node_id"))).alias("node_id"))
    inside = own.join(others, ["content_id", "node_id"], "left_semi").select("content_id", F.col("of").alias("node_id"), F.lit(True).alias("inside")).distinct()
    above = nodes.join(others, ["content_id", "node_id"], "left_semi").select("content_id", F.explode("ancestors").alias("node_id"), F.lit(True).alias("above")).distinct()
    out = nodes.select("content_id", "node_id").join(inside, ["content_id", "node_id"], "left").join(above, ["content_id", "node_id"], "left")
    return out.select("content_id", "node_id", F.when(F.col("inside"), "none").when(F.col("above"), "refinement").otherwise("full").alias("extent"))
