"""Queries on trees and traces.

The tree: a region is a file with a package, an import and a class; its nations are nested classes, their
customers methods with one parameter, the customers' orders statements.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import traces as R
from ..operators import tree as T
from ..session import settled
from .registry import query

RAW = """WITH raw AS (
SELECT r_regionkey AS rk, [r_regionkey] AS path, 'program' AS tag, CAST(NULL AS VARCHAR) AS text, true AS is_named FROM region
UNION ALL SELECT r_regionkey, [r_regionkey, -2], 'package_declaration', 'package tpch;', true FROM region
UNION ALL SELECT r_regionkey, [r_regionkey, -1], 'import_declaration', 'import ' || r_name, true FROM region
UNION ALL SELECT r_regionkey, [r_regionkey, 0], 'class_declaration', NULL, true FROM region
UNION ALL SELECT r_regionkey, [r_regionkey, 0, -1], 'identifier', r_name, true FROM region
UNION ALL SELECT r_regionkey, [r_regionkey, 0, 0], 'class_body', NULL, true FROM region
UNION ALL SELECT n_regionkey, [n_regionkey, 0, 0, n_nationkey], 'class_declaration', NULL, true FROM nation
UNION ALL SELECT n_regionkey, [n_regionkey, 0, 0, n_nationkey, -1], 'identifier', n_name, true FROM nation
UNION ALL SELECT n_regionkey, [n_regionkey, 0, 0, n_nationkey, 0], 'class_body', NULL, true FROM nation
UNION ALL SELECT n_regionkey, [n_regionkey, 0, 0, n_nationkey, 0, c_custkey], 'method_declaration', NULL, true FROM cust
UNION ALL SELECT n_regionkey, [n_regionkey, 0, 0, n_nationkey, 0, c_custkey, -3], 'identifier', c_name, true FROM cust
UNION ALL SELECT n_regionkey, [n_regionkey, 0, 0, n_nationkey, 0, c_custkey, -2], 'formal_parameters', NULL, true FROM cust
UNION ALL SELECT n_regionkey, [n_regionkey, 0, 0, n_nationkey, 0, c_custkey, -2, 0], 'formal_parameter', NULL, true FROM cust
UNION ALL SELECT n_regionkey, [n_regionkey, 0, 0, n_nationkey, 0, c_custkey, -2, 0, 0], 'type_identifier', c_mktsegment, true FROM cust
UNION ALL SELECT n_regionkey, [n_regionkey, 0, 0, n_nationkey, 0, c_custkey, -2, 0, 1], 'identifier', 'x', true FROM cust
UNION ALL SELECT n_regionkey, [n_regionkey, 0, 0, n_nationkey, 0, c_custkey, o_orderkey], 'statement', o_orderstatus || ' ' || o_orderpriority, false FROM ord
), """
#: The same tree in DuckDB: ancestors are the nodes at the prefixes of a path.
TREE = (
    RAW.replace("WITH raw", "WITH cust AS (SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey), ord AS (SELECT * FROM orders JOIN cust ON o_custkey = c_custkey), raw")
    + """num AS (SELECT *, CAST(row_number() OVER (PARTITION BY rk ORDER BY path) - 1 AS INTEGER) AS node_id FROM raw),
pre AS (SELECT rk, node_id, path[1:k] AS path, k FROM (SELECT rk, node_id, path, unnest(range(1, len(path) + 1)) AS k FROM num)),
up AS (SELECT p.rk, p.node_id, n.node_id AS up, p.k - 1 AS up_depth FROM pre p JOIN num n ON n.rk = p.rk AND n.path = p.path),
ext AS (SELECT rk, up AS node_id, max(node_id) AS end_id FROM up GROUP BY ALL),
nodes AS (SELECT num.rk AS content_id, num.node_id, u.up AS parent_id, end_id, CAST(len(path) - 1 AS INTEGER) AS depth, tag, text, is_named, end_id = num.node_id AS is_leaf
  FROM num JOIN ext ON ext.rk = num.rk AND ext.node_id = num.node_id LEFT JOIN up u ON u.rk = num.rk AND u.node_id = num.node_id AND u.up_depth = len(path) - 2),
anc AS (SELECT rk AS content_id, u.node_id, up AS ancestor_id, CAST(max(up_depth) OVER (PARTITION BY rk, node_id) - up_depth AS INTEGER) AS distance FROM up u),
low AS (SELECT a.content_id, a.ancestor_id AS node_id, a.node_id AS leaf_id, l.tag, l.text, l.is_named FROM anc a JOIN nodes l ON l.content_id = a.content_id AND l.node_id = a.node_id AND l.is_leaf)
"""
)

#: Included tokens by feature, as a predicate on leaves.
INCLUDED = """SELECT content_id, node_id, 'imports' AS feature FROM nodes WHERE tag = 'import_declaration' AND content_id % 2 = 0
UNION ALL SELECT content_id, node_id, 'nations' FROM nodes WHERE is_leaf AND tag = 'identifier' AND text IN ('GERMANY', 'CHINA', 'ASIA', 'NATION_3', 'NATION_8', 'REGION_1')
UNION ALL SELECT content_id, node_id, 'names' FROM nodes WHERE is_leaf AND tag = 'identifier' AND text LIKE '%7'
UNION ALL SELECT content_id, node_id, 'urgent' FROM nodes WHERE tag = 'statement' AND text LIKE 'F 1%'
UNION ALL SELECT content_id, node_id, 'names' FROM nodes WHERE tag = 'statement' AND text LIKE 'P%'"""


def rtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The node table, computed once: the queries join it with itself."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    region, nation = read("region"), read("nation")
    cust = read("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    orders = read("orders").join(cust, F.col("o_custkey") == F.col("c_custkey"))

    def node(path, tag, text=None, named=True):
        at = F.array(*((F.col(x) if isinstance(x, str) else F.lit(x)).cast("long") for x in path))
        return F.struct(at.alias("path"), F.lit(tag).alias("tag"), (F.lit(None).cast("string") if text is None else text).alias("text"), F.lit(named).alias("is_named"))

    r, n = ["r_regionkey"], ["n_regionkey", 0, 0, "n_nationkey"]
    c = [*n, 0, "c_custkey"]
    parts = {
        "r_regionkey": (region, [
            node(r, "program"), node([*r, -2], "package_declaration", F.lit("package tpch;")), node([*r, -1], "import_declaration", F.concat(F.lit("import "), "r_name")),
            node([*r, 0], "class_declaration"), node([*r, 0, -1], "identifier", F.col("r_name")), node([*r, 0, 0], "class_body"),
        ]),
        "n_regionkey": (nation, [node(n, "class_declaration"), node([*n, -1], "identifier", F.col("n_name")), node([*n, 0], "class_body")]),
        "n_regionkey ": (cust, [
            node(c, "method_declaration"), node([*c, -3], "identifier", F.col("c_name")), node([*c, -2], "formal_parameters"), node([*c, -2, 0], "formal_parameter"),
            node([*c, -2, 0, 0], "type_identifier", F.col("c_mktsegment")), node([*c, -2, 0, 1], "identifier", F.lit("x")),
        ]),
        "n_regionkey  ": (orders, [node([*c, "o_orderkey"], "statement", F.concat_ws(" ", "o_orderstatus", "o_orderpriority"), False)]),
    }
    out = None
    for key, (df, nodes) in parts.items():
        rows = df.select(F.col(key.strip()).alias("content_id"), F.inline(F.array(*nodes)))
        out = rows if out is None else out.union(rows)
    return settled(T.number_nodes(out))


def included(nodes: DataFrame) -> DataFrame:
    own = nodes.select("content_id", "node_id", "tag", "text", "is_leaf")
    name = (F.col("tag") == "identifier") & F.col("is_leaf")
    rules = [
        ("imports", (F.col("tag") == "import_declaration") & (F.col("content_id") % 2 == 0)),
        ("nations", name & F.col("text").isin("GERMANY", "CHINA", "ASIA", "NATION_3", "NATION_8", "REGION_1")),
        ("names", name & F.col("text").like("%7")),
        ("urgent", (F.col("tag") == "statement") & F.col("text").like("F 1%")),
        ("names", (F.col("tag") == "statement") & F.col("text").like("P%")),
    ]
    features = F.explode(F.array_distinct(F.array_compact(F.array(*(F.when(rule, F.lit(f)) for f, rule in rules)))))
    return own.select("content_id", "node_id", features.alias("feature"))


@query(TREE + "SELECT content_id, node_id, parent_id, end_id, depth, tag, text, is_leaf FROM nodes")
def tree_nodes(spark, sf_dir):
    """All nodes in pre-order."""
    return rtree(spark, sf_dir).drop("ancestors", "is_named")


@query(TREE + "SELECT content_id, node_id, leaf_id FROM low")
def tree_leaves(spark, sf_dir):
    """The leaves below every node."""
    return T.leaves_below(rtree(spark, sf_dir))


@query(TREE + "SELECT content_id, node_id, CASE WHEN is_leaf THEN text ELSE tag END AS shown FROM nodes WHERE parent_id IS NULL")
def tree_root(spark, sf_dir):
    """Roots as they are shown."""
    return T.roots(rtree(spark, sf_dir)).select("content_id", "node_id", T.representation().alias("shown"))


@query(TREE + "SELECT content_id, node_id, CAST(row_number() OVER (PARTITION BY content_id ORDER BY node_id) - 1 AS INTEGER) AS leaf_pos FROM nodes WHERE is_leaf")
def leaf_positions(spark, sf_dir):
    """Leaves in order: the token sequence of a file."""
    return T.leaves(rtree(spark, sf_dir)).select("content_id", "node_id", "leaf_pos")


@query(TREE + "SELECT content_id, node_id, ancestor_id, distance FROM anc WHERE distance > 0")
def tree_ancestors(spark, sf_dir):
    """All ancestors of every node, nearest first."""
    return T.ancestors(rtree(spark, sf_dir))


@query(TREE + "SELECT content_id, parent_id AS node_id, min(node_id) AS child_id, arg_min(text, node_id) AS child_text FROM nodes WHERE tag = 'identifier' AND parent_id IS NOT NULL GROUP BY ALL")
def tree_child_by_tag(spark, sf_dir):
    """The first identifier of every node that has one."""
    return T.child_by_tag(rtree(spark, sf_dir), "identifier")


@query(TREE + "SELECT content_id, node_id, array_to_string(list_sort(list(DISTINCT text)), '|') AS texts FROM low GROUP BY ALL")
def leaf_hash_sets(spark, sf_dir):
    """Distinct leaf texts of every subtree."""
    return T.leaf_sets(rtree(spark, sf_dir)).withColumn("texts", F.array_join("texts", "|"))


@query(TREE + "SELECT content_id, node_id, CAST(sum(CASE WHEN tag = 'identifier' THEN 3 WHEN is_named THEN 2 ELSE 1 END) AS BIGINT) AS weight FROM low GROUP BY ALL")
def leaf_weight_rollup(spark, sf_dir):
    """Leaf weights summed up the tree."""
    return T.leaf_weights(rtree(spark, sf_dir))


@query(
    TREE
    + """SELECT a.content_id, a.node_id AS a, b.node_id AS b, CASE WHEN (a.node_id <= b.node_id AND b.node_id <= a.end_id) OR (b.node_id <= a.node_id AND a.node_id <= b.end_id) THEN 'overlapping'
WHEN (CASE WHEN a.depth % 2 = b.depth % 2 THEN a.node_id < b.node_id ELSE a.depth % 2 < b.depth % 2 END) THEN 'before' ELSE 'after' END AS relation
FROM nodes a JOIN nodes b ON a.content_id = b.content_id AND a.tag IN ('class_declaration', 'import_declaration') AND b.tag IN ('class_declaration', 'import_declaration')"""
)
def relative_position(spark, sf_dir):
    """How classes and imports lie to each other; a node's line is its depth's parity, its column its number."""
    some = rtree(spark, sf_dir).filter("tag IN ('class_declaration', 'import_declaration')")
    one, two = (some.select("content_id", F.col("node_id").alias(f"{x}_id"), F.col("end_id").alias(f"{x}_end"), (F.col("depth") % 2).alias(f"{x}_line"), F.col("node_id").alias(f"{x}_col")) for x in "ab")
    return one.join(two, "content_id").select("content_id", F.col("a_id").alias("a"), F.col("b_id").alias("b"), T.relative_position("a", "b").alias("relation"))


@query(
    TREE
    + """, gone AS (SELECT DISTINCT a.content_id, a.node_id FROM anc a JOIN nodes n ON n.content_id = a.content_id AND n.node_id = a.ancestor_id AND n.tag = 'formal_parameters' WHERE a.distance > 0),
whole AS (SELECT content_id, node_id, string_agg(text, ' ' ORDER BY leaf_id) AS whole FROM low GROUP BY ALL)
SELECT content_id, node_id, parent_id, tag, CASE WHEN tag = 'formal_parameters' THEN whole ELSE text END AS text, is_leaf OR tag = 'formal_parameters' AS is_leaf
FROM nodes ANTI JOIN gone USING (content_id, node_id) LEFT JOIN whole USING (content_id, node_id)"""
)
def atomic_collapse(spark, sf_dir):
    """The tree with parameter lists as leaves."""
    return T.collapse(rtree(spark, sf_dir), ["formal_parameters"])


_MARK = "tag = 'statement' AND text LIKE 'F 1%'"


@query(
    TREE
    + f""", hit AS (SELECT DISTINCT a.content_id, a.ancestor_id AS node_id FROM anc a JOIN nodes n USING (content_id, node_id) WHERE n.{_MARK.replace("AND text", "AND n.text")}),
clean AS (SELECT * FROM nodes ANTI JOIN hit USING (content_id, node_id))
SELECT c.content_id, c.node_id FROM clean c ANTI JOIN clean p ON p.content_id = c.content_id AND p.node_id = c.parent_id"""
)
def maximal_unmarked_subtrees(spark, sf_dir):
    """The largest subtrees without an urgent finished order."""
    nodes = rtree(spark, sf_dir)
    return T.unmarked_subtrees(nodes, nodes.filter(_MARK).select("content_id", "node_id")).select("content_id", "node_id")


@query(TREE + "SELECT DISTINCT a.content_id, a.node_id FROM anc a JOIN nodes n ON n.content_id = a.content_id AND n.node_id = a.ancestor_id WHERE n.tag = 'formal_parameters'")
def marked_subtrees(spark, sf_dir):
    """Everything in a parameter list."""
    nodes = rtree(spark, sf_dir)
    return T.inside_marked(nodes, nodes.filter("tag = 'formal_parameters'").select("content_id", "node_id")).select("content_id", "node_id")


@query(
    TREE
    + """SELECT digest, count(*) AS n FROM (SELECT a.content_id, a.ancestor_id, md5(string_agg(CAST(a.distance AS VARCHAR) || chr(1) || n.tag || chr(1) || CASE WHEN n.is_leaf THEN coalesce(n.text, '') ELSE '' END, chr(2) ORDER BY n.node_id)) AS digest
FROM anc a JOIN nodes n ON n.content_id = a.content_id AND n.node_id = a.node_id GROUP BY ALL) GROUP BY 1"""
)
def subtree_hash_groups(spark, sf_dir):
    """Equal subtrees by their hashes."""
    return T.subtree_hashes(rtree(spark, sf_dir)).groupBy("digest").agg(F.count("*").alias("n"))


@query(
    TREE
    + """, pairs AS (SELECT i.content_id, i.node_id AS a, t.node_id AS b FROM nodes i JOIN nodes p ON p.content_id = i.content_id AND p.parent_id = i.parent_id AND p.tag = 'formal_parameters'
  JOIN anc x ON x.content_id = p.content_id AND x.ancestor_id = p.node_id JOIN nodes t ON t.content_id = x.content_id AND t.node_id = x.node_id AND t.tag = 'type_identifier' WHERE i.tag = 'identifier')
SELECT pairs.content_id, a, b, CAST(arg_min(i + j, i * 1000 + j) AS INTEGER) AS proximity FROM pairs
JOIN (SELECT c.content_id, c.node_id, n.tag, c.distance - 1 AS i FROM anc c JOIN nodes n ON n.content_id = c.content_id AND n.node_id = c.ancestor_id WHERE c.distance > 0) u ON u.content_id = pairs.content_id AND u.node_id = a
JOIN (SELECT c.content_id, c.node_id, n.tag, c.distance - 1 AS j FROM anc c JOIN nodes n ON n.content_id = c.content_id AND n.node_id = c.ancestor_id WHERE c.distance > 0) w ON w.content_id = pairs.content_id AND w.node_id = b AND w.tag = u.tag
GROUP BY ALL"""
)
def ancestor_proximity(spark, sf_dir):
    """Steps from a method's name and its parameter's type to their first ancestors of one kind."""
    nodes = rtree(spark, sf_dir)
    names = nodes.filter("tag = 'identifier'").select("content_id", F.col("node_id").alias("a"), F.col("parent_id").alias("m"))
    lists = nodes.filter("tag = 'formal_parameters'").select("content_id", F.col("parent_id").alias("m"), F.col("node_id").alias("ancestor_id"))
    types = nodes.filter("tag = 'type_identifier'").select("content_id", F.col("node_id").alias("b"), F.explode("ancestors").alias("ancestor_id"))
    pairs = names.join(lists.hint("merge"), ["content_id", "m"]).join(types.hint("merge"), ["content_id", "ancestor_id"]).select("content_id", "a", "b")
    return T.proximity(nodes, pairs)


FQN = (
    TREE
    + """, cls AS (SELECT n_regionkey AS content_id, 'tpch.' || r_name || '.' || n_name AS fqn, [n_regionkey, 0, 0, n_nationkey] AS path FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT r_regionkey, 'tpch.' || r_name, [r_regionkey, 0] FROM region),
cfq AS (SELECT n.rk AS content_id, n.node_id, c.fqn AS class_fqn FROM cls c JOIN num n ON n.rk = c.content_id AND n.path = c.path),
mfq AS (SELECT n.rk AS content_id, n.node_id, c_name || '(' || c_mktsegment || ')' AS method_fqn FROM cust JOIN num n ON n.rk = n_regionkey AND n.path = [n_regionkey, 0, 0, n_nationkey, 0, c_custkey]),
inn AS (SELECT a.content_id, a.node_id, arg_min(c.class_fqn, a.distance) AS class_fqn FROM anc a JOIN cfq c ON c.content_id = a.content_id AND c.node_id = a.ancestor_id GROUP BY ALL),
enc AS (SELECT n.content_id, n.node_id, coalesce(i.class_fqn, '') AS class_fqn, coalesce(m.method_fqn, '') AS method_fqn FROM nodes n LEFT JOIN inn i USING (content_id, node_id)
  LEFT JOIN (SELECT a.content_id, a.node_id, x.method_fqn FROM anc a JOIN mfq x ON x.content_id = a.content_id AND x.node_id = a.ancestor_id) m USING (content_id, node_id)),
inc AS (SELECT DISTINCT * FROM ("""
    + INCLUDED
    + """)),
full_lines AS (SELECT DISTINCT feature, 'class' AS kind, c.class_fqn, '' AS method_fqn FROM inc JOIN nodes l USING (content_id, node_id) JOIN nodes p ON p.content_id = l.content_id AND p.node_id = l.parent_id AND p.tag = 'class_declaration'
    JOIN anc a ON a.content_id = l.content_id AND a.node_id = l.node_id JOIN cfq c ON c.content_id = a.content_id AND c.node_id = a.ancestor_id WHERE l.tag = 'identifier'
  UNION SELECT DISTINCT feature, 'method', e.class_fqn, e.method_fqn FROM inc JOIN nodes l USING (content_id, node_id) JOIN nodes p ON p.content_id = l.content_id AND p.node_id = l.parent_id AND p.tag = 'method_declaration'
    JOIN enc e ON e.content_id = l.content_id AND e.node_id = l.node_id WHERE l.tag = 'identifier'),
ref_lines AS (SELECT DISTINCT feature, 'refinement' AS kind, 'tpch.' || r_name AS class_fqn, '' AS method_fqn FROM inc JOIN nodes n USING (content_id, node_id) JOIN region ON r_regionkey = content_id WHERE n.tag = 'import_declaration'
  UNION SELECT feature, 'refinement', class_fqn, method_fqn FROM inc JOIN enc USING (content_id, node_id) WHERE class_fqn <> '' OR method_fqn <> ''),
all_lines AS (SELECT * FROM full_lines UNION SELECT * FROM ref_lines),
top_cls AS (SELECT * FROM all_lines a WHERE kind = 'class' AND NOT EXISTS (SELECT 1 FROM all_lines b WHERE b.kind = 'class' AND b.feature = a.feature AND starts_with(a.class_fqn, b.class_fqn || '.'))),
rest AS (SELECT * FROM all_lines a WHERE kind <> 'class' AND NOT EXISTS (SELECT 1 FROM top_cls b WHERE b.feature = a.feature AND (a.class_fqn = b.class_fqn OR starts_with(a.class_fqn, b.class_fqn || '.')))),
pruned AS (SELECT * FROM top_cls UNION ALL SELECT * FROM rest WHERE kind = 'method'
  UNION ALL SELECT * FROM rest a WHERE kind = 'refinement' AND NOT EXISTS (SELECT 1 FROM rest b WHERE b.kind = 'method' AND b.feature = a.feature AND a.class_fqn = b.class_fqn AND a.method_fqn = b.method_fqn))
"""
)


@query(FQN + "SELECT content_id, node_id, class_fqn FROM cfq")
def class_fqn(spark, sf_dir):
    """Full names of all classes."""
    return R.class_fqns(rtree(spark, sf_dir))


@query(FQN + "SELECT content_id, node_id, method_fqn FROM mfq")
def method_fqn(spark, sf_dir):
    """Names and parameter types of all methods."""
    return R.method_fqns(rtree(spark, sf_dir))


@query(FQN + "SELECT content_id, node_id, class_fqn, method_fqn FROM enc")
def enclosing_names(spark, sf_dir):
    """The class and the method around every node."""
    return R.enclosing(rtree(spark, sf_dir))


@query(FQN + "SELECT feature, kind, class_fqn, method_fqn FROM full_lines")
def full_traces(spark, sf_dir):
    """Wholly included classes and methods of each feature."""
    nodes = rtree(spark, sf_dir)
    return R.full_traces(nodes, included(nodes))


@query(FQN + "SELECT feature, kind, class_fqn, method_fqn FROM ref_lines")
def refinement_traces(spark, sf_dir):
    """Partly included classes and methods of each feature."""
    nodes = rtree(spark, sf_dir)
    return R.refinement_traces(nodes, included(nodes))


@query(FQN + "SELECT feature, kind, class_fqn, method_fqn FROM pruned")
def prune_lines(spark, sf_dir):
    """Lines that no other line covers."""
    nodes = rtree(spark, sf_dir)
    return R.prune(R.traces(nodes, included(nodes)), "feature")


@query(
    FQN
    + """SELECT feature, rank, line FROM (SELECT feature, CAST(CASE kind WHEN 'class' THEN 1 WHEN 'method' THEN 2 ELSE 3 END AS INTEGER) AS rank,
CASE kind WHEN 'class' THEN class_fqn WHEN 'method' THEN class_fqn || ' ' || method_fqn ELSE class_fqn || CASE WHEN method_fqn = '' THEN '' ELSE ' ' || method_fqn END || ' Refinement' END AS line FROM pruned)"""
)
def trace_render(spark, sf_dir):
    """Each feature's trace as lines of text."""
    nodes = rtree(spark, sf_dir)
    return R.rendered(R.prune(R.traces(nodes, included(nodes)), "feature")).select("feature", "rank", "line")


@query(
    TREE
    + f""", oth AS (SELECT content_id, node_id FROM nodes WHERE {_MARK})
SELECT n.content_id, n.node_id, CASE WHEN i.node_id IS NOT NULL THEN 'none' WHEN a.node_id IS NOT NULL THEN 'refinement' ELSE 'full' END AS extent FROM nodes n
LEFT JOIN (SELECT DISTINCT x.content_id, x.node_id FROM anc x JOIN oth o ON o.content_id = x.content_id AND o.node_id = x.ancestor_id) i ON i.content_id = n.content_id AND i.node_id = n.node_id
LEFT JOIN (SELECT DISTINCT x.content_id, x.ancestor_id AS node_id FROM anc x JOIN oth o ON o.content_id = x.content_id AND o.node_id = x.node_id WHERE x.distance > 0) a ON a.content_id = n.content_id AND a.node_id = n.node_id"""
)
def node_trace_kind(spark, sf_dir):
    """Whether each node is wholly, partly or not at all apart from urgent finished orders."""
    nodes = rtree(spark, sf_dir)
    return R.extent(nodes, nodes.filter(_MARK).select("content_id", "node_id"))


@query(TREE + "SELECT content_id, node_id, repeat('  ', depth) || tag AS line FROM nodes")
def tree_outline(spark, sf_dir):
    """Every node as a line of an outline."""
    return rtree(spark, sf_dir).select("content_id", "node_id", T.indented().alias("line"))


@query(
    TREE
    + """SELECT a.content_id, a.node_id AS a, b.node_id AS b, (a.depth = b.depth AND a.node_id = b.node_id) AS same, (a.depth < b.depth OR (a.depth = b.depth AND a.node_id < b.node_id)) AS earlier
FROM nodes a JOIN nodes b ON a.content_id = b.content_id AND a.tag = 'class_declaration' AND b.tag = 'class_declaration'"""
)
def position_order(spark, sf_dir):
    """Equality and order of the places of classes; a node's line is its depth, its column its number."""
    some = rtree(spark, sf_dir).filter("tag = 'class_declaration'")
    place = lambda n: F.struct(F.col("depth").alias("start_line"), F.col("node_id").alias("start_col"), F.col("depth").alias("end_line"), F.col("node_id").alias("end_col")).alias(f"p{n}")
    one, two = (some.select("content_id", F.col("node_id").alias(n), place(n)) for n in "ab")
    return one.join(two, "content_id").select("content_id", "a", "b", T.same_place(F.col("pa"), F.col("pb")).alias("same"), T.starts_before(F.col("pa"), F.col("pb")).alias("earlier"))
