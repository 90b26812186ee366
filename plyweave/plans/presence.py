"""Queries on presence, features and set expressions.

The alignment: a column is the number in an event's properties, a system the user id modulo 8, plus 1.  A column is there for the
sake of one label over three features, which the type of its first event tells; a system has the column if it has events there
and its configuration satisfies the label.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import setexpr as E
from ..operators import presence as P
from .registry import query

SYSTEMS = [f"Sys{k}" for k in range(1, 9)]
FEATURES = ["a", "b", "c"]
TABLE = E.truth_table(FEATURES, SYSTEMS)
LITERALS = ["True"] + [" & ".join(x for x in combo if x) for combo in product(*(("", f, f"~{f}") for f in FEATURES)) if any(combo)]
EXPRESSIONS = [E.of_label(x, FEATURES, TABLE) for x in LITERALS]

#: What a column is there for, by the type of its first event.
KINDS = {"click": "a", "view": "a & ~b", "purchase": "~c", "signup": "b", "error": "True"}
MASKS = {k: sum(1 << SYSTEMS.index(x) for x in E.of_label(v, FEATURES, TABLE).lhs) for k, v in KINDS.items()}

CELLS = f"""WITH raw AS (SELECT CAST(json_extract(props, '$.k') AS INTEGER) AS col, CAST(user_id % 8 + 1 AS BIGINT) AS system, event_type, event_id FROM events WHERE props IS NOT NULL AND user_id IS NOT NULL),
cells AS (SELECT DISTINCT col, system, event_type FROM raw),
masks AS (SELECT col, CASE arg_min(event_type, event_id) {" ".join(f"WHEN '{k}' THEN {m}" for k, m in MASKS.items())} ELSE 0 END AS mask FROM raw GROUP BY 1),
picked AS (SELECT DISTINCT col, system FROM cells JOIN masks USING (col) WHERE (mask >> CAST(system - 1 AS INTEGER)) & 1 = 1),
ppresent AS (SELECT col, list_sort(list(DISTINCT system)) AS systems FROM picked GROUP BY 1),
pkeyed AS (SELECT col, systems, array_to_string(systems, ' ') AS systems_key FROM ppresent)
"""


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").filter("props IS NOT NULL AND user_id IS NOT NULL")
    return events.select(F.get_json_object("props", "$.k").cast("int").alias("col"), (F.col("user_id") % 8 + 1).alias("system"), "event_type", "event_id")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir).select("col", "system", "event_type").distinct()


def present(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of the systems that have the column."""
    kind = raw(spark, sf_dir).groupBy("col").agg(F.min_by("event_type", "event_id").alias("kind"))
    mask = F.coalesce(*(F.when(F.col("kind") == k, F.lit(m)) for k, m in MASKS.items()), F.lit(0))
    here = F.expr("shiftright(mask, cast(system - 1 AS int)) & 1 = 1")
    return cells(spark, sf_dir).join(kind.select("col", mask.alias("mask")), "col").filter(here).drop("mask")


def picked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present(spark, sf_dir).select("col", "system").distinct()


def rule(key: F.Column) -> F.Column:
    """An expression for each key of systems, in place of an external program."""
    n = F.length(key)
    return F.when(n % 3 == 0, "A ∧ ¬B").when(n % 3 == 1, "C ∨ D ∧ A").otherwise("B")


RULE = "CASE length(systems_key) % 3 WHEN 0 THEN 'A ∧ ¬B' WHEN 1 THEN 'C ∨ D ∧ A' ELSE 'B' END"
LABELS = CELLS + f""", looked AS (SELECT col, systems_key, {RULE} AS expr FROM pkeyed),
named AS (SELECT col, systems_key, expr, array_to_string(list_sort(list_transform(string_split(expr, ' ∧ '), lambda x: replace(x, '¬', 'not_'))), '_and_') AS label FROM looked),
parts AS (SELECT DISTINCT col, systems_key, unnest(string_split(label, ' ∨ ')) AS feature FROM named)
"""


def looked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = P.present_systems(picked(spark, sf_dir), ["col"])
    features = columns.select("systems_key").distinct().withColumn("expr", rule(F.col("systems_key")))
    return P.look_up(columns, features)


@query(CELLS + "SELECT DISTINCT system FROM cells")
def system_names(spark, sf_dir):
    """All systems of an alignment."""
    return cells(spark, sf_dir).select("system").distinct()


@query(CELLS + "SELECT col, systems_key FROM pkeyed")
def presence_key(spark, sf_dir):
    """The systems present in each column."""
    return P.present_systems(picked(spark, sf_dir), ["col"]).select("col", "systems_key")


@query(LABELS + "SELECT col, systems_key, expr FROM looked")
def feature_lookup(spark, sf_dir):
    """The feature expression of each column."""
    return looked_up(spark, sf_dir).select("col", "systems_key", "expr")


@query(LABELS + "SELECT col, label FROM named")
def feature_label(spark, sf_dir):
    """The feature expression as a name."""
    return looked_up(spark, sf_dir).select("col", L.and_label(F.col("expr")).alias("label"))


@query(LABELS + "SELECT col, feature, replace(feature, ' ', '_') AS file_name, replace(feature, '_', ' ') AS shown FROM parts")
def feature_explode(spark, sf_dir):
    """Each feature of each column, as file name and as shown."""
    out = P.labelled(looked_up(spark, sf_dir))
    return out.select("col", "feature", L.file_name(F.col("feature")).alias("file_name"), L.shown(F.col("feature")).alias("shown"))


@query(LABELS + "SELECT DISTINCT col, array_to_string(list_sort(list_transform(string_split(p, ' ∧ '), lambda x: replace(x, '¬', 'not_'))), '_and_') AS feature FROM (SELECT col, unnest(string_split(expr, ' ∨ ')) AS p FROM looked)")
def feature_explode_strict(spark, sf_dir):
    """The same with the disjunction split first."""
    return P.labelled(looked_up(spark, sf_dir), "strict").select("col", "feature")


@query(LABELS + "SELECT feature, count(*) AS n FROM parts JOIN picked USING (col) GROUP BY 1 ORDER BY n DESC, feature LIMIT 20")
def feature_topk20(spark, sf_dir):
    """The twenty features with most tokens."""
    return P.feature_counts(P.labelled(looked_up(spark, sf_dir)).join(picked(spark, sf_dir), "col"))


@query(LABELS + "SELECT CAST(0 AS INTEGER) AS rank, feature FROM (SELECT DISTINCT feature FROM parts) UNION ALL SELECT 1, 'Unknown'")
def feature_names(spark, sf_dir):
    """All features, then Unknown."""
    return P.feature_list(P.labelled(looked_up(spark, sf_dir)))


def _expression_sql() -> str:
    rows = []
    for e in EXPRESSIONS:
        need = sum(1 << SYSTEMS.index(s) for s in e.lhs)
        bar = sum(1 << SYSTEMS.index(s) for s in e.rhs)
        rows.append(f"('{e.label}', {need}, {bar})")
    masks = "SELECT col, CAST(sum(1 << CAST(system - 1 AS INTEGER)) AS BIGINT) AS m FROM picked GROUP BY 1"
    return CELLS + f", held AS ({masks}), ex(label, a, b) AS (VALUES {', '.join(rows)}) SELECT label, col FROM held JOIN ex ON (m & a) = a AND (m & b) = 0"


@query(_expression_sql())
def setexpr_eval(spark, sf_dir):
    """The columns in which each of 27 expressions over eight systems holds."""
    columns = P.present_systems(picked(spark, sf_dir), ["col"]).withColumn("systems", F.transform("systems", lambda s: F.concat(F.lit("Sys"), s.cast("string"))))
    return E.evaluate(columns, EXPRESSIONS, ["col"])


@query(CELLS + "SELECT col FROM ppresent WHERE list_contains(systems, 1) AND list_contains(systems, 4)")
def setexpr_intersect(spark, sf_dir):
    """Columns of two systems at once."""
    columns = P.present_systems(picked(spark, sf_dir), ["col"])
    return columns.filter(E.holds(F.col("systems"), F.array(F.lit(1).cast("long"), F.lit(4).cast("long")), F.array().cast("array<long>"))).select("col")


@query(CELLS + "SELECT col FROM ppresent WHERE list_contains(systems, 1) AND NOT list_contains(systems, 6)")
def setexpr_subtract(spark, sf_dir):
    """Columns of one system without another."""
    columns = P.present_systems(picked(spark, sf_dir), ["col"])
    return columns.filter(E.holds(F.col("systems"), F.array(F.lit(1).cast("long")), F.array(F.lit(6).cast("long")))).select("col")


TEXTS = CELLS + """, words AS (SELECT col, system, min(event_type) AS text FROM cells JOIN picked USING (col, system) GROUP BY ALL),
wide AS (SELECT col, CAST(max(strlen(text)) AS INTEGER) AS width FROM words GROUP BY 1),
every AS (SELECT w.col, s.system, t.text, w.width FROM wide w CROSS JOIN (SELECT DISTINCT system FROM words) s LEFT JOIN words t ON t.col = w.col AND t.system = s.system)
"""


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present(spark, sf_dir).groupBy("col", "system").agg(F.min("event_type").alias("text"))


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cells, fillers included, with the width of their column: fillers come from each system's own list of columns."""
    tokens, wide = words(spark, sf_dir), P.widths(words(spark, sf_dir), ["col"])
    every = wide.agg(F.array_sort(F.collect_list(F.struct("col", "width"))).alias("columns"))
    systems = tokens.select("system").distinct().join(F.broadcast(every))
    return systems.select("system", F.explode("columns").alias("c")).select("system", "c.col", "c.width").join(tokens, ["col", "system"], "left")


@query(TEXTS + "SELECT col, width FROM wide")
def column_width(spark, sf_dir):
    """The width of each column."""
    return P.widths(words(spark, sf_dir), ["col"])


@query(TEXTS + "SELECT col, arg_min(text, system) AS consensus FROM words GROUP BY 1")
def consensus_column(spark, sf_dir):
    """The first token of each column."""
    return P.consensus(words(spark, sf_dir), ["col"], "system")


@query(CELLS + "SELECT system, string_agg(CASE WHEN p.col IS NULL THEN '0' ELSE '1' END, '' ORDER BY r.col) AS bits FROM (SELECT DISTINCT system FROM picked) s CROSS JOIN (SELECT unnest(range(100)) AS col) r LEFT JOIN picked p USING (system, col) GROUP BY 1")
def bit_matrix(spark, sf_dir):
    """Each system's row of bits over 100 columns."""
    return P.bit_rows(picked(spark, sf_dir), ["system"], 100)


@query(CELLS + "SELECT s.system, CAST(r.col AS INTEGER) AS col, p.col IS NOT NULL AS is_node, CAST(CASE WHEN p.col IS NOT NULL THEN count(p.col) OVER (PARTITION BY s.system ORDER BY r.col) - 1 END AS INTEGER) AS leaf_pos FROM (SELECT DISTINCT system FROM picked) s CROSS JOIN (SELECT unnest(range(100)) AS col) r LEFT JOIN picked p ON p.system = s.system AND p.col = r.col")
def bit_cells(spark, sf_dir):
    """The rows of bits read back as cells."""
    return P.bit_cells(P.bit_rows(picked(spark, sf_dir), ["system"], 100), ["system"])


@query(
    CELLS
    + """, prof AS (SELECT s.system, r.col, (r.col + s.system) % 3 <> 0 AS is_node FROM (SELECT DISTINCT system FROM picked) s CROSS JOIN (SELECT unnest(range((SELECT max(col) + 1 FROM picked) * 2)) AS col) r),
slots AS (SELECT system, col, CASE WHEN is_node THEN sum(CASE WHEN is_node THEN 1 ELSE 0 END) OVER (PARTITION BY system ORDER BY col) - 1 END AS old_col FROM prof)
SELECT slots.system, CAST(slots.col AS INTEGER) AS col, CASE WHEN p.col IS NOT NULL THEN 't' || p.col END AS token FROM slots LEFT JOIN picked p ON p.system = slots.system AND p.col = slots.old_col"""
)
def realign_gaps(spark, sf_dir):
    """Rows moved to a profile with a gap in every third column."""
    row = picked(spark, sf_dir).withColumn("token", F.concat(F.lit("t"), F.col("col").cast("string")))
    last = row.agg(F.max("col")).first()[0] or 0  # two thirds of the profile's columns are nodes, as many as the row has columns at least
    profile = row.select("system").distinct().select("system", F.explode(F.sequence(F.lit(0), F.lit(2 * last + 1))).alias("col")).withColumn("is_node", (F.col("col") + F.col("system")) % 3 != 0)
    return P.realigned(row, profile, ["system"])


@query(TEXTS + "SELECT system, string_agg(CASE WHEN text IS NULL THEN repeat(' ', width) ELSE text END, '' ORDER BY col) AS row_text FROM every GROUP BY 1")
def render_row(spark, sf_dir):
    """Each system's aligned row as text."""
    return P.rendered_rows(matrix(spark, sf_dir), ["system"])


LAYOUT = r"""WITH lined AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS ln FROM documents WHERE text IS NOT NULL),
toks AS (SELECT doc_id, ln, unnest(string_split(line, ' ')) AS text, unnest(range(len(string_split(line, ' ')))) AS k FROM lined),
pos AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id, ln ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c0, row_number() OVER (PARTITION BY doc_id ORDER BY ln, k) - 1 AS col FROM toks WHERE true),
kept AS (SELECT * FROM pos WHERE text <> ''),
moved AS (SELECT *, coalesce(lag(ln) OVER w, 0) AS pl, coalesce(lag(c0 + length(text)) OVER w, 0) AS pc FROM kept WINDOW w AS (PARTITION BY doc_id ORDER BY col))
SELECT doc_id, CAST(col AS BIGINT) AS col, repeat(chr(10), CAST(ln - pl AS BIGINT)) || repeat('&nbsp;', CAST(greatest(CASE WHEN ln > pl THEN c0 ELSE c0 - pc END, 0) AS BIGINT)) || '<span title="' || f || '" class="' || f || '">' || replace(replace(text, '<', '&lt;'), '>', '&gt;') || '</span>' AS html
FROM (SELECT *, CASE WHEN length(text) % 3 = 0 THEN 'Unknown' ELSE 'f_' || CAST(length(text) AS VARCHAR) END AS f FROM moved)"""


@query(LAYOUT)
def html_layout(spark, sf_dir):
    """The words of every document as spans at their lines and columns."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("text IS NOT NULL")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ln", "line"))
    before = W.partitionBy("doc_id").orderBy("ln").rowsBetween(W.unboundedPreceding, -1)
    lines = lines.withColumn("first", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)))
    parts = lines.select("doc_id", "ln", "first", F.posexplode(F.split("line", " ")).alias("k", "text"))
    words_before = W.partitionBy("doc_id").orderBy("ln", "k")
    at = F.coalesce(F.sum(F.length("text") + 1).over(words_before.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cells = parts.select("doc_id", "ln", "text", (at - F.col("first")).cast("int").alias("start_col"), (F.row_number().over(words_before) - 1).cast("long").alias("col"))
    numbered = cells.filter("text <> ''")
    feature = F.when(F.length("text") % 3 == 0, "").otherwise(F.concat(F.lit("f "), F.length("text").cast("string")))
    tokens = numbered.select("doc_id", "col", F.col("ln").alias("start_line"), "start_col", F.col("ln").alias("end_line"), (F.col("start_col") + F.length("text")).alias("end_col"), "text", feature.alias("feature"))
    return P.laid_out(tokens, ["doc_id"])


@query(r"SELECT doc_id, CASE WHEN source LIKE '%1' THEN 'cpp' WHEN source LIKE '%2' THEN 'java' END AS language FROM documents")
def language_by_suffix(spark, sf_dir):
    """The language that a path's suffix stands for; sources ending in 1 and 2 make C++ and Java paths."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = F.concat(F.lit("x/"), F.col("source"), F.when(F.col("source").endswith("1"), ".hpp").when(F.col("source").endswith("2"), ".java").otherwise(".txt"))
    return docs.select("doc_id", L.language_of(path).alias("language"))
