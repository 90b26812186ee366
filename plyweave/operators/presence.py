"""Presence of systems in the columns of an alignment: keys, bit rows, widths, consensus, features.

Cells are rows (family, system, col, and a token or null for a filler).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import labels as L


def present_systems(cells: DataFrame, keys: list[str], system_col: str = "system", token_col: str | None = None) -> DataFrame:
    """(keys, systems, systems_key): the systems with a token in each column, ascending, and their key ``"1 2 5"``.

    Columns of fillers only are left out.  Systems are ordered as numbers, also where they are strings; strings that are none follow bytewise.
    """
    some = cells.filter(F.col(token_col).isNotNull()) if token_col else cells
    systems = F.array_sort(F.collect_set(system_col))
    if dict(cells.dtypes)[system_col] == "string":
        number = F.expr(f"try_cast(`{system_col}` AS decimal(38, 0))")
        ordered = F.array_sort(F.collect_set(F.struct(number.isNull().alias("other"), number.alias("number"), F.col(system_col).alias("system"))))
        systems = F.transform(ordered, lambda x: x.system)
    found = some.groupBy(*keys).agg(systems.alias("systems"))
    return found.withColumn("systems_key", F.array_join(F.transform("systems", lambda s: s.cast("string")), " "))


def look_up(columns: DataFrame, features: DataFrame) -> DataFrame:
    """Adds ``expr`` from ``features`` (systems_key, expr); keys without one have an empty expression."""
    return columns.join(features, "systems_key", "left").withColumn("expr", F.coalesce(F.rtrim("expr"), F.lit("")))


def labelled(columns: DataFrame, mode: str = "compat") -> DataFrame:
    """One row for each feature of a column, from its ``expr``."""
    return columns.withColumn("feature", F.explode(F.array_distinct(L.labels(L.unicode_operators(F.col("expr")), mode))))


def feature_counts(tokens: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` features with most tokens, ties by name."""
    return tokens.groupBy("feature").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "feature").limit(k)


def feature_list(tokens: DataFrame) -> DataFrame:
    """(rank, feature): all features by name, ``Unknown`` last."""
    some = tokens.select("feature").distinct().select(F.lit(0).alias("rank"), "feature")
    return some.union(tokens.sparkSession.createDataFrame([(1, "Unknown")], "rank int, feature string"))


def widths(cells: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """The largest byte length of a text in each column, which fillers are padded to."""
    return cells.groupBy(*keys).agg(F.coalesce(F.max(F.octet_length(text_col)), F.lit(0)).alias("width"))


def consensus(cells: DataFrame, keys: list[str], order_col: str, text_col: str = "text") -> DataFrame:
    """Each column's first token in merge order; columns of fillers only are dropped."""
    some = cells.filter(F.col(text_col).isNotNull())
    return some.groupBy(*keys).agg(F.min_by(text_col, order_col).alias("consensus"))


def bit_rows(cells: DataFrame, keys: list[str], width: int | Column, col: str = "col") -> DataFrame:
    """(keys, bits): a string of 1 for tokens and 0 for fillers, from rows for the tokens only."""
    last = (width if isinstance(width, Column) else F.lit(width)) - 1
    found = cells.groupBy(*keys).agg(F.array_sort(F.collect_set(F.col(col).cast("int"))).alias("c"))
    inside = F.filter("c", lambda k: (k >= 0) & (k <= last))
    ends = F.concat(F.array(F.lit(-1)), inside, F.array((last + 1).cast("int")))  # zeros fill the way from one token to the next
    runs = F.zip_with(ends, F.slice(ends, 2, F.size(ends)), lambda a, b: F.when(b.isNotNull(), F.concat(F.repeat(F.lit("0"), b - a - 1), F.when(b <= last, "1").otherwise(""))))
    return found.withColumn("bits", F.array_join(runs, "")).drop("c")


def bit_cells(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, col, is_node, leaf_pos): the inverse; the n-th 1 of a row is its n-th leaf."""
    cells = rows.select(*keys, F.posexplode(F.split("bits", "")).alias("col", "bit")).filter("bit <> ''")
    rank = F.sum((F.col("bit") == "1").cast("int")).over(W.partitionBy(*keys).orderBy("col")) - 1
    return cells.select(*keys, "col", (F.col("bit") == "1").alias("is_node"), F.when(F.col("bit") == "1", rank).cast("int").alias("leaf_pos"))


def realigned(row: DataFrame, profile: DataFrame, keys: list[str]) -> DataFrame:
    """A row's cells moved to a profile's columns: fillers of the profile are new gaps, its k-th node takes the row's k-th cell.

    ``row`` has (keys, col, token), ``profile`` (keys, col, is_node).
    """
    rank = F.sum(F.col("is_node").cast("int")).over(W.partitionBy(*keys).orderBy("col")) - 1
    slots = profile.select(*keys, "col", F.when(F.col("is_node"), rank).alias("old_col"))
    return slots.join(row.withColumnRenamed("col", "old_col"), [*keys, "old_col"], "left").select(*keys, "col", "token")


def without_fillers(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pos, text): the tokens of each row in order, from cells (keys, col, text) with null for a filler."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy("col")) - 1
    return cells.filter("text IS NOT NULL").select(*keys, place.alias("pos"), "text")


def rendered_cell(token: Column, width: Column) -> Column:
    """A filler as blanks, a token with every white-space character as one blank."""
    return F.when(token.isNull(), F.repeat(F.lit(" "), width)).otherwise(F.regexp_replace(token, r"\s", " "))


def rendered_rows(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row_text) from cells (keys, col, text, width)."""
    parts = F.sort_array(F.collect_list(F.struct("col", rendered_cell(F.col("text"), F.col("width")).alias("t"))))
    return cells.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x.t), "").alias("row_text"))


def laid_out(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, col, html): tokens (start_line, start_col, end_line, end_col, text, feature) as spans at their places.

    Line breaks and blanks fill the way from the end of the previous token; a token without a feature is ``Unknown``.
    """
    w = W.partitionBy(*keys).orderBy("col")
    line, at = F.coalesce(F.lag("end_line").over(w), F.lit(0)), F.coalesce(F.lag("end_col").over(w), F.lit(0))
    placed = tokens.withColumn("__down", F.greatest(F.col("start_line") - line, F.lit(0)))
    placed = placed.withColumn("__right", F.greatest(F.when(F.col("__down") > 0, F.col("start_col")).otherwise(F.col("start_col") - at), F.lit(0)))
    name = F.when(F.coalesce("feature", F.lit("")) == "", "Unknown").otherwise(L.file_name(F.col("feature")))
    span = F.concat(F.lit('<span title="'), name, F.lit('" class="'), name, F.lit('">'), L.escaped(F.col("text")), F.lit("</span>"))
    html = F.concat(F.repeat(F.lit("\n"), F.col("__down").cast("int")), F.repeat(F.lit("&nbsp;"), F.col("__right").cast("int")), span)
    return placed.select(*keys, "col", html.alias("html"))
