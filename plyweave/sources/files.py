"""Source files of variants: every sub-directory of a root is a variant, one relative path a family."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SUFFIXES = {"cpp": ("cpp", "hpp"), "java": ("java",)}
#: Syntax-tree tags whose subtree becomes one leaf, by language (fixed values).
ATOMIC = {
    "cpp": ("identifier", "call_expression", "number_literal", "char_literal", "preproc_defined", "unary_expression", "binary_expression", "parenthesized_expression"),
    "java": ("throw_statement", "import_declaration", "instanceof_expression", "method_invocation", "field_access", "array_access", "class_literal", "modifiers", "formal_parameter", "catch_formal_parameter", "package_declaration"),
}


def family_key(relative: Column) -> Column:
    """A relative path with slashes as underscores; paths that differ only there are one family."""
    return F.translate(relative, "/\\", "__")


def variant_key(directory: Column) -> Column:
    """A directory's name without its last suffix."""
    return F.regexp_replace(directory, r"(?<=.)\.[^.]*$", "")


def variant_order(variant: str = "variant") -> list[Column]:
    """Numeric variants ascending, then the others bytewise."""
    number = F.expr(f"try_cast({variant} AS decimal(38, 0))")
    return [number.isNull(), number, F.col(variant)]


def of_language(path: Column, language: str) -> Column:
    """Whether a path ends in a suffix of the language, case counting."""
    return F.regexp_extract(path, r"\.([^./]*)\z", 1).isin(*SUFFIXES[language])


def located(files: DataFrame, root: str) -> DataFrame:
    """``files`` (path, ...) below the variants of ``root`` with family and variant; files that lie in no variant are left out."""
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    below = F.expr(f"substring(path, instr(path, '{base}/') + {len(base) + 1})")
    inside = files.withColumn("__below", below).filter(F.col("__below").contains("/"))
    family, variant = family_key(F.expr("substring(__below, instr(__below, '/') + 1)")), variant_key(F.substring_index("__below", "/", 1))
    return inside.select(family.alias("family"), variant.alias("variant"), *files.columns)


def numbered(files: DataFrame) -> DataFrame:
    """``files`` with ``variant_idx``, the place of a variant within its family."""
    return files.withColumn("variant_idx", F.row_number().over(W.partitionBy("family").orderBy(*variant_order(), "path")) - 1)


def discover(spark: SparkSession, root: str, language: str) -> DataFrame:
    """(family, variant, variant_idx, path, size, content_id, content) of all files of a language below the variants of ``root``.

    Files that lie in no variant are left out.  Byte-identical files have one ``content_id``.
    """
    if language not in SUFFIXES:
        raise ValueError(f"unknown language {language}: use {', '.join(SUFFIXES)}")
    pattern = "*.{" + ",".join(SUFFIXES[language]) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    named = located(files.select("path", F.col("length").alias("size"), "content"), root)
    return numbered(named.select("family", "variant", "path", "size", F.sha2("content", 256).alias("content_id"), "content"))


def atomic_tags(spark: SparkSession, path: str) -> list[str]:
    """Tags from a text file: one a line, blank lines and those that begin with # are skipped."""
    lines = spark.read.text(path).select(F.regexp_replace("value", r"\r$", "").alias("tag"))
    return sorted(r.tag for r in lines.filter((F.col("tag") != "") & ~F.col("tag").startswith("#")).distinct().collect())
