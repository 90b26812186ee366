"""Alignments as text: the bit matrix that programs read, and the rows that people read."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.presence import rendered_cell


def machine_texts(cells: DataFrame, variants: DataFrame) -> DataFrame:
    """(family, content): the family's name, then name, path and bits of every variant in order.

    ``cells`` has (family, variant_idx, col, pos), ``variants`` (family, variant_idx, variant, path).
    """
    bits = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("col", F.col("pos").isNotNull().alias("node")))), lambda x: F.when(x.node, "1").otherwise("0")), "")
    rows = cells.groupBy("family", "variant_idx").agg(bits.alias("bits"))
    named = variants.select("family", "variant_idx", "variant", "path").join(rows, ["family", "variant_idx"])
    record = F.concat_ws("\n", "variant", "path", "bits")
    return _joined(named.select("family", "variant_idx", record.alias("record")), F.col("family"))


def human_texts(cells: DataFrame, variants: DataFrame) -> DataFrame:
    """(family, content): a heading, then path and aligned row of every variant, and a blank line."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("col", rendered_cell(F.col("text"), F.col("width")).alias("t")))), lambda x: x.t), "")
    rows = cells.groupBy("family", "variant_idx").agg(text.alias("row"))
    named = variants.select("family", "variant_idx", "path").join(rows, ["family", "variant_idx"])
    out = _joined(named.select("family", "variant_idx", F.concat_ws("\n", "path", "row").alias("record")), F.concat(F.lit("Alignment for: "), "family", F.lit(":")))
    return out.withColumn("content", F.concat("content", F.lit("\n")))


def _joined(records: DataFrame, head) -> DataFrame:
    parts = F.transform(F.sort_array(F.collect_list(F.struct("variant_idx", "record"))), lambda x: x.record)
    grouped = records.groupBy("family").agg(F.array_join(parts, "\n").alias("body"))
    return grouped.select("family", F.concat(head, F.lit("\n"), "body", F.lit("\n")).alias("content"))


def write_texts(texts: DataFrame, path: str, key: str = "family") -> None:
    """One folder with a text file for each key; what was at ``path`` before is replaced, nothing beside it is touched."""
    body = F.regexp_replace("content", r"\n\z", "")
    texts.select(key, body.alias("value")).write.mode("overwrite").partitionBy(key).text(path)


def write_named(texts: DataFrame, path: str, suffix: str, key: str = "family") -> None:
    """One file ``<path>/<key><suffix>`` for each key, with its content; files of other names stay.

    Spark writes the files side by side; the driver then only renames them.
    """
    spark = texts.sparkSession
    aside = f"{path.rstrip('/')}/_writing"
    write_texts(texts, aside, key)
    jvm = spark._jvm
    root, target = jvm.org.apache.hadoop.fs.Path(aside), jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in fs.listStatus(root):
        name = folder.getPath().getName()
        if not folder.isDirectory() or "=" not in name:
            continue
        to = jvm.org.apache.hadoop.fs.Path(target, unquote(name.split("=", 1)[1]) + suffix)
        for file in fs.listStatus(folder.getPath()):
            fs.delete(to, False)
            fs.rename(file.getPath(), to)
    fs.delete(root, True)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(family, record, system, source, bits) from files of :func:`machine_texts`: one file, or all ``*.output`` files below a folder.

    Records end at the first whose system is not a number; of records of one system the first counts.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.read.option("recursiveFileLookup", "true")
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        reader = reader.option("pathGlobFilter", "*.output")
    return records(reader.text(path, wholetext=True), "value")


def records(whole: DataFrame, col: str) -> DataFrame:
    """What :func:`read_matrix` gives, from a column of whole texts."""
    lines = whole.select(F.split(col, "\n").alias("l"))
    family = F.element_at("l", 1)
    n = F.floor((F.size("l") - 1) / 3).cast("int")
    records = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(k.alias("record"), F.get("l", k * 3 + 1).alias("system"), F.get("l", k * 3 + 2).alias("source"), F.get("l", k * 3 + 3).alias("bits"))))
    good = F.expr("cast(coalesce(nullif(array_position(transform(r, x -> x.system RLIKE '^ *[0-9]+'), false), 0) - 1, size(r)) AS int)")
    kept = lines.select(family.alias("family"), F.coalesce(records, F.array().cast("array<struct<record: int, system: string, source: string, bits: string>>")).alias("r"))
    rows = kept.select("family", F.explode(F.slice("r", F.lit(1), good)).alias("x")).select("family", "x.*")
    rows = rows.withColumn("system", F.expr("cast(trim(system) AS bigint)")).withColumn("bits", F.regexp_extract("bits", "^[01]*", 0))
    first = rows.groupBy("family", "system").agg(F.min_by(F.struct("record", "source", "bits"), "record").alias("f"))
    return first.select("family", "f.record", "system", "f.source", "f.bits")
