"""Queries on files by their paths, on plain text functions, and on alignments as text.

A document stands for a file: its source is the variant, with a number alone for English, its length in hundreds the path within it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import presence as P
from ..sources import files as S
from ..sources import matrix as M
from . import presence as E
from .registry import query
from .tokens import documents

PATHS = r"""WITH parts AS (SELECT CASE WHEN lang = 'en' THEN substr(source, 4) ELSE source END || '.' || coalesce(lang, 'none') AS dir,
  'src\' || CAST(n_chars // 100 AS VARCHAR) || CASE lang WHEN 'en' THEN '.java' WHEN 'de' THEN '.hpp' WHEN 'fr' THEN '.cpp' ELSE '.Java' END AS rest FROM documents WHERE source IS NOT NULL AND n_chars IS NOT NULL),
paths AS (SELECT DISTINCT 'file:/lines/' || dir || '/' || rest AS path, dir, rest FROM parts),
placed AS (SELECT replace(replace(rest, '/', '_'), '\', '_') AS family, left(dir, length(dir) - strpos(reverse(dir), '.')) AS variant, path FROM paths)
"""


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    lang = F.col("lang")
    folder = F.concat(F.when(lang == "en", F.substring("source", 4, 100)).otherwise(F.col("source")), F.lit("."), F.coalesce(lang, F.lit("none")))
    suffix = F.when(lang == "en", ".java").when(lang == "de", ".hpp").when(lang == "fr", ".cpp").otherwise(".Java")
    hundreds = F.expr("n_chars DIV 100").cast("string")
    path = F.concat(F.lit("file:/lines/"), folder, F.lit("/src\\"), hundreds, suffix)
    return documents(spark, sf_dir).select(path.alias("path")).filter("path IS NOT NULL").distinct()


@query(PATHS + "SELECT family, variant, path FROM placed")
def file_families(spark, sf_dir):
    """The family and the variant of every file."""
    return S.located(paths(spark, sf_dir), "file:/lines")


@query(PATHS + "SELECT family, variant, path, CAST(row_number() OVER (PARTITION BY family ORDER BY try_cast(variant AS DECIMAL(38, 0)) IS NULL, try_cast(variant AS DECIMAL(38, 0)), variant, path) - 1 AS INTEGER) AS variant_idx FROM placed")
def variant_order(spark, sf_dir):
    """The place of every variant within its family: numbers first."""
    return S.numbered(S.located(paths(spark, sf_dir), "file:/lines"))


@query(PATHS + "SELECT path, 'cpp' AS language FROM placed WHERE path LIKE '%.cpp' OR path LIKE '%.hpp' UNION ALL SELECT path, 'java' FROM placed WHERE path LIKE '%.java'")
def files_of_language(spark, sf_dir):
    """The files of each language; case counts."""
    files = paths(spark, sf_dir)
    parts = [files.filter(S.of_language(F.col("path"), x)).select("path", F.lit(x).alias("language")) for x in sorted(S.SUFFIXES)]
    return parts[0].union(parts[1])


@query("SELECT doc_id, replace(text, 'th', 'TH--') AS text FROM documents")
def replace_all(spark, sf_dir):
    """All occurrences of one string replaced by another that is longer."""
    return documents(spark, sf_dir).select("doc_id", L.replace_all(F.col("text"), "th", "TH--").alias("text"))


@query(r"SELECT doc_id, k, regexp_replace(piece, '^[ \t]+|[ \t]+$', '', 'g') AS piece FROM (SELECT doc_id, unnest(range(len(p))) AS k, unnest(p) AS piece FROM (SELECT doc_id, string_split(text || chr(9), '.') AS p FROM documents WHERE text IS NOT NULL))")
def trimmed(spark, sf_dir):
    """Every sentence without blanks and tabs at its ends; line breaks stay."""
    pieces = documents(spark, sf_dir).filter("text IS NOT NULL").select("doc_id", F.posexplode(F.split(F.concat("text", F.lit("\t")), r"\.")).alias("k", "piece"))
    return pieces.select("doc_id", F.col("k").cast("long").alias("k"), L.trimmed(F.col("piece")).alias("piece"))


ALIGNED = E.TEXTS + """, fams AS (SELECT 'f' || CAST(col // 10 AS VARCHAR) AS family, system, col, text, width FROM every),
rendered AS (SELECT family, system, string_agg(CASE WHEN text IS NULL THEN repeat(' ', width) ELSE text END, '' ORDER BY col) AS shown, string_agg(CASE WHEN text IS NULL THEN '0' ELSE '1' END, '' ORDER BY col) AS bits FROM fams GROUP BY ALL)
"""


def aligned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The event matrix as alignments of ten columns each, and their variants."""
    cells = E.matrix(spark, sf_dir).select(
        F.concat(F.lit("f"), F.expr("col DIV 10").cast("string")).alias("family"), (F.col("system") - 1).cast("int").alias("variant_idx"), "col", F.when(F.col("text").isNotNull(), F.col("col")).alias("pos"), "text", "width"
    )
    name = (F.col("variant_idx") + 1).cast("string")
    return cells, cells.select("family", "variant_idx").distinct().select("family", "variant_idx", name.alias("variant"), F.concat(F.lit("v/"), name).alias("path"))


@query(ALIGNED + "SELECT family, 'Alignment for: ' || family || ':' || chr(10) || string_agg('v/' || system || chr(10) || shown, chr(10) ORDER BY system) || chr(10) || chr(10) AS content FROM rendered GROUP BY 1")
def human_text(spark, sf_dir):
    """Alignments as people read them."""
    return M.human_texts(*aligned(spark, sf_dir))


@query(ALIGNED + "SELECT family, family || chr(10) || string_agg(system || chr(10) || 'v/' || system || chr(10) || bits, chr(10) ORDER BY system) || chr(10) AS content FROM rendered GROUP BY 1")
def machine_text(spark, sf_dir):
    """Alignments as programs read them."""
    return M.machine_texts(*aligned(spark, sf_dir))


@query(ALIGNED + "SELECT family, CAST(system AS BIGINT) AS system, 'v/' || system AS source, bits, CAST(row_number() OVER (PARTITION BY family ORDER BY system) - 1 AS INTEGER) AS record FROM rendered")
def matrix_records(spark, sf_dir):
    """The records of those texts, read back from what they hold."""
    return M.records(M.machine_texts(*aligned(spark, sf_dir)).select("content"), "content")


@query(E.TEXTS + "SELECT system, CAST(row_number() OVER (PARTITION BY system ORDER BY col) - 1 AS INTEGER) AS pos, text FROM every WHERE text IS NOT NULL")
def system_tokens(spark, sf_dir):
    """Each system's tokens in order, without fillers."""
    return P.without_fillers(E.matrix(spark, sf_dir), ["system"])
