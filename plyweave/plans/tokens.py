"""Queries on tokens and similarity; documents that begin with the same six tokens are a family."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import similarity as S
from ..operators import tokens as T
from ..session import settled
from .registry import query

FAMILIES = r"""WITH split AS (SELECT doc_id, string_split_regex(text, '\s+') AS toks FROM documents WHERE text IS NOT NULL),
named AS (SELECT doc_id, toks, array_to_string(toks[1:6], ' ') AS family FROM split),
fam AS (SELECT family, doc_id, toks, CAST(row_number() OVER (PARTITION BY family ORDER BY doc_id) - 1 AS INTEGER) AS v, count(*) OVER (PARTITION BY family) AS members FROM named),
multi AS (SELECT * FROM fam WHERE members > 1),
tok AS (SELECT family, v, doc_id, unnest(toks) AS token, unnest(range(len(toks))) AS pos FROM multi),
gram AS (SELECT family, v, array_to_string(toks[k:k + 5], ' ') AS g FROM (SELECT family, v, toks, unnest(range(1, len(toks) - 4)) AS k FROM multi WHERE len(toks) >= 6)),
bag AS (SELECT family, v, g, count(*) AS n FROM gram GROUP BY ALL),
common AS (SELECT a.family, a.v AS i, b.v AS j, CAST(sum(b.n) AS BIGINT) AS common FROM bag a JOIN bag b ON a.family = b.family AND a.g = b.g AND a.v < b.v GROUP BY ALL),
best AS (SELECT f.family, coalesce(i, 0) AS i, coalesce(j, 1) AS j, coalesce(common, 0) AS common FROM (SELECT DISTINCT family FROM multi) f
  LEFT JOIN (SELECT * FROM common QUALIFY row_number() OVER (PARTITION BY family ORDER BY common DESC, i, j) = 1) c USING (family)),
occ AS (SELECT family, token, count(*) AS occ FROM tok GROUP BY ALL),
weight AS (SELECT family, token, occ, max(occ) OVER (PARTITION BY family) - occ + 1 AS weight FROM occ)
"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.several(T.family_variants(documents(spark, sf_dir), "doc_id", "text"))


@query(r"SELECT doc_id, CAST(unnest(range(len(t))) AS INTEGER) AS pos, unnest(t) AS token FROM (SELECT doc_id, string_split_regex(text, '\s+') AS t FROM documents WHERE text IS NOT NULL)")
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token of every document."""
    docs = documents(spark, sf_dir).filter("text IS NOT NULL")
    return docs.select("doc_id", F.posexplode(T.whitespace_tokens(F.col("text"))).alias("pos", "token"))


@query(FAMILIES + "SELECT doc_id, CAST(pos AS INTEGER) AS pos, token, CAST(row_number() OVER (PARTITION BY doc_id, token ORDER BY pos) AS INTEGER) AS nth FROM tok")
def token_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which occurrence of a token in its variant each one is."""
    tokens = T.token_rows(families(spark, sf_dir), "variant").withColumnRenamed("variant", "doc_id")
    return tokens.withColumn("nth", F.row_number().over(W.partitionBy("doc_id", "token").orderBy("pos")))


@query(FAMILIES + "SELECT family, token, occ, max(occ) OVER (PARTITION BY family) AS max_occ FROM occ")
def hash_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of each token in its family."""
    return T.occurrences(T.token_rows(families(spark, sf_dir), "family"))


@query(FAMILIES + "SELECT family, token, occ, weight FROM weight")
def rarity_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rarity weight of each token in its family."""
    return T.rarity(T.occurrences(T.token_rows(families(spark, sf_dir), "family"))).drop("max_occ")


@query(r"SELECT doc_id, CAST(k - 1 AS INTEGER) AS pos, array_to_string(t[k:k + 5], ' ') AS gram FROM (SELECT doc_id, t, unnest(range(1, len(t) - 4)) AS k FROM (SELECT doc_id, string_split_regex(text, '\s+') AS t FROM documents WHERE text IS NOT NULL) WHERE len(t) >= 6)")
def ngrams6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All windows of six tokens of every document."""
    docs = documents(spark, sf_dir).filter("text IS NOT NULL").select("doc_id", T.whitespace_tokens(F.col("text")).alias("t"))
    return docs.select("doc_id", F.posexplode(T.n_grams(F.col("t"))).alias("pos", "g")).select("doc_id", "pos", F.array_join("g", " ").alias("gram"))


@query(FAMILIES + "SELECT family, i, j, common FROM common")
def ngram_common_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Common six-grams of all pairs of variants in a family."""
    return S.common_pairs_of_rows(T.family_rows(documents(spark, sf_dir), "doc_id", "text"))


@query(FAMILIES + "SELECT family, i, j, common FROM best")
def best_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most similar pair of variants of each family."""
    lists = settled(S.gram_lists(families(spark, sf_dir)))
    return S.best_pairs(lists, S.top_pairs(lists))


@query(
    FAMILIES
    + """, used AS (SELECT family, unnest([i, j]) AS v FROM best),
united AS (SELECT DISTINCT b.family, b.g FROM bag b JOIN used u ON b.family = u.family AND b.v = u.v),
unused AS (SELECT m.family, m.v FROM multi m ANTI JOIN used u ON m.family = u.family AND m.v = u.v),
score AS (SELECT b.family, b.v, CAST(sum(b.n) AS BIGINT) AS common FROM bag b SEMI JOIN united u ON b.family = u.family AND b.g = u.g GROUP BY ALL)
SELECT family, v AS next_idx, coalesce(common, 0) AS common FROM unused LEFT JOIN score USING (family, v) QUALIFY row_number() OVER (PARTITION BY family ORDER BY coalesce(common, 0) DESC, v) = 1"""
)
def next_best_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The variant that joins each family's best pair next."""
    lists = settled(S.gram_lists(families(spark, sf_dir)))
    return S.next_variant(lists, S.best_pairs(lists, S.top_pairs(lists)))


@query("SELECT md5(text) AS digest, min(doc_id) AS representative, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1")
def content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-identical documents, with one to stand for them."""
    return T.distinct_contents(documents(spark, sf_dir), "doc_id", "text")


@query(
    FAMILIES
    + """, own AS (SELECT DISTINCT t.family, t.v, t.token, w.weight FROM tok t JOIN weight w ON t.family = w.family AND t.token = w.token),
total AS (SELECT family, v, sum(weight) AS total FROM own GROUP BY ALL)
SELECT a.family, a.v AS i, b.v AS j, round(CAST(sum(a.weight) AS DOUBLE) / CAST(greatest(max(x.total), max(y.total)) AS DOUBLE), 6) AS sim
FROM own a JOIN own b ON a.family = b.family AND a.token = b.token AND a.v < b.v JOIN total x ON x.family = a.family AND x.v = a.v JOIN total y ON y.family = b.family AND y.v = b.v GROUP BY ALL"""
)
def subtree_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted overlap of the token sets of all pairs in a family."""
    return S.weighted_overlap_of_rows(T.family_rows(documents(spark, sf_dir), "doc_id", "text"), 6)


@query(
    FAMILIES
    + """, sets AS (SELECT m.family, m.v, coalesce(s.s, '') AS s FROM multi m LEFT JOIN (SELECT family, v, array_to_string(list_sort(list(DISTINCT g)), '|') AS s FROM bag GROUP BY ALL) s USING (family, v))
SELECT a.family, a.v AS i, b.v AS j, CASE WHEN a.s = b.s THEN 1.7976931348623157e308 ELSE CAST(coalesce(c.common, 0) AS DOUBLE) END AS sim
FROM sets a JOIN sets b ON a.family = b.family AND a.v < b.v LEFT JOIN common c ON c.family = a.family AND c.i = a.v AND c.j = b.v
QUALIFY row_number() OVER (PARTITION BY a.family ORDER BY sim DESC, a.v, b.v) = 1"""
)
def guide_tree_first_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first merge of each family's guide tree."""
    return S.first_merges_of_rows(T.family_rows(documents(spark, sf_dir), "doc_id", "text"))
