"""The ``opN_*`` queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import annsearch, langid, lmscore, mixing, packing, pii, pivots, sharding, simhash, token_file


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards of nearly equal bytes."""
    return sharding.shard_digest(_table(spark, sf_dir, "documents"), 8)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and near-duplicate components of all documents."""
    return simhash.simhash_digest(_table(spark, sf_dir, "documents"))


def op3_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked pseudo-likelihood of every document under a network trained on all of them."""
    return lmscore.score_digest(_table(spark, sf_dir, "documents"))


def op4_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors within each label."""
    return pivots.vector_digest(_table(spark, sf_dir, "embeddings"))


def op5_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written to files and read back."""
    return token_file.token_digest(_table(spark, sf_dir, "documents"), _tokenizer())


def op6_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector among all others."""
    return annsearch.search_digest(_table(spark, sf_dir, "embeddings"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.pii_digest(_table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raked weights, probabilities and the sample of all documents."""
    return mixing.mix_digest(_table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 tokens."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"), _tokenizer(), 1024)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    return langid.langid_digest(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_histogram_shards, op2_simhash, op3_pseudo_likelihood, op4_pivots, op5_token_file, op6_multi_index, op7_pii, op8_mixing, op9_packing, op10_language_id)}


VECTORS = """WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
lowest AS (SELECT a, min(b) AS b FROM reach GROUP BY 1),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, b) AS component_id, vec_id = least(vec_id, b) AS kept FROM v LEFT JOIN lowest ON lowest.a = vec_id LEFT JOIN degree ON degree.a = vec_id"""

#: Patterns in their plain form, with the test of a match: ``m`` the match, ``d`` its digits, ``a`` and ``b`` what stands before and after.
_SQL_KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR CAST('0' || left(ltrim(x, '0'), 4) AS INTEGER) > 255)) = 0"),
    ("card", r"[0-9]([\x20-]?[0-9])+", "length(d) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN (length(d) - i) % 2 = 0 THEN CAST(d[i] AS INTEGER) ELSE CAST(d[i] AS INTEGER) * 2 - CASE WHEN CAST(d[i] AS INTEGER) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "length(d) BETWEEN 9 AND 15"),
    ("iban", r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", "NOT regexp_matches(a, '[A-Za-z0-9]$') AND NOT regexp_matches(b, '^[A-Za-z0-9]') AND list_reduce(list_prepend(0, list_transform(string_split(substr(replace(m, ' ', ''), 5) || substr(replace(m, ' ', ''), 1, 4), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)), lambda t, x: (t * CASE WHEN x > 9 THEN 100 ELSE 10 END + x) % 97) = 1"),
    ("ssn", "[0-9]{3}-[0-9]{2}-[0-9]{4}", "NOT regexp_matches(a, '[A-Za-z0-9-]$') AND NOT regexp_matches(b, '^[A-Za-z0-9-]') AND regexp_matches(substr(t, greatest(s - 40, 0) + 1, least(s, 40)) || ' ' || substr(t, s + length(m) + 1, 20), '[Ss][Ss][Nn]|[Ss]ocial [Ss]ecurity')"),
)


def _pii_sql() -> str:
    found = " UNION ALL ".join(f"SELECT doc_id, t, '{k}' AS kind, {n} AS rank, regexp_extract_all(t, '{p}') AS ms, string_split_regex(t, '{p}') AS ps FROM docs" for n, (k, p, _) in enumerate(_SQL_KINDS))
    valid = " OR ".join(f"(kind = '{k}' AND {v})" for k, _, v in _SQL_KINDS)
    counts = ", ".join(f"count(kind) FILTER (WHERE kind = '{k}') AS n_{k}" for k, _, _ in _SQL_KINDS[:4])
    line = "kind || ':' || s || ':' || (s + length(m))"
    return f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({found}),
each AS (SELECT doc_id, t, kind, rank, ms[i] AS m, regexp_replace(ms[i], '[^0-9]', '', 'g') AS d, ps[i] AS a, ps[i + 1] AS b,
  CAST(list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s
  FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM found)),
kept AS (SELECT * FROM each WHERE {valid})
SELECT docs.doc_id, {counts}, sha256(coalesce(string_agg({line}, ',' ORDER BY s, rank) FILTER (WHERE rank < 4), '')) AS base_sha256, coalesce(string_agg({line}, ',' ORDER BY s, rank), '') AS spans
FROM docs LEFT JOIN kept ON kept.doc_id = docs.doc_id GROUP BY docs.doc_id"""


def oracle_sql() -> dict[str, str]:
    """The operators that SQL can express; the others are held against brute force in the tests."""
    return {"op4_pivots": VECTORS, "op7_pii": _pii_sql()}
