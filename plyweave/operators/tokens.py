"""Tokens, n-grams, occurrence counts and rarity weights of families of variants."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import steady_batches

N_GRAM = 6


def whitespace_tokens(text: Column) -> Column:
    """The text split at runs of white space."""
    return F.split(text, r"\s+")


def family_rows(docs: DataFrame, id_col: str, text_col: str, key_tokens: int = N_GRAM) -> DataFrame:
    """(family, variant, tokens): texts that begin with the same tokens are of one family; texts that are null are of none."""
    rows = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("variant"), whitespace_tokens(F.col(text_col)).alias("tokens"))
    return rows.withColumn("family", F.array_join(F.slice("tokens", 1, key_tokens), " "))


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (family, variant, ...) with ``variant_idx``, from 0 in ascending order of their variant."""
    return rows.withColumn("variant_idx", F.row_number().over(W.partitionBy("family").orderBy("variant")) - 1)


def family_variants(docs: DataFrame, id_col: str, text_col: str, key_tokens: int = N_GRAM) -> DataFrame:
    """(family, variant, variant_idx, tokens): texts that begin with the same tokens are variants of one family.

    Variants are numbered from 0 in ascending order of their id; texts that are null have none.
    """
    return numbered(family_rows(docs, id_col, text_col, key_tokens))


def several(variants: DataFrame, least: int = 2) -> DataFrame:
    """Only families of at least ``least`` variants."""
    return variants.withColumn("__n", F.count("*").over(W.partitionBy("family"))).filter(F.col("__n") >= least).drop("__n")


def token_rows(variants: DataFrame, *keys: str) -> DataFrame:
    """One row for each token, with its position from 0."""
    return variants.select(*keys, F.posexplode("tokens").alias("pos", "token"))


def n_grams(tokens: Column, n: int = N_GRAM) -> Column:
    """All windows of ``n`` tokens in order, duplicates included; shorter sequences have none."""
    if n < 1:
        raise ValueError("n-grams need a size of at least 1")
    windows = F.transform(F.sequence(F.lit(1), F.size(tokens) - (n - 1)), lambda i: F.slice(tokens, i, n))
    return F.when(F.size(tokens) >= n, windows).otherwise(F.array().cast("array<array<string>>"))


def hashed_n_grams(tokens: Column, n: int = N_GRAM) -> Column:
    """The same windows as 64-bit hashes, sensitive to order."""
    return F.transform(n_grams(tokens, n), lambda g: F.xxhash64(g))


def gram_rows(rows: DataFrame, keys: list[str], n: int = N_GRAM) -> DataFrame:
    """(keys, items): the same windows of each row's ``tokens`` as 64-bit hashes, sensitive to order; each token is hashed once, not once for each window."""
    if n < 1:
        raise ValueError("n-grams need a size of at least 1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(keys))
            begin, flat = lists.offsets.to_numpy().astype(np.int64), lists.flatten().to_numpy().view(np.uint64)
            many = np.maximum(np.diff(begin) - n + 1, 0)
            ends = np.cumsum(many)
            at = np.repeat(begin[:-1] - begin[0] - ends + many, many) + np.arange(int(many.sum()))
            code = flat[at]
            for k in range(1, n):
                code = (code ^ (code >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + flat[at + k]
            items = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(code.view(np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], items], [*keys, "items"])

    steady_batches(rows.sparkSession)
    own = rows.select(*keys, F.transform("tokens", lambda t: F.xxhash64(t)).alias("tokens"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema if f.name in keys)
    return own.mapInArrow(run, f"{schema}, items array<bigint>")


def occurrences(tokens: DataFrame) -> DataFrame:
    """(family, token, occ, max_occ): how often each token occurs in its family."""
    counted = tokens.groupBy("family", "token").agg(F.count("*").alias("occ"))
    return counted.withColumn("max_occ", F.max("occ").over(W.partitionBy("family")))


def rarity(counted: DataFrame) -> DataFrame:
    """Adds ``weight``: 1 for a family's commonest token, more for rarer ones."""
    return counted.withColumn("weight", F.col("max_occ") - F.col("occ") + 1)


def distinct_contents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(digest, representative, n): byte-identical texts counted once, so that work on contents runs once for each."""
    return df.filter(F.col(text_col).isNotNull()).groupBy(F.md5(F.col(text_col).cast("binary")).alias("digest")).agg(F.min(id_col).alias("representative"), F.count("*").alias("n"))
