"""Approximate nearest neighbours by multi-index hashing.

Vectors are lengthened by one component so that the largest inner product is the smallest angle, turned
by learned rotations (iterative quantization, from several starts) and cut to signs.  Codes are split into substrings of
eight bits, and for each substring the rows of a block are listed by its value.  A code within R bits of a query is within R / m
bits of it in one of the m substrings, so the lists of all values that near hold every code within the radius; only these
codes are compared, and only vectors whose codes lie within the radius are multiplied.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import cut

SUBSTRING_BITS = 8
#: What turns a substring's value into those at a distance of up to 0, 1, ... 8 bits.
NEAR = [np.array(sorted((x for x in range(256) if x.bit_count() <= d), key=int.bit_count)) for d in range(SUBSTRING_BITS + 1)]
ROWS, QUERIES = 8192, 2048


@dataclass
class Model:
    longest: float  # the largest norm
    rotation: np.ndarray  # the learned rotations side by side
    radius: int


def usable(vector: Column) -> Column:
    """Not null, not all zero, every component finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _lengthened(x: np.ndarray, longest: float) -> np.ndarray:
    spare = np.sqrt(np.maximum(longest**2 - (x**2).sum(axis=1), 0))
    return np.column_stack([x, spare])


def _query_form(x: np.ndarray) -> np.ndarray:
    return np.column_stack([x, np.zeros(len(x))])


def codes(x: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    """Sign bits as bytes, one for each substring."""
    return np.packbits(x @ rotation > 0, axis=1)


def _rotation(x: np.ndarray, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """An orthogonal map that brings ``x`` near to its signs, alternating between the two; its columns fill whole substrings."""
    width = x.shape[1]
    bits = -(-width // SUBSTRING_BITS) * SUBSTRING_BITS
    rotation = np.linalg.qr(rng.standard_normal((bits, width)))[0].T
    for _ in range(rounds):
        u, _, v = np.linalg.svd(x.T @ np.sign(x @ rotation), full_matrices=False)
        rotation = u @ v
    return rotation


def fit(sample: np.ndarray, longest: float, rows: int, *, starts: int = 2, rounds: int = 30, recall: float = 0.97, k: int = 20, seed: int = 11) -> Model:
    """Rotations and radius from a bounded sample of ``rows`` rows.

    The radius is such that the share ``recall`` of near neighbours lies within it.  The nearest ``k`` of all rows
    are as near as the nearest k * len(sample) / rows of the sample, one at least.
    """
    x = _lengthened(sample, longest)
    rng = np.random.default_rng(seed)
    rotation = np.hstack([_rotation(x, rounds, rng) for _ in range(starts)])
    step = max(1, len(sample) // 512)
    some = np.arange(0, len(sample), step)
    score = sample[some] @ sample.T
    score[np.arange(len(some)), some] = -np.inf
    many = min(len(sample) - 1, -(-k * len(sample) // max(rows, 1)))
    top = np.argsort(-score, axis=1)[:, :many]
    distance = np.bitwise_count(codes(_query_form(sample[some]), rotation)[:, None, :] ^ codes(x, rotation)[top]).sum(axis=2)
    return Model(longest, rotation, int(np.quantile(distance, recall)) if distance.size else rotation.shape[1])


class Index:
    """The rows of a block, listed by the value of each substring."""

    def __init__(self, rows: np.ndarray):
        self.codes, (n, self.m) = rows, rows.shape
        order = np.argsort(rows, axis=0, kind="stable")
        self.flat = order.T.ravel()
        self.starts = np.stack([s * n + np.searchsorted(rows[order[:, s], s], np.arange(257)) for s in range(self.m)]) if n else np.zeros((self.m, 257), np.int64)

    def within(self, query: np.ndarray, radius: int) -> np.ndarray:
        """Numbers of all rows whose codes are within ``radius`` bits of ``query``, ascending.

        With radius = m * r + a, the first a + 1 substrings are probed to a distance of r and the others to r - 1, which misses nothing.
        """
        r, a = divmod(min(radius, self.m * SUBSTRING_BITS), self.m)
        spans = [(s, query[s] ^ NEAR[min(reach, SUBSTRING_BITS)]) for s in range(self.m) if (reach := r if s <= a else r - 1) >= 0]
        first = np.concatenate([self.starts[s, v] for s, v in spans])
        many = np.concatenate([self.starts[s, v + 1] for s, v in spans]) - first
        hit = np.zeros(len(self.codes), bool)
        hit[self.flat[np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())]] = True
        found = np.flatnonzero(hit)
        return found[np.bitwise_count(self.codes[found] ^ query).sum(axis=1) <= radius]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def real_vectors(vectors: DataFrame, vector_col: str) -> Column:
    """The vectors as doubles, or as floats where they are floats; shorter ones are filled with zeros to the longest length."""
    kind = dict(vectors.dtypes)[vector_col]
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    least, most = vectors.agg(F.min(F.size(F.col(vector_col))), F.max(F.size(F.col(vector_col)))).first()
    v = F.col(vector_col).cast(kind)
    return v if least == most else F.concat(v, F.array_repeat(F.lit(0.0), F.lit(most or 0) - F.size(v)).cast(kind))


def norm(vector: Column) -> Column:
    """Euclidean length, without overflow on the way."""
    big = F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double"))))
    return F.least(big * F.sqrt(F.aggregate(vector, F.lit(0.0), lambda t, x: t + (x / big) * (x / big))), F.lit(1e308))


def search(
    vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding", *, sample: int = 4096, recall: float = 0.97,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows found with the largest inner product, for each row where ``is_query`` holds.

    Every other usable row is a candidate; ties go to the smaller id.  Null, zero and non-finite vectors and null ids
    take no part; a shorter vector is filled with zeros; a product that is not a number counts as the least.  Rows with a query's own id are not its candidates; other
    repeated rows are candidates each.  The model is fitted on at most ``sample`` rows (those with the smallest
    hashes of their ids); every row is indexed.  Rows and queries meet in blocks, so no task holds all of either.  Queries
    for which the radius holds fewer than ``k`` rows in all are searched again, with a radius that grows in each block until
    it holds ``k`` or all rows of the block; so ``k`` rows are returned wherever there are as many.
    """
    spark = vectors.sparkSession
    ok = vectors.filter(F.col(id_col).isNotNull() & usable(F.col(vector_col)))
    ok = cut(ok.select(F.col(id_col).cast("long").alias("id"), real_vectors(ok, vector_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")), "vectors")
    longest, n, asked = ok.agg(F.max(norm(F.col("v"))), F.count("*"), F.count_if(F.col("q"))).first()
    if not asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    drawn = ok.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toPandas()
    shared = spark.sparkContext.broadcast(fit(np.stack(drawn.v.values).astype(np.float64) / longest, 1.0, n, recall=recall, k=k))

    def meet(widen: bool):
        def run(_, table):
            model, role = shared.value, table.column("role").to_numpy()
            ids, v = table.column("id").to_numpy(), _matrix(table.column("v").combine_chunks())
            x, y, x_id, y_id = v[role == 0], v[role == 1], ids[role == 0], ids[role == 1]
            index = Index(codes(_lengthened(x / longest, model.longest), model.rotation))
            asking = codes(_query_form(y / longest), model.rotation)
            found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
            for at in range(len(y) if len(x) else 0):
                radius = model.radius
                near = index.within(asking[at], radius)
                near = near[x_id[near] != y_id[at]]
                if widen:
                    there = min(k, int((x_id != y_id[at]).sum()))
                    while len(near) < there:
                        radius += index.m
                        near = index.within(asking[at], radius)
                        near = near[x_id[near] != y_id[at]]
                score = np.einsum("ij,j->i", x[near], y[at])
                score = np.where(np.isnan(score), -np.inf, score)
                if len(near) > k:
                    least = np.partition(score, -k)[-k]
                    near, score = near[score >= least], score[score >= least]
                best = np.lexsort((x_id[near], -score))[:k]
                found.append((np.full(len(best), y_id[at]), x_id[near[best]], score[best]))
            return pa.table(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*found, strict=True)), strict=True)))

        return run

    def block(parts: int) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")

    everywhere = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    row_blocks = -(-n // ROWS)

    def searched(queries: DataFrame, many: int, widen: bool) -> DataFrame:
        query_blocks = -(-many // QUERIES)
        rows = ok.select(block(row_blocks).alias("b"), everywhere(query_blocks).alias("c"), F.lit(0).alias("role"), "id", "v")
        asking = queries.select(everywhere(row_blocks).alias("b"), block(query_blocks).alias("c"), F.lit(1).alias("role"), "id", "v")
        pairs = rows.union(asking).groupBy("b", "c").applyInArrow(meet(widen), "query_id long, vec_id long, score double")
        rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    first = cut(searched(ok.filter("q"), asked, False), "found")
    short = ok.filter("q").join(first.filter(F.col("rank") == k).select("query_id"), F.col("id") == F.col("query_id"), "left_anti")
    short = cut(short.select("id", "v"), "short")
    left = short.count()
    if not left:
        return first
    enough = first.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").select(*first.columns)
    return enough.union(searched(short, left, True))


def search_digest(vectors: DataFrame) -> DataFrame:
    """The contract's search: every twentieth row against all others, 20 nearest."""
    return search(vectors, F.col("vec_id") % 20 == 0, 20)
