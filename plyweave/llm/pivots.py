"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by its nearest reference points (pivots) in order.  It is listed under its nearest
pivot and looked up under each of its ``depth`` nearest ones; a meeting with enough shared pivots is
verified on the vectors themselves.  Pivots are vectors of the table that lie apart from each other, so a
dense group does not take them all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._buckets import BOTH, QUERY, components, linked
from ._shared import cut
from .annsearch import _matrix, real_vectors, usable

#: Rows of either side of a bucket in one block.
BLOCK = 4096
#: Rows whose products with all pivots are held at once.
AT_ONCE = 512


def _unit(v: np.ndarray) -> np.ndarray:
    """Vectors of length 1, without overflow on the way."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1)[:, None]


def choose_pivots(sample: np.ndarray, most: int, apart: float = 0.8) -> np.ndarray:
    """Unit vectors from ``sample``, each of a cosine below ``apart`` to those before it."""
    unit = _unit(sample)
    kept, n = np.zeros((min(most, len(unit)), unit.shape[1])), 0
    for at in range(0, len(unit), AT_ONCE):
        some = unit[at : at + AT_ONCE]
        some = some[(some @ kept[:n].T).max(axis=1, initial=-1) < apart]
        before = n
        for x in some:
            if n == len(kept):
                return kept
            if (kept[before:n] @ x).max(initial=-1) < apart:
                kept[n] = x
                n += 1
    return kept[:n]


def permutations(unit: np.ndarray, pivots: np.ndarray, depth: int) -> np.ndarray:
    """The ``depth`` nearest pivots of each vector, nearest first, ties to the lower number."""
    out = [np.zeros((0, depth), np.int64)]
    for at in range(0, len(unit), AT_ONCE):
        far = -(unit[at : at + AT_ONCE] @ pivots.T)
        last = np.partition(far, depth - 1, axis=1)[:, depth - 1 : depth]
        row, pivot = np.nonzero(far <= last)
        order = np.lexsort((pivot, far[row, pivot], row))
        row, pivot = row[order], pivot[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        out.append(pivot[rank < depth].reshape(-1, depth))
    return np.concatenate(out).astype(np.int32)


def vector_groups(
    vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", *, depth: int = 12, shared: int = 3, pivots: int = 65_536, sample: int = 4096,
) -> DataFrame:
    """(vec_id, n_links, component_id) for every row: its links to other rows, and the smallest vec_id reachable by them.

    Rows link if their labels are equal and not null and the cosine of their vectors, in double precision, is
    ``threshold`` or more.  Null, zero and non-finite vectors link with nothing, nor do rows with a null id (their
    component is null).  A shorter vector is filled with zeros.

    Equal vectors are one node with a weight, so copies are not paired.  There is a pivot for 16 nodes up to 2048, then for 1024 nodes, and
    ``pivots`` at most; they are chosen from ``sample`` rows (those with the smallest hashes of their ids) or twice as many rows
    as there are pivots.  A pair is found if the nearest pivot of one is among the ``depth`` nearest of the other and they share
    ``shared`` of them; the tests hold what is found against all pairs.
    """
    spark = vectors.sparkSession
    rows = cut(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), real_vectors(vectors, vector_col).alias("v"), usable(F.col(vector_col)).alias("ok")), "vectors")
    live = rows.filter("ok AND label IS NOT NULL AND vec_id IS NOT NULL")
    nodes = cut(live.groupBy("label", "v").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight")), "vector-nodes")
    n = nodes.count()
    many = min(pivots, max(16, min(2048, n // 16), n // 1024))
    drawn = nodes.orderBy(F.xxhash64("id"), "id").limit(max(sample, 2 * many)).select("v").toPandas()
    alone = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if not len(drawn):
        return alone
    known = choose_pivots(np.stack(drawn.v.values).astype(np.float64), many)
    depth, shared = min(depth, len(known)), min(shared, len(known))
    points = spark.sparkContext.broadcast(known)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column("v")
            wide = v.type.value_type.bit_width // 8 * len(v[0])
            near = permutations(_unit(_matrix(v)), points.value, depth)
            payload = pa.FixedSizeBinaryArray.from_buffers(pa.binary(wide), len(v), [None, pa.py_buffer(np.ascontiguousarray(v.flatten().to_numpy()))]).cast(pa.binary())
            order = pa.array([x.tobytes() for x in near], pa.binary())
            for k in range(depth):
                role = np.full(len(v), QUERY if k else BOTH, np.int8)
                yield pa.RecordBatch.from_arrays([batch.column("label_key"), pa.array(near[:, k]), pa.array(role), batch.column("id"), batch.column("weight"), order, payload], ["label_key", "pivot", "role", "id", "weight", "near", "v"])

    real = np.float32 if dict(rows.dtypes)["v"] == "array<float>" else np.float64
    schema = "label_key long, pivot int, role byte, id long, weight long, near binary, v binary"
    described = nodes.select(F.xxhash64("label").alias("label_key"), "v", "id", "weight").mapInArrow(describe, schema)
    described = described.withColumn("key", F.xxhash64("label_key", "pivot"))

    def columns(batch: pa.RecordBatch) -> dict:
        read = lambda name, kind: np.frombuffer(b"".join(batch.column(name).to_pylist()), kind).reshape(batch.num_rows, -1)
        return {"id": batch.column("id").to_numpy(), "weight": batch.column("weight").to_numpy(), "label": batch.column("label_key").to_numpy(), "pivot": batch.column("pivot").to_numpy(), "near": read("near", np.int32), "unit": _unit(read("v", real).astype(np.float64))}

    def verify(table: dict, i: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Whether a meeting is a link; of a pair that meets both ways, the one whose index row has the smaller id counts."""
        id_, near = table["id"], table["near"]
        ok = (id_[i] != id_[q]) & (table["label"][i] == table["label"][q]) & (table["pivot"][i] == table["pivot"][q])
        at = np.flatnonzero(ok)
        again = (id_[i[at]] > id_[q[at]]) & (near[i[at]] == near[q[at], :1]).any(axis=1)
        at = at[~again]
        common = (near[i[at], :, None] == near[q[at], None, :]).sum(axis=(1, 2))
        at = at[common >= shared]
        cosine = np.einsum("ij,ij->i", table["unit"][i[at]], table["unit"][q[at]])
        ok[:] = False
        ok[at[cosine >= threshold]] = True
        return ok

    found = cut(linked(described, verify, columns, block=BLOCK, weights=True, heavy_queries=True), "vector-links")
    reached = components(found.filter("n IS NULL").select("a", "b"))
    links = found.filter("n IS NOT NULL").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    labelled = nodes.join(links, "id", "left").join(reached, "id", "left")
    labelled = labelled.select("label", "v", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("component", "id").alias("c"))
    with_links = live.select("vec_id", "label", "v").join(labelled, ["label", "v"]).select("vec_id", F.col("n").alias("n_links"), F.col("c").alias("component_id"))
    others = rows.filter("NOT coalesce(ok AND label IS NOT NULL AND vec_id IS NOT NULL, false)")
    return with_links.union(others.select("vec_id", F.lit(0).cast("long"), "vec_id"))


def vector_digest(vectors: DataFrame) -> DataFrame:
    """The contract's columns."""
    out = vector_groups(vectors)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
