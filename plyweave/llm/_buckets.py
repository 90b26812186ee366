"""Pairs within buckets, components of pairs: the engine below the near-duplicate operators.

Rows (key, role, id, payload) meet when their keys are equal and one is an index row, the other a
query row.  A bucket is cut into blocks, so no task holds a whole large one, and what leaves a task
is a star for each group of linked ids rather than every pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import cut

#: Roles of a row; their order puts the index rows first and the query rows last in a sorted bucket.
INDEX, BOTH, QUERY = 0, 1, 2
PAIRS_AT_ONCE = 1 << 19
#: Edges that a task unites at once (16 MB).
EDGES_AT_ONCE = 1 << 20


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (id, smallest id linked to it in these pairs) that connect what the pairs connect."""
    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    far = label != np.arange(len(ids))
    return ids[far], ids[label[far]]


def _bounds(key: np.ndarray, role: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each bucket in sorted rows: its start, the end of index rows, the start of query rows, its end."""
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]).any(axis=1) if key.ndim > 1 else key[1:] != key[:-1]
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(key))
    group = np.cumsum(new) - 1
    return start, start + np.bincount(group[role <= BOTH], minlength=len(start)), end - np.bincount(group[role >= BOTH], minlength=len(start)), end


def bucket_pairs(key: np.ndarray, role: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers (index, query) of all meetings, some at a time."""
    start, index_end, query_start, end = _bounds(key, role)
    some = (index_end > start) & (end > query_start)
    start, index_end, query_start, end = (x[some] for x in (start, index_end, query_start, end))
    n_query, n_index = end - query_start, index_end - start
    query = np.repeat(query_start - np.cumsum(n_query) + n_query, n_query) + np.arange(n_query.sum())
    first, many = np.repeat(start, n_query), np.repeat(n_index, n_query)
    done = np.concatenate([[0], np.cumsum(many)])
    at = 0
    while at < len(query):
        to = max(at + 1, int(np.searchsorted(done, done[at] + PAIRS_AT_ONCE, "right")) - 1)
        q, f, m = query[at:to], first[at:to], many[at:to]
        yield np.repeat(f - np.cumsum(m) + m, m) + np.arange(m.sum()), np.repeat(q, m)
        at = to


def _dealt(rows: DataFrame, block: int, heavy_queries: bool) -> DataFrame:
    """Rows with block numbers: a bucket's index rows are cut into parts of about ``block``, and so are its query rows, and each part meets each.

    Query rows are counted only with ``heavy_queries``; else they are cut as the index rows are.
    """
    index, query = F.count_if(F.col("role") <= BOTH), F.count_if(F.col("role") >= BOTH)
    if heavy_queries:
        sizes = rows.groupBy("key").agg(index.alias("i"), query.alias("q")).filter(f"i > 0 AND q > 0 AND (i > {block} OR q > {block})")
    else:
        sizes = rows.filter(F.col("role") <= BOTH).groupBy("key").agg(index.alias("i"), index.alias("q")).filter(f"i > {block}")
    hot = cut(sizes.select("key", F.ceil(F.col("i") / block).cast("int").alias("pi"), F.ceil(F.col("q") / block).cast("int").alias("pq")), "hot-buckets")
    known = hot.count()
    if not known:
        return rows.withColumn("bi", F.lit(0)).withColumn("bj", F.lit(0))
    hot = F.broadcast(hot) if known <= 100_000 else hot
    rows = rows.join(hot, "key", "left")
    own = lambda parts: F.pmod(F.xxhash64("id"), parts).cast("int")
    every = lambda parts: F.sequence(F.lit(0), F.col(parts) - 1)
    as_index = F.transform(every("pq"), lambda x: F.struct(own("pi").alias("bi"), x.alias("bj"), F.lit(INDEX).alias("as")))
    as_query = F.transform(every("pi"), lambda x: F.struct(x.alias("bi"), own("pq").alias("bj"), F.lit(QUERY).alias("as")))
    places = (
        F.when(F.col("pi").isNull(), F.array(F.struct(F.lit(0).alias("bi"), F.lit(0).alias("bj"), F.col("role").cast("int").alias("as"))))
        .when(F.col("role") == INDEX, as_index).when(F.col("role") == QUERY, as_query).otherwise(F.concat(as_index, as_query))
    )
    out = rows.withColumn("__at", F.explode(places))
    return out.withColumn("bi", F.col("__at.bi")).withColumn("bj", F.col("__at.bj")).withColumn("role", F.col("__at.as").cast("byte")).drop("__at", "pi", "pq")


def split(rows: DataFrame, id_col: str, size: Column, most: int) -> DataFrame:
    """``rows`` (key, ...) with ``one`` and ``two``: groups that any two rows of a key share at least one of.

    A key whose sizes sum to ``most`` or less is one group.  A larger one is cut into parts by a hash of its ids, and each two
    parts are a group of ``most`` or about that, so every pair of rows still meets and no task holds more.
    """
    heavy = cut(rows.groupBy("key").agg(F.sum(size).alias("n")).filter(F.col("n") > most).select("key", F.ceil(2 * F.col("n") / most).cast("int").alias("parts")), "heavy-keys")
    known = heavy.count()
    if not known:
        return rows.withColumn("one", F.lit(0)).withColumn("two", F.lit(0))
    rows = rows.join(F.broadcast(heavy) if known <= 100_000 else heavy, "key", "left")
    own = F.pmod(F.xxhash64(id_col), "parts").cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: x != own)
    places = F.transform(others, lambda x: F.struct(F.least(own, x).alias("one"), F.greatest(own, x).alias("two")))
    places = F.when(F.col("parts").isNull(), F.array(F.struct(F.lit(0).alias("one"), F.lit(0).alias("two")))).otherwise(places)
    out = rows.withColumn("__at", F.explode(places))
    return out.withColumn("one", F.col("__at.one")).withColumn("two", F.col("__at.two")).drop("__at", "parts")


def whole_buckets(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches``, which are sorted by ``names``, cut so that no bucket is divided between two of them."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.ones(batch.num_rows, bool)
        new[1:] = np.logical_or.reduce([batch.column(c).to_numpy()[1:] != batch.column(c).to_numpy()[:-1] for c in names])
        goes_on = bool(rest) and all(rest[-1].column(c)[-1].as_py() == batch.column(c)[0].as_py() for c in names)
        last = int(np.flatnonzero(new)[-1])  # the last bucket may go on in the next batch
        if goes_on and not last:
            rest.append(batch)
            continue
        if rest or last:
            yield pa.Table.from_batches([*rest, batch.slice(0, last)]).combine_chunks().to_batches()[0]
        rest = [batch.slice(last)]
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks().to_batches()[0]


#: Which meetings are links.
Verify = Callable[[dict, np.ndarray, np.ndarray], np.ndarray]


def linked(rows: DataFrame, verify: Verify, columns: Callable[[pa.RecordBatch], dict], *, block: int, weights: bool = False, heavy_queries: bool = False) -> DataFrame:
    """Links between the ids of ``rows`` (key long, role byte, id long, and what ``columns`` reads).

    ``columns`` turns a batch into named arrays, ``verify`` tells which (index, query) row numbers are
    links; it must accept a pair once over all buckets if ``weights`` are wanted.  Returns rows (a, b, n):
    with n null an edge, ``b`` the smaller id; else id ``a`` has links to rows of ``n`` in weight.  The table that ``verify``
    gets is the same for all meetings of some whole buckets, so it can keep there what it has found.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            key = np.stack([batch.column(c).to_numpy() for c in ("key", "bi", "bj")], axis=1)
            role = batch.column("role").to_numpy()
            table, found = columns(batch), []
            for i, q in bucket_pairs(key, role):
                ok = verify(table, i, q)
                if ok.any():
                    found.append((i[ok], q[ok]))
                if sum(len(x[0]) for x in found) > PAIRS_AT_ONCE:
                    yield out(table, found)
                    found = []
            if found:
                yield out(table, found)

        def out(table: dict, found: list) -> pa.RecordBatch:
            i, q = (np.concatenate(x) for x in zip(*found, strict=True))
            a, b = stars(table["id"][i], table["id"][q])
            n = np.zeros(len(a), np.int64)
            edge = np.ones(len(a), bool)
            if weights:
                ids, flat = np.unique(np.concatenate([table["id"][i], table["id"][q]]), return_inverse=True)
                sums = np.bincount(flat, np.concatenate([table["weight"][q], table["weight"][i]]), len(ids)).astype(np.int64)
                a, b, n, edge = np.append(a, ids), np.append(b, ids), np.append(n, sums), np.append(edge, np.zeros(len(ids), bool))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n, mask=edge)], ["a", "b", "n"])

        for batch in whole_buckets(batches, ("key", "bi", "bj")):
            yield from links(batch)

    dealt = _dealt(rows, block, heavy_queries).repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj", "role")
    return dealt.mapInArrow(run, "a long, b long, n long")


def _forest(edges: DataFrame) -> DataFrame:
    """Edges (a, b), ``b`` the smaller id, that connect what ``edges`` connect.

    An id of a large group has an edge from each of its buckets, most of them to a few smallest ids.  All edges of an id meet in one
    task, and stars of what they connect there leave it: one for each id and a few between the smallest ones, however many edges came.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            a, b = stars(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            if sum(len(a) for a, _ in held) >= EDGES_AT_ONCE:
                yield out()
        if held:
            yield out()

    ends = [F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")]
    known = edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(*ends).distinct()
    return known.repartition("a").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in ``edges`` (a, b): the smallest id that can be reached.

    Large-star and small-star rounds (Kiveris et al., 2014) until nothing changes; each round's edges are
    written to the shared folder.  The rounds begin with few edges, see :func:`_forest`.  Nulls and loops are ignored; no edges give no rows.
    """
    now = cut(_forest(edges).distinct(), "edges")
    mark = F.struct(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38, 0)")))
    before = now.select(mark).first()[0]
    while before[0]:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        now = cut(small.select("e.a", "e.b").filter("a <> b").distinct(), "edges")
        after = now.select(mark).first()[0]
        if after == before:
            break
        before = after
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)
