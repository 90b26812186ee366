"""Sharding by histogram sort.

Rows get the sort key (hash of the text, id), so copies of a text are neighbours.  Exact byte and
row counts below candidate boundaries are taken over all partitions, the intervals around each
wanted splitter are probed more finely until the splitters meet the tolerance, and the rows are
exchanged once.  Only DataFrame functions run.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import cut, small_table

LOWEST = -(1 << 63)
TOP_BITS = 12


@dataclass
class _Leaf:
    """An interval of keys: its node number, exact contents and the extent of the keys in it."""

    node: int
    size: int
    rows: int
    h: tuple[int, int]
    i: tuple[int, int]


def _histogram(placed: DataFrame) -> list[_Leaf]:
    stats = placed.groupBy("__node").agg(
        F.sum("__size").alias("s"), F.count("*").alias("n"),
        F.min("__h").alias("h0"), F.max("__h").alias("h1"), F.min("__i").alias("i0"), F.max("__i").alias("i1"),
    )
    return [_Leaf(r[0], r.s, r.n, (r.h0, r.h1), (r.i0, r.i1)) for r in stats.collect()]


def _descend(df: DataFrame, levels: list[list[tuple]]) -> DataFrame:
    """Replace each refined node by the child in which a row's key lies, level by level."""
    for rows in levels:
        table = small_table(df.sparkSession, rows, "__node long, axis int, low long, step long, base long")
        child = F.expr("base + CASE axis WHEN 0 THEN (__h - low) DIV step ELSE (__i - low) DIV step END")
        df = df.join(table, "__node", "left").withColumn("__node", F.coalesce(child, "__node")).drop("axis", "low", "step", "base")
    return df


def _splitters(leaves: list[_Leaf], shards: int) -> tuple[list[int], list[int]]:
    """Bytes before each leaf, and for each inner splitter the leaf that it precedes."""
    before, total = [], 0
    for x in leaves:
        before.append(total)
        total += x.size
    before.append(total)
    cuts = []
    for k in range(1, shards):
        want = total * k / shards
        at = bisect_left(before, want)
        if at > 0 and want - before[at - 1] <= before[at] - want:
            at -= 1
        cuts.append(max(at, cuts[-1] if cuts else 0))
    return before, cuts


def histogram_shards(
    df: DataFrame, n_shards: int, hash_col: str, id_col: str, size_col: str, *, tolerance: float = 0.01, fanout: int = 1024, spread: int = 512, cut_first: bool = True,
) -> DataFrame:
    """``df`` with ``shard`` (0 to ``n_shards`` - 1) and ``slot`` (gapless from 0 in each shard).

    Shards are ranges of the key (``hash_col``, ``id_col``) whose sums of ``size_col`` differ from
    equal shares by at most ``tolerance`` of a share, or by one row where rows are larger than that.
    Rows with one hash stay together unless they are too many for the tolerance; then ids divide them.

    No interval that is exchanged as one holds more than 1/``spread`` of the rows, unless its rows
    have one key.  The driver holds at most 2**12 + ``fanout`` * (``spread`` + ``n_shards``) counts.

    Null hashes, ids and sizes count as lowest key, lowest id and 0.  Rows with equal keys are never
    separated in order; which of them comes first is open.  Ids must span less than 2**63.  Input
    columns named ``shard`` or ``slot`` are replaced.  An empty table stays empty.
    """
    columns = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    keyed = df.select(
        *columns, F.coalesce(F.col(hash_col).cast("long"), F.lit(LOWEST)).alias("__h"), F.col(id_col).cast("long").alias("__i"), F.coalesce(F.col(size_col).cast("long"), F.lit(0)).alias("__size")
    )
    slim = keyed.select("__h", "__i", "__size")
    slim = cut(slim, "shard-keys") if cut_first else slim
    lowest = slim.agg(F.min("__i")).first()[0]
    root = [F.coalesce("__i", F.lit(lowest if lowest is not None else 0)).alias("__i"), F.shiftrightunsigned(F.col("__h").bitwiseXOR(F.lit(LOWEST)), 64 - TOP_BITS).cast("long").alias("__node")]
    start = slim.select("__h", "__size", *root)

    leaves = sorted(_histogram(start), key=lambda x: (x.h, x.i))
    total, rows = sum(x.size for x in leaves), sum(x.rows for x in leaves)
    allowed, most = tolerance * total / n_shards, max(64, rows // spread)
    levels: list[list[tuple]] = []
    fresh = 1 << TOP_BITS
    while True:
        before, cuts = _splitters(leaves, n_shards)
        finer = {n for n, x in enumerate(leaves) if x.rows > most}
        for k, at in enumerate(cuts, 1):
            want = total * k / n_shards
            if abs(before[at] - want) > allowed:
                finer.add(at if before[at] < want else at - 1)
        finer = {n for n in finer if 0 <= n < len(leaves) and (leaves[n].h[0] < leaves[n].h[1] or leaves[n].i[0] < leaves[n].i[1])}
        if not finer:
            break
        table = []
        for n in sorted(finer):
            axis, (low, high) = (0, leaves[n].h) if leaves[n].h[0] < leaves[n].h[1] else (1, leaves[n].i)
            table.append((leaves[n].node, axis, low, max(1, -(-(high - low + 1) // fanout)), fresh))
            fresh += fanout
        levels.append(table)
        placed = _descend(start, levels).filter(F.col("__node") >= table[0][4])
        leaves = sorted([x for n, x in enumerate(leaves) if n not in finer] + _histogram(placed), key=lambda x: (x.h, x.i))

    shard, slot, places = 0, 0, []
    for n, x in enumerate(leaves):
        while shard < n_shards - 1 and n >= cuts[shard]:
            shard, slot = shard + 1, 0
        places.append((x.node, shard, slot))
        slot += x.rows
    table = small_table(df.sparkSession, places, "__node long, shard int, __base long")
    order = W.partitionBy("__node").orderBy("__h", "__i")
    out = _descend(keyed.select(*columns, "__h", "__size", *root), levels).join(table, "__node")
    return out.withColumn("slot", F.col("__base") + F.row_number().over(order) - 1).select(*columns, "shard", "slot")


def shard_documents(docs: DataFrame, n_shards: int, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` with ``size`` (UTF-8 bytes of the text plus 1), ``shard`` and ``slot``: shards of nearly equal bytes.

    See :func:`histogram_shards`.  A null text has size 1 and the key of an empty one.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.drop("size", "shard", "slot").withColumn("size", F.octet_length(text).cast("long") + 1).withColumn("__key", F.xxhash64(text))
    return histogram_shards(docs, n_shards, "__key", id_col, "size", **options).drop("__key")


def shard_digest(docs: DataFrame, n_shards: int) -> DataFrame:
    """The contract's columns: one narrow row for each document is written once, probed and exchanged."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(
        "doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("__key")
    )
    narrow = cut(narrow, "shard-digest")
    out = histogram_shards(narrow, n_shards, "__key", "doc_id", "size", cut_first=False)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
