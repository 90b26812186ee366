"""Packing documents into sequences of bounded length with a grouping genetic algorithm.

Pieces of one length are alike, so a packing is a list of groups: a pattern (how many pieces of which
lengths share a sequence) and how often it is used.  The search then costs the same for any number of
documents.  Crossover injects a parent's well-filled groups into the other, removes what would then be
used twice, and best-fits the displaced pieces.  Islands evolve in separate tasks and exchange their elite.
Afterwards the pieces take the places of the best packing by length and rank, without being gathered.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._bpe import encoder
from ._shared import cut, steady_batches
from .token_file import with_end

#: Pattern: (length, count) pairs by falling length.
Pattern = tuple[tuple[int, int], ...]
Packing = dict[Pattern, int]


def fill(pattern: Pattern) -> int:
    return sum(x * n for x, n in pattern)


def _best_fit(counts: dict[int, int], capacity: int, open_groups: Packing, rng: np.random.Generator, shuffle: float = 0.0) -> Packing:
    """Put ``counts`` pieces of each length into the fullest sequences that still hold them, longest first.

    ``shuffle``: how strongly the order of lengths is perturbed.  Whole groups of alike sequences are filled at once.
    """
    by_gap: dict[int, dict[Pattern, int]] = {}
    for pattern, n in open_groups.items():
        by_gap.setdefault(capacity - fill(pattern), {})[pattern] = n
    gaps = sorted(by_gap)

    def put(pattern: Pattern, n: int) -> None:
        gap = capacity - fill(pattern)
        if gap not in by_gap:
            by_gap[gap] = {}
            gaps.insert(bisect_left(gaps, gap), gap)
        by_gap[gap][pattern] = by_gap[gap].get(pattern, 0) + n

    lengths = sorted(counts, key=lambda x: -x * (1 + shuffle * rng.standard_normal()) if shuffle else -x)
    for x in lengths:
        left = counts[x]
        while left:
            at = bisect_left(gaps, x)
            while at < len(gaps) and not by_gap[gaps[at]]:
                del by_gap[gaps[at]]
                del gaps[at]
            if at < len(gaps):
                gap = gaps[at]
                pattern, n = by_gap[gap].popitem()
            else:
                gap, pattern, n = capacity, (), left
            each = min(gap // x, left)
            use = min(n, left // each)
            if n > use and pattern:
                by_gap[gap][pattern] = by_gap[gap].get(pattern, 0) + n - use
            grown = dict(pattern)
            grown[x] = grown.get(x, 0) + each
            put(tuple(sorted(grown.items(), reverse=True)), use)
            left -= each * use
    out: Packing = {}
    for group in by_gap.values():
        for pattern, n in group.items():
            if n:
                out[pattern] = out.get(pattern, 0) + n
    return out


def _missing(counts: dict[int, int], packing: Packing) -> dict[int, int]:
    left = dict(counts)
    for pattern, n in packing.items():
        for x, k in pattern:
            left[x] -= k * n
    return {x: n for x, n in left.items() if n}


def _score(packing: Packing, capacity: int) -> tuple[int, float]:
    """Number of sequences, then the mean squared fill, negated: the less the better."""
    n = sum(packing.values())
    return n, -sum((fill(p) / capacity) ** 2 * k for p, k in packing.items()) / max(n, 1)


def _cross(one: Packing, two: Packing, counts: dict[int, int], capacity: int, rng: np.random.Generator) -> Packing:
    """Whole well-filled groups of ``one`` go into ``two``; groups that would use a piece twice shrink; the rest is best-fitted."""
    level = capacity - int(rng.integers(0, 3))
    child = {p: n for p, n in one.items() if fill(p) >= level and rng.random() < 0.7}
    left = _missing(counts, child)
    for pattern, n in sorted(two.items(), key=lambda x: -fill(x[0])):
        if fill(pattern) < capacity - 8 and rng.random() < 0.8:
            continue
        use = min([n, *(left.get(x, 0) // k for x, k in pattern)])
        if use > 0:
            child[pattern] = child.get(pattern, 0) + use
            for x, k in pattern:
                left[x] -= k * use
    return _best_fit({x: n for x, n in left.items() if n}, capacity, child, rng, 0.15 * rng.random())


def _mutate(packing: Packing, counts: dict[int, int], capacity: int, rng: np.random.Generator) -> Packing:
    """Break up the worst-filled groups and some others, and best-fit their pieces."""
    kept = {p: n for p, n in packing.items() if fill(p) == capacity and rng.random() < 0.9}
    return _best_fit(_missing(counts, kept), capacity, kept, rng, 0.1 * rng.random())


def evolve(counts: dict[int, int], capacity: int, start: list[Packing], seed: int, generations: int, size: int) -> list[Packing]:
    """One island: its population after some generations, best first.  It ends early at the lower bound."""
    rng = np.random.default_rng(seed)
    least = -(-sum(x * n for x, n in counts.items()) // capacity)
    people = [*start]
    while len(people) < size:
        people.append(_best_fit(counts, capacity, {}, rng, 0.0 if not people else 0.3 * rng.random()))
    people.sort(key=lambda p: _score(p, capacity))
    for _ in range(generations):
        if _score(people[0], capacity)[0] <= least:
            break
        a, b = sorted(rng.integers(0, len(people), 2))
        child = _cross(people[a], people[b], counts, capacity, rng)
        if rng.random() < 0.3:
            child = _mutate(child, counts, capacity, rng)
        if child not in people:
            people = sorted([*people, child], key=lambda p: _score(p, capacity))[:size]
    return people


def pack_counts(spark, counts: dict[int, int], capacity: int, *, islands: int = 4, epochs: int = 3, generations: int = 12, size: int = 6, seed: int = 7) -> Packing:
    """The best packing found of ``counts`` pieces by length, evolved on islands in Spark tasks.

    ``counts`` has one entry for each length up to ``capacity`` at most, and a packing a few patterns for
    each, so what moves between driver and islands does not grow with the documents.
    """
    if not counts:
        return {}
    least = -(-sum(x * n for x, n in counts.items()) // capacity)
    best = _best_fit(counts, capacity, {}, np.random.default_rng(seed))
    elite: list[Packing] = [best]
    for epoch in range(epochs):
        if _score(best, capacity)[0] <= least:
            break

        def island(batches: Iterator[pd.DataFrame], elite=tuple(elite), epoch=epoch) -> Iterator[pd.DataFrame]:
            for rows in batches:
                for k in rows["id"].tolist():
                    people = evolve(counts, capacity, list(elite), seed + 1000 * epoch + k, generations, size)
                    yield pd.DataFrame({"island": [k], "people": [repr([tuple(p.items()) for p in people[:2]])]})

        import ast

        found = spark.range(0, islands, 1, islands).mapInPandas(island, "island long, people string").collect()
        people = [dict(p) for r in sorted(found, key=lambda r: r.island) for p in ast.literal_eval(r.people)]
        people.sort(key=lambda p: _score(p, capacity))
        elite = people[:2]
        best = min([best, *elite], key=lambda p: _score(p, capacity))
    return best


def _places(packing: Packing) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length, runs of ranks: first rank, pieces in each sequence, first sequence, place of the first piece in it."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    base = 0
    for pattern, n in sorted(packing.items(), reverse=True):
        at = 0
        for x, k in pattern:
            runs.setdefault(x, []).append((used.get(x, 0), k, base, at))
            used[x] = used.get(x, 0) + k * n
            at += x * k
        base += n
    return {x: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for x, r in runs.items()}


def pack(pieces: DataFrame, capacity: int, length_col: str = "length", order_cols: tuple[str, ...] = ("doc_id", "piece"), **options) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: a place for each piece, sequences filled gapless from 0 to ``capacity`` at most.

    Lengths must be from 1 to ``capacity``.  Pieces with equal lengths take their places in the order of
    ``order_cols``; equal rows in any order.  Input columns named like the new ones are replaced; an empty
    table stays empty.
    """
    spark = pieces.sparkSession
    columns = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    pieces = cut(pieces.select(*columns), "pieces")
    bounds = pieces.agg(F.min(length_col), F.max(length_col)).first()
    if bounds[0] is not None and (bounds[0] < 1 or bounds[1] > capacity):
        raise ValueError(f"lengths from 1 to {capacity} are needed")
    # A length's pieces are numbered in slices, since one length may hold a large share of them.
    slices = max(1, min(65_536, pieces.count() // 1024))
    sliced = pieces.withColumn("__slice", F.pmod(F.xxhash64(*order_cols), F.lit(slices)))
    sizes = cut(sliced.groupBy(F.col(length_col).alias("__length"), F.col("__slice")).agg(F.count("*").alias("__n")), "piece-counts")
    counts = {r[0]: r[1] for r in sizes.groupBy("__length").agg(F.sum("__n")).collect()}  # one for each length
    packing = pack_counts(spark, counts, capacity, **options)
    places = spark.sparkContext.broadcast(_places(packing))
    before = F.sum("__n").over(W.partitionBy("__length").orderBy("__slice")) - F.col("__n")
    sizes = sizes.select("__length", F.col("__slice").alias("__s"), before.alias("__before"))
    number = F.row_number().over(W.partitionBy(length_col, "__slice").orderBy(*order_cols)) - 1
    ranked = sliced.withColumn("__k", number).join(sizes, (F.col(length_col) == F.col("__length")) & (F.col("__slice") == F.col("__s")))
    ranked = ranked.select(*columns, (F.col("__before") + F.col("__k")).alias("__rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = places.value
        for batch in batches:
            length, rank = batch.column(columns.index(length_col)).to_numpy(), batch.column("__rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for some in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if len(some):
                    first, each, base, at = table[int(length[some[0]])]
                    run = np.searchsorted(first, rank[some], "right") - 1
                    n = rank[some] - first[run]
                    sequence[some] = base[run] + n // each[run]
                    offset[some] = at[run] + n % each[run] * length[some]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], [*columns, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, *, end_id: int | None = 2, text_col: str = "text", id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every whole text: only longer ones are cut, the first piece may be shorter.

    A null text counts as empty and has the end id alone; without an end id it gives no piece.
    """
    steady_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path).encode
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, counts = with_end(*encode(batch.column(1).to_pylist()), end_id)
            ids = ids.astype("<u4")
            pieces = -(-counts // capacity)
            doc = np.repeat(np.arange(len(counts)), pieces)
            piece = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            spare = (pieces * capacity - counts)[doc]  # what the first piece is shorter by
            start = np.maximum(piece * capacity - spare, 0)
            end = (piece + 1) * capacity - spare
            base = (np.cumsum(counts) - counts)[doc]
            spans = list(zip((base + start).tolist(), (base + end).tolist(), strict=True))
            out = [batch.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(end - start), pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in spans], pa.int64())]
            if with_ids:
                held = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(held), pa.array(ids.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(out, names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text).mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, *, end_id: int | None = 2, with_ids: bool = False, **options) -> DataFrame:
    """Pieces of all ``docs`` with their places in sequences of at most ``capacity`` tokens."""
    return pack(cut_pieces(docs, tokenizer_path, capacity, end_id=end_id, with_ids=with_ids), capacity, **options)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids, offsets): the packed sequences themselves; ``packed`` must carry ids."""
    row = F.struct("offset", "ids", "doc_id")
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    return rows.select("sequence_id", F.flatten("rows.ids").alias("ids"), F.col("rows.doc_id").alias("doc_ids"), F.col("rows.offset").alias("offsets"))
