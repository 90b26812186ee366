"""Near-duplicates by SimHash fingerprints and Golay-code fuzzy hashing.

Every 23-bit word lies within 3 bits of exactly one codeword of the binary Golay code.  So if two
words differ in one bit at most, the codeword nearest to one is within 4 bits of the other; and if
they differ in two, some codeword is within 4 bits of both.  The codewords near a segment of a
fingerprint are its keys, about five each.

Where texts may differ in more bits, the keys are joint codewords of two segments, and the nearest ones are found by soft
decision: a bit counts as much as the shingles that it has more of than of its opposite.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._buckets import BOTH, INDEX, QUERY, bucket_pairs, components, linked, split, stars, whole_buckets
from ._shared import cut, steady_batches

WORD, DATA = 23, 12
#: Generator polynomial of the binary Golay code (fixed value).
GENERATOR = 0b110001110101
SEED = 42
#: Index rows of a bucket in one block.
BLOCK = 4096
#: The near-duplicates of a key, and the bytes of sets of a candidate group, that one task takes; keys with up to so many rows have their pairs listed.
BLOCK_ROWS, GROUP_BYTES, FEW = 32_768, 32 << 20, 64
#: Codewords of each segment that make keys, and the pairs of segments of 256 bits that are joint.  Those of the first 128 bits travel with
#: the last 128 and the others with the first, so that what is compared says nothing that the key said.
NEAREST = 6
JOINT = ((0, 1), (2, 3), (6, 7), (8, 9))
#: Counters by which keys with many rows are found.
COUNTERS = 1 << 18


@cache
def _golay() -> tuple[np.ndarray, np.ndarray]:
    """For each of 2048 syndromes the error patterns of at most 4 bits, lightest first, -1 where there are fewer; and the syndromes of single bits."""
    single = []
    for bit in range(WORD):
        x = 1 << bit
        for k in range(WORD - 1, WORD - DATA - 1, -1):
            if x >> k & 1:
                x ^= GENERATOR << (k - (WORD - DATA))
        single.append(x)
    found: list[list[int]] = [[] for _ in range(1 << (WORD - DATA))]
    for weight in range(5):
        for bits in combinations(range(WORD), weight):
            s = 0
            for b in bits:
                s ^= single[b]
            found[s].append(sum(1 << b for b in bits))
    wide = max(map(len, found))
    return np.array([x + [-1] * (wide - len(x)) for x in found], np.int64), np.array(single, np.int64)


def golay_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each 23-bit word: the number of its nearest codeword, and of all within 4 bits (-1: none)."""
    errors, single = _golay()
    words = words.astype(np.int64)
    syndrome = np.zeros(len(words), np.int64)
    for bit in range(WORD):
        syndrome ^= single[bit] * (words >> bit & 1)
    near = errors[syndrome]
    keys = np.where(near >= 0, (words[:, None] ^ near) >> (WORD - DATA), -1)
    return keys[:, 0], keys


def _shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of each run of ``shingle`` words, lower-cased A-Z, repeats included; of all words if there are fewer."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest, seed = xxhash.xxh64_intdigest, SEED
    return np.array([digest(joined[s:e], seed) for s, e in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)], np.uint64)


def _margins(hashes: np.ndarray, lanes: int = 1) -> np.ndarray:
    """For each of ``lanes`` * 64 bits how many more of the hashes have it than have not.

    The first lane takes the hashes themselves; further lanes take them mixed with another constant each.
    """
    out = np.zeros((lanes, 64), np.int64)
    for lane in range(lanes):
        x = _mixed(hashes, lane) if lane else hashes
        for at in range(0, len(x), 60_000):
            bits = np.unpackbits(x[at : at + 60_000].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            out[lane] += np.add.reduce(bits, axis=0, dtype=np.uint16)
    return 2 * out.ravel() - len(hashes)


def _majority(hashes: np.ndarray, lanes: int = 1) -> bytes:
    """``lanes`` * 64 bits: a bit is 1 if set in over half the hashes; without any all are 0."""
    return np.packbits(_margins(hashes, lanes) > 0).tobytes()


def _mixed(x: np.ndarray, salt: int | np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit mixer."""
    x = x + np.asarray(salt, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _codewords() -> np.ndarray:
    """(WORD, 4096): the bits of all codewords by their numbers, 1 or -1, lowest bit first."""
    numbers = np.arange(1 << DATA, dtype=np.int64) << (WORD - DATA)
    rest = numbers.copy()
    for k in range(WORD - 1, WORD - DATA - 1, -1):
        rest ^= np.where(rest >> k & 1, GENERATOR << (k - (WORD - DATA)), 0)
    return (((numbers | rest) >> np.arange(WORD)[:, None] & 1) * 2 - 1).astype(np.float32)


def soft_codewords(margins: np.ndarray, most: int = NEAREST) -> np.ndarray:
    """(rows, most): numbers of the codewords that agree best with 23 ``margins`` each, the best first.

    Agreement is the sum of margins on the codeword's side less that of the others; ties go to the smaller number.  Margins are
    brought to whole numbers whose sums a float holds, so a row's codewords do not depend on the rows beside it.
    """
    large = np.abs(margins).max(axis=1, initial=1)
    margins = np.where(large[:, None] > 1 << 17, np.rint(margins * ((1 << 17) / large)[:, None]), margins).astype(np.float32)
    out = np.zeros((len(margins), most), np.int32)
    for at in range(0, len(margins), 256):
        agree = margins[at : at + 256] @ _codewords()
        rows = np.arange(len(agree))
        for k in range(most):
            out[at : at + 256, k] = best = agree.argmax(axis=1)
            agree[rows, best] = -np.inf
    return out


def fingerprint(text: str | None, shingle: int = 3) -> bytes:
    """64 bits of the shingles, repeats included."""
    return _majority(_shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", *, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint of each whole text as a long, written to the shared folder."""
    steady_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(x.as_py(), shingle) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.frombuffer(b"".join(prints), ">i8").astype(np.int64))], ["doc_id", "fp"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return cut(narrow.mapInArrow(run, "doc_id long, fp long"), "fingerprints")


def _set_prints(docs: DataFrame, text_col: str, id_col: str, shingle: int) -> DataFrame:
    """(doc_id, text_hash, node, fp, codes): ``node`` is a hash of the text's set of shingles, ``fp`` 256 bits of that set and ``codes`` the
    nearest codewords of its segments, none without shingles; repeats do not count."""
    steady_batches(docs.sparkSession)
    segments = sorted({s for pair in JOINT for s in pair})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(_shingle_hashes(x.as_py(), shingle)) for x in batch.column(2)]
            nodes = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64).view(np.int64)
            margins = np.array([_margins(x, 4) for x in sets], np.int64).reshape(-1, 256)
            prints = pa.array([x.tobytes() for x in np.packbits(margins > 0, axis=1)], pa.binary())
            some = np.flatnonzero([len(x) > 0 for x in sets])
            codes = np.concatenate([soft_codewords(margins[some, WORD * s : WORD * (s + 1)]) for s in segments], axis=1)
            ends = np.zeros(len(sets) + 1, np.int32)
            ends[some + 1] = codes.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(ends, dtype=np.int32)), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(nodes), prints, lists], ["doc_id", "text_hash", "node", "fp", "codes"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return cut(narrow.mapInArrow(run, "doc_id long, text_hash long, node long, fp binary, codes array<int>"), "set-prints")


def _exact_rows(fps: DataFrame) -> DataFrame:
    """Keys for links of 2 bits at most in 64.

    Of the three segments (22, 21, 21 bits) one has no error and another at most one.  For each such
    pair the key is the first segment's value with a codeword of the second: the nearest one in the
    index, all within 4 bits in a query.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().astype(np.uint64)
            parts = [(fp >> np.uint64(s) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in ((42, 22), (21, 21), (0, 21))]
            near = [golay_keys(x) for x in parts]
            ids, keys, roles = [], [], []
            for combo, (z, y) in enumerate(permutations(range(3), 2)):
                base = np.int64(combo) << 34 | parts[z] << 12
                keys.append(base | near[y][0])
                ids.append(fp)
                roles.append(np.full(len(fp), INDEX, np.int8))
                for column in near[y][1].T:
                    ok = column >= 0
                    keys.append((base | column)[ok])
                    ids.append(fp[ok])
                    roles.append(np.full(ok.sum(), QUERY, np.int8))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(roles)), pa.array(np.concatenate(ids).astype(np.int64))], ["key", "role", "id"])

    return fps.mapInArrow(run, "key long, role byte, id long")


def _own(batch: pa.RecordBatch) -> dict:
    return {"id": batch.column("id").to_numpy()}


def simhash_groups(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", *, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """(doc_id, fp, component_id): documents whose 64-bit fingerprints differ in ``max_bits`` (0 to 2) bits at most are linked.

    ``component_id`` is the smallest doc_id reachable by links.  Every link is found: see :func:`_exact_rows`.
    Equal fingerprints are one node, so copies are never paired.  Null and blank texts have fingerprint 0 and
    are linked like others.  Null ids are no component's smallest id; a group of only such has a null component.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("links of at most 2 bits are supported")
    fps = fingerprints(docs, text_col, id_col, shingle=shingle)
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-nodes")

    def verify(table: dict, i: np.ndarray, q: np.ndarray) -> np.ndarray:
        a, b = table["id"][i], table["id"][q]
        return (a < b) & (np.bitwise_count((a ^ b).view(np.uint64)) <= max_bits)

    edges = linked(_exact_rows(nodes.select("fp")), verify, _own, block=BLOCK)
    return _grouped(fps, nodes, edges)


def _grouped(fps: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Documents with the smallest doc_id of their component; ``nodes`` has (fp or node, first)."""
    node = "node" if "node" in nodes.columns else "fp"
    reached = components(edges.select("a", "b")).select(F.col("id").alias(node), "component")
    labelled = nodes.join(reached, node, "left").withColumn("component", F.coalesce("component", node))
    first = labelled.groupBy("component").agg(F.min("first").alias("component_id"))
    return fps.join(labelled.join(first, "component").select(node, "component_id"), node)


def _bits(similarity: float) -> float:
    """Expected differing bits of 256 between sets of a Jaccard similarity, by the angle between their vectors."""
    return 256 * float(np.arccos(2 * similarity / (1 + similarity))) / np.pi


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", *, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id): documents whose sets of ``shingle`` words have a Jaccard similarity of ``similarity`` or more are linked.

    Texts with one set are a node.  Nodes have fingerprints of 256 bits; keys are joint codewords of two segments (:func:`_joint_keys`).
    Nodes that share a key and differ in few enough bits are put into one candidate group; within it the sets alone decide,
    see :func:`set_components`.  Of 4096 codewords the 6 that agree best with a segment are its own; two sets at 0.8 share one of a
    segment's with a probability of about 0.95, hence one of the 144 keys in all but about 1 of 10,000 cases (simulated).
    Texts without words differ from all texts but each other;
    null ids as in :func:`simhash_groups`.
    """
    prints = _set_prints(docs, text_col, id_col, shingle)
    nodes = cut(prints.groupBy("node", "fp", "codes").agg(F.min("doc_id").alias("first"), F.min("text_hash").alias("text_hash")), "near-nodes")
    most = int(_bits(similarity) / 2 + 5 * np.sqrt(_bits(similarity) / 2 * (1 - _bits(similarity) / 256)))
    groups = cut(components(_near_edges(nodes, most)).select(F.col("id").alias("node"), "component"), "near-groups")
    sets = _sets(docs.select(F.col(text_col).alias("text")), nodes.join(groups, "node").select("node", "component", "text_hash"), shingle)
    return _grouped(prints.select("doc_id", "node"), nodes.select("node", "first"), _set_edges(sets, similarity)).select("doc_id", "component_id")


def _joint_keys(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Row number, key and the 128 bits that travel with it (two longs), of all joint codewords of a batch (id, fp, codes)."""
    segments = sorted({s for pair in JOINT for s in pair})
    own = np.flatnonzero(np.diff(batch.column("codes").offsets.to_numpy()))
    codes = batch.column("codes").flatten().to_numpy().reshape(len(own), len(segments), NEAREST).astype(np.int64)
    fp = np.frombuffer(b"".join(batch.column("fp").take(pa.array(own)).to_pylist()), np.int64).reshape(-1, 4)
    keys, bits = [], []
    for table, pair in enumerate(JOINT):
        one, two = (codes[:, segments.index(s)] for s in pair)
        keys.append((table << 2 * DATA | one[:, :, None] << DATA | two[:, None, :]).reshape(len(own), -1))
        far = fp[:, 2:] if pair[1] * WORD < 128 else fp[:, :2]
        bits.append(np.repeat(far[:, None], NEAREST**2, axis=1))
    bits = np.concatenate(bits, axis=1).reshape(-1, 2)
    return np.repeat(own, len(JOINT) * NEAREST**2), np.concatenate(keys, axis=1).ravel(), bits[:, 0].copy(), bits[:, 1].copy()


def _joint_rows(nodes: DataFrame) -> DataFrame:
    """(key, id, x, y, one, two): a node's row for each of its keys, in groups that any two rows of a key share at least one of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                own, key, x, y = _joint_keys(part)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part.column("id").to_numpy()[own]), pa.array(x), pa.array(y)], ["key", "id", "x", "y"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            n += np.bincount(_joint_keys(batch)[1] % COUNTERS, minlength=COUNTERS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["at", "n"])

    own = nodes.select(F.col("node").alias("id"), "fp", "codes")
    rows = own.mapInArrow(run, "key long, id long, x long, y long")
    # A key is heavy only if its counter is; rows are counted key by key only where one is.
    if own.mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).filter(F.col("n") > BLOCK_ROWS).isEmpty():
        return rows.withColumn("one", F.lit(0)).withColumn("two", F.lit(0))
    return split(rows, "id", F.lit(1), BLOCK_ROWS)


def _near_edges(nodes: DataFrame, most: int) -> DataFrame:
    """Edges (a, b) that connect the nodes of each joint codeword that differ in ``most`` of the 128 bits beside it at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_buckets(batches, ("key", "one", "two")):
            key = np.stack([batch.column(c).to_numpy() for c in ("key", "one", "two")], axis=1)
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]).any(axis=1)
            start = np.flatnonzero(new)
            size = np.diff(start, append=len(key))
            several = np.repeat(size > 1, size)
            if not several.any():
                continue
            own, key = np.flatnonzero(several), key[several]
            ids = batch.column("id").to_numpy()[own]
            fp = np.stack([batch.column(c).to_numpy()[own] for c in ("x", "y")], axis=1).view(np.uint64)
            start, size = np.cumsum(size[size > 1]) - size[size > 1], size[size > 1]
            found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
            few = np.flatnonzero(np.repeat(size <= FEW, size))
            for i, q in bucket_pairs(key[few], np.full(len(few), BOTH, np.int8)):
                i, q = few[i[i < q]], few[q[i < q]]
                ok = np.bitwise_count(fp[i] ^ fp[q]).sum(axis=1) <= most
                found.append((ids[i[ok]], ids[q[ok]]))
            for at, n in zip(start[size > FEW].tolist(), size[size > FEW].tolist(), strict=True):
                label = near_components(fp[at : at + n], most)
                far = np.flatnonzero(label != np.arange(n))
                found.append((ids[at + far], ids[at + label[far]]))
            a, b = stars(*(np.concatenate(x) for x in zip(*found, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    steady_batches(nodes.sparkSession)
    rows = _joint_rows(nodes)
    return rows.repartition("key", "one", "two").sortWithinPartitions("key", "one", "two").mapInArrow(run, "a long, b long")


def near_components(fp: np.ndarray, most: int) -> np.ndarray:
    """For each fingerprint the first one that steps of ``most`` bits at most lead to; one that is reached is not compared again."""
    label = np.arange(len(fp))
    rest = label.copy()
    while len(rest):
        root, rest = rest[0], rest[1:]
        todo = [root]
        while todo and len(rest):
            near = np.bitwise_count(fp[rest] ^ fp[todo.pop()]).sum(axis=1) <= most
            label[rest[near]] = root
            todo.extend(rest[near].tolist())
            rest = rest[~near]
    return label


def set_components(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For each set of numbers the first one that links of ``similarity`` or more lead to; exact.

    From a set that was reached, all that were not are looked at: two similar sets share one of the rarest numbers of either (so
    many that the others could not make up the similarity), hence a list of sets by those numbers gives the candidates, and
    the whole sets decide.  A group of alike copies is reached from its first, and pairs within it are never listed.
    """
    label = np.arange(len(sets))
    size = np.array([len(x) for x in sets], np.int64)
    flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint32)
    _, code, often = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(often), np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(often))
    code = rank[code]
    code = code[np.lexsort((code, np.repeat(label, size)))]
    begin = np.cumsum(size) - size
    rare = np.where(size > 0, size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1, 0)
    member = np.zeros(len(often) + 1, bool)
    left = np.ones(len(sets), bool)

    def spans(which: np.ndarray, many: np.ndarray) -> np.ndarray:
        return np.repeat(begin[which] - np.cumsum(many) + many, many) + np.arange(many.sum())

    def listed() -> tuple[np.ndarray, np.ndarray]:
        which = np.flatnonzero(left)
        numbers, owner = code[spans(which, rare[which])], np.repeat(which, rare[which])
        order = np.argsort(numbers, kind="stable")
        return numbers[order], owner[order]

    remain = held = len(sets)
    numbers, owner = listed()
    for root in range(len(sets)):
        if not left[root]:
            continue
        left[root] = False
        remain -= 1
        todo = [root]
        while todo and remain:
            x = todo.pop()
            if 2 * remain < held:
                numbers, owner = listed()
                held = remain
            own = code[begin[x] : begin[x] + size[x]]
            first = np.searchsorted(numbers, own[: rare[x]], "left")
            many = np.searchsorted(numbers, own[: rare[x]], "right") - first
            near = owner[np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())]
            near = np.unique(near[left[near]])
            near = near[np.minimum(size[near], size[x]) >= similarity * np.maximum(size[near], size[x]) - 1e-9]
            if not len(near):
                continue
            member[own] = True
            ends = np.cumsum(size[near])
            common = np.add.reduceat(member[code[spans(near, size[near])]].astype(np.int64), ends - size[near])
            member[own] = False
            hit = near[common >= similarity * (size[near] + size[x] - common) - 1e-9]
            label[hit] = root
            left[hit] = False
            remain -= len(hit)
            todo.extend(hit.tolist())
    return label


def _sets(texts: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(key, id, shingles): for the nodes of ``wanted`` (node, component, text_hash) their component and set, as sorted 32-bit hashes; a node may come once for each task."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            fresh = [k for k, x in enumerate(batch.column(1).to_pylist()) if x not in seen and not seen.add(x)]
            sets = [np.unique(_shingle_hashes(batch.column(2)[k].as_py(), shingle) >> np.uint64(32)).astype("<u4").tobytes() for k in fresh]
            some = batch.take(pa.array(fresh, pa.int64()))
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(sets, pa.binary())], ["key", "id", "shingles"])

    wanted = cut(wanted, "near-wanted")
    if wanted.count() <= 1_000_000:  # 24 MB at most
        wanted = F.broadcast(wanted)
    own = texts.withColumn("text_hash", F.xxhash64("text")).join(wanted, "text_hash").select("component", "node", "text")
    return cut(own.mapInArrow(collect, "key long, id long, shingles binary"), "near-sets")


def _set_edges(sets: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) that connect what links between the sets of each key connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_buckets(batches, ("key", "one", "two")):
            key = np.stack([batch.column(c).to_numpy() for c in ("key", "one", "two")], axis=1)
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]).any(axis=1)
            ids, a, b = batch.column("id").to_numpy(), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for start, end in zip(np.flatnonzero(new).tolist(), np.append(np.flatnonzero(new)[1:], len(key)).tolist(), strict=True):
                own, first = np.unique(ids[start:end], return_index=True)
                label = set_components([np.frombuffer(batch.column("shingles")[int(start + k)].as_py(), "<u4") for k in first], similarity)
                a.append(own[label != np.arange(len(own))])
                b.append(own[label[label != np.arange(len(own))]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    steady_batches(sets.sparkSession)
    rows = split(sets, "id", F.length("shingles"), GROUP_BYTES)
    return rows.repartition("key", "one", "two").sortWithinPartitions("key", "one", "two").mapInArrow(run, "a long, b long")


def simhash_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    out = simhash_groups(docs)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
