"""Scoring documents by masked pseudo-likelihood.

A window network predicts every word from the two words on either side: their embeddings, scaled by
position, are summed, and a two-level softmax (group of classes, then class within the group) gives the conditional
log-probability of a word's class.  The most frequent words are classes of their own; the others share the rest, and the
probability of a word within its class is its share of the class in the whole corpus.  The counts of all words are a table
that grows with the corpus: its frequent part, which a parameter bounds, is broadcast, the other words are joined.  A document's score is the sum of these
log-probabilities over its words.

Training covers the whole corpus.  The output starts at the corpus frequencies.  Documents are dealt to rounds and, within a
round, to replicas by hashes of their ids and texts; a replica learns its documents in the order of those hashes, and the replicas are averaged by the
words that they saw.  How many replicas there are depends on the number of words alone, so how the input is partitioned changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import cut, steady_batches

GROUPS, WITHIN, DIM = 32, 64, 16
#: Words that are classes of their own; the other words share the other classes by their hashes.
OWN = 1536
#: Words whose counts are broadcast, at most (12 MB).
FREQUENT = 1 << 19
#: Words that a replica learns in a round, about.
REPLICA_WORDS = 1_000_000
OFFSETS = (-2, -1, 1, 2)
BATCH = 4096
#: Bytes of text in one numpy pass.
CHUNK_BYTES = 500_000
PRIME = np.uint64(0x100000001B3)


@dataclass
class Network:
    """Embeddings by class (class 0 stands beyond the ends), their scale by position, output weights of groups and of words in a group."""

    into: np.ndarray  # (classes + 1, DIM)
    place: np.ndarray  # (4, DIM)
    group: np.ndarray  # (DIM + 1, GROUPS)
    shift: np.ndarray  # (GROUPS, DIM)
    word: np.ndarray  # (DIM + 1, WITHIN)
    bias: np.ndarray  # (GROUPS, WITHIN)

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.parts()])

    def parts(self) -> tuple[np.ndarray, ...]:
        return self.into, self.place, self.group, self.shift, self.word, self.bias

    @classmethod
    def start(cls, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (0.1 * rng.standard_normal(shape)).astype(np.float32)
        return cls(draw(GROUPS * WITHIN + 1, DIM), 1 + draw(len(OFFSETS), DIM), draw(DIM + 1, GROUPS), draw(GROUPS, DIM), draw(DIM + 1, WITHIN), np.zeros((GROUPS, WITHIN), np.float32))

    def at_frequencies(self, class_counts: np.ndarray) -> Network:
        """This network with output weights that predict the corpus frequencies, whatever the context."""
        often = (class_counts[1:] + 0.5).reshape(GROUPS, WITHIN)
        self.group[:] = 0
        self.group[DIM] = np.log(often.sum(axis=1) / often.sum())
        self.bias[:] = np.log(often / often.sum(axis=1, keepdims=True))
        self.word[DIM] = 0
        return self

    @classmethod
    def of(cls, flat: np.ndarray) -> Network:
        out, at = [], 0
        for x in cls.start(0).parts():
            out.append(flat[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return cls(*out)


@dataclass
class Vocabulary:
    """Frequent words by ascending hash with their counts and classes, and the count of each class."""

    hashes: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    class_counts: np.ndarray  # (classes + 1,), class 0 unused

    def look(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class of each word, and its count, 0 where it is not among the frequent ones."""
        if not len(self.hashes):
            return _shared_class(hashes), np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        known = self.hashes[at] == hashes
        return np.where(known, self.classes[at], _shared_class(hashes)), np.where(known, self.counts[at], 0)


def _shared_class(hashes: np.ndarray) -> np.ndarray:
    return OWN + 1 + (hashes.view(np.uint64) % np.uint64(GROUPS * WITHIN - OWN)).astype(np.int64)


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(hash, n): how often each word of all texts occurs; as many rows as the corpus has words, written to the shared folder."""
    steady_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            words, at = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
            return words, np.bincount(at, np.concatenate([n for _, n in held]), len(words)).astype(np.int64)

        def out(words: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(words), pa.array(n)], ["hash", "n"])

        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in _pieces(texts):
                held.append(np.unique(word_hashes(texts[a:b])[0], return_counts=True))
            if sum(len(x) for x, _ in held) > 4_000_000:
                held = [merged()]
                if len(held[0][0]) > 2_000_000:
                    yield out(*held.pop())
        if held:
            yield out(*merged())

    counted = docs.select(F.col(text_col).alias("text")).filter(F.col("text").isNotNull()).mapInArrow(run, "hash long, n long")
    return cut(counted.groupBy("hash").agg(F.sum("n").alias("n")), "word-counts")


def vocabulary(counts: DataFrame, *, frequent: int = FREQUENT) -> Vocabulary:
    """The ``frequent`` most frequent words at most (whole ranges of counts), and the counts of the classes."""
    step = F.floor(F.log2("n") * 8).cast("int")
    steps = {r[0]: r[1] for r in counts.groupBy(step.alias("s")).count().collect()}  # a few hundred
    total, least = 0, None
    for s in sorted(steps, reverse=True):
        total += steps[s]
        if total > frequent:
            break
        least = s
    head = counts.filter(step >= F.lit(least)).toPandas() if least is not None else pd.DataFrame({"hash": np.zeros(0, np.int64), "n": np.zeros(0, np.int64)})
    head = head.sort_values(["n", "hash"], ascending=[False, True], ignore_index=True)
    classes = np.where(np.arange(len(head)) < OWN, np.arange(len(head)) + 1, _shared_class(head["hash"].to_numpy(np.int64)))
    sums = np.bincount(classes, head.n.to_numpy(float), GROUPS * WITHIN + 1).astype(np.int64)
    tail = counts.filter(step < F.lit(least)) if least is not None else counts
    modulus = GROUPS * WITHIN - OWN  # of the hash as an unsigned number
    unsigned = F.pmod(F.pmod(F.col("hash"), F.lit(modulus)) + F.when(F.col("hash") < 0, F.lit(2**64 % modulus)).otherwise(0), F.lit(modulus))
    for r in tail.groupBy((unsigned + OWN + 1).alias("c")).agg(F.sum("n").alias("n")).collect():
        sums[r.c] += r.n
    order = np.argsort(head["hash"].to_numpy(np.int64), kind="stable")
    return Vocabulary(head["hash"].to_numpy(np.int64)[order], head.n.to_numpy(np.int64)[order], classes[order], sums)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word of the texts, split at ASCII white space and with A-Z lower-cased, and words in each text."""
    raw = [(x or "").encode().lower() for x in texts]
    size = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
    text = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    blank = (text == 32) | ((text >= 9) & (text <= 13))
    start = np.flatnonzero(~blank & np.append(True, blank[:-1]))
    end = np.flatnonzero(~blank & np.append(blank[1:], True)) + 1
    # A polynomial hash of each word: prefix sums of bytes times powers, brought to the same power.
    power = np.cumprod(np.full(int((end - start).max(initial=0)) + 1, PRIME, np.uint64))
    place = np.arange(len(text)) - np.repeat(start, np.diff(start, append=len(text))) if len(start) and start[0] == 0 else np.arange(len(text)) - np.concatenate([np.zeros(start[0] if len(start) else len(text), np.int64), np.repeat(start, np.diff(start, append=len(text)))])
    value = np.where(blank, 0, text.astype(np.uint64) + np.uint64(1)) * power[np.clip(place, 0, len(power) - 1)]
    total = np.concatenate([[np.uint64(0)], np.cumsum(value, dtype=np.uint64)])
    h = total[end] - total[start]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    ends = np.cumsum(size)
    return h.view(np.int64), np.diff(np.searchsorted(start, np.concatenate([[0], ends])))


def _context(classes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(words, 4): classes around each word within its text, 0 beyond the ends."""
    n = len(classes)
    doc = np.repeat(np.arange(len(counts)), counts)
    out = np.zeros((n, len(OFFSETS)), np.int64)
    for k, o in enumerate(OFFSETS):
        if abs(o) < n:
            a, b = (slice(-o, None), slice(None, o)) if o < 0 else (slice(None, -o), slice(o, None))
            out[a, k] = np.where(doc[a] == doc[b], classes[b], 0)
    return out


def _softmax(x: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ``x`` (classes, words) the log-probability of each word's ``chosen`` class, and the sums that make probabilities of what is left in ``x``."""
    x -= x.max(axis=0)
    out = x[chosen, np.arange(x.shape[1])]
    np.exp(x, out=x)
    total = x.sum(axis=0)
    return out - np.log(total), total


def _forward(net: Network, context: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, ...]:
    """What :func:`learn` needs of some words, one column each, and last their log-probabilities."""
    group, word = np.divmod(target - 1, WITHIN)
    near = [net.into.take(context[:, k], axis=0) for k in range(len(OFFSETS))]
    total = near[0] * net.place[0]
    for k in range(1, len(OFFSETS)):
        total += near[k] * net.place[k]
    h = np.ones((DIM + 1, len(target)), np.float32)
    np.tanh(total.T, out=h[:DIM])
    first = net.group.T @ h
    one, first_sum = _softmax(first, group)
    # Below the moved numbers stands a 1 in the row of the word's group, so that one product adds its bias.
    moved = np.zeros((DIM + 1 + GROUPS, len(target)), np.float32)
    moved[DIM + 1 + group, np.arange(len(target))] = 1
    moved[: DIM + 1] = h
    moved[:DIM] += net.shift.T @ moved[DIM + 1 :]
    second = np.concatenate([net.word, net.bias]).T @ moved
    two, second_sum = _softmax(second, word)
    return near, h, moved, group, word, first, first_sum, second, second_sum, one + two


def _scatter(rows: np.ndarray, where: np.ndarray, size: int) -> np.ndarray:
    """Sums of ``rows`` by ``where``."""
    order = np.argsort(where.astype(np.int16), kind="stable")  # numbers of 16 bits are sorted by their digits
    own = where[order]
    new = np.flatnonzero(np.diff(own, prepend=-1))
    out = np.zeros((size, rows.shape[1]), np.float32)
    out[own[new]] = np.add.reduceat(rows.take(order, axis=0), new, axis=0)
    return out


def learn(net: Network, classes: np.ndarray, counts: np.ndarray, memory: list[np.ndarray], rate: float) -> None:
    """One pass of AdaGrad over all words of some texts; ``memory`` holds the squared gradients."""
    context = _context(classes, counts)
    for a in range(0, len(classes), BATCH):
        x, t = context[a : a + BATCH], classes[a : a + BATCH]
        near, h, moved, group, word, d1, first_sum, d2, second_sum, _ = _forward(net, x, t)
        at, share = np.arange(len(t)), np.float32(1 / len(t))
        d1 *= share / first_sum
        d2 *= share / second_sum
        d1[group, at] -= share
        d2[word, at] -= share
        back2 = net.word[:DIM] @ d2
        inner = np.ascontiguousarray(((net.group[:DIM] @ d1 + back2) * (1 - h[:DIM] ** 2)).T)
        into = _scatter((inner[:, None, :] * net.place).reshape(-1, DIM), x.ravel(), len(net.into))
        place = np.stack([(inner * y).sum(axis=0) for y in near])
        outer = moved @ d2.T
        for part, grad, seen in zip(net.parts(), (into, place, h @ d1.T, moved[DIM + 1 :] @ back2.T, outer[: DIM + 1], outer[DIM + 1 :]), memory, strict=True):
            seen += grad**2
            part -= rate * grad / (np.sqrt(seen) + np.float32(1e-6))


def _pieces(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to] or "") <= CHUNK_BYTES):
            size += len(texts[to] or "")
            to += 1
        yield at, to
        at = to


def train(docs: DataFrame, words: Vocabulary, text_col: str = "text", id_col: str | None = None, *, rounds: int = 4, rate: float = 0.1, seed: int = 5, replica_words: int = REPLICA_WORDS) -> Network:
    """A network trained on every document of ``docs``, each in one of ``rounds`` rounds.

    What returns to the driver is one network's numbers a round, whatever the size of the corpus; every
    replica sends its copy to their sum.  With ``id_col`` copies of a text are dealt to different replicas.  Null and blank texts have no words and teach nothing.
    """
    spark = docs.sparkSession
    steady_batches(spark)
    flat = Network.start(seed).at_frequencies(words.class_counts).flat()
    replicas = max(1, int(words.class_counts.sum()) // (rounds * replica_words))
    keys = [F.xxhash64(*((id_col,) if id_col else ()), text_col).alias("h"), F.col(text_col).alias("text")]
    dealt = docs.select(*keys).filter(F.col("text").isNotNull()).withColumn("round", F.pmod(F.col("h"), F.lit(rounds))).withColumn("replica", F.pmod(F.xxhash64("h"), F.lit(replicas)).cast("int"))
    known = spark.sparkContext.broadcast(words)
    for k in range(rounds):
        shared = spark.sparkContext.broadcast(flat)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            now, net, memory, seen = -1, None, [], 0

            def out() -> pa.RecordBatch:
                own = net.flat()
                return pa.RecordBatch.from_arrays([pa.array(np.arange(len(own), dtype=np.int32)), pa.array(own.astype(np.float64) * seen), pa.array(np.full(len(own), seen, np.int64))], ["at", "value", "n"])

            held: list[str] = []  # texts of the replica up to a chunk, so that batches do not matter

            def teach() -> int:
                hashes, counts = word_hashes(held)
                held.clear()
                learn(net, known.value.look(hashes)[0], counts, memory, rate)
                return len(hashes)

            size = 0
            for batch in batches:
                for replica, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if replica != now:
                        if held:
                            seen += teach()
                        if seen:
                            yield out()
                        now, net, seen, size = replica, Network.of(shared.value), 0, 0
                        memory = [np.zeros_like(x) for x in net.parts()]
                    if held and size + len(text) > CHUNK_BYTES:
                        seen, size = seen + teach(), 0
                    held.append(text)
                    size += len(text)
            if held:
                seen += teach()
            if seen:
                yield out()

        own = dealt.filter(F.col("round") == k).repartition(replicas, "replica").sortWithinPartitions("replica", "h", "text").select("replica", "text")
        mean = own.mapInArrow(run, "at int, value double, n long").groupBy("at").agg((F.sum("value") / F.sum("n")).alias("value")).toPandas()
        if len(mean):
            flat = np.zeros(len(flat), np.float32)
            flat[mean["at"]] = mean["value"]
        shared.destroy()
    return Network.of(flat)


def score(docs: DataFrame, net: Network, words: Vocabulary, counts: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``log_likelihood`` (the sum over all words) and ``mean_log_likelihood``.

    ``counts`` has the words of the corpus (:func:`count_words`); a word that it lacks counts as a half.  A null or blank text has 0 words, the
    sum 0 and a null mean.  Columns named like the new ones are replaced.
    """
    spark = docs.sparkSession
    steady_batches(spark)
    new = ("n_words", "log_likelihood", "mean_log_likelihood")
    columns = [c for c in docs.columns if c.lower() not in new]
    docs = docs.select(*columns)
    shared = spark.sparkContext.broadcast((net, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = shared.value
        log_class = np.log(np.maximum(known.class_counts, 0.5))
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = batch.column(columns.index(text_col)).to_pylist()
            sums, sizes, rare, many, spans = [np.zeros(0)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
            for a, b in _pieces(texts):
                hashes, counted = word_hashes(texts[a:b])
                classes, often = known.look(hashes)
                context = _context(classes, counted)
                each = [_forward(model, context[k : k + BATCH], classes[k : k + BATCH])[-1] for k in range(0, len(classes), BATCH)]
                inside = np.where(often > 0, np.log(np.maximum(often, 1)), 0.0) - log_class[classes]
                total = np.concatenate([[0.0], np.cumsum(np.concatenate(each) + inside, dtype=np.float64)]) if each else np.zeros(1)
                ends = np.cumsum(counted)
                sums.append(total[ends] - total[ends - counted])
                sizes.append(counted)
                doc = np.repeat(np.arange(b - a), counted)[often == 0]
                order = np.lexsort((hashes[often == 0], doc))
                doc, tail = doc[order], hashes[often == 0][order]
                first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (tail[1:] != tail[:-1]))) if len(doc) else np.zeros(0, np.int64)
                rare.append(tail[first])
                many.append(np.diff(first, append=len(doc)).astype(np.int32))
                spans.append(np.bincount(doc[first], minlength=b - a))
            held = np.concatenate([[0], np.cumsum(np.concatenate(spans))]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(held), pa.array(np.concatenate(x))) for x in (rare, many)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(row + np.arange(len(texts))), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(sums)), *lists], [*columns, "__row", new[0], new[1], "__rare", "__many"])
            row += len(texts)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    part = cut(docs.mapInArrow(run, f"{schema}, __row long, n_words long, log_likelihood double, __rare array<long>, __many array<int>"), "scored")
    rows = part.filter(F.size("__rare") > 0).select("__row", F.explode(F.arrays_zip("__rare", "__many")).alias("w")).select("__row", F.col("w.__rare").alias("hash"), F.col("w.__many").alias("many"))
    rare = counts.filter(F.col("n") < int(words.counts.min())) if len(words.counts) else counts
    found = rows.join(rare, "hash", "left").groupBy("__row").agg(F.sum(F.col("many") * F.log(F.coalesce(F.col("n").cast("double"), F.lit(0.5)))).alias("__more"))
    whole = part.drop("__rare", "__many").join(found, "__row", "left").withColumn("log_likelihood", F.col("log_likelihood") + F.coalesce("__more", F.lit(0.0)))
    return whole.select(*columns, "n_words", "log_likelihood", F.try_divide(F.col("log_likelihood"), F.col("n_words")).alias("mean_log_likelihood"))


def fit(docs: DataFrame, text_col: str = "text", id_col: str | None = None, **options) -> tuple[Network, Vocabulary, DataFrame]:
    """Network, vocabulary and word counts of a corpus, as :func:`score` takes them."""
    counts = count_words(docs, text_col)
    words = vocabulary(counts)
    return train(docs, words, text_col, id_col, **options), words, counts


def score_digest(docs: DataFrame) -> DataFrame:
    """Every document's score under a network trained on all of them."""
    return score(docs.select("doc_id", "text"), *fit(docs, id_col="doc_id")).drop("text")
