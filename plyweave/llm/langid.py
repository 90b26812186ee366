"""Language identification: multinomial naive Bayes over hashed character n-grams, in numpy.

Counts of all training documents are summed in Spark; the log-probability matrix (languages by
buckets, a size that the parameters fix) is broadcast; whole texts are scored in sparse batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import steady_batches

BUCKETS, ORDERS = 1 << 14, (1, 2, 3)
CHUNK_CHARS = 150_000


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # (buckets, languages): log probabilities
    prior: np.ndarray
    orders: tuple[int, ...]


def _pieces(texts: list[str], reach: int) -> Iterator[tuple[np.ndarray, list[str], np.ndarray]]:
    """Batches of about :data:`CHUNK_CHARS` characters: the texts' numbers, their lower-cased pieces between blanks, and tails.

    A longer text comes in pieces that overlap by ``reach`` characters, its tail, in which no n-gram of a piece may begin.
    """
    owner: list[int] = []
    found: list[str] = []
    tails: list[int] = []
    chars = 0
    for k, text in enumerate(texts):
        low = f" {text.lower()} "
        for at in range(0, len(low), CHUNK_CHARS):
            piece = low[at : at + CHUNK_CHARS + reach]
            if found and chars + len(piece) > CHUNK_CHARS:
                yield np.array(owner), found, np.array(tails)
                owner, found, tails, chars = [], [], [], 0
            owner.append(k)
            found.append(piece)
            tails.append(max(len(piece) - CHUNK_CHARS, 0) if at + CHUNK_CHARS < len(low) else 0)
            chars += len(piece)
    if found:
        yield np.array(owner), found, np.array(tails)


def features(texts: list[str], buckets: int, orders: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram of the lower-cased texts, and the text that it is in; texts stand between blanks."""
    return _hashed([f" {x.lower()} " for x in texts], np.zeros(len(texts), np.int64), buckets, orders)


def _hashed(pieces: list[str], tails: np.ndarray, buckets: int, orders: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram of the pieces that does not begin in a piece's tail, and the piece that it is in."""
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    cp = np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32)
    doc = np.repeat(np.arange(len(pieces)), size)
    begins = np.ones(len(cp), bool)
    for k in np.flatnonzero(tails).tolist():
        end = int(size[: k + 1].sum())
        begins[end - int(tails[k]) : end] = False
    found, owner = [], []
    mixed = np.zeros(len(cp), np.uint32)
    for n in range(1, max(orders) + 1):
        mixed = mixed[: len(cp) - n + 1] * np.uint32(0x01000193) ^ cp[n - 1 :]
        if n in orders:
            inside = (doc[: len(mixed)] == doc[n - 1 :]) & begins[: len(mixed)]
            h = (mixed + np.uint32(n)) * np.uint32(0x9E3779B1)
            found.append((h[inside] >> np.uint32(32 - (buckets.bit_length() - 1))).astype(np.int64))
            owner.append(doc[: len(mixed)][inside])
    return np.concatenate(found), np.concatenate(owner)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", *, buckets: int = BUCKETS, orders: tuple[int, ...] = ORDERS, alpha: float = 0.5) -> Model:
    """A model of all rows with a text that has a letter and a label; ``buckets`` must be a power of two.

    The driver gets one count for each language and bucket.  No such rows: a model without languages.
    """
    steady_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                own = [t for t, x in zip(texts, langs, strict=True) if x == lang and has_letter(t)]
                total = sums.setdefault(lang, np.zeros(buckets + 1, np.int64))
                total[buckets] += len(own)
                for _, pieces, tails in _pieces(own, max(orders) - 1):
                    total[:buckets] += np.bincount(_hashed(pieces, tails, buckets, orders)[0], minlength=buckets)
        for lang, total in sums.items():
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(total[used])], ["lang", "bucket", "n"])

    labelled = docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = labelled.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts.lang[counts.bucket == buckets].unique())
    dense = np.zeros((buckets + 1, len(languages)))
    counts = counts[counts.lang.isin(languages)]
    dense[counts.bucket, [languages.index(x) for x in counts.lang]] = counts.n
    seen = dense[:buckets] + alpha
    documents = dense[buckets]
    return Model(languages, np.log(seen / seen.sum(axis=0)).astype(np.float32), np.log(documents / max(documents.sum(), 1)), orders)


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and its posterior probability for each text; ``und`` and 0 without a letter or without languages."""
    names, scores = ["und"] * len(texts), np.zeros(len(texts))
    where = [k for k, x in enumerate(texts) if has_letter(x)] if model.languages else []
    known = [texts[k] for k in where]
    total = np.zeros((len(known), len(model.languages)))
    for which, pieces, tails in _pieces(known, max(model.orders) - 1):
        found, owner = _hashed(pieces, tails, len(model.weights), model.orders)
        np.add.at(total, which, np.stack([np.bincount(owner, model.weights[found, k], len(pieces)) for k in range(len(model.languages))], axis=1))
    if known:
        total += model.prior
        best = total.argmax(axis=1)
        share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        for k, x, s in zip(where, best.tolist(), share.tolist(), strict=True):
            names[k], scores[k] = model.languages[x], s
    return names, scores


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1); equal posteriors go to the language that sorts first.

    Only the text is read.  Input columns named like the new ones are replaced.
    """
    spark = docs.sparkSession
    steady_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # buckets * languages numbers
    columns = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    docs = docs.select(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = predict(shared.value, batch.column(columns.index(text_col)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores)], [*columns, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, lang_pred string, score double")


def held_out(id_col: str = "doc_id"):
    """Documents that no query learns from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def langid_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    model = train(docs.filter(~held_out()))
    marked = docs.select("doc_id", held_out().alias("held_out"), "text")
    texts = identify(marked, model)
    return texts.select("doc_id", "held_out", "lang_pred", "score")
