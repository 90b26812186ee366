"""Mixing sources to target weights by iterative proportional fitting.

Token weights of the cells (source, language, topic) are raked until every margin meets its targets;
documents are then sampled by the calibrated weight of their cell.  The cells are a group-by; raking runs
on the driver up to a stated number of cells, and as group-bys and joins beyond it, with the same result.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import cut

#: Up to so many cells the driver rakes them itself.
DRIVER_CELLS = 100_000
UNKNOWN = "(none)"
#: The largest factor of a cell; one that its tokens bound could grow on.
MOST = 1e12


def tempered(tokens: Mapping[str, float], power: float) -> dict[str, float]:
    """Target shares: each value's share of tokens to a power; below 1 it lifts the rare ones."""
    raised = {k: v**power for k, v in tokens.items() if v > 0}
    total = sum(raised.values())
    return {k: v / total for k, v in raised.items()}


def wanted_tokens(have: np.ndarray, shares: np.ndarray, total: float, bounded: bool) -> np.ndarray:
    """Tokens that each value of a margin should have, ``total`` in all and in proportion to ``shares``.

    With ``bounded`` no value gets more than it has: what it lacks goes to the others, in proportion to their shares.
    """
    shares = np.where(have > 0, shares, 0.0)
    if not shares.sum():
        return np.zeros(len(have))
    want = total * shares / shares.sum()
    if not bounded:
        return want
    full = np.zeros(len(have), bool)
    while (over := ~full & (want > have)).any():
        full |= over
        rest = shares[~full].sum()
        spare = max(total - have[full].sum(), 0.0)
        want = np.where(full, have, spare * shares / rest if rest else 0.0)
    return want


def rake(cells: pd.DataFrame, margins: list[str], wanted: list[dict[str, float]], rounds: int, tolerance: float, bounded: bool) -> np.ndarray:
    """Tokens of each cell after fitting its margins to ``wanted`` tokens; ``cells`` has the margins and ``tokens``.

    A cell has its tokens times a factor, and with ``bounded`` not more than its tokens; each step multiplies the factors of
    a margin's value by what it should have over what it has.
    """
    tokens = cells.tokens.to_numpy(float)
    factor = np.ones(len(tokens))
    codes = [pd.factorize(cells[m], sort=True) for m in margins]
    targets = [np.array([w.get(v, 0.0) for v in values]) for w, (_, values) in zip(wanted, codes, strict=True)]
    total = max(max((t.sum() for t in targets), default=0), 1)
    fitted = tokens * np.minimum(factor, 1) if bounded else tokens * factor
    for _ in range(rounds):
        worst = 0.0
        for (code, values), want in zip(codes, targets, strict=True):
            have = np.bincount(code, fitted, len(values))
            worst = max(worst, np.abs(have - want).max(initial=0) / total)
            factor = np.minimum(factor * np.divide(want, have, out=np.zeros_like(want), where=have > 0)[code], MOST)
            fitted = tokens * np.minimum(factor, 1) if bounded else tokens * factor
        if worst <= tolerance:
            return fitted
    warnings.warn(f"margins are off by {worst:.2g} of all tokens after {rounds} rounds", stacklevel=3)
    return fitted


def _wanted_frame(cells: DataFrame, margin: str, shares: dict[str, float] | None, power: float, total: float, bounded: bool) -> DataFrame:
    """(margin, want): :func:`wanted_tokens` for values that stay in Spark."""
    values = cells.groupBy(margin).agg(F.sum("tokens").cast("double").alias("have"))
    if shares is None:
        values = values.withColumn("share", F.when(F.col("have") > 0, F.pow("have", F.lit(power))).otherwise(0.0))
    else:
        given = cells.sparkSession.createDataFrame(list(shares.items()) or [(None, 0.0)], f"{margin} string, share double")
        values = values.join(given, margin, "left").withColumn("share", F.when(F.col("have") > 0, F.coalesce("share", F.lit(0.0))).otherwise(0.0))
    values = cut(values, "margin")
    level = total / (values.agg(F.sum("share")).first()[0] or 1.0)
    for _ in range(60 if bounded else 0):
        full, rest = values.agg(F.sum(F.when(F.col("share") * level > F.col("have"), F.col("have")).otherwise(0.0)), F.sum(F.when(F.col("share") * level > F.col("have"), 0.0).otherwise(F.col("share")))).first()
        new = max(total - (full or 0.0), 0.0) / rest if rest else level
        if new <= level * (1 + 1e-12):
            break
        level = new
    want = F.col("share") * F.lit(level)
    return values.select(margin, (F.least(want, F.col("have")) if bounded else want).alias("want"))


def _rake_frame(cells: DataFrame, margins: list[str], shares: list[dict[str, float] | None], power: float, part: float | None, rounds: int, tolerance: float) -> DataFrame:
    """The same as group-bys over the cells, whose lineage is cut each round."""
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0) * (1.0 if part is None else part)
    now = cells.withColumn("factor", F.lit(1.0))
    for k, m in enumerate(margins):
        now = now.join(_wanted_frame(cells, m, shares[k], power, total, part is not None).withColumnRenamed("want", f"__want{k}"), m)
    fitted = F.col("tokens") * (F.col("factor") if part is None else F.least(F.col("factor"), F.lit(1.0)))
    worst = 0.0
    for _ in range(rounds):
        for k, m in enumerate(margins):
            now = now.withColumn("__have", F.sum(fitted).over(W.partitionBy(m))).withColumn(f"__off{k}", F.abs(F.col("__have") - F.col(f"__want{k}")))
            now = now.withColumn("factor", F.when(F.col("__have") > 0, F.least(F.lit(MOST), F.col("factor") * F.col(f"__want{k}") / F.col("__have"))).otherwise(0.0)).drop("__have")
        now = cut(now, "raked")
        worst = max(now.agg(*(F.max(f"__off{k}") for k in range(len(margins)))).first()) / max(total, 1)
        now = now.drop(*(f"__off{k}" for k in range(len(margins))))
        if worst <= tolerance:
            break
    else:
        warnings.warn(f"margins are off by {worst:.2g} of all tokens after {rounds} rounds", stacklevel=3)
    return now.select(*margins, "tokens", fitted.alias("fitted"))


def uniform(id_col: str | Column, seed: int) -> Column:
    """A number in [0, 1) that an id and a seed decide."""
    return F.shiftrightunsigned(F.xxhash64(id_col, F.lit(seed)), 11) / F.lit(float(1 << 53))


def mix(
    docs: DataFrame, tokens_col: str, margins: list[str], id_col: str = "doc_id", *, power: float = 0.7, keep: float | None = None, targets: list[dict[str, float]] | None = None, rounds: int = 2000, tolerance: float = 1e-7, seed: int = 17, driver_cells: int = DRIVER_CELLS,
) -> DataFrame:
    """``docs`` with ``weight``, ``probability`` and ``kept``.

    ``targets``: for each margin the share of tokens that each value should have; values without one get none.
    Without ``targets`` they are the present shares to the ``power``.  ``weight`` is a cell's fitted tokens over
    its own.  Without ``keep``, ``probability`` is that over the largest weight, so expected tokens are in the target proportions
    and no document is repeated.  With ``keep``, the share of tokens to keep, a cell can give no more than it has: targets of values
    that lack tokens are lowered to what they have and the others' raised in proportion, the fit is bounded by the cells' tokens, and
    expected tokens meet these targets.  Where margins contradict each other under the bound, a warning says how far they are off;
    :func:`shares` tells what a mixture has.  ``kept``: a number that the id and ``seed`` decide lies below the probability;
    repeated ids are kept or dropped together.

    Nulls in a margin are a value of their own, ``(none)``; a null or negative token count is 0.  A cell without
    tokens has weight and probability 1 and takes no part in the fit.  Columns named like the new ones are replaced.
    """
    columns = [c for c in docs.columns if c.lower() not in ("weight", "probability", "kept")]
    names = [f"__m{k}" for k in range(len(margins))]
    keyed = docs.select(*columns, *(F.coalesce(F.col(m).cast("string"), F.lit(UNKNOWN)).alias(n) for m, n in zip(margins, names, strict=True)))
    count = F.greatest(F.coalesce(F.col(tokens_col).cast("long"), F.lit(0)), F.lit(0))
    cells = cut(keyed.groupBy(*names).agg(F.sum(count).alias("tokens")), "cells")
    shares = targets or [None] * len(names)
    if cells.count() <= driver_cells:
        local = cells.orderBy(*names).toPandas()
        total, wanted = float(local.tokens.sum()) * (1.0 if keep is None else keep), []
        for n, given in zip(names, shares, strict=True):
            have = local.groupby(n).tokens.sum()
            share = tempered(have.to_dict(), power) if given is None else given
            wanted.append(dict(zip(have.index, wanted_tokens(have.to_numpy(float), np.array([share.get(v, 0.0) for v in have.index]), total, keep is not None), strict=True)))
        local["fitted"] = rake(local, names, wanted, rounds, tolerance, keep is not None)
        fitted = docs.sparkSession.createDataFrame([tuple(r) for r in local.itertuples(index=False)], ", ".join(f"{n} string" for n in names) + ", tokens long, fitted double")
    else:
        fitted = _rake_frame(cells, names, shares, power, keep, rounds, tolerance)
    weight = F.when(F.col("tokens") > 0, F.col("fitted") / F.col("tokens") / F.lit(1.0 if keep is None else keep)).otherwise(1.0)
    weighed = cut(fitted.withColumn("weight", weight), "weights")
    largest = weighed.filter("tokens > 0").agg(F.max("weight")).first()[0] or 1.0
    probability = F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.col("weight") * F.lit(1 / largest if keep is None else keep))).otherwise(1.0)
    weighed = weighed.select(*names, "weight", probability.alias("probability"))
    if weighed.count() <= driver_cells:
        weighed = F.broadcast(weighed)
    out = keyed.join(weighed, names)
    return out.select(*columns, "weight", "probability", (uniform(id_col, seed) < F.col("probability")).alias("kept"))


def shares(mixed: DataFrame, tokens_col: str, margin: str) -> DataFrame:
    """(value, present, expected, sampled): a margin's shares of tokens in all documents, in expectation and in what was kept."""
    count = F.greatest(F.coalesce(F.col(tokens_col).cast("long"), F.lit(0)), F.lit(0))
    rows = mixed.select(F.coalesce(F.col(margin).cast("string"), F.lit(UNKNOWN)).alias("value"), count.alias("t"), "probability", "kept")
    sums = cut(rows.groupBy("value").agg(F.sum("t").alias("a"), F.sum(F.col("t") * F.col("probability")).alias("b"), F.sum(F.when(F.col("kept"), F.col("t")).otherwise(0)).alias("c")), "shares")
    totals = sums.agg(F.sum("a"), F.sum("b"), F.sum("c")).first()
    return sums.select("value", *(F.try_divide(F.col(x), F.lit(float(t or 0))).alias(n) for x, t, n in zip("abc", totals, ("present", "expected", "sampled"), strict=True)))


def words(text: str) -> Column:
    """Words of a whole text, split at white space; null: 0."""
    blanks = F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+"))
    return F.coalesce(blanks, F.lit(0)).cast("long")


def topic(text: str) -> Column:
    """A coarse kind of text, from its whole length: table, markup, shout, code or prose; null texts have none."""
    t = F.col(text)
    size = F.length(t)
    many = lambda chars: F.regexp_count(t, F.lit(f"[{chars}]"))
    return (
        F.when(size == 0, "empty").when(many("|") * 50 > size, "table").when(many("#$%&*~^") * 25 > size, "markup").when(many("!") * 25 > size, "shout")
        .when(many("={}();<>") * 50 > size, "code").when(size.isNotNull(), "prose")
    )


def mix_digest(docs: DataFrame) -> DataFrame:
    """All documents with their raked weight and the decision; margins are source, language and topic, tokens are words; half the tokens stay."""
    narrow = docs.select("doc_id", "source", "lang", topic("text").alias("topic"), words("text").alias("tokens"))
    return mix(cut(narrow, "mix-digest"), "tokens", ["source", "lang", "topic"], keep=0.5)
