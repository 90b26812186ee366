"""Scalar functions on feature expressions and labels, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AND, OR, NOT = " ∧ ", " ∨ ", "¬"


def replace_all(text: Column, old: str, new: str) -> Column:
    """All occurrences from left to right; an empty ``old`` changes nothing."""
    return F.replace(text, F.lit(old), F.lit(new)) if old else text


def unicode_operators(expr: Column) -> Column:
    """``~``, ``&`` and ``|`` as the logical signs that labels use."""
    return F.replace(F.replace(F.replace(expr, F.lit(" & "), F.lit(AND)), F.lit(" | "), F.lit(OR)), F.lit("~"), F.lit(NOT))


def and_label(expr: Column) -> Column:
    """A conjunction as a name: negations as ``not_``, parts sorted bytewise and joined by ``_and_``."""
    return F.array_join(F.array_sort(F.transform(F.split(expr, AND), lambda x: F.replace(x, F.lit(NOT), F.lit("not_")))), "_and_")


def or_parts(label: Column) -> Column:
    return F.split(label, OR)


def labels(expr: Column, mode: str = "compat") -> Column:
    """The features that an expression stands for.

    ``compat``: conjunctions are sorted before the disjunction is split, which mixes their parts.  ``strict``: the
    other way round.
    """
    if mode == "compat":
        return or_parts(and_label(expr))
    if mode != "strict":
        raise ValueError("mode is compat or strict")
    return F.transform(or_parts(expr), and_label)


def file_name(label: Column) -> Column:
    return F.replace(label, F.lit(" "), F.lit("_"))


def shown(label: Column) -> Column:
    return F.replace(label, F.lit("_"), F.lit(" "))


def escaped(text: Column) -> Column:
    """``<`` and ``>`` for HTML."""
    return F.replace(F.replace(text, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def trimmed(text: Column) -> Column:
    """Without blanks and tabs at the ends."""
    return F.regexp_replace(text, r"\A[ \t]+|[ \t]+\z", "")


def language_of(path: Column) -> Column:
    """``cpp`` or ``java`` by the suffix of a path; null for others."""
    suffix = F.regexp_extract(path, r"\.([^.]*)$", 1)
    return F.when(suffix.isin("cpp", "hpp"), "cpp").when(suffix == "java", "java")
