"""Set expressions over the systems of an alignment: ``label: { A & B } \\ { C | D }``.

All expressions are evaluated in one pass: a column of the alignment is a bit mask of the systems present,
and an expression two masks that it is compared with.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SetExpression:
    label: str
    lhs: tuple[str, ...]
    rhs: tuple[str, ...]


def parse_block(text: str, separator: str) -> tuple[str, ...]:
    """Names in ``{ A & B }``; blanks are ignored, and so is a name that no separator or brace ends."""
    out, name = [], ""
    for c in text:
        if c in (separator, "}"):
            if name:
                out.append(name)
            name = ""
        elif c != "{" and not c.isspace():
            name += c
    return tuple(out)


def parse(line: str) -> SetExpression:
    """The label ends at the first colon; without a backslash nothing is taken away."""
    label, _, body = line.partition(":")
    left, _, right = body.partition("\\")
    return SetExpression(label.strip(" \t"), parse_block(left, "&"), parse_block(right or "{}", "|"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(label, lhs, rhs) from a text file of expressions, one a line."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    label, body = F.substring_index("value", ":", 1), F.expr("substring(value, instr(value, ':') + 1)")
    left = F.substring_index(body, "\\", 1)
    right = F.when(body.contains("\\"), F.regexp_replace(body, r"^[^\\]*\\", "")).otherwise("{}")
    names = lambda block, sep: F.filter(F.split(F.regexp_replace(F.regexp_replace(block, r"[{\s]", ""), r"\}.*$", ""), sep), lambda x: x != "")
    return lines.select(F.regexp_replace(label, r"^[ \t]+|[ \t]+$", "").alias("label"), names(left, "&").alias("lhs"), names(right, r"\|").alias("rhs"))


def holds(systems: Column, lhs: Column, rhs: Column) -> Column:
    """All of ``lhs`` and none of ``rhs`` are among ``systems``; an empty ``lhs`` never holds."""
    return (F.size(lhs) > 0) & (F.size(F.array_except(lhs, systems)) == 0) & ~F.arrays_overlap(rhs, systems)


def mask(systems: list[str], names: Column) -> Column:
    """Bits of ``names`` by their place in ``systems``; for at most 63 systems."""
    if len(systems) > 63:
        raise ValueError("masks hold at most 63 systems; use holds()")
    bits = F.create_map(*(x for k, s in enumerate(systems) for x in (F.lit(s), F.lit(1 << k))))
    return F.aggregate(names, F.lit(0).cast("long"), lambda m, s: m.bitwiseOR(F.coalesce(bits[s], F.lit(0).cast("long"))))


def evaluate(columns: DataFrame, expressions: list[SetExpression], key_cols: list[str], systems_col: str = "systems") -> DataFrame:
    """(label, key_cols): the columns of the alignment in which each expression holds.

    An expression that needs a system which is nowhere holds nowhere; one that excludes such a system is not affected.
    """
    systems = sorted({s for e in expressions for s in (*e.lhs, *e.rhs)})
    code = lambda names: sum(1 << systems.index(s) for s in dict.fromkeys(names))
    tests = [(e.label, code(e.lhs), code(e.rhs)) for e in expressions if e.lhs]
    masked = columns.select(*key_cols, mask(systems, F.col(systems_col)).alias("__m"))
    hits = F.filter(
        F.array(*(F.struct(F.lit(label).alias("label"), F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for label, a, b in tests)),
        lambda t: (F.col("__m").bitwiseAND(t.a) == t.a) & (F.col("__m").bitwiseAND(t.b) == 0),
    )
    return masked.select(F.explode(hits).alias("t"), *key_cols).select("t.label", *key_cols)


def truth_table(features: list[str], systems: list[str]) -> dict[str, tuple[bool, ...]]:
    """Which features each system has: system k has the bits of k."""
    return dict(zip(systems, product((False, True), repeat=len(features)), strict=True))


def of_label(label: str, features: list[str], table: dict[str, tuple[bool, ...]]) -> SetExpression:
    """The expression of a conjunction of literals such as ``a & ~b``: systems that satisfy it, without the others."""
    wanted = [(features.index(x.strip().lstrip("~")), not x.strip().startswith("~")) for x in label.split("&")] if label != "True" else []
    inside = [s for s, v in table.items() if all(v[k] == w for k, w in wanted)]
    return SetExpression(label, tuple(inside), tuple(s for s in table if s not in inside))
