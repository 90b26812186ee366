"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Every step is a SQL function: the matches of a pattern and the pieces between them give each
match's place, so no code outside the JVM runs and no row is shuffled.  Patterns are written
without backtracking (possessive, anchored at the start of a run), which finds the same matches
as the plain form in linear time and without deep recursion.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEFORE, AFTER = 40, 20
#: Lists grow by appending within blocks of so many matches, so that a text with many matches is not copied for each of them.
BLOCK = 256


@dataclass(frozen=True)
class Kind:
    """One kind of span.  ``kept`` is SQL for how many characters of a match count, 0 for none, over ``x.m``, the match,
    ``x.a`` and ``x.b``, what stands before and after it up to the next match.

    ``shorter`` is the same where a match may also count up to an earlier group.  A span's score is ``score``, more by 0.3 with a word of ``context`` near it; ``base`` kinds are
    kept whatever their score, others from the threshold on.
    """

    name: str
    pattern: str
    kept: str
    score: float
    context: str
    base: bool = True
    needs: str = ""
    shorter: str = ""


def _if(valid: str) -> str:
    return f"if({valid}, length(x.m), 0)"


_DIGITS = "regexp_replace(x.m, '[^0-9]', '')"


def _luhn(digits: str) -> str:
    value = f"cast(substr({digits}, i, 1) AS int)"
    doubled = f"{value} * 2 - if({value} > 4, 9, 0)"
    return f"aggregate(sequence(1, length({digits})), 0, (t, i) -> t + if((length({digits}) - i) % 2 = 1, {doubled}, {value})) % 10 = 0"


def _mod97(account: str) -> str:
    moved = f"concat(substr({account}, 5), substr({account}, 1, 4))"
    return f"aggregate(split({moved}, ''), 0, (t, c) -> if(c BETWEEN '0' AND '9', (t * 10 + cast(c AS int)) % 97, (t * 100 + ascii(c) - 55) % 97)) = 1"


_ACCOUNT = f"NOT x.b RLIKE '^[A-Za-z0-9]' AND {_mod97("replace(x.m, ' ', '')")}"
#: The longest run of whole groups from the start that is an account number: short words in capitals may follow one.
_GROUPS = "transform(sequence(size(split(x.m, ' ')), 1, -1), k -> array_join(slice(split(x.m, ' '), 1, k), ' '))"
_EARLIER = f"(length(g) < length(x.m) OR NOT x.b RLIKE '^[A-Za-z0-9]') AND length(replace(g, ' ', '')) BETWEEN 15 AND 34 AND {_mod97("replace(g, ' ', '')")}"
_SHORTER = f"if(x.a RLIKE '[A-Za-z0-9]$', 0, length(coalesce(get(filter({_GROUPS}, g -> {_EARLIER}), 0), '')))"

KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "length(x.m)", 0.9, "[Mm]ail|[Cc]ontact", needs="@"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _if("forall(split(x.m, '[.]'), n -> coalesce(try_cast(n AS decimal(38, 0)) <= 255, ltrim('0', n) = ''))"), 0.6, "[Ii][Pp]|[Hh]ost|[Ss]erver", needs="."),
    Kind("card", r"[0-9](?:[ -]?[0-9])++", _if(f"CASE WHEN length({_DIGITS}) BETWEEN 12 AND 19 THEN {_luhn(_DIGITS)} ELSE false END"), 0.7, "[Cc]ard|[Vv]isa|[Cc]redit|[Pp]ay"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", _if(f"length({_DIGITS}) BETWEEN 9 AND 15"), 0.6, "[Pp]hone|[Tt]el|[Cc]all|[Ff]ax", needs="+"),
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", _if(f"NOT x.a RLIKE '[A-Za-z0-9]$' AND {_ACCOUNT}"), 0.9, "[Ii][Bb][Aa][Nn]|[Aa]ccount", base=False, shorter=_SHORTER),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", _if("NOT x.a RLIKE '[A-Za-z0-9-]$' AND NOT x.b RLIKE '^[A-Za-z0-9-]'"), 0.4, "[Ss][Ss][Nn]|[Ss]ocial [Ss]ecurity", base=False, needs="-"),
)


def _blocks(items: str) -> str:
    """SQL: an array that is not empty, in pieces of :data:`BLOCK`."""
    return f"transform(array({items}), e -> transform(sequence(0, (size(e) - 1) DIV {BLOCK}), k -> slice(e, k * {BLOCK} + 1, {BLOCK})))[0]"


def _found(kind: Kind, rank: int, threshold: float, shorter: bool) -> Column:
    """SQL over ``__text``, ``__m_kind`` and ``__p_kind``: the kept spans of one kind."""
    # y.w is the part of the text around a block's matches, from y.at on: a place in a long text is found by counting to it.
    near = f"concat(substr(y.w, greatest(s.start - {BEFORE}, 0) - y.at + 1, least(s.start, {BEFORE})), ' ', substr(y.w, s.end - y.at + 1, {AFTER}))"
    matches = f"transform(__m_{kind.name}, (m, i) -> struct(m, __p_{kind.name}[i] AS a, __p_{kind.name}[i + 1] AS b, length(__p_{kind.name}[i]) AS skip, length(m) AS long))"
    kept = kind.shorter if shorter and kind.shorter else kind.kept
    begins = "aggregate(bs, struct(0 AS pos, cast(array() AS array<int>) AS out), (acc, b) -> struct(acc.pos + aggregate(b, 0, (t, x) -> t + x.skip + x.long) AS pos, concat(acc.out, array(acc.pos)) AS out), acc -> acc.out)"
    placed = f"""
        aggregate(b,
            struct(begin AS pos, cast(array() AS array<struct<start: int, end: int>>) AS out),
            (acc, x) -> struct(
                acc.pos + x.skip + x.long AS pos,
                concat(acc.out, array(struct(acc.pos + x.skip AS start, acc.pos + x.skip + {kept} AS end))) AS out),
            acc -> filter(acc.out, s -> s.end > s.start))"""
    scored = f"transform(y.spans, s -> struct(s.start, {rank} AS rank, s.end, '{kind.name}' AS kind, cast(least(1.0, {kind.score} + if({near} RLIKE '{kind.context}', 0.3, 0.0)) AS double) AS score))"
    around = f"struct(greatest(begin - {BEFORE}, 0) AS at, substr(__text, greatest(begin - {BEFORE}, 0) + 1, aggregate(b, {BEFORE + AFTER}, (t, x) -> t + x.skip + x.long)) AS w, {placed} AS spans)"
    found = f"flatten(transform(array({_blocks(matches)}), bs -> zip_with(bs, {begins}, (b, begin) -> transform(array({around}), y -> {scored})[0]))[0])"
    return F.expr(f"if(size(__m_{kind.name}) = 0, {EMPTY}, {found if kind.base else f'filter({found}, z -> z.score >= {threshold})'})")


EMPTY = "cast(array() AS array<struct<start: int, rank: int, end: int, kind: string, score: double>>)"


def find_pii(docs: DataFrame, text_col: str = "text", *, threshold: float = 0.6, shorter: bool = True) -> DataFrame:
    """``docs`` with ``pii``: an array of (start, rank, end, kind, score) by start, then kind as listed in :data:`KINDS`.

    Offsets count code points from 0, ends are exclusive.  Spans of one kind never overlap; spans of
    different kinds may.  With ``shorter``, a match for an account number that fails as a whole may count up to the end of
    one of its groups, since a word in capitals may follow.  A null or empty text has an empty array.  An input column named ``pii`` is replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.drop("pii").withColumn("__text", text)
    none = F.expr("cast(array() AS array<string>)")
    for k in KINDS:
        every = F.regexp_extract_all("__text", F.lit(k.pattern), F.lit(0))
        out = out.withColumn(f"__m_{k.name}", F.when(F.col("__text").contains(k.needs), every).otherwise(none) if k.needs else every)
    for k in KINDS:
        out = out.withColumn(f"__p_{k.name}", F.when(F.size(f"__m_{k.name}") > 0, F.split("__text", k.pattern, -1)).otherwise(none))
    found = F.sort_array(F.concat(*(_found(k, n, threshold, shorter) for n, k in enumerate(KINDS))))
    return out.withColumn("pii", found).drop("__text", *(f"__{x}_{k.name}" for x in "mp" for k in KINDS))


def redact(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with each span of personal data replaced by its kind, as in ``[EMAIL]``; overlapping spans become one.

    A null text stays null.
    """
    found = find_pii(docs, text_col, **options)
    begins = "aggregate(bs, struct(0 AS pos, cast(array() AS array<int>) AS out), (acc, b) -> struct(greatest(acc.pos, array_max(transform(b, s -> s.end))) AS pos, concat(acc.out, array(acc.pos)) AS out), acc -> acc.out)"
    pieces = """
        aggregate(b,
            struct(begin AS pos, cast(array() AS array<string>) AS out),
            (acc, s) -> struct(
                greatest(acc.pos, s.end) AS pos,
                if(s.start >= acc.pos, concat(acc.out, array(concat(substr(w, acc.pos - begin + 1, s.start - acc.pos), '[', upper(s.kind), ']'))), acc.out) AS out),
            acc -> acc.out)"""
    around = f"substr({text_col}, begin + 1, array_max(transform(b, s -> s.end)) - begin)"
    parts = f"flatten(transform(array({_blocks('pii')}), bs -> zip_with(bs, {begins}, (b, begin) -> transform(array({around}), w -> {pieces})[0]))[0])"
    walked = f"concat(array_join({parts}, ''), substr({text_col}, array_max(transform(pii, s -> s.end)) + 1))"
    return found.withColumn(text_col, F.expr(f"if(size(pii) = 0, {text_col}, {walked})")).drop("pii")


def pii_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns from the spans of :func:`find_pii`, whose matches count as a whole or not at all."""
    found = find_pii(docs.select("doc_id", "text"), shorter=False).select("doc_id", "pii")
    line = "concat_ws(':', s.kind, cast(s.start AS string), cast(s.end AS string))"
    base = sum(k.base for k in KINDS)
    count = [F.expr(f"cast(size(filter(pii, s -> s.kind = '{k.name}')) AS long)").alias(f"n_{k.name}") for k in KINDS if k.base]
    return found.select(
        "doc_id", *count,
        F.expr(f"sha2(array_join(transform(filter(pii, s -> s.rank < {base}), s -> {line}), ','), 256)").alias("base_sha256"),
        F.expr(f"array_join(transform(pii, s -> {line}), ',')").alias("spans"),
    )
