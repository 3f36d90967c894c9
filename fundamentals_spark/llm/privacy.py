"""Personal data in texts: patterns propose spans, checksums confirm them, words nearby adjust the score.

Built from Spark's own functions only. Spark has no function for the places of all matches, but ``split`` and
``regexp_extract_all`` with one pattern give the pieces between the matches and the matches, whose lengths add up to places.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundamentals_spark.llm.common import fresh

#: Code points before a match in which context words count.
CONTEXT = 48
#: A span is kept from this score on.
THRESHOLD = 0.5


@dataclass(frozen=True)
class Kind:
    """A kind of personal data: the pattern, a test on the match ``m``, a test that its text can hold one, the score, context words.

    Patterns use possessive loops, which cost linear time and no stack; look-behinds keep a search from starting again
    inside a run that has failed. Neither changes what matches.
    """

    name: str
    pattern: str
    valid: str
    needs: str
    score: float
    context: str


LUHN = (
    "aggregate(transform(split(reverse(regexp_replace(m, '[^0-9]', '')), ''), (c, i) -> if(i % 2 = 0, cast(c as int), if(cast(c as int) > 4, 2 * cast(c as int) - 9, 2 * cast(c as int)))), 0, (a, x) -> a + x) % 10 = 0"
)
MOD97 = (
    "aggregate(split(concat(substring(regexp_replace(m, ' ', ''), 5), substring(regexp_replace(m, ' ', ''), 1, 4)), ''), 0,"
    " (a, c) -> if(c between '0' and '9', (a * 10 + cast(if(c between '0' and '9', c, '0') as int)) % 97, (a * 100 + ascii(c) - 55) % 97)) = 1"
)
DIGITS = "length(regexp_replace(m, '[^0-9]', ''))"

#: The first four are the base kinds; their score alone passes the threshold, so context can only add.
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "true", "contains({t}, '@')", 0.9, "mail|contact|write"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "forall(split(m, '[.]'), p -> coalesce(try_cast(p as int) <= 255, false))", "contains({t}, '.')", 0.6, r"\bip\b|address|host|server"),
    Kind("card", r"[0-9](?:[ -]?[0-9]){13,}+", f"if({DIGITS} between 14 and 19, {LUHN}, false)", "true", 0.8, "card|visa|credit|carte|karte|tarjeta"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", f"{DIGITS} between 10 and 15", "contains({t}, '+')", 0.6, "phone|call|tel|mobile|fax"),
    Kind("iban", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", f"if(length(regexp_replace(m, ' ', '')) between 15 and 34, {MOD97}, false)", "true", 0.6, "iban|account|bank|konto|compte|cuenta"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "substring(m, 1, 3) not in ('000', '666') and substring(m, 1, 1) <> '9' and substring(m, 5, 2) <> '00' and substring(m, 8, 4) <> '0000'", "contains({t}, '-')", 0.3, r"ssn|social security"),
)
BASE = ("email", "ip", "card", "phone")
#: Matches that one array is grown by.
BLOCK = 128


def _lit(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def kind_spans(text: str, kind: Kind, ordinal: int) -> Column:
    """array<struct<start, ord, end, score>> of a kind's confirmed spans in text column ``text``, places in code points."""
    t = f"`{text}`"
    p = _lit(kind.pattern)
    # places are running sums over blocks of BLOCK pieces, so no long array is copied for every match
    step = f"(a, x) -> if(x.m is null, a, struct(a.at + length(x.b) + length(x.m) as at, concat(a.found, array(struct(a.at + length(x.b) as start, x.m as m, right(x.b, {CONTEXT}) as b))) as found))"
    block = f"aggregate(slice(z, k * {BLOCK} + 1, {BLOCK}), struct(element_at(o, k + 1) as at, cast(array() as array<struct<start: int, m: string, b: string>>) as found), {step}, a -> a.found)"
    blocks = f"sequence(0, cast((size(z) - 1) div {BLOCK} as int))"
    sums = f"aggregate(transform({blocks}, k -> aggregate(slice(z, k * {BLOCK} + 1, {BLOCK}), 0, (a, x) -> a + length(x.b) + coalesce(length(x.m), 0))), array(0), (a, x) -> concat(a, array(element_at(a, -1) + x)))"
    pieces = f"zip_with(split({t}, {p}, -1), regexp_extract_all({t}, {p}, 0), (b, m) -> struct(b, m))"
    placed = f"flatten(flatten(transform(array({pieces}), z -> transform(array({sums}), o -> flatten(transform({blocks}, k -> {block}))))))"
    valid = f"filter({placed}, x -> element_at(transform(array(x.m), m -> {kind.valid}), 1))"
    scored = f"transform({valid}, x -> struct(x.start as start, {ordinal} as ord, x.start + length(x.m) as end, cast({kind.score} as double) + if(rlike(lower(x.b), {_lit(kind.context)}), 0.2D, 0D) as score))"
    kept = f"filter({scored}, x -> x.score >= {THRESHOLD})"
    return F.expr(f"if({kind.needs.format(t=t)} and rlike({t}, {p}), {kept}, cast(array() as array<struct<start: int, ord: int, end: int, score: double>>))")


def with_spans(df: DataFrame, text_col: str = "text", kinds: tuple[Kind, ...] = KINDS, name: str = "spans") -> tuple[DataFrame, str]:
    """``df`` with one column array<struct<kind, start, end, score>> by start, then kind as listed; also the name it got.

    A null text counts as empty and has no spans. Rows are treated alone: repeated rows get equal spans, an empty table an
    empty one. Other columns pass through untouched whatever their names.
    """
    cols = list(df.columns)
    t = fresh(df, "__p_text")
    out = df.withColumn(t, F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    parts = []
    for i, kind in enumerate(kinds):
        c = fresh(out, f"__p_{kind.name}")
        out = out.withColumn(c, kind_spans(t, kind, i))
        parts.append(F.col(c))
    name = fresh(df, name)
    names = "array(" + ", ".join(f"'{k.name}'" for k in kinds) + ")"
    all_spans = fresh(out, "__p_all")
    out = out.withColumn(all_spans, F.sort_array(F.concat(*parts)))
    spans = F.expr(f"transform(`{all_spans}`, s -> struct(element_at({names}, s.ord + 1) as kind, s.start as start, s.end as end, s.score as score))")
    return out.select(*[F.col(f"`{c}`") for c in cols], spans.alias(name)), name


def redacted(text: str, spans: str) -> Column:
    """The text with every span replaced by its kind in angle brackets; a span that begins inside an earlier one joins it."""
    t = f"coalesce(`{text}`, '')"
    step = "if(s.start >= a.at, struct(s.end as at, concat(a.out, substring(w, a.at - f + 1, s.start - a.at), '<', upper(s.kind), '>') as out), struct(greatest(a.at, s.end) as at, a.out as out))"
    blocks = f"sequence(0, cast((size(`{spans}`) - 1) div {BLOCK} as int))"
    ends = f"aggregate(transform({blocks}, k -> array_max(transform(slice(`{spans}`, k * {BLOCK} + 1, {BLOCK}), s -> s.end))), array(0), (a, x) -> concat(a, array(greatest(element_at(a, -1), x))))"
    part = f"aggregate(slice(`{spans}`, k * {BLOCK} + 1, {BLOCK}), struct(f as at, '' as out), (a, s) -> {step}, a -> a.out)"
    # a block of spans looks at its own stretch of the text only: from where the spans before it end (f) to where its own end
    own = f"element_at(transform(array(element_at(o, k + 1)), f -> element_at(transform(array(substring({t}, f + 1, element_at(o, k + 2) - f)), w -> {part}), 1)), 1)"
    whole = f"element_at(transform(array({ends}), o -> concat(array_join(transform({blocks}, k -> {own}), ''), substring({t}, element_at(o, -1) + 1))), 1)"
    return F.expr(f"if(size(`{spans}`) = 0, `{text}`, {whole})")


def find_personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """id_col and ``spans`` for every row; see ``with_spans`` for nulls, ties, repeated rows and empty tables."""
    out, spans = with_spans(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", kinds)
    return out.select(F.col("doc_id").alias(id_col), F.col(spans).alias("spans"))
