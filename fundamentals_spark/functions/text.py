"""Column functions for texts, numbers, periods, units and account codes; null in, null out."""

from __future__ import annotations

from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented Latin letters and their plain forms.
_ACCENTED = "ÁÀÂÃÄÅáàâãäåÉÈÊËéèêëÍÌÎÏíìîïÓÒÔÕÖóòôõöÚÙÛÜúùûüÇçÑñÝýÿ"
_PLAIN = "AAAAAAaaaaaaEEEEeeeeIIIIiiiiOOOOOoooooUUUUuuuuCcNnYyy"


def strip_accents(c: Column) -> Column:
    return F.translate(c, _ACCENTED, _PLAIN)


def norm_text(c: Column, mode: str = "fold") -> Column:
    """``fold``: no accents, lower case, single spaces; ``upper``: no accents, upper case, trimmed; ``key``: upper case with
    everything but letters and digits as one space and ``S A`` as ``SA``; ``token``: lower case with the rest as one space."""
    plain = strip_accents(c)
    if mode == "upper":
        return F.trim(F.upper(plain))
    if mode == "key":
        spaced = F.trim(F.regexp_replace(F.upper(plain), "[^A-Z0-9]+", " "))
        return F.regexp_replace(spaced, r"\bS A\b", "SA")
    if mode == "token":
        return F.trim(F.regexp_replace(F.lower(plain), "[^a-z0-9]+", " "))
    return F.trim(F.regexp_replace(F.lower(plain), r"[ \t\n\r\f]+", " "))


def parse_number(c: Column, mode: str = "statement") -> Column:
    """Locale numbers as decimal(38,6). Parentheses and a leading minus change the sign; blank, ``-``, ``n/d``, anything with
    ``%`` and a minus elsewhere is null. With both separators the last one is the decimal one. A single ``1.234`` is 1.234
    in ``statement`` mode and 1234 in ``operational`` mode; a comma alone is the decimal separator."""
    t = F.regexp_replace(F.lower(F.trim(c)), r"r\$|us\$|[  ]", "")
    parens = t.rlike(r"^\(.*\)$")
    inner = F.when(parens, F.regexp_extract(t, r"^\((.*)\)$", 1)).otherwise(t)
    minus = inner.startswith("-")
    body = F.regexp_replace(inner, r"^[+-]", "")
    comma, dot = F.locate(",", body) > 0, F.locate(".", body) > 0
    thousands = body.rlike(r"^[0-9]{1,3}(\.[0-9]{3})+$")
    grouped = thousands if mode == "operational" else thousands & body.rlike(r"\..*\.")
    plain = (
        F.when(comma & dot & (F.length(F.substring_index(body, ",", -1)) < F.length(F.substring_index(body, ".", -1))), F.replace(F.regexp_replace(body, r"\.", ""), F.lit(","), F.lit(".")))
        .when(comma & dot, F.regexp_replace(body, ",", ""))
        .when(comma, F.replace(body, F.lit(","), F.lit(".")))
        .when(grouped, F.regexp_replace(body, r"\.", ""))
        .otherwise(body)
    )
    ok = plain.rlike(r"^[0-9]+(\.[0-9]+)?$|^\.[0-9]+$")
    value = F.when(ok, plain).try_cast("decimal(38,6)")
    return F.when(parens != minus, -value).otherwise(value)


def norm_cvm_code(c: Column) -> Column:
    """Trimmed, without a trailing ``.0``, left-padded with zeros to six; longer codes stay whole."""
    t = F.regexp_replace(F.trim(c.cast("string")), r"\.0$", "")
    return F.when(F.length(t) < 6, F.lpad(t, 6, "0")).otherwise(t)


def norm_cnpj(c: Column) -> Column:
    """Digits only, left-padded with zeros to fourteen; no digits give null."""
    t = F.regexp_replace(c.cast("string"), "[^0-9]", "")
    return F.when(t == "", None).when(F.length(t) < 14, F.lpad(t, 14, "0")).otherwise(t)


def quarter_label(d: Column) -> Column:
    """``1T26`` for a date."""
    return F.concat(F.quarter(d).cast("string"), F.lit("T"), F.lpad((F.year(d) % 100).cast("string"), 2, "0"))


def parse_period(c: Column, as_of_year: int) -> Column:
    """struct<label, kind, year, quarter> of a period label: ``1T26``, ``1Q2026``, ``6M26``, ``FY25``, ``2025``, ``LTM 1T26``.

    Years after ``as_of_year`` and anything else give null; two-digit years are of this century.
    """
    t = F.regexp_replace(F.upper(F.trim(c)), r"\s+", "")

    def part(pattern: str, group: int) -> Column:
        return F.nullif(F.regexp_extract(t, pattern, group), F.lit("")).cast("int")

    quarter, months, annual = r"^(LTM)?([1-4])[TQ](20)?([0-9]{2})$", r"^(3|6|9|12)M(20)?([0-9]{2})$", r"^(FY)?(20)?([0-9]{2})$"
    is_annual = t.rlike(annual) & (t.rlike("^FY") | t.rlike("^20[0-9]{2}$"))
    year = 2000 + F.coalesce(part(quarter, 4), part(months, 3), F.when(is_annual, part(annual, 3)))
    q = F.coalesce(part(quarter, 2), part(months, 1) / 3).cast("int")
    kind = F.when(t.rlike(quarter), F.when(t.startswith("LTM"), "ltm").otherwise("quarter")).when(t.rlike(months), "ytd").when(is_annual, "annual")
    yy = F.lpad((year % 100).cast("string"), 2, "0")
    label = F.when(kind == "quarter", F.concat(q.cast("string"), F.lit("T"), yy)).when(kind == "ltm", F.concat(F.lit("LTM "), q.cast("string"), F.lit("T"), yy)).when(kind == "ytd", F.concat((q * 3).cast("string"), F.lit("M"), yy)).otherwise(F.concat(F.lit("FY"), year.cast("string")))
    return F.when(kind.isNotNull() & (year <= as_of_year), F.struct(label.alias("label"), kind.alias("kind"), year.cast("int").alias("year"), q.alias("quarter")))


def parse_period_text(c: Column) -> Column:
    """struct<reference, start, end> of the dates in a free text: three or more ISO dates are reference, start and end; two
    are start and end, one is both; the end is then the reference. Without ISO dates the first and last dd/mm/yyyy date are start
    and end. No date, or an end that is no day of the calendar, gives null."""
    iso = F.transform(F.regexp_extract_all(c, F.lit(r"(20[0-9]{2}-[0-9]{2}-[0-9]{2})"), F.lit(1)), lambda x: F.try_to_date(x, "yyyy-MM-dd"))
    local = F.transform(F.regexp_extract_all(c, F.lit(r"([0-9]{2}/[0-9]{2}/20[0-9]{2})"), F.lit(1)), lambda x: F.try_to_date(x, "dd/MM/yyyy"))
    dates = F.when(F.size(iso) > 0, iso).otherwise(local)
    at = lambda i: F.try_element_at(dates, F.lit(i))
    three = F.size(iso) >= 3
    end = F.when(three, at(3)).otherwise(at(-1))
    made = F.struct(F.when(three, at(1)).otherwise(end).alias("reference"), F.when(three, at(2)).otherwise(at(1)).alias("start"), end.alias("end"))
    return F.when(end.isNotNull(), made)


def norm_unit(value: Column, unit: Column, family: str = "construction") -> Column:
    """struct<value, unit, multiplier, raw_value, raw_unit, converted>.

    ``construction`` money comes in millions (billions x 1000, thousands / 1000, plain / 1e6), ``retail`` money in units;
    areas in thousands of square metres and patient-days in thousands are multiplied by 1000.
    """
    u = norm_text(unit, "fold")
    billions, millions, thousands = u.rlike(r"\bbilh|\bbi\b"), u.rlike(r"\bmilh|\bmm\b|\bmi\b"), u.rlike(r"\bmil\b|\(000s\)|\b000s\b")
    money = u.rlike(r"r\$|\bbrl\b|reais")
    area = u.rlike(r"\bm2\b|m²")
    power = F.when(billions, 1e9).when(millions, 1e6).when(thousands, 1e3).otherwise(1.0)
    base = 1e6 if family == "construction" else 1.0
    factor = F.when(money, power / base).when(area | u.rlike("pacientes?-dia|patient"), F.when(thousands, 1e3).otherwise(1.0)).otherwise(1.0)
    name = F.when(money, F.lit("BRL million" if family == "construction" else "BRL")).when(area, "m2").otherwise(u)
    return F.struct((value * factor).alias("value"), name.alias("unit"), factor.alias("multiplier"), value.alias("raw_value"), unit.alias("raw_unit"), (factor != 1.0).alias("converted"))


def account_sort_key(c: Column, width: int = 6) -> Column:
    """Sorts hierarchical codes by their segments, numbers as numbers."""
    return F.array_join(F.transform(F.split(c, "[.-]"), lambda s: F.lpad(s, width, "0")), ".")


def account_depth(c: Column) -> Column:
    return F.size(F.split(c, "[.]")) - 1


def account_parent(c: Column, longest: int = 7) -> Column:
    """Nearest ancestor of at most ``longest`` characters; null for a root."""
    n = F.size(F.split(c, "[.]"))
    found = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda k: F.array_join(F.slice(F.split(c, "[.]"), F.lit(1), n - k), ".")), lambda p: (p != "") & (F.length(p) <= longest))
    return F.when(n > 1, F.try_element_at(found, F.lit(1)))


def ancestors(c: Column) -> Column:
    """All proper ancestors of a code: ``1.01.02`` has ``1`` and ``1.01``."""
    parts = F.split(c, "[.]")
    n = F.size(parts)
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))).otherwise(F.array().cast("array<string>"))


def balance_side(c: Column) -> Column:
    first = F.substring_index(c, ".", 1)
    return F.when(first == "1", "assets").when(first == "2", "liabilities")


# Terms of the company's own part and of the whole of a project.
COMPANY_SHARE = ("participacao da companhia", "company share", "% companhia", "%avll", "% cal", "%ez", "% even", "%cbr", "ex permuta")
ONE_HUNDRED = ("100%", "cem por cento", "total projects")


def has_any(t: Column, terms: tuple[str, ...]) -> Column:
    """Whether one of the terms stands in the text."""
    return reduce(or_, [t.contains(x) for x in terms])


def ownership_basis(c: Column) -> Column:
    """company_share if a term of the company's part stands in the text, else one_hundred_percent for a term of the whole, else unknown."""
    t = norm_text(c, "fold")
    has = lambda terms: F.exists(F.array(*map(F.lit, terms)), lambda x: t.contains(x))
    return F.when(has(COMPANY_SHARE), "company_share").when(has(ONE_HUNDRED), "one_hundred_percent").otherwise("unknown")


def line_periods(c: Column) -> Column:
    """All quarter labels of a line, as ``qTyy``."""
    found = F.regexp_extract_all(F.upper(c), F.lit(r"\b([1-4][TQ](?:20)?[0-9]{2})\b"), F.lit(1))
    return F.transform(found, lambda p: F.concat(F.substring(p, 1, 1), F.lit("T"), F.substring(p, -2, 2)))


def line_values(c: Column) -> Column:
    """All number tokens of a line as decimals; tags, image links and percentages go first."""
    clean = F.regexp_replace(F.regexp_replace(c, r"<[^>]*>|!\[[^\]]*\]\([^)]*\)", " "), r"[0-9.,]+ ?%", " ")
    clean = F.regexp_replace(clean, r"\b[1-4][TQtq](20)?[0-9]{2}\b", " ")
    return F.transform(F.regexp_extract_all(clean, F.lit(r"(?:^|[^0-9A-Za-z.,])([0-9]+(?:[.,][0-9]+)*)"), F.lit(1)), lambda n: parse_number(n, "operational"))


def parse_doc_name(c: Column) -> Column:
    """struct<ticker, period, type> of ``TICKER_qTyy_TYPE``; null when the name has another form."""
    p = r"^([A-Z]{4}[0-9]{1,2})_([1-4]T[0-9]{2})_([A-Z_]+)"
    t = F.upper(c)
    return F.when(t.rlike(p), F.struct(F.regexp_extract(t, p, 1).alias("ticker"), F.regexp_extract(t, p, 2).alias("period"), F.regexp_extract(t, p, 3).alias("type")))


# Marker characters of UTF-8 text that was read as cp1252.
_MOJIBAKE = "ÃÂâ€"


def repair_mojibake(c: Column) -> Column:
    """UTF-8 that was decoded as cp1252, decoded again: only where markers exist and fewer are left afterwards.

    Spark's ``encode`` does not know cp1252, so an Arrow function does it, and only for rows that hold a marker.
    """
    @F.pandas_udf("string")
    def fix(s: pd.Series) -> pd.Series:
        def one(t):
            try:
                out = t.encode("cp1252").decode("utf-8")
            except (UnicodeEncodeError, UnicodeDecodeError):
                return t
            return out if sum(map(out.count, _MOJIBAKE)) < sum(map(t.count, _MOJIBAKE)) else t

        return s.map(lambda t: None if t is None else one(t))

    return F.when(c.rlike(f"[{_MOJIBAKE}]"), fix(F.when(c.rlike(f"[{_MOJIBAKE}]"), c))).otherwise(c)


# Document types in order of priority with their terms (accents folded), and terms that exclude a document.
DOCUMENT_TYPES = (
    ("PLANILHA_RESULTADOS", ("planilha de resultados", "planilha de fundamentos", "dados historicos", "fundamentos", "spreadsheet", "xlsx", "xlsm", "excel")),
    ("PREVIA_OPERACIONAL", ("previa operacional", "pre-operational", "operational preview", "operational data")),
    ("TRANSCRICAO_WEBCAST", ("transcricao", "transcript", "webcast transcript", "teleconferencia transcricao", "transcricao da teleconferencia")),
    ("DEMONSTRACOES_FINANCEIRAS", ("demonstracoes financeiras", "demonstracao financeira", "financial statements", "itr", "dfp", "informacoes trimestrais")),
    ("RELEASE_RESULTADOS", ("release de resultados", "release resultados", "earnings release", "relatorio de resultados", "press release")),
    ("APRESENTACAO_RESULTADOS", ("apresentacao de resultados", "apresentacao resultados", "earnings presentation", "resultados apresentacao")),
)
EXCLUDED_DOCUMENTS = ("audio", "video", "webcast ao vivo", "calendar", "calendario")


def classify_document(c: Column) -> Column:
    """The first type of the priority list with a term in the text; null if none has or an excluded term stands in it."""

    def first(t: Column) -> Column:
        return F.when(~has_any(t, EXCLUDED_DOCUMENTS), F.coalesce(*[F.when(has_any(t, terms), F.lit(name)) for name, terms in DOCUMENT_TYPES]))

    return F.get(F.transform(F.array(norm_text(c, "fold")), first), F.lit(0))  # the text is folded once for all terms
