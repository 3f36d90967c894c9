"""Links to investor documents in crawled pages, with address, period and type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fundamentals_spark.functions.text import classify_document, has_any, norm_text

# What a document's address or surroundings hold, endings of page assets, and hints of a spreadsheet download.
DOCUMENT_TERMS = (".pdf", ".xlsx", ".xlsm", ".xls", "download", "documento", "arquivo", "file", "document")
ASSETS = ("css", "js", "png", "jpg", "jpeg", "gif", "svg", "webp", "woff", "woff2", "ttf")
SHEET_HINTS = ("/v2/d/", "/download", "download=", "/document/", "/arquivo/")
PATH_HINTS = (".pdf", ".xls", "download", "document", "arquivo")
#: Characters before and after a link that tell its period and type.
REACH = 600



def _tokens(t: Column) -> Column:
    """Runs of digits, runs of letters and single marks of a folded text, without spaces."""
    return F.regexp_extract_all(t, F.lit("[0-9]+|[a-z]+|[^0-9a-z ]"), F.lit(0))


def free_period(c: Column) -> Column:
    """struct<label, year> of the first quarter in a free text (``2T26``, ``4Q 2025``, ``1 trimestre 2024``, ``2025-3T``), else the fourth quarter of its first year 20xx; null if it has neither."""
    t = norm_text(F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c), "fold")

    def found(words: Column) -> Column:
        at = lambda i: F.coalesce(F.when(i >= 0, F.get(words, i)), F.lit(""))
        year = lambda x: (F.length(x) == 2) & x.between("00", "99") | (F.length(x) == 4) & x.between("2000", "2099")
        quarter = lambda x: x.isin("1", "2", "3", "4")
        beyond = lambda i, step: F.when(at(i).isin("-", "_", "/"), at(i + step)).otherwise(at(i))
        pair = lambda q, y: F.struct(q.alias("q"), y.alias("y"))
        places = F.array_compact(F.transform(words, lambda x, i: F.when(x.isin("t", "q", "tri", "trimestre"), i)))

        def first(places: Column, units: tuple[str, ...], ahead: bool) -> Column:
            """The first quarter with one of the units, whose year stands behind it, or before the quarter's digit."""
            reach = lambda i: beyond(i + 1, 1) if ahead else beyond(i - 2, -1)
            hits = F.filter(places, lambda i: at(i).isin(*units) & quarter(at(i - 1)) & year(reach(i)))
            return F.get(F.transform(F.slice(hits, 1, 1), lambda i: pair(at(i - 1), reach(i))), F.lit(0))

        annual = F.get(F.filter(words, lambda x: (F.length(x) == 4) & x.between("2000", "2099")), F.lit(0))
        quarters = lambda at_units: F.coalesce(*[first(at_units, *k) for k in ((("t", "q"), True), (("tri", "trimestre"), True), (("t", "q"), False))])
        return F.coalesce(F.get(F.transform(F.array(places), quarters), F.lit(0)), F.when(annual.isNotNull(), pair(F.lit("4"), annual)))

    named = lambda p: F.struct(F.concat(p["q"], F.lit("T"), F.substring(p["y"], -2, 2)).alias("label"), (F.substring(p["y"], -2, 2).cast("int") + 2000).alias("year"))
    # arrays of one give names to what is used more than once
    return F.get(F.transform(F.array_compact(F.transform(F.array(_tokens(t)), found)), named), F.lit(0))


def absolute_url(base: Column, link: Column) -> Column:
    """``link`` as seen from the page ``base``, without fragment: absolute, ``//host``, ``/path``, ``?query`` or relative, with dot segments resolved."""
    link = F.regexp_replace(link, "#.*$", "")
    origin = F.regexp_extract(base, r"^([A-Za-z][\w+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"^[A-Za-z][\w+.-]*://[^/?#]*([^?#]*)", 1)
    folder = F.concat(F.regexp_replace(path, "[^/]*$", ""), F.when(path == "", F.lit("/")).otherwise(F.lit("")))
    relative = F.concat(F.regexp_replace(F.concat(folder, F.regexp_extract(link, r"^([^?]*)", 1)), "/{2,}", "/"), F.regexp_extract(link, r"(\?.*)$", 1))
    target = F.when(link.startswith("/"), link).when(link.startswith("?"), F.concat(path, link)).otherwise(relative)
    query = F.regexp_extract(target, r"(\?.*)$", 1)
    steps = F.split(F.regexp_replace(target, r"\?.*$", ""), "/")
    up = F.aggregate(steps, F.array().cast("array<string>"), lambda done, s: F.when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).when(s == ".", done).otherwise(F.concat(done, F.array(s))))
    resolved = F.concat(origin, F.when(target.rlike(r"(^|/)\.{1,2}(/|\?|$)"), F.concat(F.array_join(up, "/"), query)).otherwise(target))
    return F.when(link.rlike(r"^[A-Za-z][\w+.-]*:"), link).when(link.startswith("//"), F.concat(F.regexp_extract(base, r"^([A-Za-z][\w+.-]*:)", 1), link)).otherwise(resolved)


def _links(html: Column) -> Column:
    """array<struct<raw, title, near>> of a page's different links: first those of attributes, then addresses anywhere in markup or script."""
    # start tags, then name = value pairs within them; a value stands in quotes of either kind or in none
    tags = F.regexp_extract_all(html, F.lit(r"<[A-Za-z](?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+>"), F.lit(0))
    pairs = F.flatten(F.transform(tags, lambda tag: F.regexp_extract_all(tag, F.lit(r"""[\w:-]+\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)"""), F.lit(0))))
    linking = F.filter(pairs, lambda p: F.lower(F.regexp_extract(p, r"^[\w:-]+", 0)).isin("href", "src") | F.lower(p).startswith("data"))
    attributes = F.transform(linking, lambda p: F.regexp_replace(p, r"^[^=]*=\s*", ""))
    # whatever stands between quotes, brackets and spaces and begins as an address or as a path to a document
    pieces = F.split(html, r"""["'<>\\\s]+""")
    addresses = F.filter(F.transform(F.filter(pieces, lambda x: x.contains("://")), lambda x: F.regexp_extract(x, "https?:.*", 0)), lambda x: x.contains("://"))
    paths = F.filter(pieces, lambda x: x.startswith("/") & ~x.startswith("//") & has_any(F.lower(x), PATH_HINTS))
    found = F.concat(attributes, addresses, paths)
    found = F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"""^[\s"'(\[{]+|[\s"'()\[\]{};,]+$""", "")))
    found = F.filter(found, lambda x: (x != "") & ~x.rlike(r"(?i)^(#|javascript:|mailto:|tel:|data:)"))

    def seen(x: Column) -> Column:
        at = F.position(x, html)
        start = F.greatest(at - REACH, F.lit(1))
        after = F.substr(html, at, F.lit(REACH))
        return F.struct(x.alias("raw"), F.trim(F.regexp_extract(after, r"^[^<>]*>\s*([^<]*)", 1)).alias("title"), F.substr(html, start, at + REACH - start).alias("near"))

    return F.transform(found, seen)


def _judged(whole: Column) -> Column:
    """struct<looks, type, p> of a link's texts: whether they look like a document's, its type, its period."""
    looks = F.get(F.transform(F.array(norm_text(whole, "fold")), lambda t: has_any(t, DOCUMENT_TERMS)), F.lit(0))
    return F.struct(looks.alias("looks"), classify_document(whole).alias("type"), free_period(whole).alias("p"))


def discover_links(pages: DataFrame, domains: DataFrame | None = None, first_year: int = 2000, undated_sheet_year: int | None = None, company: str = "page_id") -> DataFrame:
    """company, page_url, document_url, title, period, year, type: one document for each company, period and type.

    ``pages``: page_id, url, html and the ``company`` column. A link counts if its host is one of ``domains`` (column domain)
    or below one, if its address or surroundings look like a document's, and if period and type can be told from title,
    address and the ``REACH`` characters around its first place in the page; nothing is guessed. Assets, years before
    ``first_year`` and spreadsheets without a spreadsheet's address go; spreadsheets without a period count as ``HISTORICO``
    of ``undated_sheet_year`` where that is given. An address counts once in a page; the earliest page (by page_id) and the
    first link in it win. Null pages and pages without links give no rows; other columns are not read.
    """
    # texts get a name of their own, or stand in an array of one that is exploded: each is then computed once, not for each use
    # (outer, as Spark otherwise computes the array once more to drop rows without one)
    pages = pages.select("page_id", F.col(company).alias("company"), F.col("url").alias("page_url"), F.replace("html", F.lit("\\/"), F.lit("/")).alias("__html"))
    links = pages.select("page_id", "company", "page_url", F.posexplode_outer(_links(F.col("__html"))).alias("n", "link")).filter("n is not null")
    links = links.select("page_id", "company", "page_url", "n", "link.*").withColumn("raw", F.replace("raw", F.lit("&amp;"), F.lit("&")))
    links = links.withColumn("document_url", absolute_url(F.col("page_url"), F.col("raw")))
    path = F.lower(F.regexp_extract("document_url", r"^[A-Za-z][\w+.-]*://[^/?#]*([^?#]*)", 1))
    ending = F.regexp_extract(path, r"\.([a-z0-9]+)$", 1)
    if domains is not None:  # every suffix of the host meets the allowed ones by equality; these are rules and sent to the tasks, so no text is shuffled
        host = F.split(F.lower(F.regexp_extract("document_url", r"^[A-Za-z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"\.")
        allowed = domains.select(F.lower("domain").alias("__d")).distinct()
        links = links.withColumn("__d", F.explode(F.transform(F.sequence(F.lit(1), F.size(host)), lambda i: F.array_join(F.slice(host, i, F.size(host)), ".")))).join(F.broadcast(allowed), "__d", "left_semi").drop("__d")
    whole = F.concat_ws(" ", "title", "raw", "document_url", "near")
    links = links.select("page_id", "company", "page_url", "n", "document_url", "title", F.inline_outer(F.transform(F.array(whole), _judged)).alias("looks", "type", "p"))
    sheet = F.col("type") == "PLANILHA_RESULTADOS"
    hint = F.lower(F.concat(path, F.lit(" "), F.regexp_extract("document_url", r"\?([^#]*)", 1)))
    is_sheet = ending.isin("xlsx", "xlsm", "xls") | has_any(hint, SHEET_HINTS)
    undated = F.when(sheet & F.lit(undated_sheet_year is not None), F.struct(F.lit("HISTORICO").alias("label"), F.lit(undated_sheet_year).cast("int").alias("year")))
    links = links.withColumn("p", F.coalesce("p", undated))
    links = links.filter(F.col("type").isNotNull() & F.col("p").isNotNull() & (F.col("p.year") >= first_year) & ~ending.isin(*ASSETS) & (~sheet | is_sheet) & F.col("looks"))
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.regexp_extract("document_url", r"([^/?#]*)(?:[?#].*)?$", 1))
    kept = links.select("page_id", "company", "page_url", "n", "document_url", title.alias("title"), F.col("p.label").alias("period"), F.col("p.year").alias("year"), "type")
    first = kept.withColumn("k", F.row_number().over(W.partitionBy("page_id", "document_url").orderBy("n"))).filter("k = 1")
    best = first.withColumn("k", F.row_number().over(W.partitionBy("company", "period", "type").orderBy("page_id", "n"))).filter("k = 1")
    return best.select(F.col("company").alias(company), "page_url", "document_url", "title", "period", "year", "type")
