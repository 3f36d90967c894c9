"""Link discovery: golden pages, addresses and edge cases."""

import pytest
from pyspark.sql import functions as F

from fundamentals_spark.sources.links import absolute_url, discover_links, free_period

BASE = "https://ri.example.com/central/"
PAGES = {
    1: '<ul class=files><li><A HREF=/arquivos/resultado_3T25.pdf target=_blank>Release de resultados - 3T25</A></li></ul>',
    2: '<td class="doc"><a title="Release de resultados | 3T25" href = "baixar?arquivo=77">abrir</a></td>',
    3: "<article><header>Ano 2025 / 3T25</header><p>Apresentacao de resultados</p><footer><a href='../midia/apresentacao.pdf?v=4'>ver</a></footer></article>",
    4: '<tr><th>Release de resultados 3T25</th><td><span role="button" data-file="/api/v3/document/41">PDF</span></td></tr>',
    5: '<script>window.items=[{"nome":"Demonstrações financeiras 3T25","link":"https:\\/\\/files.example.org\\/dfs_3T25.pdf"}]</script>',
    6: '<script>render({"t": "Release de resultados 3T25", "p": "/download/41/release"})</script>',
    7: '<p>Release de resultados 3T25</p><a href="/document/9"><img src="/icone.svg"></a><i data-src=/document/9></i>',
    8: '<a href="/document/9">PDF</a>',
    9: '<iframe src="/previa_operacional_4T25.pdf"></iframe> Previa operacional 4T25',
    10: '<a href="planilha-3T25.XLSX">Planilha de fundamentos 3T25</a>',
    11: '<a href="planilha-3T25.htm">Planilha de fundamentos 3T25</a>',
    12: '<link rel=x href="/release-3T25.css"><a href="tel:+5511">release de resultados 3T25 download</a>',
    13: '<a href="/release-2T19.pdf">Release de resultados 2T19</a>',
    14: None,
    15: "",
}


def test_golden_pages(spark):
    pages = spark.createDataFrame([(k, BASE, h) for k, h in PAGES.items()], "page_id long, url string, html string")
    got = {r.page_id: (r.document_url.removeprefix("https://"), r.period, r.type) for r in discover_links(pages, first_year=2022).collect()}
    assert got == {
        1: ("ri.example.com/arquivos/resultado_3T25.pdf", "3T25", "RELEASE_RESULTADOS"),
        2: ("ri.example.com/central/baixar?arquivo=77", "3T25", "RELEASE_RESULTADOS"),
        3: ("ri.example.com/midia/apresentacao.pdf?v=4", "3T25", "APRESENTACAO_RESULTADOS"),
        4: ("ri.example.com/api/v3/document/41", "3T25", "RELEASE_RESULTADOS"),
        5: ("files.example.org/dfs_3T25.pdf", "3T25", "DEMONSTRACOES_FINANCEIRAS"),
        6: ("ri.example.com/download/41/release", "3T25", "RELEASE_RESULTADOS"),
        7: ("ri.example.com/document/9", "3T25", "RELEASE_RESULTADOS"),
        9: ("ri.example.com/previa_operacional_4T25.pdf", "4T25", "PREVIA_OPERACIONAL"),
        10: ("ri.example.com/central/planilha-3T25.XLSX", "3T25", "PLANILHA_RESULTADOS"),
    }


def test_domains_and_choice(spark):
    html = '<a href="//evil.org/release-2T26.pdf">Release de resultados 2T26</a><a href="https://a.cdn.com/r-2T26.pdf?a=1&amp;b=2#x">Release de resultados 2T26</a><a href="https://notcdn.com/s.pdf">Release de resultados 2T26</a>'
    pages = spark.createDataFrame([(2, "c", BASE, html), (1, "c", BASE, html.replace("r-2T26", "q-2T26")), (3, "d", BASE, html)], "page_id long, co string, url string, html string")
    domains = spark.createDataFrame([("CDN.com",), ("a.cdn.com",)], "domain string")
    got = sorted((r.co, r.document_url, r.title) for r in discover_links(pages, domains, company="co").collect())
    t = "Release de resultados 2T26"
    assert got == [("c", "https://a.cdn.com/q-2T26.pdf?a=1&b=2", t), ("d", "https://a.cdn.com/r-2T26.pdf?a=1&b=2", t)]
    assert discover_links(pages.limit(0), domains, company="co").count() == 0


def test_undated_sheet(spark):
    pages = spark.createDataFrame([(1, BASE, '<a href="planilha.xlsx">Planilha de fundamentos</a>')], "page_id long, url string, html string")
    assert discover_links(pages).count() == 0
    row = discover_links(pages, undated_sheet_year=2026).first()
    assert (row.document_url, row.period, row.year) == (BASE + "planilha.xlsx", "HISTORICO", 2026)


@pytest.mark.parametrize("text,want", [("4Q 2025", ("4T25", 2025)), ("1 trimestre 2024", ("1T24", 2024)), ("2025-3T", ("3T25", 2025)), ("DFP 2023", ("4T23", 2023)), ("release%202T26", ("2T26", 2026)), ("100% a+b 3T22", ("3T22", 2022)), ("12T26", None), ("", None), (None, None)])
def test_free_period(spark, text, want):
    r = spark.createDataFrame([(text,)], "t string").select(free_period(F.col("t")).alias("p")).first().p
    assert (tuple(r) if r else None) == want


@pytest.mark.parametrize("link", ["a.pdf", "../a.pdf", "../../../a.pdf", "./x/../a.pdf?y=../z", "/a/./b", "//h/p", "?q=1", "http://o/p#f", "a//b"])
def test_absolute_url(spark, link):
    from urllib.parse import urldefrag, urljoin

    for base in ("https://h.com/x/y/z.html?k=1", "https://h.com", "https://h.com/x/"):
        got = spark.createDataFrame([(base, link)], "b string, l string").select(absolute_url(F.col("b"), F.col("l")).alias("u")).first().u
        assert got == urldefrag(urljoin(base, link)).url


def test_texts_are_computed_once(spark):
    """Each link's texts are folded for looks, type and period, not again for each term and filter."""
    pages = spark.createDataFrame([(1, BASE, PAGES[1])], "page_id long, url string, html string")
    plan = discover_links(pages)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") <= 3 and plan.count("try_url_decode") + plan.count("UrlCodec") <= 2
