"""Links and stated totals of awkward and hostile pages."""

import time

import pytest
from pyspark.sql import functions as F

from estate_spark.functions.text import inner_text
from estate_spark.operators import links

HREFS = [
    ('<a title="a > b" href="/bostad/x-1">', ["/bostad/x-1"]),
    ("<a title='5 > 4' data-href=/no class=c href='/y'>", ["/y"]),
    ('<a title="see href=/no" href=/bare>', ["/bare"]),
    ('<A CLASS="x"HREF = "/u?a=1&amp;b=2" >t</A>', ["/u?a=1&b=2"]),
    ('<a hreflang="sv" href="/l">', ["/l"]),
    ('<a class="x"" href="/stray">', ["/stray"]),
    ('<a title="never closed href=/z>', ["/z"]),
    ("<a\n\tdisabled\n href=\n'/lines'>", ["/lines"]),
    ('<abbr href="/no"><area href="/no"><a>none</a><a href="">', []),
    ('<a href="/one"><a x=1 href="/two" href="/three">', ["/one", "/two"]),
    ('<a/href="/slash">', ["/slash"]),
    ('<a href="/less<than">', ["/less<than"]),
    ("<a " + " ".join(f"a{i}=v" for i in range(900)) + " href=/far>", ["/far"]),
]


@pytest.mark.parametrize("html, want", HREFS)
def test_hrefs(rows, html, want):
    assert rows([(html,)], "html string").select(links.page_hrefs(F.col("html")).alias("h")).first().h == want


def test_a_link_behind_a_quoted_bracket_is_found(rows):
    page = rows([(1, "https://s.example/q", '<a title="a > b" href="/bostad/x-1">')], "page_id long, url string, html string")
    assert [(r.url, r.property_id) for r in links.active_links(page).collect()] == [("https://s.example/bostad/x-1", "1")]


@pytest.mark.parametrize(
    "html, want",
    [
        ("<p>a</p><script>var x = '<b>';</script>b<!-- c -->d&nbsp;e", "a b d e"),
        ("1 < 2 and 3 > 2 <br/>end", "1 < 2 and 3 > 2 end"),
        ("before <script> if (a < b) never closed", "before"),
        ("before <!-- never closed", "before"),
        ("before <p never closed", "before"),
        ("<STYLE a='b'>x</Style >y", "y"),
        (None, None),
    ],
)
def test_text(rows, html, want):
    got = rows([(html,)], "html string").select(inner_text(F.col("html"))).first()[0]
    assert (got if got is None else " ".join(got.split())) == want


def test_total_between_tags(rows):
    cases = [
        ("<p>Visar <b>50</b> av <b>1 234</b> bostäder</p>", 1234),
        ("Visar x Visar 1 av 7", 7),
        ("Visar 1\nav 9", 0),
        ("Visar nothing", 0),
        ("", 0),
        (None, 0),
    ]
    got = rows([(h,) for h, _ in cases], "html string").select(links.stated_total(inner_text(F.col("html")))).collect()
    assert [r[0] for r in got] == [n for _, n in cases]


@pytest.mark.parametrize(
    "piece",
    ["<script ", "<style>", "<!-- ", "<", "<a ", '<a b="', "<a b='\" ", "<a x=y ", "<a href", "Visar ", "Visar 1 av", "<a \" ' ", "a=b ", "1 ", '<a """""""" '],
)
def test_hostile_pages_are_read_in_linear_time(rows, piece):
    page = "<a " * (piece == "a=b ") + piece * (1_000_000 // len(piece))
    df = rows([(page,)], "html string").select(F.size(links.page_hrefs(F.col("html"))), F.length(inner_text(F.col("html"))), links.stated_total(F.col("html")))
    df.collect()
    start = time.perf_counter()
    df.collect()
    assert time.perf_counter() - start < 3
