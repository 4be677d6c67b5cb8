"""WARC archives and URL filters."""

import base64
import gzip
import hashlib
from collections import Counter

import pytest

from estate_spark.llm import url_filter, warc
from estate_spark.llm.queries import URL_RULES

LONG = "<p>" + "long text é " * 9000
PAGES = [
    (1, "http://a.net/", "<p>one"),
    (2, "http://a.net/2", None),
    (3, None, ""),
    (4, "http://b.org/fr/", "<p>one"),
    (0, "http://c", "<p>one"),
    (5, "http://d", LONG),
    (6, "http://e", LONG),
    (7, "http://f", LONG + "!"),
    (None, "http://g", "<p>one"),
    (0, "http://c", "<p>one"),
    (8, "http://h\r\nX: y", "1\r\n\r\n0\r\n\r\n"),
]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, u, h, "x", "y") for i, u, h in PAGES]
    return spark.createDataFrame(rows, "page_id long, url string, html string, d string, first string").repartition(3)


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


@pytest.mark.parametrize("least", [0, 100])
def test_archives_round_trip(pages, folder, least):
    got = warc.read_archives(warc.write_archives(pages, folder, least_bytes=least), payload=True).collect()
    first = {}
    for i, _, h in PAGES:
        if i is not None and len((h or "").encode()) >= least:
            first[h or ""] = min(i, first.get(h or "", i))
    want = Counter()
    for i, _, h in PAGES:
        body = h or ""
        again = i is not None and body in first and i > first[body]
        want[i, len(body.encode()), digest(h), "revisit" if again else "response", first[body] if again else None, None if again else body.encode()] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got) == want


def test_archives_of_nothing(pages, folder):
    assert warc.read_archives(warc.write_archives(pages.limit(0), folder)).collect() == []


def records_of(folder):
    names = [r for r in folder.iterdir() if r.name.endswith(".warc.gz")]
    return [warc.parse(m) for name in names for m in warc.members(str(name))]


def test_segments_name_their_origin(pages, tmp_path):
    warc.write_archives(pages, f"file://{tmp_path}/w")
    records = [f for f, _ in records_of(tmp_path / "w")]
    parts = [f for f in records if f["warc-type"] == "continuation"]
    assert parts and {f["warc-segment-origin-id"] for f in parts} <= {f["warc-record-id"] for f in records if f["warc-type"] == "response"}
    assert sum("warc-segment-total-length" in f for f in parts) == len({f["warc-segment-origin-id"] for f in parts})
    assert not any("x" in f for f in records)  # a line break in a url starts no field


def test_a_missing_segment_is_told(spark, pages, tmp_path):
    warc.write_archives(pages, f"file://{tmp_path}/w")
    out, dropped = [], False
    for name in (tmp_path / "w").iterdir():
        if name.name.endswith(".warc.gz"):
            for member in warc.members(str(name)):
                if not dropped and b"WARC-Type: continuation" in member and b"WARC-Segment-Number: 2" in member:
                    dropped = True
                    continue
                out.append(gzip.compress(member))
    (tmp_path / "cut.warc.gz").write_bytes(b"".join(out))
    manifest = spark.createDataFrame([(f"file://{tmp_path}/cut.warc.gz",)], "file string")
    with pytest.raises(Exception, match="missing or not of the stated total length"):
        warc.read_archives(manifest).collect()


def test_chunked_framing():
    for body in (b"", b"a", b"x" * 20_000, b"\r\n0\r\n\r\n"):
        assert warc.unchunked(warc.chunked(body)) == body
    assert warc.unchunked(b"3;ext=1\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n")


URLS = [
    None, "", "no scheme", "http://", "HTTP://Example.NET/en/1", "http://www.example.net/en/", "http://example.net/en", "http://badexample.net/en/x",
    "http://x.org/fr/", "http://org/fr/a?b", "http://x.org/fr", "http://example.com/de/x#y", "http://sub.example.com/de/", "http://notexample.com/de/",
    "http://net", "http://net/", "http://a.b.c.net?x=/", "http://ÉCOLE.net/", "a://b.net/://c.com/", "http://example.com/en/", "http://example.net/de/",
]


def plain_verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.index(c) for c in "/?#" if c in rest] + [len(rest)])
    host, path = rest[:cut].translate({c: c + 32 for c in range(65, 91)}), rest[cut:]
    path = path[: min([path.index(c) for c in "?#" if c in path] + [len(path)])]
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best and best.text, best.action if best else "allow"


def test_verdicts(spark):
    rows = [(i, u, "x", "y") for i, u in enumerate(URLS)] + [(None, "http://a.net/", "x", "y"), (4, URLS[4], "x", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, found string")
    got = Counter(map(tuple, url_filter.judge(df, URL_RULES).collect()))
    assert got == Counter((i, *plain_verdict(u)) for i, u, _, _ in rows)
    assert url_filter.judge(df.limit(0), URL_RULES).collect() == []
    assert {r.verdict for r in url_filter.judge(df, []).collect()} == {"allow"}


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(5000).selectExpr("concat('host', id) AS key")
    listed = [f"host{i}" for i in range(0, 5000, 37)] + ["elsewhere"]
    cascade = url_filter.build_cascade(spark, listed, universe)
    judged = universe.select("key", url_filter.member(cascade, universe.key).alias("inside")).collect()
    assert {r.key for r in judged if r.inside} == set(listed) - {"elsewhere"}
    assert sum(level.bits for level in cascade) < 64 * 60


def test_too_long_a_list_is_refused(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "MOST_BITS", 64)
    with pytest.raises(ValueError, match="split the rules"):
        url_filter.build_cascade(spark, [f"h{i}" for i in range(500)], spark.range(10).selectExpr("concat('x', id) AS key"))


def test_no_python_in_the_plan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    plan = url_filter.judge(df, URL_RULES)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "Join", "Exchange"))
