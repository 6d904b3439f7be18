import re
import time

import pytest

from textloom.llm import urlfilter


def brute_rule(url, rules):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1], m[2]) if m else ("", "")
    host = re.sub("[A-Z]", lambda c: c[0].lower(), host)
    best = None
    for v, r in rules:
        h, s, p = r.partition("/")
        if m and (host == h or host.endswith("." + h)) and path.startswith(s + p) and (best is None or len(r) > len(best[0])):
            best = (r, v)
    return host, path, best


def bare(url):
    url = url.split("#")[0]
    m = re.match(r"(?s)^(.*?://[^/?]*)(.*)", url)
    return m[1].lower() + m[2] if m else url


def brute(pages, edges, rules=urlfilter.RULES):
    group = {}

    def find(u):
        while group.setdefault(u, u) != u:
            u = group[u]
        return u

    for a, b in edges:
        group[find(bare(a))] = find(bare(b))
    said = {}
    for u in list(group):
        if best := brute_rule(u, rules)[2]:
            said.setdefault(find(u), set()).add(best[1])
    out = []
    for i, url in pages:
        host, path, best = brute_rule(url, rules)
        verdict = best and best[1]
        if not verdict:
            seen = said.get(find(bare(url)), set()) if url and bare(url) in group else set()
            verdict = "block" if seen == {"block"} else "allow"
        out.append((i, host, path, best and best[0], verdict))
    return sorted(out, key=str)


PAGES = [
    (1, "https://www.Example.COM/en/12?x#y", ""),
    (2, "http://a.example.com/en/77", ""),
    (3, "http://x.net/de/8", ""),
    (4, "http://example.net/de/81", ""),
    (5, "http://notexample.net/de/81", ""),
    (6, "http://alias.io/a", '<link rel="canonical" href="http://b.com/en/1">'),
    (7, "http://alias.io/b#frag", "<LINK href='/a' REL='alternate canonical'>"),
    (8, "http://alias.io/c", '<meta http-equiv="Refresh" content="0; URL=http://alias.io/b?">'),
    (9, "http://alias.io/d", '<link rel=canonical href=b>'),
    (10, "http://other.io/x", '<link rel="canonical" href="http://b.com/en/2"><link rel="canonical" href="http://example.com/en/7">'),
    (11, "http://other.io/y", '<!-- <link rel="canonical" href="http://b.com/en/2"> --><script>"<link rel=canonical href=http://b.com/en/2>"</script>'),
    (12, None, '<link rel="canonical" href="http://b.com/en/2">'),
    (13, "no scheme", None),
    (14, "", ""),
    (15, "http://", ""),
    (16, "http://com/en/", ""),
    (17, "http://z.org/es/" + "p" * 20000, ""),
    (17, "http://z.org/es/" + "p" * 20000, ""),
    (18, "http://q.io/?a://b.com/en/", ""),
    (None, "http://alias.io/a", ""),
    (19, "HTTP://ALIAS.io/a#z", ""),
    (20, "http://com?x", ""),
    (21, "mailto:x", '<link rel="canonical" href="mailto:b.com">'),
]
EDGES = [
    ("http://alias.io/a", "http://b.com/en/1"),
    ("http://alias.io/b", "http://alias.io/a"),
    ("http://alias.io/c", "http://alias.io/b"),
    ("http://alias.io/d", "http://alias.io/b"),
    ("http://other.io/x", "http://b.com/en/2"),
    ("http://other.io/x", "http://example.com/en/7"),
]


def frame(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "h", "p") for r in rows], "page_id long, url string, html string, host string, path string")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_matches_brute_force(spark):
    assert rows(urlfilter.judge(frame(spark))) == brute([p[:2] for p in PAGES], EDGES)


@pytest.mark.parametrize("inline", [0, 256])
def test_redirect_table_and_large_rule_sets(spark, monkeypatch, inline):
    monkeypatch.setattr(urlfilter, "INLINE_RULES", inline)
    chain = [(f"http://c.io/{i}", f"http://c.io/{i + 1}") for i in range(40)] + [("http://c.io/40", "http://b.com/en/9"), (None, "http://x"), ("http://s.io/1", "http://s.io/1")]
    pages = [(i, f"http://c.io/{i}", None) for i in range(40)] + PAGES
    got = urlfilter.judge(frame(spark, pages), redirects=spark.createDataFrame(chain, "source string, target string"))
    assert rows(got) == brute([p[:2] for p in pages], EDGES + [e for e in chain if e[0]])
    assert sum(r.verdict == "block" for r in got.collect() if r.rule is None) >= 44


def test_driver_table_and_empty(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    assert rows(urlfilter.judge(df)) == brute([(r.page_id, r.url) for r in df.collect()], [])
    assert urlfilter.judge(frame(spark, [])).collect() == []


def test_query_carries_blocks_over_links(spark, tmp_path):
    """The query over the driver's urls and pages that declare canonical links: by brute force and by its SQL."""
    import duckdb

    from textloom.llm.queries import ORACLE_SQL, op2_url_filter

    own = [(r.page_id, r.url, r.html) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    linked = [(1000 + i, f"http://alias.io/{i}", f'<link rel="canonical" href="{own[i][1]}">') for i in range(len(own))] + [(2000 + i, f"http://far.io/{i}", f'<link rel="canonical" href="http://alias.io/{i}">') for i in range(len(own))]
    path = f"{tmp_path}/pages.parquet"
    spark.createDataFrame(own + linked, "page_id long, url string, html string").coalesce(1).write.parquet(path)
    got = rows(op2_url_filter(spark, str(tmp_path)))
    edges = [(u, re.search('href="([^"]*)', h)[1]) for _, u, h in linked]
    assert got == brute([r[:2] for r in own + linked], edges)
    assert sum(r[4] == "block" and r[3] is None for r in got) > 5
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{path}/*.parquet')")
        columns = ("page_id", "host", "path", "rule", "verdict")
        assert sorted(c.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL['op2_url_filter']})").fetchall(), key=str) == got


@pytest.mark.parametrize("h", ["<!--" * 250000, "<script>" * 120000, "<link " * 160000, "<meta " + " " * 1000000 + ">", "</script " * 100000 + "<script>" * 10000])
def test_odd_html_of_a_megabyte_is_scanned_in_a_moment(h):
    began = time.perf_counter()
    assert urlfilter.declared("http://x.example/a", h + '<link rel=canonical href="/b">') in (["http://x.example/b"], [])
    assert time.perf_counter() - began < 5


def test_hidden_tags():
    def found(h):
        return urlfilter.declared("http://x.example/a", h)

    link = '<link rel="canonical" href="/b">'
    assert found(f"<!-- {link} -->{link}") == found(f"<SCRIPT>{link}</script >{link}") == found(f"<!-- <script> -->{link}") == found(link)
    assert found(f"<!-- {link} --><script>{link}</script>") == []
    assert found(f"<!-- {link}") == found(f"<script> {link}") == ["http://x.example/b"]
