import hashlib
import math
import random
import re
from collections import Counter

import pytest

from beaconfold.llm import fingerprint, llr_rules, queries
from beaconfold.llm.html_extract import Page, common_lines, extract_main_text, main_text, page_lines

W = re.compile(r"[^\x20\x09-\x0D]+")
ODD = ["", None, " \n\t ", "a b c d e f g h " * 10, "same line\nsame line\n\nsame line\n", "# * $ | <x>", "é 字   x", "w " * 20_000, "one two three", "one two three"]


def measures(text):
    w = W.findall(text or "")
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if W.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_base_measures_against_brute_force(spark):
    rnd = random.Random(4)
    texts = ODD + ["".join(rnd.choice(["a ", "b ", "c\n", "a b c d e f g h i ", "# "]) for _ in range(rnd.randint(1, 80))) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = llr_rules.base_measures(llr_rules.with_hashes(docs)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r[m] for m in llr_rules.MEASURES) == measures(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)


def test_rules_keep_clean_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op5_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    open_ = rows[~rows.base_failed]
    assert open_[open_.quality == 1].kept.mean() > 0.99 and open_[open_.quality == 0].kept.mean() < 0.3
    assert not rows[rows.base_failed].kept.any()


def test_rules_on_odd_tables(spark):
    docs = spark.createDataFrame([(i % 8, t, "x") for i, t in enumerate(ODD)], "doc_id long, text string, score string")
    ratios = llr_rules.gram_ratios(docs, docs.where("false").select("doc_id"))
    assert llr_rules.quality_rules(docs, ratios).count() == len(ODD)
    assert llr_rules.quality_rules(docs.where("false"), ratios).count() == 0


def test_ratios_count_all_trusted_rows(spark):
    docs = spark.range(24_000).selectExpr("id as doc_id", "concat('w', id, ' ', id) as text")
    ids = docs.select("doc_id")
    ratios = llr_rules.gram_ratios(docs, ids.union(ids).union(spark.sql("select cast(null as bigint)")))
    assert ratios.count() > 10_000 and ratios.where("llr <> 0").count() == 0  # all rows are trusted, so both multinomials are the same
    some = llr_rules.gram_ratios(spark.createDataFrame([(1, "x"), (1, "x"), (None, "y"), (2, "z")], "doc_id long, text string"), ids.where("doc_id = 1"))
    scale = 2 / 4  # two of four 1-grams are trusted
    assert sorted(r.llr for r in some.collect()) == pytest.approx(sorted(math.log((g + 8) / (n * scale + 8)) for n, g in [(2, 2), (1, 0), (1, 0)]))


def edited(rows):
    ordered = sorted(rows, key=lambda r: (-r[0], r[1] or ""))
    for i, (k, t) in enumerate(ordered):
        t, u = t or "", ordered[(i + 1) % len(ordered)][1] or ""
        yield k, t, t[: len(t) - len(t) // 2] + u[: len(t) // 2]


@pytest.mark.parametrize("n", [1, 2, 5, 40])
def test_fingerprints_of_neighbours(spark, n):
    rnd = random.Random(n)
    rows = [(k * 7 - 20, ODD[k] if k < len(ODD) else " ".join(rnd.choice("abcdefgh字é") for _ in range(rnd.randint(0, 60)))) for k in range(n)]
    got = {r.doc_id: r for r in fingerprint.fingerprint_neighbours(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == n
    prints = {}
    for k, t, e in edited(rows):
        assert got[k].n_chars == len(t) and got[k].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert prints.setdefault(t, got[k].fingerprint) == got[k].fingerprint
        assert 0 <= got[k].near_edited <= 1 and 0 <= got[k].near_next <= 1
        if t == e:
            assert got[k].near_edited == 1 and got[k].fingerprint == got[k].edited_fingerprint


def test_sketches_estimate_containment(spark):
    words = [f"w{i}" for i in range(6000)]
    small, large = " ".join(words[:1500]), " ".join(words)
    df = spark.createDataFrame([(small, large)], "a string, b string")
    df = fingerprint.with_sketch(fingerprint.with_sketch(df, "a", "sa"), "b", "sb")
    r = df.select(fingerprint.containment("sa", "sb").alias("c"), fingerprint.resemblance("sa", "sb").alias("j"), "sa", "sb").first()
    assert r.c == 1.0 and abs(r.j - 0.25) < 0.06 and 500 < len(r.sb.hashes) < 1000


def test_fingerprints_of_nothing(spark):
    assert fingerprint.fingerprint_neighbours(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_common_lines_are_a_longest_subsequence():
    rnd = random.Random(5)
    for k in range(800):
        a, b = ([rnd.choice("abcd") for _ in range(rnd.randint(0, 12 + k // 20))] for _ in range(2))
        found, rest = common_lines(a, b), iter(b)
        assert len(found) == lcs(a, b) and all(x in rest for x in [a[i] for i in sorted(found)])
    same = ["x", "y"] * 20_000  # lines that repeat very often
    assert len(common_lines(["a", *same], [*same[1:], "b"])) == len(same) - 1


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><div id="cookie-notice">Cookies</div>
<nav><ul><li>Home<li>About</ul></nav><main><div class="sidebar">side</div><article><header><h1>Title &amp; more</h1></header><p>First <b>para</b>&nbsp;graph<br>x
<p class="ad">Buy<p>Second<script>if(a<b){}</script> one<form><input name=q>Search</form><ul><li>i1<li>i2</ul>
<section class="comments"><article class="comment"><p>nice</p></article></section></article></main><footer>&copy; x</footer></body></html>"""


def test_marked_articles(spark):
    assert [x.text for x in page_lines(PAGE) if x.region == 1] == ["Title & more", "First para graph x", "Second one", "i1", "i2"]


@pytest.mark.parametrize(
    "markup, kept",
    [
        ('<article class="post has-sidebar"><p>x</p></article>', True),
        ('<div class="site-footer"><p>x</p></div>', False),
        ('<div class="related-posts"><p>x</p></div>', False),
        ('<section id="reader-comments"><p>x</p></section>', False),
        ('<div role="dialog"><p>x</p></div>', False),
        ('<p style="display: none">x</p>', False),
        ('<div class="entry"><p>x</p></div>', True),
        ('<div class="page-header"><p>x</p></div>', False),
        ('<article><div class="entry-header"><p>x</p></div></article>', True),
        ("<select><option>x</select><button>x</button><textarea>x</textarea><!-- x --><style>x</style>", False),
    ],
)
def test_regions(markup, kept):
    assert [x.region != 0 for x in page_lines(f"<body>{markup}</body>")] == [True] * kept or not kept
    assert kept or all(x.region == 0 for x in page_lines(f"<body>{markup}</body>"))


def test_differencing_deletes_what_unmarked_pages_share(spark):
    page = "<body><div>Top of site</div><p>{0} text of page</p><div>About us</div><p>more {0}</p><div>All of it</div></body>"
    rows = [(i, f"https://h.org/a/{i}", page.format(f"unique{i}")) for i in range(6)]
    rows += [(10, "https://h.org/b/1", PAGE), (11, "https://h.org/b/2", PAGE), (12, None, None), (13, "x", ""), (14, "https://solo.org/", "<p>alone</p>"), (14, "https://solo.org/", "<p>alone</p>")]
    rows += [(15, "https://v.org/", "<p>" + "long " * 50_000 + "</p><p>broken <a href='x")]
    pages = spark.createDataFrame([(*r, "n") for r in rows], "page_id long, url string, html string, text string")
    results = []
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for partitions in (1, 4, 8):  # pages at the edges of ranges meet their neighbours as well
            spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
            results.append(sorted(extract_main_text(pages).collect(), key=str))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    got = results[0]
    assert results == [got] * 3
    texts = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert [texts[i] for i in range(6)] == [f"unique{i} text of page\nmore unique{i}" for i in range(6)]
    assert texts[10] == texts[11] == "Title & more\nFirst para graph x\nSecond one\ni1\ni2"
    assert texts[12] == texts[13] == "" and texts[14] == "alone" and texts[15].startswith("long long")
    assert extract_main_text(pages.where("false")).count() == 0


def test_differencing_alone_finds_the_articles_of_unmarked_pages(spark):
    """Pages of several hosts without any telling tag or name: what the pages of a host share goes, on every page."""
    rnd, rows, want = random.Random(7), [], {}
    for host in range(5):
        chrome = [f"<div>host {host} line {k}</div>" for k in range(12)]
        for n in range(9):
            own = [f"text {rnd.random()} of {host}/{n}" for _ in range(rnd.randint(1, 6))]
            want[len(rows)] = "\n".join(own)
            rows.append((len(rows), f"https://h{host}.org/d{n % 3}/{n}", "<body>" + "".join([*chrome[:7], *(f"<p>{x}</p>" for x in own), *chrome[7:]])))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract_main_text(pages).collect()}
    assert got == want
    assert sum(got[i] != "\n".join(x.text for x in page_lines(h)) for i, _, h in rows) == len(rows)  # pages that differencing changes


def test_page_ids_beside_null_ids(spark):
    big = (1 << 53) + 1
    pages = spark.createDataFrame([(None, "https://a.org/1", "<p>a</p>"), (big, "https://a.org/1", "<p>b</p>"), (big, "https://a.org/1", "<p>b</p>")], "page_id long, url string, html string").coalesce(1)
    assert sorted((r.page_id or 0, r.text) for r in extract_main_text(pages).collect()) == [(0, "a"), (big, "b"), (big, "b")]


def test_differencing_decides_unmarked_lines_beside_marked_ones():
    html = '<body><div>Top of site</div><h1>Head {0}</h1><p>lead {0}</p><div class="entry"><p>marked {0}</p><p>quote</p></div><p>tail {0}</p><p><a href="/">go {0}</a></p><div>About us</div></body>'
    one, two, alone = (Page(h, f"/a/{n}", (n,), page_lines(html.format(n))) for h, n in (("h", 1), ("h", 2), ("solo", 3)))
    text = "Head {0}\nlead {0}\nmarked {0}\nquote\ntail {0}"
    assert main_text(one, None, two) == text.format(1) and main_text(two, one, alone) == text.format(2)
    assert main_text(one, one, two) == text.format(1)  # a copy leaves it to the other neighbour
    whole = f"Top of site\n{text.format(1)}\nAbout us"
    assert main_text(one, one, one) == main_text(one, None, alone) == whole  # nothing to compare with


@pytest.mark.parametrize(
    "html, text",
    [
        ("<p><a>Tom &amp; co</a> x y</p>", "Tom & co x y"),
        ("<p><a>\n      indented text of a link\n   </a> and more</p>", "indented text of a link and more"),
        ("<p><a>&lt;&lt;&lt;&lt;</a>&gt;</p>", "<<<<>"),
        ("<h1><a href='/x'>A linked headline</a></h1><p>t</p>", "A linked headline\nt"),
        ("<h2>\n<a href='/x'>\nA <b>linked</b>&nbsp;headline</a></h2>", "A linked headline"),
        ("<ul><li> <a href='/'> Home &amp; more </a> </li><li><a href='/b'>About</a></li></ul><p>t</p>", "t"),
        ("<p>A<a href='/'>B</a></p><div><a href='/'>x</a> <a href='/'>y</a></div>", "AB"),
    ],
)
def test_lines_with_links(html, text):
    page = Page("h", "/a", (1,), page_lines(f"<body>{html}</body>"))
    assert main_text(page, None, None) == text


def test_a_headline_that_neighbours_share_goes():
    pages = [Page("h", f"/a/{i}", (i,), page_lines(f"<body><h1><a href='/'>Site</a></h1><h2><a href='/{i}'>Head {i}</a></h2><p>text {i}</p></body>")) for i in range(2)]
    assert main_text(pages[0], None, pages[1]) == "Head 0\ntext 0"


def test_articles_of_the_table(spark):
    import html

    sf = "/root/testdata/sf0.01"
    got = {r.page_id: r.text for r in queries.op3_html_extraction(spark, sf).collect()}
    for p in spark.read.parquet(f"{sf}/pages.parquet").collect():
        body = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", body))
        assert got[p.page_id] == "\n".join(b for b in blocks if b)
