"""HTML extraction: the given pages against their article element, other layouts, edge cases."""

import html
import re

import pytest

from turnlens.llm.html_text import Counter, extract_text, main_text, page_counts, weights


def article(page):
    m = re.search(r"<article>(.*?)(?:</article>|$)", page, re.S)
    blocks = re.split(r"<[^>]*>", re.sub(r"</?b>", "", m[1])) if m else []
    return " ".join(b for b in (" ".join(html.unescape(x).split()) for x in blocks) if b)


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r for r in extract_text(pages).collect()}
    for r in pages.collect():
        assert got[r["page_id"]]["text"] == article(r["html"]), r["page_id"]
        assert got[r["page_id"]]["url"] == r["url"] and got[r["page_id"]]["n_chars"] == len(article(r["html"]))


@pytest.fixture(scope="module")
def fitted():
    good, bad = Counter(), Counter()
    page = ("<body><nav><a>one two</a></nav><div class=ad>three four five</div><article><h1>six</h1><p>" + "word " * 50
            + "</p></article><footer>seven eight</footer></body>")
    for _ in range(20):
        g, b = page_counts(page)
        good.update(g)
        bad.update(b)
    return weights(good, bad)


PAGES = [
    ("<header><h1>Site</h1><a>Home</a></header><nav><a>x</a></nav><div class='cookie-notice'>We use cookies on this site</div>"
     "<main><header><h1>Title</h1></header><p>First &amp; second para<b>graph</b> text.</p><aside><p>Related stuff</p></aside>"
     "<p>Third\n <i>x</i> &#8211; y</p><form><input><button>Send</button></form><section id='comments'>"
     "<article class='comment'><p>I disagree with all of this</p></article></section></main><footer>c 2020</footer>",
     "Title First & second paragraph text. Third x – y"),
    ("<div id=top-menu><ul><li>A<li>B</ul></div><div class=x><div class=advert>buy now</div><h2>Head</h2><p>One two three"
     "<p>four five<ul><li>item one<li>item two</ul></div><div class='reader-comments'><p>me too and so on</p></div>"
     "<script>var a = '<p>no</p>'</script><style>p{}</style><!-- <p>hidden</p> -->", "Head One two three four five item one item two"),
    ("plain words only", "plain words only"), ("<p>a", "a"), ("<nav>x y z</nav>", ""), ("", ""), ("<<<>>>", None),
    ("<p>a&nbsp;&nbsp;b<br>c &lt;tag&gt; &unknown; d</p>", "a b c <tag> &unknown; d"), ("<p title='a > b'>t</p", "t"),
]


BODY = "<p>One two three four five six</p><p>seven eight nine ten</p>"
TEXT = "One two three four five six seven eight nine ten"
PAGES += [
    (f"<html><body class='has-sidebar'><nav>a b</nav>{BODY}</body></html>", TEXT),
    (f"<body class='no-comments sidebar'><nav>a b</nav><div>{BODY}</div><footer>c</footer>", TEXT),
    (f"<nav>a b</nav><article class='post category-legal tag-search related'>{BODY}</article><aside>c d</aside>", TEXT),
    (f"<form action=x><nav>a b</nav><div>{BODY} and so on</div></form>", TEXT + " and so on"),
    (f"<article><div class='entry-header'><h1>The title</h1></div>{BODY}<div class='comments'>{BODY * 3}</div></article>",
     "The title " + TEXT),
    (f"<div class='widget'>{BODY}</div><nav>a b</nav>", TEXT),
    ("<article><p>one <svg class='i'/> two three</p><p>four</p><svg viewBox=\"0 0 1 1\" hidden /><p>five</p><iframe/><p>six"
     "<object data=a.swf /> seven</p></article>", "one two three four five six seven"),
    ("<article><p>one<svg class='i'><path d='x'/>no</svg> two</p><iframe src=http://a/>no</iframe><p>three</p></article>",
     "one two three"),
]


def test_labelled_pages_decide_listed_and_compound_marks():
    page = f"<nav>a b</nav><article><div class='site-notice'>{BODY * 9}</div></article><div class='comments'>c d e f</div>"
    good, bad = Counter(), Counter()
    for _ in range(20):
        g, b = page_counts(page)
        good.update(g)
        bad.update(b)
    page = f"<article><p>Start</p>{BODY}<div class='site-notice'>x y</div><div class='comments'><p>z</p></div></article>"
    assert main_text(page, weights(good, bad)) == "Start " + TEXT + " x y"


@pytest.mark.parametrize("page, want", PAGES)
def test_layouts(fitted, page, want):
    got = main_text(page, fitted)
    assert want is None or got == want


def test_nulls_long_pages_and_clashing_names(spark):
    long_page = "<article>" + "<p>some words here</p>" * 30_000 + "</article><footer>end</footer>"
    rows = [(1, "u", long_page, "a", "b"), (2, None, None, "a", "b"), (None, "u", "", "a", "b"),
            (3, "v", "<article><p>same</p></article>", "a", "b"), (3, "v", "<article><p>same</p></article>", "a", "b")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, key string")
    got = sorted(((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in extract_text(pages).collect()), key=str)
    text = "some words here " * 29_999 + "some words here"
    assert got == sorted([(1, "u", text, len(text)), (2, None, "", 0), (None, "u", "", 0), (3, "v", "same", 4), (3, "v", "same", 4)],
                         key=str)
    assert extract_text(pages.where("false")).count() == 0


POST = " ".join(f"post{i}" for i in range(50))
CHAT = " ".join(f"chat{i}" for i in range(60))


@pytest.fixture(scope="module")
def fitted_on_pages(spark):
    from turnlens.llm.html_text import fit_weights
    return fit_weights(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


@pytest.mark.parametrize("page, want", [
    *[(f"<div class=post><p>{POST}</p></div><div class=comments><p>{' '.join([CHAT] * n)}</p></div>", POST) for n in (1, 4, 10)],
    (f"<article><p>{POST}</p></article><div class=comments><p>{' '.join([CHAT] * 10)}</p></div>", POST),
    (f"<article><p>{POST}</p><section id=comments><p>{' '.join([CHAT] * 10)}</p></section></article>", POST),
    (f"<article><p>four words of body</p><div class=notice><p>{CHAT}</p></div></article>", "four words of body"),
    (f"<div class=widget><p>{CHAT}</p></div><div class=post><p>{POST}</p></div>", POST),
    (f"<div class='cookie'><p>{CHAT}</p></div>", ""), (f"<ul class=menu><li>{CHAT}</ul>", ""),
    ("<p data-x=it's>Hello we don't stop here today</p>", "Hello we don't stop here today"),
    ("<p title=\"it's > that\" id = 'a\"b'>Hello</p><p>you're</p>", "Hello you're"),
    ("<article><p>one <svg data-x=it's class=i /> two</p><p>don't</p></article>", "one two don't"),
    ("<p a=\"open>one</p><p>two</p>", None)])
def test_comments_notices_and_quotes(fitted, fitted_on_pages, page, want):
    for weight in (fitted, fitted_on_pages):
        got = main_text(page, weight)
        assert want is None or got == want


def test_deep_pages_take_linear_time(fitted):
    import time

    def seconds(n):
        start = time.time()
        assert "x" in main_text("<div>" * n + "<b>x</b>" * n, fitted)
        main_text("<div class='a b'>x" * n + "</i>" * n, fitted)
        return time.time() - start

    assert seconds(3000) < 1.0 and seconds(30_000) < 30 * max(seconds(3000), 0.05)


def test_best_region_is_the_maximum(fitted):
    """The region of the scan against the best of all contiguous regions by their sums."""
    import random
    from turnlens.llm import html_text as H
    r = random.Random(3)
    for _ in range(150):
        parts = []
        for _ in range(r.randint(1, 7)):
            words = " ".join(r.choice("abcdef") for _ in range(r.randint(1, 30)))
            parts.append(r.choice(["<p>{}</p>", "<li>{}", "<div>{}</div>", "<nav>{}</nav>", "<div class=comments><p>{}</p></div>",
                                   "{}", "<footer>{}</footer>", "<h2>{}</h2>"]).format(words))
        elements, stretches = H.parsed("".join(parts))
        held = [0] * len(elements)
        for s in stretches:
            if s.element >= 0:
                held[s.element] += len(s.text.split())
        around, out = H.scores(elements, held, fitted)
        value, kept = [], []
        for s in stretches:
            n, listed = len(s.text.split()), s.element >= 0 and out[s.element]
            each = H.WORD + (around[s.element] if s.element >= 0 else 0.0)
            each = -abs(each) if listed else max(-H.LIMIT, min(H.LIMIT, each))
            value.append(each * n if each > 0 else max(each * n, -H.STRETCH))
            kept.append(n > 0 and not listed and each > H.LEAST)
        best, span = 0.0, (0, 0)
        for i in range(len(stretches)):
            total = 0.0
            for j in range(i, len(stretches)):
                total += value[j] - (H.TAG_COST * stretches[j].tags if j > i else 0.0)
                if total > best + 1e-9:
                    best, span = total, (i, j + 1)
        want = " ".join(" ".join(stretches[k].text.split()) for k in range(*span) if kept[k])
        assert H.main_text("".join(parts), fitted).split() == want.split()


def test_copies_of_a_page_count_once(spark):
    from turnlens.llm.html_text import fit_weights
    one = [(i, f"<nav>a b</nav><article><p class=k{'abcde'[i]}>{POST}</p></article>") for i in range(5)]
    pages = spark.createDataFrame(one, "page_id long, html string")
    copies = spark.createDataFrame(one + [one[0]] * 50, "page_id long, html string")
    assert fit_weights(pages) == fit_weights(copies) and len(fit_weights(copies, sample=1)) < len(fit_weights(copies))
