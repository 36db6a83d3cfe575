import html as H
import itertools
import re

import numpy as np
import pytest

from plumeria.llm import dom_extract as X


def test_marginals_against_all_labellings():
    rng = np.random.default_rng(1)
    dom = X.parse("<nav><ul><li><a href=x>a</a><li>b</ul></nav><div class=post><h1>t</h1><p>some <b>text<br><p>more</div>")
    forest = X.Forest([dom, X.parse("<p>x")])
    weight, pair = rng.standard_normal(X.FEATURES), rng.standard_normal((X.N_KINDS, 2, 2))
    p, joint = X.marginals(forest, weight, pair)
    score = forest.unary(weight)
    total, single, double = 0.0, np.zeros(forest.n), np.zeros((forest.n, 2, 2))
    for label in itertools.product((0, 1), repeat=forest.n):
        label = np.array(label)
        child = np.flatnonzero(forest.parent >= 0)
        mass = np.exp((score * label).sum() + pair[forest.kind[child], label[forest.parent[child]], label[child]].sum())
        total += mass
        single += mass * label
        for i in child:
            double[i, label[forest.parent[i]], label[i]] += mass
    assert np.allclose(p, single / total)
    child = np.flatnonzero(forest.parent >= 0)
    assert np.allclose(joint[child], double[child] / total)


def test_training_climbs_to_the_expected_counts():
    doms = []
    for page in X.labelled_pages(60, 3):
        dom = X.Labelled()
        dom.feed(page)
        dom.close()
        doms.append(dom)
    forest, label = X.Forest(doms), np.concatenate([d.label for d in doms])
    weight, pair = X.train(forest, label, rounds=300, decay=0.0)
    p, _ = X.marginals(forest, weight, pair)
    seen = np.bincount(forest.columns, label[forest.rows], X.FEATURES) - np.bincount(forest.columns, p[forest.rows], X.FEATURES)
    assert np.abs(seen).sum() < 0.1 * len(label) and ((p >= 0.5) == label).mean() > 0.97


def test_held_out_accuracy():
    weight, pair = X.trained()
    doms = []
    for page in X.labelled_pages(150, 1234):
        dom = X.Labelled()
        dom.feed(page)
        dom.close()
        doms.append(dom)
    p, _ = X.marginals(X.Forest(doms), weight, pair)
    label = np.concatenate([d.label for d in doms])
    text = np.concatenate([np.array(d.own) > 0 for d in doms])
    assert ((p >= 0.5) == label)[text].mean() > 0.96


def test_articles_of_the_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    right = 0
    for r in X.extract(pages).collect():
        inner = re.search("<article>(.*)</article>", html[r.page_id], re.S)[1]
        blocks = [" ".join(H.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?p>|</?h1>", inner)]
        right += r.text == "\n\n".join(filter(None, blocks))
    assert right >= 0.99 * len(html)


BODY = "Long enough a paragraph of plain text to be the main matter of a page, with some more words. " * 3


@pytest.mark.parametrize(
    "html,want",
    [
        (f"<article><p>{BODY}&amp; &lt;b&gt; &eacute;&#233;&nbsp;x</article>", BODY + "& <b> éé x"),
        (f"<article><p>{BODY}<script>var a='<p>no</p>'</script><style>p{{}}</style><!-- no --><p>{BODY}</article>", BODY.strip() + "\n\n" + BODY.strip()),
        (f"<article><p>a\n\t b<br>c {BODY}</p></b></i></article>", f"a b c {BODY}".strip()),
        (f"<main><div class=comments><p>nice post</p></div><p>{BODY}</p></main>", BODY.strip()),
        (f"<div id=cookie-notice><p>We use cookies.</p></div><article><h1>T</h1><p>{BODY}</p><form><label>x</label></form></article><footer>&copy; y</footer>", "T\n\n" + BODY.strip()),
    ],
)
def test_blocks(html, want):
    assert X.main_texts([html], *X.trained()) == [" ".join(want.split(" ")).strip()]


@pytest.mark.parametrize("html", [None, "", " ", "<", "<p", "<!--", "</p></div>", "<div>" * 5000 + "x", "<table><td><tr></table>", "<script>never closed", "a" * 300_000, "<p>x" * 20_000, "\x00<p>\x00"])
def test_odd_html_does_not_fail(html):
    [text] = X.main_texts([html], *X.trained())
    assert isinstance(text, str)


def test_empty_table_and_repeats(spark):
    pages = spark.createDataFrame([(1, "u", "<p>x"), (1, "u", "<p>x"), (None, None, None)], "page_id long, url string, html string").selectExpr("*", "1 AS text")
    assert X.extract(pages).count() == 3 and X.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    "start",
    [
        "<html><head><title>t</title><meta charset=x><body>",
        "<head><title>t</title><noscript>no<img></noscript><link rel=x>",
        "<head><noscript><p>no</p><body>",
        "<body><button>",
        "<body><noscript>",
        "<body><svg><path>",
        "<body><div><button>go</div>",
        "<body><div><select><option>a<option>b</div>",
        "<body><div><noscript>no</div><noscript><p>no</p></noscript>",
        "<body><div><button>go<button>on</button></div>",
    ],
)
def test_dropped_elements_without_end(start):
    """Nothing of the article is lost."""
    assert X.main_texts([f"{start}<article><h1>T</h1><p>{BODY}</p></article></body></html>"], *X.trained()) == ["T\n\n" + BODY.strip()]


def test_dropped_elements_with_end_stay_dropped():
    page = f"<head><title>t</title></head><body><article><p>{BODY}<button><div><p>no</p></div></button><noscript><article><p>{BODY}</p></article></noscript><p>{BODY}</article>"
    assert X.main_texts([page], *X.trained()) == [BODY.strip() + "\n\n" + BODY.strip()]


@pytest.mark.parametrize("depth", [150, 198, 250, 3000])
def test_depth_does_not_matter(depth):
    """The article is found in nested blocks, and the sidebar stays out under tags that are never closed."""
    page = f"<body>{'<div>' * depth}<article><p>{BODY}</p></article>{'</div>' * depth}<aside class=sidebar><p>Other posts <a href=x>one</a></p></aside>"
    assert X.main_texts([page], *X.trained()) == [BODY.strip()]
    page = f"<body>{'<b>' * depth}<article><p>{BODY}</p><p>{BODY}</p></article><aside class=sidebar><ul><li><a href=x>one</a></li></ul></aside>"
    assert X.main_texts([page], *X.trained()) == [BODY.strip() + "\n\n" + BODY.strip()]


def test_formulas_are_text():
    page = f"<article><p>{BODY}<math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p></article>"
    assert X.main_texts([page], *X.trained()) == [BODY.strip() + " x=2 holds."]


def test_deep_pages_take_linear_time():
    import time

    began = time.perf_counter()
    X.parse("<b>" * 60_000 + "<p>x</p>" * 20_000 + "</i>" * 20_000 + "<svg>" + "<g>" * 30_000 + "</h>" * 20_000)
    assert time.perf_counter() - began < 10


LINE = "Text of the page, a bit longer than a line so that it is surely an article of some kind."
DENSE = "".join(f"<p>The <a href=a>{a} line</a> began when <a href=b>the old canal</a> was closed and the <a href=c>valley had no other way</a> to send {a} <a href=d>coal</a>, and it ran until <a href=e>the great flood of that year</a> took the bridge.</p>" for a in ("north", "south", "east", "west", "hill"))


def plain(html):
    return "\n\n".join(" ".join(H.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</p><p>|</p>", html) if b.strip())


@pytest.mark.parametrize(
    "html,want",
    [
        (f"<nav><a href=x>Home</a></nav><article><h1>T</h1>{DENSE}</article><footer>c</footer>", "T\n\n" + plain(DENSE)),
        (f"<article><h1>Terms</h1><dl><dt>First<dd>{LINE}<dt>Second<dd>Shorter.</dl></article><footer>c</footer>", f"Terms\n\nFirst\n\n{LINE}\n\nSecond\n\nShorter."),
        (f"<nav><ul><li><a href=x>Home</a></ul></nav><article><p>{LINE}</p><h2>References</h2><ol><li><a href=x>A paper about it</a></li><li>Someone, <a href=x>Another</a>, 1999.</li></ol></article>", f"{LINE}\n\nReferences\n\nA paper about it\n\nSomeone, Another, 1999."),
        ("<article><p>Plain words only here.</p><p><a href=x>All of it is a link</a></p></article>", "Plain words only here.\n\nAll of it is a link"),
        (f"<!--[if IE]><p>x</p><![endif]--><article><p>{LINE}</p><![endif]--></article>", LINE),
        (f"<!DOCTYPE html [<!ELEMENT x>]><article><p>{LINE}</p></article>", LINE),
        (f"<!DOCTYPE html [<article><p>{LINE}</p><p>a[0]></p></article>", LINE + "\n\na[0]>"),
        (f"<article><p>{LINE}</p><![foo[x]]><p>{LINE}</p><![<p>{LINE}</p></article>", f"{LINE}\n\n{LINE}\n\n{LINE}"),
        (f"<!--><article><!-- a > b --><p>{LINE}<!---><!--x--!></p><!-- </article> never > ended", LINE + "\n\nnever > ended"),
        (f"<!-- </noscript> --><body><noscript><article><p>{LINE}</p></article>", LINE),
        (f"<script>var a='</button>'</script><body><button><article><p>{LINE}</p></article>", LINE),
        (f"<article><p>Before <span class='ad advert'>Buy now!</span> after. {LINE}</p><span class='newsletter notice'>Join our list</span><p>And <span class=name>more</span> words <a class=external href=x>here</a>.</p></article>", f"Before after. {LINE}\n\nAnd more words here."),
    ],
)
def test_articles_that_the_grammar_did_not_draw(html, want):
    assert X.main_texts([html], *X.trained()) == [want]


def test_ten_thousand_broken_pages():
    r = __import__("random").Random(8)
    bits = ["<![", "<![foo[x]]>", "<![CDATA[", "]]>", "<!", "<!-", "<!--", "-->", "<!DOCTYPE [<!ELEMENT x>]>", "<?x", "</", "<", ">", "<p", "<p class='", '"', "=", "&#x", "&#99999999;", "&lt", "<script>", "</script", "<noscript>", "<svg><p>", "</body>", "<head>", "<span class=ad>", "<table><td>", "<dl><dd>", "<a href=x>", "</a>", "<title>", "\x00", "\ud7ff", "text ", "é "]
    pages = ["".join(r.choice(bits) for _ in range(r.randint(1, 40))) for _ in range(10_000)]
    out = [t for i in range(0, len(pages), 500) for t in X.main_texts(pages[i : i + 500], *X.trained())]
    assert len(out) == len(pages) and all(isinstance(t, str) for t in out)


def test_declarations_take_linear_time():
    import time

    began = time.perf_counter()
    for page in ("<![" * 50_000, "<!doctype [" * 20_000, "<![cdata[" * 20_000, "<!-- " * 50_000, "<script> " * 50_000):
        X.parse(page)
    assert time.perf_counter() - began < 20
