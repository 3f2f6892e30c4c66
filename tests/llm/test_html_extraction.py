import html
import re
import time

import pytest

from scholia.llm import html_extraction
from scholia.llm.boosting import BoostedTrees


@pytest.fixture(scope="module")
def trees():
    return html_extraction.model()


def test_made_pages_not_fitted_on(trees):
    maker, wrong, total = html_extraction.Maker(4321), 0, 0
    pages = [maker.page() for _ in range(60)]
    for page, text in zip(pages, html_extraction.texts_of(pages, trees)):
        pieces = sorted(p for x in html_extraction.parse(page) for p in x.pieces)
        want = [w for _, t in pieces for w in t.split() if w[0].lower() == "m"]
        got = text.split()
        wrong += len(set(got) ^ set(want))
        total += len(want)
    assert total > 5000 and wrong / total < 0.02


CASES = [
    ("<article><h1>Title</h1><p>One &amp; two&nbsp;three &lt;b&gt;.<p>Next\n  line</article>", "Title One & two three <b>. Next line"),
    ("<nav><a href=x>Home</a></nav><article><p>Text <b>bo</b>ld wor<i>d</i>s here.</p><script>var x='</p><p>no';</script><style>p{}</style></article><footer>Foot</footer>", "Text bold words here."),
    ("<article><p>Main text stands here, with words.</p><!-- <p>not</p> --><p>More of the main text.</p></article", "Main text stands here, with words. More of the main text."),
]


LINE = "The committee met again on Tuesday morning, and nothing at all was decided there."
#: A paragraph of an article that must stay, whatever its attributes say.
KEPT = [
    f'<p title="the hidden truth">{LINE}</p>', f'<p aria-hidden="false">{LINE}</p>', f'<p data-state="not hidden">{LINE}</p>', f'<p data-class="advert" data-id="sidebar">{LINE}</p>',
    f"<p title='style=display:none'>{LINE}</p>", f'<p data-x="{"<b>y</b> " * 1000}">{LINE}</p>', f'<p title=it\'s data-y="a>b">{LINE}</p>', f"<p x=y/>{LINE}</p>",
    f"<p>{LINE}</p><script src=x />var a = '<p>not this</p>';</script>", f"<script>var b = 1;</script foo><p>{LINE}</p>", f"<p>{LINE}</p><!--><!---><!-- never -->",
    f"<p>{LINE}<button hidden>Press</p>", f'<p style="color:red">{LINE}</p><p style="x:y; display : none">never</p>', f"<p>{LINE}</p><select><option>One<option>Two</select><template><p>never</p></template>",
]


@pytest.mark.parametrize("block", KEPT)
def test_attributes_and_odd_tags_lose_no_text(trees, block):
    page = f"<html><body><nav><a href=/>Home</a> <a href=/a>About</a></nav><article><h1>A title</h1><p>{LINE}</p>{block}<p>{LINE}</p></article><footer>Copyright</footer></body></html>"
    assert html_extraction.texts_of([page], trees) == [f"A title {LINE} {LINE} {LINE}"]


@pytest.mark.parametrize("before", ["", "<nav><a href=/>Home</a> <a href=/x>News</a></nav>"])
@pytest.mark.parametrize("after", ["", "<footer>Copyright and so on</footer>"])
@pytest.mark.parametrize("tag", ["article", "main"])
@pytest.mark.parametrize("words", [LINE, "Three words here.", LINE * 9])
def test_short_articles(trees, before, after, tag, words):
    assert html_extraction.texts_of([f"<html><body>{before}<{tag}><p>{words}</p></{tag}>{after}</body></html>"], trees) == [words]


def test_unclosed_button_formulas_and_objects(trees):
    page = f"<body><button>Menu<article><h1>Title</h1><p>{LINE}</p><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> hold, as <object>was said</object> before.</p><p>{LINE}</p></article>"
    assert html_extraction.texts_of([page], trees) == [f"Title {LINE} Let x=1 hold, as was said before. {LINE}"]


@pytest.mark.parametrize("deep", [600, 20_000])
def test_deep_nests_keep_their_ancestors(trees, deep):
    """What follows a deep nest still hangs where it stands: a sidebar's paragraph below the sidebar, the article's below the article."""
    page = f'<body><div class="sidebar">{"<div>" * deep}x{"</div>" * deep}<p>links and more links</p></div><article><h1>Title</h1><p>{LINE}</p>{"<span>" * deep}<p>{LINE}</p></article>'
    nodes = html_extraction.parse(page)
    (side,) = [x for x in nodes if any("links and" in t for _, t in x.pieces)]
    assert nodes[side.parent].tag == "div" and nodes[side.parent].parent == 0
    assert all(nodes[x.parent].tag == "article" for x in nodes if any(LINE in t for _, t in x.pieces))
    nest = f"<article><h1>Title</h1><p>{LINE}</p>{'<div>' * deep}<p>{LINE}</p>{'</div>' * deep}<p>{LINE}</p></article>"
    assert isinstance(html_extraction.texts_of([nest], trees)[0], str)


@pytest.mark.parametrize(("source", "text"), CASES)
def test_pages(trees, source, text):
    assert html_extraction.texts_of([source], trees) == [text]


@pytest.mark.parametrize("source", ["", "<", "<<<>>>", "</p></div>", "<p", "plain", "<article>" * 3000 + "x", "<b><i><p></b></i>", "a < b > c", "<!doctype", "<script>never closed", "&#xffffff;&bogus;&"])
def test_broken_markup_parses(trees, source):
    assert isinstance(html_extraction.texts_of([source], trees)[0], str)


@pytest.mark.parametrize("source", ["<div>" * 20_000 + "x", "<p><b>t" * 20_000, "<a x=\"1' " * 20_000 + ">", "<" * 50_000 + ">", "<!-- a " * 20_000 + ">", "<a href='" * 3000 + "<" * 50_000, "<a " * 100_000 + 'x=">"', "<div>" * 20_000 + "</x>" * 20_000, "<li>x" * 20_000, "<div>" * 10_000 + "<li>x" * 10_000, "<script>" * 50_000, "<p x='" * 50_000 + ">"])
def test_hostile_markup_takes_linear_time(source):
    began = time.process_time()
    html_extraction.parse(source)
    assert time.process_time() - began < 5


def test_places_of_text():
    said = lambda s: " ".join("".join(t for x in html_extraction.parse(s) for _, t in x.pieces).split())
    assert said("<p>x<!-- never <p>y") == "x" and said("<a title='a>b'>k</a> <p") == "k" and said("a<br>b<!-- > -->c") == "a bc"


def test_table_of_pages(spark, trees):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r for r in html_extraction.extracted(pages, trees).collect()}
    for r in pages.collect():
        inner = r.html.split("<article>", 1)[1].split("</article>")[0]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>?", " ", inner)).split())
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)
    odd = spark.createDataFrame([(1, None, None, "x"), (None, "u", "", "x"), (2, "u", CASES[0][0], "x"), (2, "u", CASES[0][0], "x")], "page_id long, url string, html string, text string")
    rows = [tuple(r) for r in html_extraction.extracted(odd, trees).collect()]
    assert sorted(rows, key=str) == sorted([(1, None, "", 0), (None, "u", "", 0), (2, "u", CASES[0][1], len(CASES[0][1]))] + [(2, "u", CASES[0][1], len(CASES[0][1]))], key=str)
    assert html_extraction.extracted(odd.limit(0), trees).count() == 0


def test_boosted_trees_learn_an_exclusive_or():
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = BoostedTrees(rounds=40, depth=3, rate=0.4).fit(x[:1500], y[:1500])
    assert ((model.log_odds(x[1500:]) > 0) == y[1500:]).mean() > 0.95
