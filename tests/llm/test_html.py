import html
import itertools
import re
import time

import numpy as np
import pytest

from trajspark.llm import html_extract as h
from trajspark.llm.labelled_pages import PAGES


def hand_model():
    from collections import Counter

    counts = Counter()
    for p in PAGES:
        d = h.parse(p)
        counts.update(h.count_page(d, h.own_labels(d)))
    return h.Model.of({k: h.HAND_WEIGHT * v for k, v in counts.items()})


def brute_marginals(model, forest):
    """Sum over all labellings of one small page."""
    d = forest.doms[0]
    n, out, z = len(d.tags), np.zeros(len(d.tags)), 0.0
    for y in itertools.product((0, 1), repeat=n - 1):
        y = (0, *y)
        s = sum(model.odds.get(k, 0.0) for i in range(1, n) if y[i] for k in forest.evidence(i, d, i))
        s += sum(model.edges.get(d.tags[i], model.edges[""])[y[d.parents[i]], y[i]] for i in range(1, n))
        z += np.exp(s)
        out += np.exp(s) * np.array(y)
    return out / z


@pytest.mark.parametrize("page", ["<p>one</p>", "<div class=ad><a href=x>y</a></div><article><h1>T</h1><p>Text of it <b>bold</b><p>more</article>", "<ul><li>a<li>b</ul><main><p>hello there"])
def test_messages_give_exact_marginals(page):
    model, forest = hand_model(), h.Forest.of([h.parse(page)])
    got = model.marginals(forest)
    assert np.allclose(got, brute_marginals(model, forest), atol=1e-9)
    twice = h.Forest.of([h.parse(page), h.parse("<p>x</p>"), h.parse(page)])
    both = model.marginals(twice)
    assert np.allclose(both[: len(got)], got) and np.allclose(both[-len(got) :], got)


def test_parsing():
    d = h.parse("<p>a &amp; b<br>c<p>d</p><script>var x='</p>'</script><!-- e --><style>f</style>&lt;g&am <b>h</b> i<textarea>j</textarea><img alt='>'>k <a title=\"x>y\">l</a")
    assert h.text_of(d, np.ones(len(d.tags), bool)) == "a & b c\nd\n<g&am h ik l"
    assert h.text_of(h.parse("<ul><li>x <li>y</ul><table><tr><td>1<td>2</table>\xa0 z \n"), np.ones(99, bool)) == "x\ny\n1\n2\nz"
    assert h.parse(None).runs == [] and h.parse("").runs == []
    assert h.text_of(h.parse("<script>never closed <p>x"), np.ones(9, bool)) == ""


@pytest.mark.parametrize(
    "raw",
    [
        "<script>for(i=0;i<n;i++){}</script>", "<script>if(a<b)x=\"it's</script>", "<script>s='<!--'</script >", "<SCRIPT>a<b</Script\n>", "<style>a:after{content:'<b'}</style>",
        "<textarea>a<b \"</textarea>", "<title>x<y '</title>", "<script>'</scripts>'<x</script>", "<script src='x'/>var x = 1;</script>", "<script src=/a/>var y=2;</script>", "<style media=x/>p {}</style>", "<noembed>q</noembed>", "<xmp><p>r</xmp>", "<svg><style/></svg>", "<svg/>", "<template><p>x<b>y</template>", "<svg><path d='M0'/>",
    ],
)
def test_raw_elements_end_at_their_own_tag(raw):
    d = h.parse(f"<p>before</p>{raw}<p>after it</p><p>end</p>")
    assert h.text_of(d, np.ones(len(d.tags), bool)) == "before\nafter it\nend"


def test_formulas_and_objects_are_elements():
    d = h.parse("<p>so <math><mi>x</mi><mo>&lt;</mo><mn>2</mn></math> holds</p><object><p>shown</p></object><svg><title>t</title><text>axis</text></svg>")
    assert h.text_of(d, np.ones(len(d.tags), bool)) == "so x<2 holds\nshown\naxis" and {"math", "mi", "object", "svg"} <= set(d.tags)


def test_unseen_layouts():
    model = hand_model()
    p = "Here is a sentence that somebody wrote for readers, with a comma, and then it goes on for a while."
    page = f'<body><div class="menu"><ul><li><a href=1>Home</a><li><a href=2>News</a></ul></div><div class="article-body"><h1>Head</h1><p>{p}</p><div class="share"><a href=3>Share</a></div><p>{p}</p><div class="comments"><div class="comment"><p>{p}</p></div></div></div><div class="footer">Terms</div></body>'
    assert h.extract([page], model) == [f"Head\n{p}\n{p}"]


def test_pages_of_the_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r for r in h.extract_pages(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S).group(1)
        blocks = re.split(r"</?(?:p|h1)>", article)
        want = "\n".join(x for x in (" ".join(html.unescape(re.sub(r"<br>|</?b>", " " if "br" in b else "", b)).split()) for b in blocks) if x)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


def test_null_empty_and_repeated_pages(spark):
    page = "<body><nav><a href=x>Home</a></nav><article><h1>Title</h1><p>Words of the article, enough to matter to a reader.</p></article></body>"
    rows = [(1, "u", page, "x"), (1, "u", page, "x"), (2, None, None, "y"), (3, "v", "", "z"), (None, "w", "no markup", "n"), (4, "b", page[:70], "t"), (5, "l", page + "<p>tail</p>" * 3000, "t")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = h.extract_pages(pages).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert by[1].text == by[5].text[: len(by[1].text)] == "Title\nWords of the article, enough to matter to a reader." and by[2].text == by[3].text == "" and by[2].n_chars == 0
    assert h.extract_pages(pages.limit(0)).collect() == []


def test_deep_nesting_is_linear():
    deep = "<article><p>kept text of some length here</p>" + "<div>" * 50_000 + "<p>x" + "</div>" * 50_000 + "</article>"
    start = time.time()
    dom = h.parse(deep)
    assert time.time() - start < 5 and max(dom.levels) == 50_002
    dom = h.parse("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><p>e<p>f<table><tr><td>g<td>h<tr><td>i</table>")
    below = [(t, dom.tags[p]) for t, p in zip(dom.tags[1:], dom.parents[1:], strict=True)]
    assert below == [("ul", "#root"), ("li", "ul"), ("li", "ul"), ("ul", "li"), ("li", "ul"), ("li", "ul"), ("p", "#root"), ("p", "#root"), ("table", "#root"), ("tr", "table"), ("td", "tr"), ("td", "tr"), ("tr", "table"), ("td", "tr")]


_A = "The first paragraph says at some length what happened, where it happened and to whom, with a clause or two."
_B = "A second one goes on with the story; it has commas, numbers such as 12, and a closing thought for the reader."
_NAV = "".join(f'<a href="/{x}">{x}</a> ' for x in ("start", "latest", "archive", "team"))

#: Pages of different makes, none with an article element, and what a reader would copy out of them.
TEMPLATES = {
    "main": (
        f"<html><head><title>T</title><script>for(var i=0;i<n;i++){{document.write('<p>no</p>')}}</script></head><body><header><nav>{_NAV}</nav></header><main><h1>Big news</h1><p>{_A}</p><p>{_B}</p></main><footer>All rights reserved</footer></body></html>",
        ["Big news", _A, _B],
    ),
    "divs": (
        f'<body><div class="menu">{_NAV}</div><div class="post-content"><h2>Small news</h2><p>{_A}</p><div class="advert">Buy a car now</div><p>{_B}</p></div><div class="sidebar"><p>{_NAV}</p></div><div class="footer">Imprint</div></body>',
        ["Small news", _A, _B],
    ),
    "comments": (
        f'<div id="nav"><ul><li>{_NAV}</li></ul></div><div id="content"><h1>On the topic</h1><p>{_A}</p><p>{_B}</p><ul><li>a point of some weight</li><li>and another one</li></ul></div><div id="comments"><div class="comment"><p>I read it all and I disagree with it.</p></div></div>',
        ["On the topic", _A, _B, "a point of some weight", "and another one"],
    ),
    "roles": (
        f'<div role="navigation">{_NAV}</div><section role="main" class="story"><h1>At length</h1><p>{_A}<p>{_B}<blockquote>{_A}</blockquote></section><form class="newsletter"><label>Mail</label><button>Go</button></form><div role="contentinfo" class="footer"><a href="/x">Terms</a></div>',
        ["At length", _A, _B, _A],
    ),
    "table": (
        f'<table><tr><td class="sidebar">{_NAV}</td><td class="content"><h1>Old style</h1><p>{_A}</p><p>{_B}</p></td></tr></table><div class="cookie notice">We use cookies</div>',
        ["Old style", _A, _B],
    ),
    "math": (
        f'<nav>{_NAV}</nav><div class="entry body"><h1>Sums</h1><p>{_A} <math><mi>x</mi><mo>=</mo><mn>1</mn></math></p><p>{_B}</p></div><!-- <p>gone</p> --><style>p{{}}</style><div class="popup"><p>Join us</p></div>',
        ["Sums", _A + " x=1", _B],
    ),
    "wiki": (f'<div id="mw-head">{_NAV}</div><div id="bodyContent" class="content"><h1>A topic</h1><p>{_A}</p><div class="toc menu"><ul><li><a href="#1">One</a></li><li><a href="#2">Two</a></li></ul></div><h2>One</h2><p>{_B}</p><h2>Two</h2><p>{_A}</p></div><div id="footer" class="footer">Text is free to use</div>', ["A topic",_A,"One",_B,"Two",_A]),
    "forum": (f'<div class="breadcrumb"><a href="/">Board</a> <a href="/q">Questions</a></div><div class="post body"><h1>How is it done</h1><p>{_A}</p><pre>run it --now</pre><p>{_B}</p></div><div class="comments"><div class="comment">Me too</div><div class="comment"><p>{_A}</p></div></div>', ["How is it done",_A,"run it --now",_B]),
    "shop": (f'<header class="site-header"><form class="search"><input></form>{_NAV}</header><div class="text description content"><h1>A kettle</h1><p>{_A}</p><ul><li>holds two litres of water</li><li>comes in red, green and blue</li></ul><p>{_B}</p></div><aside class="related"><h3>Others bought</h3>{_NAV}</aside>', ["A kettle",_A,"holds two litres of water","comes in red, green and blue",_B]),
    "broken": (f'<body><div class=nav>{_NAV}</div><div class=entry><h1>Unclosed</h1><p>{_A}<p>{_B}<script src=/x.js/>var q = "<p>never</p>";</script><p>{_A}</div><div class="social share"><a href=#>Share</a>', ["Unclosed",_A,_B,_A]),
    "frames": (f'<div class="banner ad"><iframe src=x/><p>fallback</p></iframe>Ad</div><section class="story body"><h1>Framed</h1><p>{_A}</p><noembed>old</noembed><p>{_B}</p></section><nav class="pagination"><a href=1>1</a><a href=2>2</a></nav>', ["Framed",_A,_B]),
}


@pytest.mark.parametrize("name", sorted(TEMPLATES))
def test_templates_without_an_article_element(name):
    page, want = TEMPLATES[name]
    assert h.extract([page], hand_model()) == ["\n".join(want)]
