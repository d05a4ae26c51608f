"""Small hand-labelled pages. ``data-main="1"`` marks content with all below it, ``data-main="0"`` what is not."""

_P = "Plain sentences that a reader came for, in a paragraph of some length, with commas, and one more clause."
_LONG = " ".join([_P] * 4)
_MENU = "".join(f'<li><a href="/{x}">{x}</a></li>' for x in ("home", "news", "sport", "about", "contact"))

PAGES = [
    f"""<html><head><title>t</title></head><body><header class="site-header"><a href="/">Logo</a><nav class="menu"><ul>{_MENU}</ul></nav></header>
    <main data-main="1"><h1>Title of it</h1><p>{_LONG}</p><h2>Part</h2><p>{_P}</p><blockquote>{_P}</blockquote><ul><li>first point</li><li>second point</li></ul>
    <aside data-main="0" class="related"><h3>Related</h3><ul>{_MENU}</ul></aside><p>{_P} <a href="x">a link</a> <em>and so on</em>.</p></main>
    <aside class="sidebar widget"><h3>Popular</h3><ul>{_MENU}</ul></aside><footer class="site-footer"><p>All rights reserved</p></footer></body></html>""",
    f"""<html><body><div id="cookie-notice" class="cookie banner notice"><p>We use cookies to give you a better visit.</p><button>Accept</button></div>
    <div class="nav top-menu"><ul>{_MENU}</ul></div><div class="content post-content entry article-body" data-main="1"><h1>Another title</h1><p>{_LONG}</p><p>{_P}</p>
    <div class="ad advert sponsored" data-main="0">Buy this thing today</div><p>{_P}</p><table><tr><td>one</td><td>two</td></tr></table>
    <div class="share social" data-main="0"><a href="#">Share</a> <a href="#">Tweet</a></div></div>
    <div id="comments" class="comments comment-list"><h3>2 comments</h3><div class="comment"><p>{_P}</p></div><div class="comment"><p>{_LONG}</p></div></div>
    <div class="footer copyright"><p>Imprint and terms</p></div></body></html>""",
    f"""<html><body><div id="wrapper"><div id="header">The site name</div><div id="main"><article data-main="1"><header data-main="1"><h1>A third title</h1></header>
    <section class="text body"><p>{_LONG}</p><p>{_LONG}</p><pre>some code here</pre><figure><figcaption>What the picture shows</figcaption></figure></section>
    <form class="newsletter subscribe" data-main="0"><label>Your e-mail</label><input name="q"></form>
    <section class="comments" id="comments" data-main="0"><h2>Comments</h2><ol><li class="comment reply"><p>{_P}</p></li></ol></section></article></div>
    <div id="sidebar"><div class="promo ad"><p>{_P}</p></div></div><div id="footer"><p>{_P}</p></div></div></body></html>""",
    f"""<html><body><nav class="breadcrumb"><a href="/">Home</a> <a href="/a">A</a></nav><div class="story" role="main" data-main="1"><h1>The fourth</h1><div class="paragraph">{_LONG}</div>
    <div class="paragraph">{_P}</div><div class="paragraph">{_LONG}<br>{_P}</div></div><form class="search" role="search"><p>Search this site</p><input></form>
    <div class="popup modal" role="dialog"><p>Sign up for our letter, it is free and comes weekly.</p></div><div class="tags links"><a href="1">one</a><a href="2">two</a></div>
    <footer role="contentinfo"><div class="legal disclaimer">{_P}</div></footer></body></html>""",
]
