"""Pages written by hand, in layouts that no generator made: what stays is the article, in the lines given."""

import pytest

from veltra.llm import html_extract

PAGES = {
    "links in the article": (
        """<html><body><nav><a href=/>Home</a> <a href=/x>News</a></nav><article><h1>Floods in the valley</h1><p>The river rose by two metres on Monday,
        and the bridge was closed. Nobody was hurt.</p><h2>Further reading</h2><ul><li><a href=a>Further reading on floods</a></li><li><a href=b>Harbour</a></li></ul></article>
        <aside class=related><h3>More</h3><ul><li><a href=z>Old story</a></li></ul></aside><footer>Imprint</footer></body></html>""",
        ["Floods in the valley", "The river rose by two metres on Monday, and the bridge was closed. Nobody was hurt.", "Further reading", "Further reading on floods", "Harbour"],
    ),
    "links and sharing": (
        """<body><article><h1>Floods in the valley</h1><p>The river rose by two metres on Monday, and the bridge was closed.</p><ol><li><a href=a>A map of the river</a></li>
        <li><a href=b>Harbour</a></li></ol><p>It fell again on Tuesday.</p><div class="share-tools"><ul><li><a href=q>Share</a></li><li><a href=w>Tweet</a></li></ul></div></article>""",
        ["Floods in the valley", "The river rose by two metres on Monday, and the bridge was closed.", "A map of the river", "Harbour", "It fell again on Tuesday."],
    ),
    "details": (
        """<body><main><h1>Rulers</h1><p>A long text that says a lot about rulers. And more of it.</p><details><summary>How it was measured</summary><p>With a long ruler,
        on two days.</p></details></main><footer><p>Copyright by us.</p></footer>""",
        ["Rulers", "A long text that says a lot about rulers. And more of it.", "How it was measured", "With a long ruler, on two days."],
    ),
    "script fallback": (
        "<body><article><noscript>Please enable JavaScript</noscript><p>A long text that says a lot about rulers. And more of it.</p></article>",
        ["A long text that says a lot about rulers. And more of it."],
    ),
    "a blog": (
        """<html><head><title>My blog</title></head><body><div id="masthead"><h2>My blog</h2><p>Words about birds</p></div><div id="menu-main"><ul><li><a href="/">Start</a></li>
        <li><a href="/about">About</a></li></ul></div><div class="post-content"><h1>Seven herons</h1><p>This morning there were seven herons at the pond. They stood
        in a row and looked at the water.</p><blockquote>Never seen so many, said a neighbour.</blockquote><p>Tomorrow I will go again.</p></div><div class="comments-area">
        <h3>2 replies</h3><div class="comment"><p>Anna: How nice! I saw two of them last week, near the mill.</p></div></div><div id="sidebar"><h3>Archive</h3><ul><li><a href="/5">May</a></li>
        <li><a href="/6">June</a></li></ul></div><div id="footer"><p>&copy; Birds. All rights reserved.</p></div></body></html>""",
        ["Seven herons", "This morning there were seven herons at the pond. They stood in a row and looked at the water.", "Never seen so many, said a neighbour.", "Tomorrow I will go again."],
    ),
    "a recipe": (
        """<body><header><a href=/>Kitchen</a></header><main><article class="recipe"><h1>Plain bread</h1><ul><li>500 g of flour</li><li>a little salt</li><li>300 ml of water</li></ul>
        <h2>How to</h2><p>Mix it all and wait for an hour. Bake it until it is brown.</p><div class="ad-box"><p>Buy our new oven today!</p></div></article></main>
        <div class="cookie-banner"><p>We use cookies. Read more in our policy.</p><button>Accept</button></div>""",
        ["Plain bread", "500 g of flour", "a little salt", "300 ml of water", "How to", "Mix it all and wait for an hour. Bake it until it is brown."],
    ),
    "an old table layout": (
        """<html><body><table><tr><td class="nav"><a href=1>One</a><br><a href=2>Two</a></td><td><h1>On tables</h1><p>Once all pages were made of tables. They had cells for
        everything, and cells within cells. This one has two of them.</p></td></tr></table><div class=footer>Made by hand in 1999.</div></body></html>""",
        ["On tables", "Once all pages were made of tables. They had cells for everything, and cells within cells. This one has two of them."],
    ),
}


@pytest.fixture(scope="module")
def model():
    return html_extract.default_model()


@pytest.mark.parametrize("name", PAGES)
def test_page(model, name):
    page, lines = PAGES[name]
    assert html_extract.extract(page, model).split("\n") == lines


def test_the_model_is_kept(spark, model, monkeypatch):
    assert html_extract.stored_model(spark) == model
    monkeypatch.setattr(html_extract, "train", lambda *a: pytest.fail("trained again"))
    html_extract.default_model.cache_clear()
    kept = html_extract.stored_model(spark)
    assert kept == model
