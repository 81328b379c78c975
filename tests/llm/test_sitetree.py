from varkit.llm import sitetree as S

SCHEMA = "page_id long, url string, html string, text string, host string, path string"


def _extract(spark, pages, **kw):
    df = spark.createDataFrame([(i, u, h, "t", "h", "p") for i, u, h in pages], SCHEMA)
    return {r.page_id: r for r in S.extract(df, **kw).collect()}


def _text(source):
    return S.Page(source).text()


def test_furniture_markup_and_references():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="page"><header>H</header><nav><ul><li><a href="/x">Menu</a></ul></nav>
    <div class="cookie-notice">We use cookies</div><form>Name <input></form><!-- hidden <p>no</p> --><article><h1>One &amp; two</h1><script>var t="</p>";x(1<2);</script>
    <p>A <b>bold</b>\n\t word&nbsp;&eacute;&#8364;&lt;p&gt;<br>next line<p>unclosed <i>i<p>3 < 4 &bogus; <ul><li>x<li>y</ul><div class='share-bar'>Share</div>
    <section id="comments"><p>First!</p></section><aside>side</aside></article><div id="sidebar">s</div><footer>F</footer></body></html>"""
    assert _text(page) == "One & two\nA bold word é€<p>\nnext line\nunclosed i\n3 < 4 &bogus;\nx\ny"


def test_class_words_do_not_take_the_article():
    body = "<h1 class='entry-header'>Title</h1><p>The article's own words</p><div class='share-bar'>Share</div>"
    want = "Title\nThe article's own words"
    for around in ("class='content has-sidebar'", "id='search-results'", "class='layout-header-fixed'", "class='sidebar'", "class=widget"):
        assert _text(f"<body><div {around}><article>{body}</article></div><div class=footer>Imprint</div></body>") == want, around
    assert _text("<body><form id=f><div><p>All of it</p><p>in a form</p></div></form></body>") == "All of it\nin a form"
    assert _text(f"<article>{body}</article><div class=sidebar><article><p>{'A long teaser ' * 9}</article></div>") == want
    assert _text(f"<div id=content><p>{'Long text. ' * 9}</p></div><div class=sidebar><article>teaser</article></div>") == ("Long text. " * 9).strip()


NOISE = ("post-comments commentlist reader-comments disqus_thread comments comment-form ad ad-slot adverts sponsored-content article-sidebar sidebar related-posts "
         "related main-menu menu nav-links site-nav page-header site-header site-footer post-footer newsletter-signup subscribe cookie-banner consent-popup "
         "breadcrumbs social-links share-bar promo-box").split()


def test_furniture_names_inside_the_article():
    """Usual names of furniture go, whatever words they are made of; names of states and of an article's parts stay."""
    body = "The article has a good many words of its own, in a paragraph like this one"
    for name in NOISE:
        for attribute in (f"class='{name}'", f"id={name}", f"class='x-{name} y'" if name not in ("share-bar", "page-header", "site-header", "cookie-banner") else f"class='{name} y'"):
            assert _text(f"<article><h1>T</h1><p>{body}</p><div {attribute}><p>Noise here</p></div><p>End</p></article>") == f"T\n{body}\nEnd", attribute
    for name in ("has-sidebar", "entry-header", "article-header", "elementor-widget-text", "comments-open", "market-share", "story-text"):
        assert _text(f"<article><p>{body}</p><div class={name}><p>Kept</p></div></article>") == f"{body}\nKept", name


def test_titles_and_text_beside_the_main_element():
    assert _text("<div class=post><header><h1>Title</h1></header><p>Body</p></div><header>Site</header>") == "Title\nBody"
    assert _text("<body><header><h1>Site</h1></header><h1>Title</h1><main><p>Body</p></main><section><h2>More</h2><p>of it</p></section><div>Imprint</div>") == "Title\nBody\nMore\nof it"
    assert _text("<body><h1>Site</h1><article><h1>Title</h1><p>Body</p></article><section class=related><p>Others</p></section>") == "Title\nBody"
    assert _text("<p>Buy <button>Now</button> it <select><option>1<option>2</select>here") == "Buy it here"
    assert _text("<p>Buy <button>Now it") == "Buy Now it" and _text("<button>" * 20_000 + "x") == "x"


def test_pages_made_from_known_text(spark):
    """Whole pages put together from a known main text and furniture around and between its blocks, on hosts of all sizes."""
    import random
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    line = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    pages, want = [], {}
    for host, n in (("one.com", 1), ("few.com", 6), ("many.com", 60)):
        menu = f"<nav><a href=/>{line(3)}</a></nav><div class=top>{line(4)}</div>"
        for i in range(n):
            title, blocks = line(5), [line(rnd.randrange(8, 40)) for _ in range(rnd.randrange(3, 9))]
            parts = [f"<p>{b.replace(' ', '  ', 1)}</p>" for b in blocks]
            for name in rnd.sample(NOISE, 3):
                parts.insert(rnd.randrange(len(parts) + 1), f"<div class='{name}'><p>{line(4)}</p></div>")
            around = rnd.choice(["<main>{}</main>", "<div class='content has-sidebar'><article>{}</article></div>", "<div id=search-results><article>{}</article></div>"])
            page = around.format(f"<header><h1>{title}</h1></header>" + "".join(parts) + f"<form>{line(2)}<button>{line(1)}</button></form>")
            pages.append((len(pages), f"http://{host}/{i}", f"<html><head><title>{title}</title></head><body>{menu}{page}<footer>{line(5)}</footer></body></html>"))
            want[len(pages) - 1] = "\n".join([title, *blocks])
    got = _extract(spark, pages)
    assert {i: r.text for i, r in got.items()} == want


def test_small_hosts_by_prior(spark):
    """Unmarked blocks that all pages of a host repeat go from four pages on, without a switch at a number of pages."""
    own = [f"Story {i} has words {i * 7}" for i in range(11)]
    for n, gone in ((2, False), (3, False), (4, True), (11, True)):
        got = _extract(spark, [(i, f"http://a.com/{i}", f"<body><div>Alpha Site welcomes you</div><div class=story><p>{own[i]}</p></div></body>") for i in range(n)])
        assert {r.text for r in got.values()} == {own[i] if gone else f"Alpha Site welcomes you\n{own[i]}" for i in range(n)}, n


def test_odd_markup():
    assert _text("") == "" and _text("<") == "<" and _text("plain  text") == "plain text"
    assert _text("<p>a</p></div></p><p>b") == "a\nb"
    assert _text("<nav>menu<article><p>body</article>") == "body"
    assert _text('<article><p title="a>b">x</p><script>never closed <p>y</p>') == "x"
    assert _text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert _text("<article>" + "<p>" + "word " * 100_000) == ("word " * 100_000).strip()
    assert _text("<table><tr><td>1<td>2<tr><td>3</table>") == "1\n2\n3"
    assert _text("<textarea><p>no</textarea><!-- open <p>no") == ""


def _site(n, host="a.com"):
    return [(i, f"http://{host}/{i}", f"<body><div><b>Alpha Site</b> welcomes you</div><div class=story><p>Story {i} has words {i * 7}</p><p>and {i * 3} more</p></div>"
             f"<div><span>Imprint</span> and terms {i % 2}</div></body>") for i in range(n)]


def test_large_ids_beside_null_are_kept(spark):
    pages = [(2**53 + 1, "http://a/", "<p>x</p>"), (None, "http://a/", "<p>y</p>"), (2**53 + 3, "http://a/", "")]
    df = spark.createDataFrame([(i, u, h, "t", "h", "p") for i, u, h in pages], SCHEMA).coalesce(1)
    assert {(r.page_id, r.text) for r in S.extract(df).collect()} == {(2**53 + 1, "x"), (None, "y"), (2**53 + 3, "")}


def test_tree_removes_what_a_site_repeats(spark):
    got = _extract(spark, _site(40) + [(100, "http://b.org/", _site(1)[0][2]), (101, None, None)])
    for i in range(40):
        assert got[i].text == f"Story {i} has words {i * 7}\nand {i * 3} more"
    assert got[100].text.startswith("Alpha Site welcomes you")          # one page says nothing about its site
    assert got[101].text == "" and got[101].n_chars == 0 and got[101].host == ""


def test_repeated_blocks_inside_the_main_element(spark, monkeypatch):
    """A line and a list that an article has on every page go; what some pages share, and copies and near copies, stay."""
    own = [f"Page {i} tells its own story at some length, in words of number {i * 7}" for i in range(40)]
    line, links = "<p>Subscribe to our letter</p>", "<ul><li>Read this</li><li>Read that</li></ul>"
    pages = [(i, f"http://a.com/{i}", f"<body><article><h1>Title {i}</h1><p>{t}</p>{line}<p>Part {i % 2}</p>{links}</article></body>") for i, t in enumerate(own)]
    near = [(i + 100, f"http://b.com/{i}", f"<body><article><p>{own[0]}</p><p>{own[1]}</p><p>note {i}</p></article></body>") for i in range(40)]
    few = [(i + 200, f"http://c.com/{i}", pages[i][2]) for i in range(11)]
    for nodes in (S.BROADCAST_NODES, -1):
        monkeypatch.setattr(S, "BROADCAST_NODES", nodes)
        got = _extract(spark, pages + near + few)
        for i, t in enumerate(own):
            assert got[i].text == f"Title {i}\n{t}\nPart {i % 2}"
            assert got[i + 100].text == f"{own[0]}\n{own[1]}\nnote {i}"
        assert "Subscribe" in got[200].text


def test_low_nodes_joined_instead_of_broadcast(spark, monkeypatch):
    pages = _site(40) + [(200, *_site(13, "c.net")[12][1:])] + [(None, "http://a.com/", _site(1)[0][2]), (201, "http://a.com/3", _site(4)[3][2])]
    one = sorted((str(k), v.text) for k, v in _extract(spark, pages).items())
    monkeypatch.setattr(S, "BROADCAST_NODES", -1)
    assert sorted((str(k), v.text) for k, v in _extract(spark, pages).items()) == one


def test_copies_of_one_article_stay(spark):
    """A site that repeats an article on every page loses neither marked nor unmarked ones."""
    marked = [(i, "http://a.com/", "<body><div><article><p>The same text</p><div>and this</div></article></div><footer>f</footer>") for i in range(30)]
    bare = [(i + 50, "http://b.com/", "<body><div><p>The same text</p></div></body>") for i in range(30)]
    got = _extract(spark, marked + bare)
    assert got[3].text.startswith("The same text") and got[60].text == "The same text"


def test_importance_is_entropy(spark):
    counts = spark.createDataFrame([("h", "", 0, 0, 4), ("h", "", 1, 1, 4), ("h", "/a", 0, 0, 4), ("h", "/a", 1, 1, 2), ("h", "/a", 1, 2, 2),
                                    ("h", "/a", 2, 7, 4), ("h", "/b", 0, 0, 4), ("h", "/b", 1, 1, 4)] + [("h", "/b", 2, i, 1) for i in range(4)],
                                   "host string, path string, kind int, feature long, n long")
    got = {r.path: r for r in S.node_importance(counts).collect()}
    assert abs(got["/a"].presentation - 0.5) < 1e-12 and abs(got["/a"].content) < 1e-12 and got["/a"].importance < 1e-12
    assert got["/b"].importance == 1.0 and 0.3 < got[""].importance < 0.6


def test_query_and_empty_table(spark):
    from varkit.llm.queries import op3
    rows = op3(spark, "/root/testdata/sf0.001").collect()
    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == _text(pages[r.page_id]) and r.n_chars == len(r.text) and "<" not in r.text[:1]
    assert _extract(spark, []) == {}
