import pytest

from strandlake.llm import html_text as h

ARTICLE = "This is the first paragraph of the article and it goes on for quite a while."
PAGE = f"""<!DOCTYPE html><html><head><title>No</title><style>p{{x:y}}</style><script>var a="<p>no</p>";</script></head><body>
<header class="site"><a href="/">Home</a> A site about things</header><nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies to make this site better for you and others.</p></div><!-- <p>hidden</p> -->
<main><article><h1>A heading</h1><p>{ARTICLE}<p>Second &amp; third&nbsp;words,   with <b>bold</b><br>and <a href="/x">a link</a> in them.
<div class="ad">Buy now, only today, a very good offer that nobody should miss at all</div><figure><figcaption>A caption</figcaption></figure>
<p>Last.</p></article><section id="comments"><h2>Comments</h2><p>I found this article very good and would like to read more of it.</p></section></main>
<aside>Some other stories that you may like to read as well as this one here</aside><form><label>Name</label><input value="x"><textarea>text</textarea></form>
<footer>&copy; Somebody 2024, all rights reserved in every country of the world</footer></body></html>"""


def test_article_alone_is_kept():
    got = h.main_text(PAGE).split("\n\n")
    assert got[:3] == ["A heading", ARTICLE, "Second & third words, with bold and a link in them."]
    assert got[-1] == "Last." and not any(x in " ".join(got) for x in ("Buy", "cookies", "Home", "I found", "rights", "stories", "hidden", "Name"))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""), ("", ""), ("<p>", ""), ("<script>never closed <p>x", ""),
        (f"<article><p>{ARTICLE} 1 < 2 &lt;b&gt; &am &copy &#65;&#x42;", f"{ARTICLE} 1 < 2 <b> &am © AB"),
        (f"<article><p title='a > b'>{ARTICLE}</p><p>cut off <a hr", f"{ARTICLE}\n\ncut off"),
        (f"<ARTICLE><P>{ARTICLE}</P></ARTICLE><NAV><A HREF=x>y</A></NAV>", ARTICLE),
    ],
)
def test_broken_and_small_pages(page, want):
    assert h.main_text(page) == want


def test_tree_fits_its_table_and_grows_the_same_each_time():
    tree = h.default_tree()
    assert tree == h.default_tree() and isinstance(tree, tuple)
    assert sum(h.kept(tree, row[:-1]) == bool(row[-1]) for row in h.TABLE) >= 0.97 * len(h.TABLE)


def test_very_long_page():
    page = "<article>" + "".join(f"<p>{ARTICLE} {i}</p>" for i in range(5000)) + "</article>"
    assert h.main_text(page).count("\n\n") == 4999


def test_tables(spark):
    rows = [(1, "u", PAGE, 1), (1, "u", PAGE, 1), (2, None, None, None), (None, "v", "", 2)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text int")
    got = h.extract(pages).collect()
    assert len(got) == 4 and all(r.n_chars == len(r.text) for r in got)
    assert h.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    "page",
    [
        f'<article><p>{ARTICLE}</p><svg class="i"/><p>{ARTICLE}</p></article>', f"<article><p>{ARTICLE}</p><button>Go<p>{ARTICLE}</p></article>",
        f"<article><p>{ARTICLE}</p><div><video src=x></div><p>{ARTICLE}</p></article><video></video>", f"<body class='home right-sidebar'><p>{ARTICLE}</p><p>{ARTICLE}</p></body>",
        f"<div class='content with-sidebar'><article><p>{ARTICLE}</p><p>{ARTICLE}</p></article></div>",
    ],
)
def test_nothing_is_lost_after_unclosed_elements_or_inside_hinted_ones(page):
    assert h.main_text(page) == f"{ARTICLE}\n\n{ARTICLE}"


def test_entry_header_in_an_article():
    assert h.main_text(f"<article><div class='entry-header'><h1>A title here</h1></div><p>{ARTICLE}</p></article>") == f"A title here\n\n{ARTICLE}"


NAV = "<nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav>"
FOOT = "<footer>All rights reserved by somebody in the year of the page and so on, with many words in this line of the footer of the page</footer>"
LONG = "This paragraph has more than twenty words in it so that everyone who reads the page can see that it is the text and not furniture."


@pytest.mark.parametrize(
    ("begin", "end"),
    [
        ("<body class='has-sidebar'>", "</body>"), ("<div class='single comments-open'>", "</div>"), ("<div class='main-content no-sidebar'>", "</div>"),
        ("<div class='content-rail-layout'>", "</div>"), ("<form id=all action=/x>", "</form>"), ("<p title='the hidden story'>", "</p>"),
    ],
)
def test_a_wrapper_is_no_furniture_whatever_its_class(begin, end):
    assert h.main_text(f"{begin}{NAV}<h1>The title</h1><p>{LONG}</p><p>{ARTICLE}</p>{FOOT}{end}") == f"The title\n\n{LONG}\n\n{ARTICLE}"


def test_furniture_that_holds_most_words_stays_furniture_beside_a_text():
    assert h.main_text(f"<div class=post><h1>The title</h1><p>{LONG}</p></div><div id=comments>{f'<p>{LONG} I agree.</p>' * 20}</div>") == f"The title\n\n{LONG}"
    assert h.main_text("<form><label>User name</label><label>Password</label><p>Forgot your password?</p></form>") == ""
    assert h.main_text(f"<div style='display: none'><p>{LONG}</p><p>{LONG}</p></div>") == ""
    assert h.main_text(f"<article><p>{LONG}</p><p class=warning>Mind the step.</p><p class=ad>Buy it now.</p><p>{LONG}</p></article>") == f"{LONG}\n\nMind the step.\n\n{LONG}"


@pytest.mark.parametrize("piece", ["<a ", '<a href="', "<a b='x\">", "<!--", "<script>", "</", "< ", "<svg>", "<p><textarea>", '<i x="y" ', "&amp", "<div class=ad>x"])
def test_broken_markup_takes_time_in_proportion(piece):
    import time

    def seconds(n):
        began = time.process_time()
        h.main_text(piece * (n // len(piece)))
        return time.process_time() - began

    seconds(1000)
    assert seconds(1_600_000) < 0.5 + 24 * seconds(200_000)  # eight times the length; sixty-four times if it were quadratic


def test_nested_unseen_elements_take_time_in_proportion():
    import time

    def seconds(n):
        page = "<div><svg>" * n + "</svg></div>" * n
        began = time.process_time()
        h.main_text(page)
        return time.process_time() - began

    seconds(100)
    assert seconds(40_000) < 0.5 + 24 * seconds(5_000)


def test_the_end_of_the_block_around_is_that_of_a_scan():
    import random
    import re

    def scan(page, name, at):
        depth = 1
        for m in re.compile(rf"<(/?){name}(?=[\s/>])", re.I).finditer(page, at):
            depth += -1 if m[1] else 1
            if not depth:
                return m.start()
        return -1

    rng = random.Random(2)
    for _ in range(200):
        page = "".join(rng.choice(["<div>", "</div>", "<DIV a>", "</div >", "<p>", "</P>", "<divan>", "<div", "<svg>", "</svg>", "x", "<", "<h1/>"]) for _ in range(40))
        look = h._Page(page)
        for at in [m.end() for m in re.finditer(">", page)]:
            for name in ("div", "p", "h1", "ul"):
                assert look.shut(name, at) == scan(page, name, at)


def _pieces(page):
    """Block texts as the standard parser sees them."""
    from html.parser import HTMLParser

    class Cutter(HTMLParser):
        def __init__(self):
            super().__init__()
            self.parts, self.out, self.unseen = [], [], 0

        def flush(self):
            text = " ".join("".join(self.parts).split())
            self.parts = []
            if text:
                self.out.append(text)

        def handle_starttag(self, tag, attrs):
            if tag in h.BLOCKS and not self.unseen:
                self.flush()
            self.unseen += tag in h.UNSEEN
            if tag == "br" and not self.unseen:
                self.parts.append(" ")

        def handle_endtag(self, tag):
            self.unseen -= tag in h.UNSEEN
            if tag in h.BLOCKS and not self.unseen:
                self.flush()

        def handle_data(self, data):
            if not self.unseen:
                self.parts.append(data)

    cutter = Cutter()
    cutter.feed(page)
    cutter.close()
    cutter.flush()
    return cutter.out


def test_blocks_are_those_of_the_standard_parser():
    import random

    rng = random.Random(8)
    words = ["one", "two ", " three", "&amp;", "&eacute;t&eacute;", "a<b>c</b>d", "4 < 5", "<br>", "\n", "<!-- <p>no</p> -->", "<i title='x > y'>z</i>", "&#x41;"]

    def some(depth):
        out = []
        for _ in range(rng.randint(1, 4)):
            kind = rng.random()
            if kind < 0.4 or depth > 5:
                out.append("".join(rng.choices(words, k=rng.randint(1, 5))))
            elif kind < 0.5:
                name = rng.choice(["script", "style", "textarea", "select", "noscript", "svg"])
                out.append(f"<{name} x='1'>{'unseen words' if name in ('script', 'style', 'textarea') else some(9)}</{name}>")
            elif kind < 0.6:
                out.append(f"<{rng.choice(['a', 'span', 'em'])} class=\"x\">" + some(9) + "</span>")
            else:
                name = rng.choice(["div", "P", "section", "article", "ul", "li", "td", "h2", "nav"])
                out.append(f"<{name} id=k{depth}>{some(depth + 1)}</{name}>")
        return "".join(out)

    for _ in range(400):
        page = some(0)
        assert [b.text for b in h.blocks(page)] == _pieces(page), page


LONG = " ".join(f"word{i} of the text" for i in range(10))
LINKS = [f"A linked thing {i}" for i in range(6)]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<article><h1>T</h1><p>%s</p><ul>%s</ul><p>End.</p></article>" % (LONG, "".join(f"<li><a href='/{i}'>{x}</a></li>" for i, x in enumerate(LINKS))), ["T", LONG, *LINKS, "End."]),
        (f"<article><p>{LONG}</p><ul><li><a href=a>Home</a></li><li><a href=b>News</a></li></ul></article>", [LONG]),
        (f"<article><p>{LONG}</p><div class='side-by-side'><p>{LONG}</p></div></article>", [LONG, LONG]),
        (f"<article><p>{LONG}</p><div class='search-results-explained'><p>{LONG}</p></div></article>", [LONG, LONG]),
        (f"<article><p>{LONG}</p><div class='side-column'><p>{LONG}</p></div></article>", [LONG]),
        (f"<body><div class='social'><p>{LONG}</p></div></body>", [LONG]),
        (f"<body><div class='social'><p>{LONG}</p></div><p>{LONG} too</p></body>", [f"{LONG} too"]),
        (f"<body><div class='cookie-notice'><p>{LONG}</p></div></body>", [""]),
        (f"<article><p>{LONG}</p><div class='social-bar'><a href=x>Post it there</a></div><div class='post-comments'><p>{LONG}</p></div><div class='ad-slot'>{LONG}</div></article>", [LONG]),
    ],
)
def test_what_an_article_keeps_of_links_and_marked_parts(page, want):
    assert h.main_text(page).split("\n\n") == want
