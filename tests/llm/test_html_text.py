"""HTML extraction on hand-written pages and against the plain article of the test pages."""

import html
import random
import re
import time

import pytest

from panelspark.llm import html_text

CASES = [
    ("", []),
    ("plain &amp; simple\n text", ["plain & simple text"]),
    ("<p>a<p>b<br>c<div>d</div>e", ["a", "b c", "d", "e"]),
    ("<body><nav>menu</nav><article><h1>T &lt;x&gt;</h1><p>one <b>two<br></b>three</p><ul><li>l1<li>l2</ul></article><footer>f</footer>", ["T <x>", "one two three", "l1", "l2"]),
    ("<article><p>x</p><script>var a='</p><p>no';</script><style>p{}</style><!-- <p>no</p> --><p>y</article><p>out", ["x", "y"]),
    ("<main><div class='cookie-notice'>c</div><p>m</p><section id=comments><p>r</p></section></main>", ["m"]),
    ("<div class='post ad-free'>kept?</div><p>b</p>", ["b"]),
    ("<article><p><b>A<br><p>B</p></article>", ["A", "B"]),
    ("<article><p>1 < 2 && 3 > 2 &am; &copy; &#233;&nbsp;z</p></article>", ["1 < 2 && 3 > 2 &am; © é z"]),
    ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
    ("<article><header><h1>h</h1></header><p>t</p><form><p>q</p></form></article><header>site</header>", ["h", "t"]),
    ("<p title='a>b'>t</p><p title=\"unclosed>u</p>", ["t", '<p title="unclosed>u']),
]


@pytest.mark.parametrize(("page", "want"), CASES)
def test_blocks(page, want):
    assert html_text.main_blocks(page) == want


#: A story that other elements' articles, layout classes or a form around the page once hid.
HELD = [
    ("<main><p>story</p><section id=comments><article class=comment><p>c</p></article></section></main>", ["story"]),
    ("<div><p>story</p></div><aside><article><p>teaser</p></article></aside>", ["story"]),
    ("<main><p>a long story of many words</p><article><p>teaser</p></article></main>", ["a long story of many words", "teaser"]),
    ("<main><p>a list of other pages, longer</p><article><h1>T</h1><p>s</p></article></main>", ["T", "s"]),
    ("<div class='layout has-sidebar'><article><p>story</p></article><div class=sidebar>s</div></div>", ["story"]),
    ("<div class='layout has-sidebar'><p>story</p><div class=sidebar>s</div></div>", ["story"]),
    ("<div id='page-widget'><p>before</p><article><p>story</p><div class='share-buttons'>s</div></article></div>", ["story"]),
    ("<div class='post ad-free'><article><p>story</p></article></div><p>b</p>", ["story"]),
    ("<div class=widget><article><h1>T</h1><p>story</p></article></div><p>b</p>", ["T", "story"]),
    ("<form id=aspnetForm><nav>n</nav><article><p>story</p><form><p>q</p></form></article></form>", ["story"]),
    ("<p>skip</p><form id=aspnetForm><nav>n</nav><div><h1>T</h1><p>story</p></div></form>", ["skip", "T", "story"]),
    ("<form><div><p>story</p></div></form>", ["story"]),
    ("<div role=article><p>story</p></div><p>b</p>", ["story"]),
    ("<div>" * 5000 + "<p>deep</p>", ["deep"]),
    ("<div class=content-sidebar-wrap><article><p>story</p></article></div><p>b</p>", ["story"]),
    ("<article><p class=share-price>The price rose</p><div class=share-buttons>s</div></article>", ["The price rose"]),
    ("<div class=widget><h1>T</h1><p>story</p></div><p>b</p>", ["T", "story", "b"]),
]


@pytest.mark.parametrize(("page", "want"), HELD)
def test_story_is_not_dropped_with_what_stands_around_it(page, want):
    assert html_text.main_blocks(page) == want


@pytest.mark.parametrize("page", ["<span></i>x" * 100_000, "<article><i>" + "<span></i>" * 100_000, "<span><p>x" * 30_000, "<a \"'" * 100_000 + ">", "<a " * 200_000, "<ul><li>x" * 30_000])
def test_broken_pages_take_linear_time(page):
    began = time.perf_counter()
    html_text.main_blocks(page)
    assert time.perf_counter() - began < 8  # a quadratic parser takes minutes


def bare_pages():
    """(id, url, html, words of the story) of pages without article, roles or telling classes, whose menus, notices and feet differ from page to page."""
    rng = random.Random(7)
    words = lambda kind, n: " ".join(f"{kind}{rng.randrange(3000)}" for _ in range(n))
    rows = []
    for i in range(240):
        host = i % 4
        menu = "".join(f"<li><a href=/{k}>{words('m', 2)}</a>" for k in range(rng.randrange(3, 9)))
        side = f"<div class=k3><h3>{words('m', 2)}</h3><ul>{menu}</ul></div>" if host < 2 else ""
        foot = f"<div><p>{words('f', rng.randrange(5, 20))}</p><a href=/>{words('f', 2)}</a></div>"
        paragraphs = [words("s", rng.randrange(5, 80)) for _ in range(rng.randrange(2, 9))]
        story = f"<h1>{words('s', 5)}</h1>" + "".join(f"<p>{p}</p>" if host % 2 else f"<div>{p}</div>" for p in paragraphs)
        notice = f"<div class=k{i}>{words('n', rng.randrange(4, 12))} <b>{words('n', 1)}</b></div>"
        rows.append((i, f"http://h{host}.example/{i}", f"<body><div class=k1><ul>{menu}</ul></div>{notice}<div class=k2>{story}</div>{side}{foot}</body>"))
    return rows


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_templates_alone_find_the_story(spark, monkeypatch, most):
    """Word lists off: only what recurs on a host's pages is removed. Precision and recall of words; both join branches."""
    monkeypatch.setattr(html_text, "BROADCAST_TEMPLATES", most)
    rows = bare_pages()
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.page_id: r.text.split() for r in html_text.extract_text(frame, rule=html_text.Templates(lists=False)).collect()}
    story = {i: re.findall(r"s[0-9]+", re.sub("<[^>]*>", " ", page)) for i, _, page in rows}
    right = sum(sum(w[0] == "s" for w in found[i]) for i in story)
    assert right / sum(map(len, found.values())) > 0.99 and right / sum(map(len, story.values())) > 0.99
    alone = {i: h for i, _, page in rows for h in [" ".join(html_text.main_blocks(page, rule=html_text.Templates(lists=False))).split()]}
    assert right / sum(map(len, alone.values())) < 0.92  # without templates


def test_site_template_is_removed(spark):
    rows = []
    for i in range(30):
        site = "<div><p>Welcome to the site</p><div><span>links</span></div></div>"
        same = "<p>a passage that pages share</p>"
        rows.append((i, f"http://A.example/{i}", f"{site}<div><p>story {i}</p>{same}</div>", "x"))
        rows.append((100 + i, f"http://b{i}.example/", f"{site}<p>story {i}</p>", "x"))
    rows += [(500, None, None, "x"), (501, "no host", "<p>q</p>", "x")]
    found = {r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert all(found[i] == f"story {i}\n\na passage that pages share" for i in range(30))
    assert all(found[100 + i].startswith("Welcome to the site\n\nlinks\n\nstory") for i in range(30))
    assert (found[500], found[501]) == ("", "q")


def test_notices_in_turn_are_template(spark):
    rows = [(i, f"http://big.example/{i}", f"<div><p>offer number {i % 10}</p></div><div><p>story {i}</p></div>") for i in range(400)]
    rows += [(1000 + i, f"http://big.example/q{i}", f"<div><p>quoted</p></div><div><p>tale {i}</p></div>") for i in range(10)]
    found = {r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(found[i] == f"story {i}" for i in range(400))
    assert all(found[1000 + i] == f"quoted\n\ntale {i}" for i in range(10))


def test_copies_make_no_template(spark):
    page = "<body><div><p>same story</p></div></body>"
    rows = [(i, "http://c.example/x", page) for i in range(50)] + [(100 + i, "http://c.example/y", f"<p>{i}</p>") for i in range(50)]
    found = html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r.text for r in found.collect() if r.page_id < 100} == {"same story"}
    assert html_text.extract_text(found.selectExpr("page_id", "url", "text as html").limit(0)).collect() == []


def test_test_pages_equal_plain_article(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = {r.page_id: (r.text, r.n_chars) for r in html_text.extract_text(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        parts = re.split(r"</?(?:h1|p)>", article)
        blocks = [" ".join(html.unescape(re.sub(r"<br>", " ", p).replace("<b>", "")).split()) for p in parts]
        want = "\n\n".join(b for b in blocks if b)
        assert found[r.page_id] == (want, len(want))


@pytest.mark.parametrize("pages", [7, 12, 40, 300])
@pytest.mark.parametrize("head", ["<h1>t{i} title</h1>", "<div class=head><h1>t{i} title</h1></div>"])
def test_short_text_that_differs_stays(spark, pages, head):
    """A lead, a byline, a summary and a conclusion in places of their own, other words on each page; a notice that is the same on all goes from eight pages on."""
    rng = random.Random(pages)
    story = lambda n: " ".join("".join(rng.choices("abcdefghij", k=7)) for _ in range(n))
    rows, want = [], {}
    for i in range(pages):
        parts = [story(12), story(3), story(60), story(70), story(15), story(9)]
        lead, byline, *body, summary, end = parts
        page = head.format(i=i) + f"<div class=lead>{lead}</div><div class=byline>{byline}</div><div class=body><p>{body[0]}</p><p>{body[1]}</p></div><div class=summary>{summary}</div><div class=end>{end}</div>"
        rows.append((i, f"http://p{pages}.example/{i}", f"<body><div class=note>the same on all pages</div>{page}</body>"))
        want[i] = "\n\n".join([f"t{i} title", *parts])
    found = {r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    note = "" if pages >= 8 else "the same on all pages\n\n"
    assert all(found[i] == note + want[i] for i in range(pages))


def test_template_counts_equal_plain(spark):
    """Hashes and slots of each host, counted by hand from the parsed pages."""
    pages = spark.createDataFrame(bare_pages(), "page_id long, url string, html string")
    rule = html_text.Templates(lists=False)
    trees, held, bodies = {}, {}, {}
    for r in pages.collect():
        host = re.search(r"://([^/]*)", r.url)[1]
        blocks, elements = html_text.parse(r.html)
        slot = html_text.said_in(blocks, html_text.slots(elements, rule.short))
        body = html_text.hash64("\n".join(html_text.chosen(blocks) or [b for b, _ in blocks]))
        bodies.setdefault(host, set()).add(body)
        for e in elements:
            if e.tag in html_text.TEMPLATE_TAGS and len(e.parts) > 1:
                trees.setdefault((host, e.hash), set()).add(body)
        for key, said in slot.items():
            held.setdefault((host, key), {}).setdefault(body, set()).add(said)
    want = {host: set() for host in bodies}
    enough = lambda host, n: n >= 8 and len(bodies[host]) >= 8 and n * n >= 8 * 0.2 * len(bodies[host])
    for (host, key), on in trees.items():
        if enough(host, len(on)):
            want[host].add(key)
    for (host, key), on in held.items():
        texts = {max(said) for said in on.values()}
        if enough(host, len(on)) and 2 * len(on) >= len(bodies[host]) and 8 * len(texts) <= len(on):
            want[host].add(key)
    assert {r.host: set(r.template) for r in html_text.site_templates(pages, rule).collect()} == {h: w for h, w in want.items() if w}
