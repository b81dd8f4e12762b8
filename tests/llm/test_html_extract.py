import random

import pytest

from treeledger.llm import html_extract as he

PAGE = """<!DOCTYPE html><html><head><title>t &amp; u</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href=/a>{0}</a></li><li><a href=/b>b</a></li></ul></nav><!-- ad --><div class="ad">Buy {0}</div>
<article><h1>Title {0}</h1><p><b>First &lt;{0}&gt;<br><p>Second   para
of {0}</p>{1}</article><footer>&copy; x</footer></body></html>"""


def both(html):
    return he.extract(html, he.rules_of(he.wrapper_of(he.shallow(he.parse(html)))))


def test_wrapper_of_several_pages_and_their_texts(spark):
    extra = ["", "<p>Third</p><p>Fourth</p>", '<aside>related</aside><section class="comments"><article class="comment"><p>me too</p></article></section>']
    pages = [(i, f"http://h{i % 2}.org/{i}", PAGE.format(f"n{i}", extra[i % 3]), "clash") for i in range(12)]
    pages += [(50, None, None, ""), (51, "http://h1.org/x", None, ""), (52, "http://h1.org/x", "", ""), (52, "http://h1.org/x", "", "")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string, rules string")
    got = sorted((r.page_id, r.text, r.n_chars) for r in he.extract_table(df).collect())
    more = lambda i: "\nThird\nFourth" if i % 3 == 1 else ""
    want = [(i, f"Title n{i}\nFirst <n{i}>\nSecond para of n{i}{more(i)}") for i in range(12)]
    assert got == [(i, t, len(t)) for i, t in want] + [(50, "", 0), (51, "", 0), (52, "", 0), (52, "", 0)]
    assert he.extract_table(df.limit(0)).collect() == []


def test_alignment_makes_optional_and_repeated_groups():
    a = he.wrapper_of(he.parse("<div><h2>x</h2><p>1</p><h2>y</h2><p>2</p></div>"))
    b = he.wrapper_of(he.parse("<div><h2>x</h2><p>1</p><ul><li>a<li>b</ul></div>"))
    assert he.expression(he.merge(a, b)) == "<#page><div>(<h2>#text</><p>#text</>)+(<ul>(<li>#text</>)+</>)?</></>"


@pytest.mark.parametrize(
    "html,text",
    [
        ('<div class="cookie-notice">c</div><div id="content"><h2>T</h2><p>a long enough text here<p>b <i>c</i></div><div class="sidebar"><p>s</p></div><form>f</form>', "T\na long enough text here\nb c"),
        ("<main><table><tr><td>a<td>b</table><ul><li>i<li>j</ul></main>", "a\nb\ni\nj"),
        ("<article>cut off <p>in the mid", "cut off\nin the mid"),
        ("<article><p>a &amp b &#x41;&nbsp;c</article>", "a & b A c"),
        ("", ""),
    ],
)
def test_single_pages(html, text):
    assert both(html) == text


@pytest.mark.parametrize("html", ["<", "<p", '<a "<b"', "x<!-- y", "<script>", "<div>" * 30000, '<a "' * 30000, "</p>" * 10000, "<p>" * 20000])
def test_odd_pages_end_soon(html):
    assert isinstance(both(html), str)


@pytest.mark.parametrize("many", [1, 20])
def test_hosts_that_mix_templates_keep_every_article(spark, many):
    text = "a paragraph of the page number {0} that is long enough to count"
    beside = '<nav><a href=/>home</a></nav>{0}<div class="sidebar"><p>beside</p></div><footer>end</footer>'
    layouts = ["<article><p>{0}</p></article>", "<main><p>{0}</p></main>", '<div class="post-a"><p>{0}</p></div>', '<div id="other"><div class="x"><p>{0}</p></div></div>']
    told = [0] * 5 + [1, 2, 3] * many
    pages = [(i, "http://mixed.org/a", beside.format(layouts[k].format(text.format(i)))) for i, k in enumerate(told)]
    pages.append((1000, "http://mixed.org/a", beside.format("")))
    got = {r.page_id: r.text for r in he.extract_table(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    assert got == {1000: ""} | {i: text.format(i) for i in range(len(told))}


def test_pages_of_a_host_without_articles_may_differ():
    pages = [f'<div class="{name}"><p>the text of {name} that is long enough</p></div>' for name in ("content-a", "content-a", "entry-b", "plain")]
    host = he.wrapper_of(he.parse(pages[0]))
    for page in pages[1:]:
        host = he.merge(host, he.wrapper_of(he.parse(page)))
    assert [he.extract(p, he.rules_of(host)) for p in pages] == [f"the text of {n} that is long enough" for n in ("content-a", "content-a", "entry-b", "plain")]


UTILITIES = "col-md-4 d-none d-lg-block float-right mt-3 px-2 align-items-center border"


@pytest.mark.parametrize("word", ["sidebar", "share", "social", "related", "subscribe", "widget", "sponsor", "promo", "responses"])
def test_deciding_words_are_kept_among_many(word):
    assert both(f'<article><p>the text</p><div class="{UTILITIES} {word}"><p>beside it</p></div></article>') == "the text"


def test_marked_articles_are_kept_among_many_words():
    html = f'<div class="{UTILITIES}"><p>beside, of some length</p></div><div class="{UTILITIES} story"><p>the text, of some length</p></div>'
    assert both(html) == "the text, of some length"
    assert len(he.attribute_words(f'class="{" ".join(chr(97 + i // 26) + chr(97 + i % 26) for i in range(99))}"')) == he.MOST_WORDS


def of_host(pages):
    host = None
    for p in pages:
        one = he.wrapper_of(he.shallow(he.parse(p)))
        host = he.merge(host, one) if host else one
    rules = he.rules_of(host)
    return [he.extract(p, rules) for p in pages]


def test_constants_of_a_host_are_its_template():
    fixed, body = "<p>Written by the staff of this site.</p>", "<p>Page {0} says {0}.</p><p>And {0} more.</p>"
    pages = [f"<article><h1>T{i}</h1>{body.format(i)}{fixed}</article>" for i in range(30)]
    assert of_host(pages) == [f"T{i}\nPage {i} says {i}.\nAnd {i} more." for i in range(30)]
    # A host whose pages are all the same has nothing but constants; of few pages no text is known to be one.
    assert of_host(pages[:1] * 9) == ["T0\nPage 0 says 0.\nAnd 0 more.\nWritten by the staff of this site."] * 9
    assert of_host(pages[:3])[2].endswith("site.")


def test_words_are_only_a_prior():
    text = "a paragraph that is long enough to be the most of the page. " * 4
    assert both(f'<nav>n</nav><div class="post text-side-by-side"><article><p>{text}</p></article></div>') == text.strip()
    for word in ("search", "form", "related"):
        assert text.strip() in both(f'<article><h1>T</h1><div class="{word}-x"><p>{text}</p></div></article>')
    assert both(f'<article><p>short</p><section class="comments"><p>{text}</p></section></article>') == "short"
    assert both(f'<article><p>short</p></article><div class="sidebar"><p>{text}</p></div>') == "short"


@pytest.mark.parametrize("depth", [59, 60, 61, 100, 399, 401, 3000])
def test_depth_changes_nothing(depth):
    page = "<article><p>start</p>" + "<div>" * depth + "<nav><ul><li>menu</li></ul></nav><p>deep text</p><aside><p>beside</p></aside><p>end</p>" + "</div>" * depth + "<p>after</p></article>"
    assert both(page) == "start\ndeep text\nend\nafter"


def test_random_templates_against_their_known_texts():
    """Templates with optional and repeated groups: what went into the slots has to come out."""
    rng = random.Random(5)
    for _ in range(30):
        tags = [rng.choice(["p", "h2", "blockquote", "ul", "div"]) for _ in range(rng.randint(2, 5))]
        asides = [rng.choice(["", "", '<div class="promo"><p>buy</p></div>', "<nav><a href=/>x</a></nav>", "<form><input><button>go</button></form>"]) for _ in tags]
        pages, want = [], []
        for i in range(8):
            made, said = "", []
            for j, (tag, aside) in enumerate(zip(tags, asides, strict=True)):
                for k in range(rng.randint(0, 3) if j else 1):
                    text = f"slot {i} {j} {k} of this page"
                    said.append(text)
                    made += f"<ul><li>{text}</li></ul>" if tag == "ul" else f"<div><p>{text}</p></div>" if tag == "div" else f"<{tag}>{text}</{tag}>"
                made += aside
            pages.append(f"<html><body><header>site</header><article>{made}</article><footer>f</footer></body></html>")
            want.append("\n".join(said))
        assert of_host(pages) == want


def test_long_rows_of_children_align_soon():
    rows = ["".join(f"<{t}>{i}</{t}>" for i, t in enumerate(rng_tags)) for rng_tags in ([random.Random(s).choice(["p", "h2", "h3", "div", "pre"]) for _ in range(3000)] for s in (1, 1, 1))]
    assert len(of_host([f"<article>{r}</article>" for r in rows])[0].split("\n")) == 3000
