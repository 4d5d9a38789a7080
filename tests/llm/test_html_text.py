import random
import time

import pytest

from veilspark.llm import html_text
from veilspark.llm.html_text import HEADINGS, LEVELS, PARAGRAPHS, extract, main_text

CASES = {
    "article": (
        "<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/a'>Menu</a></li></ul></nav>"
        "<!-- no --><div class='ad'>Buy this, now, cheap, today.</div><article><h1>Head &amp; line</h1><p>One,  two\n three.<br>Four</p><p><b>Five</b> <i>six</i>"
        "</article><footer>&copy; me &middot; all, rights, reserved, and a very long footer text, which has many commas, in it</footer></body></html>",
        "Head & line\n\nOne, two three. Four\n\nFive six",
    ),
    "divs without marks": (
        "<body><div id=top-menu><a href=1>Home</a> <a href=2>About</a></div><div><h2>Title</h2><div><p>A first paragraph, which is long enough, to count as content of this page.</p>"
        "<p>Short.</p><p>Another paragraph, with commas, that belongs to the text as well.</p></div></div>"
        "<div class='sidebar widget'><p>Popular posts, that others read, and so on, and on, and on.</p></div></body>",
        "Title\n\nA first paragraph, which is long enough, to count as content of this page.\n\nShort.\n\nAnother paragraph, with commas, that belongs to the text as well.",
    ),
    "comments, forms, notices": (
        "<main><header><h1>H</h1></header><p>Text of the article, here.</p><div class='cookie-notice'>We use cookies, yes.</div><form><p>Your mail</p><input><button>Send</button></form>"
        "<section id='comments'><p>First!, I say, and much more text than the article, to be sure, for ever.</p></section><ul><li>point one<li>point two</ul></main>",
        "H\n\nText of the article, here.\n\npoint one\n\npoint two",
    ),
    "references": ("<p>&lt;b&gt; &#65;&#x42; &nbsp;x&amp;amp; 5 < 6", "<b> AB x&amp; 5 < 6"),
    "broken": ("<article><p>one</b></i> <a href='x>two<p>three</article>", None),
    "empty": ("", ""),
    "with a sidebar": ("<div class='main-with-sidebar'><article><p>Text of it.</p></article><div class='sidebar'><p>Others, too.</p></div></div>", "Text of it."),
    "with comments": ("<div id='page-with-comments'><article><p>Text of it.</p></article><div id='comments'><article><p>First!, I say.</p></article></div></div>", "Text of it."),
    "names of headings and sections": (
        "<article><header class='entry-header'><h1>Title</h1></header><h2 id='how-to-search'>How</h2><p>One.</p><section id='discussion'><h2>Discussion</h2><p>Two.</p></section></article>",
        "Title\n\nHow\n\nOne.\n\nDiscussion\n\nTwo.",
    ),
    "paragraphs by class": ("<article><p class='ad'>Buy.</p><p class='search-help'>One.</p><p id='notice'>Two.</p></article>", "One.\n\nTwo."),
    "aside that holds the main element": ("<div class='widget-page'><p>no</p><main><p>yes, this, is it</p></main></div>", "yes, this, is it"),
    "nothing but aside": ("<div class='notice'><p>All there is.</p></div><script>x</script>", "All there is."),
    "quotes": ("<article><p title='a > b' class=\"x\">one<p title=\"it's>two<p data-x=a'b>three</article>", "one\n\ntwo\n\nthree"),
    "last bracket": ("<article><p>one, two, three</p></article><p and no end", "one, two, three"),
    "many inline elements": ("<article><p>" + "<b>" * 20 + "one<p>two</article>", "one\n\ntwo"),
    "nothing shown": ("<script>x</script><!-- open", ""),
    "hidden": ("<article><p>seen</p><p hidden>no</p><p style='display: none'>no</p><p aria-hidden=true>no</p></article>", "seen"),
    "table": ("<article><table><tr><td>a<td>b<tr><td>c</table><pre>x\n  y</pre></article>", "a\n\nb\n\nc\n\nx y"),
}


@pytest.mark.parametrize("name", CASES)
def test_texts(name):
    page, want = CASES[name]
    got = main_text(page)
    assert isinstance(got, str) if want is None else got == want


def test_null_and_very_long_pages():
    assert main_text(None) == ""
    long = "<article>" + "".join(f"<p>paragraph {i}, of a long page</p>" for i in range(20000)) + "</article>"
    assert main_text(long).count("\n\n") == 19999
    assert main_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"


@pytest.mark.parametrize("piece", ["</b>", "</p>", "<a href=\"x", "<a \"'>", "<a b='c\">", "<", "<p ", "<b><i>", "<li><b>", "<!", "<p class=" + "a" * 400 + " x>", "a=" * 40])
def test_hostile_pages_in_linear_time(piece):
    def seconds(n):
        page = "<article><p>" + piece * n + "</article>"
        begin = time.process_time()
        assert isinstance(main_text(page), str)
        return time.process_time() - begin

    n = 200_000 // len(piece)
    assert seconds(n) < 2.5


def by_definition(root):
    """Points of all elements, each computed from its own paragraphs below by the definition."""
    def below(node, level):
        found = [(b, node, level) for b in node.blocks]
        for child in node.children:
            found += below(child, level + 1)
        return found

    def points(node):
        total = 0.0
        for (_, text, _), at, level in below(node, 0):
            level -= at.tag in PARAGRAPHS
            if 0 <= level < LEVELS:
                own = 0.5 if at.tag in HEADINGS else 1.0 + text.count(",") + min(len(text) / 100, 3.0)
                total += own * (1.0 if level == 0 else 0.5 if level == 1 else 1.0 / (3 * level))
        texts = [b for b, _, _ in below(node, 0)]
        chars = sum(len(t) for _, t, _ in texts)
        return total * (1 - sum(n for _, _, n in texts) / chars) if chars else 0.0

    return max(html_text._walk(root), key=points)


def test_container_is_that_of_the_definition():
    r = random.Random(5)
    for _ in range(150):
        parts, open_tags = [], []
        for _ in range(r.randint(3, 40)):
            if open_tags and r.random() < 0.4:
                parts.append(f"</{open_tags.pop()}>")
            else:
                tag = r.choice(["div", "section", "p", "h2", "blockquote"])
                words = r.choice(["", "a, b, c ", "some words " * r.randint(1, 30), "<a href=x>link text</a> "])
                parts.append(f"<{tag}>{words}")
                open_tags.append(tag)
        page = "".join(parts)
        root = html_text.tree(page)
        best = by_definition(root)
        inside = "\n\n".join(b[1] for b in sorted(b for node in html_text._walk(best) for b in node.blocks))
        assert all(block in main_text(page).split("\n\n") for block in inside.split("\n\n") if block)


def test_rows(spark):
    rows = [(i, f"http://x/{i}", page, "t") for i, (page, _) in enumerate(CASES.values())] + [(None, None, None, None), (0, "http://x/0", CASES["article"][0], "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = extract(pages).collect()
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in got) == sorted((str(r[0]), main_text(r[2]), len(main_text(r[2]))) for r in rows)
    assert extract(pages.limit(0)).count() == 0


def test_pages_of_the_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in pages.collect():
        text = main_text(r.html)
        assert "<" not in text and "track(" not in text and "&copy;" not in text and "©" not in text
        assert text.startswith(main_text("<article>" + r.html.split("<article>")[1].split("</h1>")[0] + "</h1></article>"))
