import html
import re

import pytest
from llm.cases import table

from stillwater.llm import html_extract as H
from stillwater.llm.html_extract import extract, main_text

PARA = "A long enough paragraph, with commas, to be taken for content by its length"


def test_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    source = {r.page_id: r.html for r in pages.collect()}
    for r in extract(pages).collect():
        article = re.search("<article>(.*)</article>", source[r.page_id], re.S)[1]
        words = html.unescape(re.sub("<[^>]+>", " ", article)).split()
        assert r.text.split() == words and r.n_chars == len(r.text)
        assert all(b == " ".join(b.split()) and b for b in r.text.split("\n\n"))


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("<p>a<br>b", "a b"),
        ("<script>x<p>y</p></script>", ""),
        (f"<body><nav><a href=x>Home</a></nav><div id=main><h2>T</h2><p>{PARA}.<p>{PARA} &amp; <b>more</b>\n it.<ul class='share'><li>x</ul></div><footer>f</footer>",
         f"T\n\n{PARA}.\n\n{PARA} & more it."),
        (f"<div class=sidebar><p>{PARA}</p><p>{PARA}</p></div><article><p>{PARA}</p><aside>no</aside><form><input>q</form><p>Short.</p></article>"
         f"<section class=comments><p>{PARA}, {PARA}, {PARA}</p></section>", f"{PARA}\n\nShort."),
        (f"<div><p><a href=x>{PARA}</a></p><p><a href=x>{PARA}</a></p></div><div><p>{PARA}</p></div>", PARA),
        ('<a "broken>x</a>', "x"),
        (f"<main><header><h1>Title</h1></header><p>{PARA}</p></main><header>Site</header>", f"Title\n\n{PARA}"),
    ],
)
def test_rules(page, text):
    assert main_text(page) == text


def test_awkward_rows(spark):
    deep = "<div>" * 20_000 + PARA + "</div>" * 20_000
    rows = [(1, "u", None), (1, None, ""), (None, "v", f"<p>{PARA}</p>"), (2, "w", deep), (2, "w", deep), (3, "x", "<p" * 50_000)]
    df = spark.createDataFrame([r + ("t", 4) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = sorted((tuple(r) for r in extract(df).collect()), key=repr)
    assert len(got) == 6 and (None, "v", PARA, len(PARA)) in got and got.count((2, "w", PARA, len(PARA))) == 2
    assert extract(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<div class=sidebar><p>{PARA}</p></div><article class='post comments-open'><p>{PARA}.</p><p>Short.</p></article>", f"{PARA}.\n\nShort."),
        (f"<div id=content class='content with-sidebar'><p>{PARA}.</p><p>{PARA}!</p></div><div class=share><p>{PARA}</p></div>", f"{PARA}.\n\n{PARA}!"),
        (f"<div class='page no-sidebar'><article><p>{PARA}</p></article></div><div class=related><p>{PARA}, {PARA}</p></div>", PARA),
        (f"<div class='post has-share'><p>{PARA}</p><div class=share>Share this</div></div>", PARA),
        (f"<body><form action=x><nav>Menu</nav><div><p>{PARA}</p></div><input></form></body>", PARA),
        (f"<body class=x><div role=main class='no-sidebar'><p>{PARA}</p></div></body>", PARA),
        (f"<div id=text><p>{PARA}, {PARA}</p></div><div class=comments><p>{PARA}, {PARA}, {PARA}</p></div>", f"{PARA}, {PARA}"),
        (f"<article><p>{PARA}</p><section class=comments><article class=comment><p>{PARA}</p></article></section></article>", PARA),
    ],
)
def test_class_words_or_a_form_alone_cut_no_article(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize(
    "page, text",
    [
        # no declared element
        (f"<div><div><p>{PARA}</p></div><div><p>{PARA}, too</p></div><div><p>{PARA}!</p></div></div><div>Short, unrelated</div>", f"{PARA}\n\n{PARA}, too\n\n{PARA}!"),
        # a declared element that isn't the main text
        (f"<div><p>{PARA}</p><p>{PARA}, {PARA}</p><p>{PARA}</p></div><div><article><p>Teaser of a little text</p></article></div>", f"{PARA}\n\n{PARA}, {PARA}\n\n{PARA}"),
        (f"<main><div><p><a href=x>{PARA}</a></p></div></main><section><p>{PARA}</p><p>{PARA}</p></section>", f"{PARA}\n\n{PARA}"),
        # a list of links inside
        (f"<main><p>{PARA}</p><ul><li><a href=x>One link here</a></li><li><a href=y>Another link</a></li></ul><ul><li>Point</ul></main>", f"{PARA}\n\nPoint"),
        # sections of unlike length in an article
        (f"<article><section><p>{PARA}, {PARA}, {PARA}</p></section><section><p>{PARA}</p></section></article>", f"{PARA}, {PARA}, {PARA}\n\n{PARA}"),
    ],
)
def test_scores_choose(page, text):
    assert main_text(page) == text


def plain_value(node):
    """The score of an element by its definition, a paragraph and an ancestor at a time."""
    inside = [x for x in H._all(node)]
    score = total = 0.0
    for x in inside:
        text = H._own_text(x).strip()
        if x.tag not in H._PARAGRAPH and x.tag != "div" or len(text) < 25:
            continue
        points = 1 + text.count(",") + min(len(text) / 100, 3)
        total += points
        up, level = (x, 0) if x.tag == "div" else (x.up, 0)
        if x is node and x.tag != "div":
            continue
        while up is not node:
            up, level = up.up, level + 1
        score += points / 2**level
    size = sum(len(p.strip()) for x in inside for p in x.parts if isinstance(p, str))

    def linked(x):
        if x.tag == "a":
            return sum(len(p.strip()) for y in H._all(x) for p in y.parts if isinstance(p, str))
        return sum(linked(p) for p in x.parts if not isinstance(p, str) and not p.cut)

    score = total * (1.25 if node.tag == "article" else 1) if node.main else score * (1.25 if node.good else 1)
    return score * (1 - (linked(node) / size if size else 0)) * node.weight


def test_against_a_plain_scorer():
    import random

    rng = random.Random(8)

    def grow(depth):
        if depth == 0 or rng.random() < 0.25:
            text = rng.choice([PARA, "Short", f"{PARA}, {PARA}", f"<a href=x>{PARA}</a>", f"{PARA} <a>link</a>"])
            return f"<p>{text}</p>" if rng.random() < 0.7 else text
        tag = rng.choice(["div", "div", "section", "ul", "article", "main", "blockquote", "div class=content", "div class=widget", "td", "a"])
        return f"<{tag}>" + "".join(grow(depth - 1) for _ in range(rng.randrange(1, 5))) + f"</{tag.split()[0]}>"

    for _ in range(300):
        root = H.parse("<body>" + "".join(grow(4) for _ in range(3)) + "</body>")
        kept = H.best_containers(root)
        nodes = [n for n in H._all(root) if n.tag not in ("html", "#root") and (n.score or n.main and n.total)]
        values = [plain_value(n) for n in nodes]
        assert all(abs(H._value(n) - v) < 1e-9 * max(1, v) for n, v in zip(nodes, values))
        if nodes:
            assert any(n in kept and H._value(n) == max(map(H._value, nodes)) for n in nodes)


@pytest.mark.parametrize(
    "page",
    ["".join(f"<div>text {i} {PARA}" for i in range(20_000)), "<p>x" + "<b>a</i>" * 20_000, "<body>" + "<b>" * 20_000 + "<h2>x</h2>" * 20_000,
     "<section><table><td>" + "<div>" * 20_000 + "</section>" * 20_000, "<div>" * 20_000 + "<header>x</header>" * 20_000, "<ul>" + "<li><b>" * 20_000],
    ids=["nested", "stray ends", "unclosed", "cells", "headers", "lists"],
)
def test_time_in_proportion(page):
    import time

    began = time.process_time()
    main_text(page)
    assert time.process_time() - began < 1


MORE = f"<p>{PARA}</p><p>{PARA}, too</p>"
LINKS = "<li><a href=x>A paper on one thing</a></li><li><a href=y>A paper on another</a></li>"
READ = "A paper on one thing\n\nA paper on another"


@pytest.mark.parametrize(
    "page, text",
    [
        # words in generated ids and in parts of classes
        (f"<article><h1 id='share-prices-fall'>Share prices fall</h1>{MORE}</article>", f"Share prices fall\n\n{PARA}\n\n{PARA}, too"),
        (f"<article>{MORE}<section id='social-media-and-search'><p>{PARA}!</p></section></article>", f"{PARA}\n\n{PARA}, too\n\n{PARA}!"),
        (f"<article>{MORE}<h2 id='related-work'>Related work</h2><p>{PARA}!</p></article>", f"{PARA}\n\n{PARA}, too\n\nRelated work\n\n{PARA}!"),
        (f"<article><p id='cookies-explained'>{PARA}</p><p class='notice-of-death'>{PARA}!</p></article>", f"{PARA}\n\n{PARA}!"),
        (f"<article><h2 class=share>Share</h2><p class=comment>{PARA}</p></article>", f"Share\n\n{PARA}"),
        (f"<article>{MORE}<div class=share>Share this</div></article>", f"{PARA}\n\n{PARA}, too"),
        # lists of links with text of the article around them
        (f"<article><p>{PARA}</p><ul>{LINKS}</ul><p>{PARA}!</p></article>", f"{PARA}\n\n{READ}\n\n{PARA}!"),
        (f"<article>{MORE}<h2>References</h2><ol>{LINKS}</ol></article>", f"{PARA}\n\n{PARA}, too\n\nReferences\n\n{READ}"),
        (f"<article><p>{PARA}</p><div><table><tr><td><a href=x>Town one</a></td><td><a href=y>Town two</a></td></tr></table></div><p>{PARA}!</p></article>",
         f"{PARA}\n\nTown one\n\nTown two\n\n{PARA}!"),
        (f"<article>{MORE}<ul>{LINKS}</ul></article>", f"{PARA}\n\n{PARA}, too"),
        (f"<article><ul>{LINKS}</ul>{MORE}</article>", f"{PARA}\n\n{PARA}, too"),
        # readers' words without a listed word
        (f"<main><article>{MORE}{MORE}</article><section class=reader-feedback><p>{PARA}</p><p>{PARA}?</p></section></main>",
         f"{PARA}\n\n{PARA}, too\n\n{PARA}\n\n{PARA}, too"),
        (f"<main><div><h1>T</h1><article>{MORE}{MORE}</article></div><div class=views><p>{PARA}</p></div></main>",
         f"T\n\n{PARA}\n\n{PARA}, too\n\n{PARA}\n\n{PARA}, too"),
    ],
)
def test_nothing_of_the_article_is_dropped(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize(
    "page",
    ["<a" * 100_000, '<a b="x ' * 100_000, "<a '" * 100_000, '<a ">"' * 20_000, '<a ">\'' * 20_000, "<!" * 100_000, "<script>" + "</script" * 100_000, "<p>x" + "<a" * 100_000 + ">", "<!--" * 100_000],
    ids=["open tags", "open values", "quotes", "ends in quotes", "mixed quotes", "declarations", "scripts", "one end", "comments"],
)
def test_bad_tags_take_time_in_proportion(page):
    import time

    began = time.process_time()
    main_text(page)
    assert time.process_time() - began < 1
