import math
import time

import pytest

from brindle.llm.htmltext import BLOCKS, RAW, _furniture, densities, extract_pages, main_text, parse

PARAGRAPHS = ["First words of the story, with R&D and <signs>.", "Second part that goes on for a while, as stories do.",
              "A third one, rather short.", "Be."]
ARTICLE = "<article><h1>Head line</h1>" + "".join(
    f"<p>{p.replace('&', '&amp;').replace('<', '&lt;')}</p>" for p in PARAGRAPHS) + "</article>"
WANT = "\n\n".join(["Head line", *PARAGRAPHS])
AROUND = {
    "menu": "<nav><ul>" + "<li><a href='/a'>Menu item</a></li>" * 8 + "</ul></nav>",
    "header": "<header><a href=/>Site name</a> <p>Some claim of the site that is quite long to read.</p></header>",
    "footer": "<footer>&copy; 2020 <p>All rights and further small print of some length.</p></footer>",
    "sidebar": "<aside><p>Popular reading elsewhere with many words in it, really many.</p></aside>",
    "named": "<div class='side-bar sidebar'><p>Popular reading elsewhere.</p><p>More of the same kind.</p></div>",
    "notice": "<div id=cookie-notice>We use cookies to make this page better for everybody.</div>",
    "advert": '<div class="ad">Buy this thing now, it is much cheaper than yesterday.</div>',
    "form": "<form><label>Your name</label><input name=x><textarea>typed text</textarea></form>",
    "script": "<script>var t = '</p><p>not text';</script>",
    "style": "<style>p{margin:0}</style>",
    "comments": "<section class=comments><p>I liked this very much, thank you for it.</p><p>Me too, and twice.</p></section>",
    "plain": "<div>Short line that belongs to nothing</div>",
    "comment": "<!-- <p>hidden words</p> -->",
}


@pytest.mark.parametrize("name", AROUND)
@pytest.mark.parametrize("place", ["before", "after"])
def test_article_without_furniture(name, place):
    around = AROUND[name]
    body = around + ARTICLE if place == "before" else ARTICLE + around
    assert main_text(f"<!DOCTYPE html><html><head><title>T</title></head><body>{body}</body></html>") == WANT


def test_all_furniture_and_divs_in_place_of_article():
    page = "<body>" + "".join(AROUND.values()) + ARTICLE.replace("article>", "div>") + "".join(AROUND.values())
    assert main_text(page) == WANT


@pytest.mark.parametrize(("page", "want"), [
    (None, ""), ("", ""), ("   ", ""), ("no markup at all", "no markup at all"), ("<p>a<p>b", "a\n\nb"),
    ("<p><b>open words here.<br><p>next  one\n here", "open words here.\n\nnext one here"),
    ("<p>a &amp; b &#233; &nbsp; c", "a & b é c"), ("<p>a <!-- x > y --> b", "a b"), ("<script>never closed <p>a", ""),
    ("<p>a<script>x</script>b</p>", "ab"), ("<div>one<p>two</p>three</div>", "one\n\ntwo\n\nthree"), ("<p>1 < 2 & 3", "1 < 2 & 3"),
    ("<p title='a > b'>text", "text"), ("<p title='open>text", "text"), ("</p></div>text", "text"), ("<ul><li>a<li>b</ul>", "a\n\nb"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a\n\nb\n\nc"), ("<!-- open comment <p>a", ""),
])
def test_broken_and_small_pages(page, want):
    assert main_text(page) == want


def test_long_and_deep_pages():
    assert main_text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert len(main_text("<p>" + "word " * 200_000)) == 999_999
    assert main_text("<" * 20_000 + '<p a="' * 2000) is not None
    assert len(parse("<p>x").tag) == 2


def test_table(frame):
    rows = [(1, "u", ARTICLE, 5), (2, None, None, 6), (2, None, None, 6), (None, "u", "<p>ä", 7)]
    out = extract_pages(frame(rows, "page_id long, url string, html string, n_chars int"))
    got = sorted(map(tuple, out.collect()), key=str)
    assert got == sorted([(1, "u", WANT, len(WANT)), (2, None, "", 0), (2, None, "", 0), (None, "u", "ä", 1)], key=str)
    assert extract_pages(frame([], "page_id long, url string, html string")).count() == 0


def paragraphs(n, size=400, first=0):
    return [f"{i:03d} " + "word " * ((size - 4) // 5 - 1) + "last" for i in range(first, first + n)]


def marked(parts, tag="p"):
    return "".join(f"<{tag}>{p}</{tag}>" for p in parts)


@pytest.mark.parametrize("holder", ["article", "main", "div", "div id=content", "div class=wrap"])
def test_sections_with_their_own_ids_and_lead_text(holder):
    sections = [paragraphs(8, first=10 * i) for i in range(3)]
    inner = "<h1>Head</h1><p>Short lead.</p>" + "".join(
        f"<section id={i}><h2>On {i}</h2>{marked(s)}</section>" for i, s in zip(("history", "career", "works"), sections))
    inner += "<p>Closing words.</p>"
    want = ["Head", "Short lead."]
    for i, s in zip(("history", "career", "works"), sections):
        want += [f"On {i}", *s]
    page = f"<body>{AROUND['menu']}{AROUND['named']}<{holder}>{inner}</{holder.split()[0]}>{AROUND['plain']}{AROUND['footer']}</body>"
    assert main_text(page) == "\n\n".join([*want, "Closing words."])


def test_sibling_with_direct_text_only():
    text = paragraphs(4)
    own = "Text of its own " * 40
    page = f"<body><div class=one>{marked(text)}</div><div class=two>{own}</div>{AROUND['plain']}</body>"
    assert main_text(page) == "\n\n".join([*text, own.strip()])


@pytest.mark.parametrize("wrapper", ["form", "div class='widget page'", "div class=social", "div class=discussion", "header"])
def test_wrapper_of_most_of_the_page(wrapper):
    text = paragraphs(5)
    page = f"<body>{AROUND['menu']}<{wrapper}>{marked(text)}{AROUND['named']}</{wrapper.split()[0]}>{AROUND['footer']}</body>"
    assert main_text(page) == "\n\n".join(text)


def test_form_around_an_article_and_replies_longer_than_it():
    assert main_text(f"<body><form>{AROUND['menu']}{ARTICLE}<input name=x></form>{AROUND['footer']}</body>") == WANT
    assert main_text(f"<body>{ARTICLE}<div class=comments>{marked(paragraphs(9))}</div></body>") == WANT


@pytest.mark.parametrize("slug", ["search", "menu-details", "alert", "share", "notice", "related", "discussion", "aside", "related-work"])
def test_slugs_of_headings_and_sections_inside_an_article(slug):
    text = paragraphs(6)
    page = (f"<body>{AROUND['menu']}<article><h1>Head</h1>{marked(text[:3])}<h2 id={slug}>On it</h2><p id='{slug}'>Short one.</p>"
            f"<section id={slug}><h3>More</h3>{marked(text[3:])}</section></article>{AROUND['footer']}</body>")
    assert main_text(page) == "\n\n".join(["Head", *text[:3], "On it", "Short one.", "More", *text[3:]])


@pytest.mark.parametrize("name", ["id=social-history", "class=search-algorithms", "class='related-work text'"])
def test_names_that_only_begin_like_furniture(name):
    text = paragraphs(4)
    page = f"<body><main><h1>Head</h1>{marked(text[:2])}<div {name}><h2>Part</h2>{marked(text[2:])}</div></main></body>"
    assert main_text(page) == "\n\n".join(["Head", *text[:2], "Part", *text[2:]])


@pytest.mark.parametrize("extra", [
    "<div class=ad>Buy this thing now.</div>", "<div class='related-posts'><p>More to read.</p></div>", "<section class=user-reviews><p>Very good.</p></section>",
    "<div class=reader-feedback><p>Well said.</p></div>", "<div id=comments><p>I agree.</p></div>", "<div id=share-links><a href=a>One</a> <a href=b>Two</a></div>",
    "<p class=advert>Buy now.</p>", "<ul class=share-buttons><li>Send</ul>", "<div class='cookie-notice'>Cookies.</div>", "<aside><p>Beside.</p></aside>",
])
def test_furniture_inside_an_article(extra):
    text = paragraphs(4)
    page = f"<body>{AROUND['menu']}<article><h1>Head</h1>{marked(text[:2])}{extra}{marked(text[2:])}</article>{AROUND['footer']}</body>"
    assert main_text(page) == "\n\n".join(["Head", *text])


def test_nesting_takes_linear_time():
    begun = time.process_time()
    assert main_text("<div>" * 100_000 + "deep") == "deep"
    assert main_text("<b>" * 50_000 + "bold" + "</i>" * 50_000) == "bold"
    assert main_text("<ul>" + "<li>" * 50_000 + "last") == "last"
    assert time.process_time() - begun < 12


def slow_densities(page):
    """Sum of child densities of every node with text, each counted anew from all that lies below it."""
    tree = parse(page)
    n = len(tree.tag)
    out = _furniture(tree)
    def below(i, j):
        while j > i:
            j = tree.parent[j]
        return j == i
    def count(i, only_links):
        def in_link(j):
            while j > 0:
                if tree.tag[j] == "a":
                    return True
                j = tree.parent[j]
            return False
        return sum(len(" ".join(t.split())) for j, t in tree.text if t and not out[j] and below(i, j) and (not only_links or in_link(j)))
    every = [(len(" ".join(t.split())), j) for j, t in tree.text if t and tree.tag[j] not in RAW]
    def linked(j):
        while j > 0:
            if tree.tag[j] == "a":
                return True
            j = tree.parent[j]
        return False
    share = sum(s for s, j in every if linked(j)) / max(1, sum(s for s, _ in every))
    density = []
    for i in range(n):
        c, lc = count(i, False), count(i, True)
        if out[i] or not c:
            density.append(0.0)
            continue
        inner = [j for j in range(n) if j != i and not out[j] and below(i, j)]
        marks, links = max(1, len(inner)), max(1, sum(tree.tag[j] == "a" for j in inner))
        base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
        density.append(max(0.0, c / marks * math.log(max(1.0, c / max(1, lc) * marks / links)) / math.log(max(math.e, base))))
    total = [sum(density[j] for j in range(1, n) if tree.parent[j] == i and not out[j] and tree.tag[j] in BLOCKS) for i in range(n)]
    return density, total


@pytest.mark.parametrize("page", [
    ARTICLE, f"<body>{''.join(AROUND.values())}{ARTICLE}</body>", "<div><p>a <a href=x>link of words</a> b<p>more <b>bold</b> text</div><ul><li><a href=y>y</a><li>z</ul>",
    "<table><tr><td>one<td><a>two</a></table><p>rest", "",
])
def test_densities_counted_node_by_node(page):
    tree = parse(page)
    density, total, _ = densities(tree, _furniture(tree))
    slow, slow_total = slow_densities(page)
    assert density == pytest.approx(slow) and total == pytest.approx(slow_total)
