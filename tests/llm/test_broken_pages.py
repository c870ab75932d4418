"""Main text of pages with broken markup, several articles and reader comments."""

import random
import time

import pytest

from gossamer.llm.html_text import main_text


def paragraphs(n, name):
    return "".join(f"<p>{name}{i} " + "some words of a long paragraph with text " * 3 + "</p>" for i in range(n))


def page(content):
    return f"<html><body><div class=menu><a href=1>Home</a> <a href=2>About</a></div>{content}<div class=footer>foot note</div></body></html>"


def check(html, want, without=()):
    lines = main_text(html).split("\n")
    words = [line.split(" ")[0] for line in lines]
    assert all(w in words for w in want), words
    assert not any(w in words for w in ("Home", "foot", *without)), words


@pytest.mark.parametrize(
    ("content", "want"),
    [
        ("<div id=content><h1>Head</h1><div class=a>" + paragraphs(17, "a") + "</div><div class=b>" + paragraphs(3, "b") + "</div></div>", ["Head", "a0", "a16", "b0", "b2"]),
        ("<main><h1>Head</h1><p>intro words that are long enough to count as text</p><article>" + paragraphs(17, "a") + "</article><section>" + paragraphs(3, "s") + "</section></main>", ["Head", "intro", "a0", "s2"]),
        ("<article>" + paragraphs(3, "a") + "</article><article>" + paragraphs(7, "b") + "</article>", ["a0", "a2", "b0", "b6"]),
        ("<h1>Head</h1><section>" + paragraphs(9, "a") + "</section><section>" + paragraphs(1, "b") + "</section>", ["Head", "a0", "a8", "b0"]),
        ("<div id=c><h1>Head</h1><div>" + paragraphs(5, "a") + "</div></div>", ["Head", "a0", "a4"]),
    ],
)
def test_no_part_of_an_article_is_lost(content, want):
    check(page(content), want)


@pytest.mark.parametrize("name", ["comments", "comment-body", "reader-comments", "comments-section", "comment-list", "replies", "comments2"])
def test_reader_comments_go_wherever_they_are(name):
    check(page("<article><h1>H</h1>" + paragraphs(4, "a") + f"<div class='{name}'>" + paragraphs(6, "c") + "</div></article>"), ["H", "a0", "a3"], ["c0", "c5"])
    check(page("<article>" + paragraphs(4, "a") + f"</article><div class='{name}'>" + paragraphs(6, "c") + "</div>"), ["a0", "a3"], ["c0", "c5"])
    check(page("<div id=main><div class=entry>" + paragraphs(2, "a") + f"</div><section id='{name}'>" + paragraphs(8, "c") + "</section></div>"), ["a0", "a1"], ["c0", "c7"])


@pytest.mark.parametrize("name", ["ads", "sponsored content", "comment-list", "has-comments", "comments-open"])
def test_names_of_whole_pages_lose_no_article(name):
    check(f"<html><body><div class='{name}'>" + paragraphs(8, "a") + "</div></body></html>", ["a0", "a7"])
    check(f"<html><body><div class='{name}'><h1>T</h1><article>" + paragraphs(8, "a") + "</article></div><div>" + paragraphs(1, "z") + "</div></body></html>", ["a0", "a7"])


def test_broken_declarations_are_no_text():
    assert main_text("<p>one <![foo]> two</p>") == "one two"
    assert main_text("see a[0]<![b") == "see a[0]"
    assert main_text("<p>x</p><![endif]-->") == "x"
    assert main_text("<!--[if IE]><p>old</p><![endif]--><p>x</p><!-->y") == "x\ny"


def test_random_soups_do_not_crash():
    rng = random.Random(1)
    parts = ["<", "!", "[", "]", ">", "-", "--", "a", "<p>", "</p>", "<div class='comments'>", "</div>", "<!--", "-->", "'", '"', "=", "/", "?", "<?", "<![", "]]>", "word word ", "<article>", "<h1>", "&amp;", "&#", "<script>", "</script>", "<!doctype ", " "]
    for _ in range(20_000):
        main_text("".join(rng.choices(parts, k=rng.randint(1, 25))))


@pytest.mark.parametrize("unit", ["<a b='", "<!--", "<![", "<?", "</", "<!x", "<a ", '<div class="a', "<p>x", "<div>", "a<"])
def test_work_follows_the_length(unit):
    began = time.time()
    main_text(unit * 20_000)
    assert time.time() - began < 8
