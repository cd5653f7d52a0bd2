"""Every visible word of odd markup comes out."""

import random

import pytest

from marlstone.llm.html_text import html_to_text

TAGS = "table tr td th tbody thead colgroup caption p div ul li b span pre h1 dl dt dd blockquote select option".split()


@pytest.mark.parametrize("html, want", [
    ("<table><table><tr><td>a</table>", ["a"]), ("<table><tr><table><tr><td>q", ["q"]), ("<table><tbody><table>q", ["q"]),
    ("<table><colgroup>lost<tr><td>x", ["lost", "x"]), ("<table><colgroup><p>lost<tr><td>x", ["lost", "x"]), ("<table><tbody><tr><td>a<caption>late<tr><td>b", ["late", "a", "b"]),
    ("<table><tr><td>1<table><tr><td>in</table>2</td><td>b</table>z", ["1", "b", "in", "2", "z"]),
])
def test_table_parts_lose_no_text(html, want):
    assert html_to_text(html).split() == want


def test_random_trees():
    r = random.Random(1)
    for n in range(3000):
        words, out, stack = [], [], []
        for i in range(r.randint(1, 25)):
            k = r.random()
            if k < 0.45:
                stack.append(r.choice(TAGS))
                out.append(f"<{stack[-1]}>")
            elif k < 0.65 and stack:
                out.append(f"</{stack.pop(r.randrange(len(stack)))}>")
            else:
                words.append(f"w{n}x{i}q")
                out.append(words[-1] + " ")
        text = html_to_text("".join(out))
        assert all(text.count(w) == 1 for w in words), "".join(out)


def test_padding_is_bounded():
    html = "<table><tr><td>" + "x" * 20_000 + "</td><td>y</td></tr>" + "<tr><td>a</td><td>b</td></tr>" * 4000 + "</table>"
    text = html_to_text(html)
    assert len(text) < 1_000_000 and "x" * 20_000 + "  y" in text and text.count("b") == 4000
