"""Markdown of pages against the trees they were made of."""

import random

import pytest

from granary.functions.html_markdown import markdown_of

WORDS = ["alpha", "beta", "gamma", "delta", "x1"]


def inline(r, depth=0):
    """(html, markdown) of a run of words, marks and links."""
    kind = r.choice(["text", "text", "strong", "em", "code", "a"]) if depth < 2 else "text"
    if kind == "text":
        words = r.choices(WORDS, k=r.randrange(1, 4))
        return r.choice([" ", "\n ", "  "]).join(words), " ".join(words)
    if kind == "code":
        return "<code>beta</code>", "`beta`"
    html, text = inline(r, depth + 1)
    if kind == "a":
        return f'<a class="k" href="/p?q=1&amp;r=2">{html}</a>', f"[{text}](https://h.org/p?q=1&r=2)"
    mark = {"strong": "**", "em": "*"}[kind]
    return f"<{kind}>{html}</{kind}>", f"{mark}{text}{mark}"


def line(r):
    parts = [inline(r) for _ in range(r.randrange(1, 4))]
    return " ".join(h for h, _ in parts), " ".join(m for _, m in parts)


def items(r, depth):
    tag = r.choice(["ul", "ol"])
    html, lines = "", []
    for n in range(1, r.randrange(2, 4)):
        h, m = line(r)
        inner = items(r, depth + 1) if depth < 2 and r.random() < 0.4 else ("", [])
        html += f"<li>{h}{inner[0]}</li>"
        lines += [(f"{n}. " if tag == "ol" else "- ") + m] + ["  " + x for x in inner[1]]
    return f"<{tag}>{html}</{tag}>", lines


def block(r, depth=0):
    kind = r.choice(["p", "h2", "list", "pre", "table", "quote", "dropped", "hr"] if depth < 2 else ["p"])
    if kind == "p":
        h, m = line(r)
        return f"<p>{h}</p>", [m]
    if kind == "h2":
        h, m = line(r)
        return f"<h2>{h}</h2>", ["## " + m]
    if kind == "list":
        h, lines = items(r, 0)
        return h, ["\n".join(lines)]
    if kind == "pre":
        return "<pre>a  &lt;b\n  c</pre>", ["```\na  <b\n  c\n```"]
    if kind == "table":
        rows = [[line(r) for _ in range(2)] for _ in range(2)]
        html = "".join("<tr>" + "".join(f"<td>{h}</td>" for h, _ in row) + "</tr>" for row in rows)
        lines = ["| " + " | ".join(m for _, m in row) + " |" for row in rows]
        return f"<table>{html}</table>", ["\n".join([lines[0], "| --- | --- |", lines[1]])]
    if kind == "quote":
        parts = [block(r, 2) for _ in range(r.randrange(1, 3))]
        return "<blockquote>" + "".join(h for h, _ in parts) + "</blockquote>", ["> " + x for _, ms in parts for x in ms]
    if kind == "hr":
        return "<hr>", ["---"]
    return "<script>let x = '<p>no</p>';</script><form><p>no <input></p></form><iframe>no</iframe><noscript>no</noscript><img src=x alt=no>", []


@pytest.mark.parametrize("seed", range(200))
def test_pages_of_random_trees(seed):
    r = random.Random(seed)
    parts = []
    last = None
    while len(parts) < 6:
        h, ms = block(r)
        if h[:3] in ("<ul", "<ol") and last == "list":
            continue
        last = "list" if h[:3] in ("<ul", "<ol") else "other"
        parts.append((h, ms))
    html = "<html><head><title>no</title></head><body>" + r.choice(["", "\n"]).join(h for h, _ in parts) + "</body></html>"
    found = markdown_of(html, "https://h.org/dir/page")
    expected = [m for _, ms in parts for m in ms]
    assert [x for x in found.split("\n") if x] == [x for m in expected for x in m.split("\n") if x]


@pytest.mark.parametrize(
    "html,expected",
    [
        (None, ""), ("", ""), ("plain &amp; text", "plain & text"), ("a<br>b", "a  \nb"), ("<p>open <b>bold", "open bold"), ("<a>no link</a> <a href='javascript:x'>js</a>", "no link js"),
        ("<p>a</p></div></ul>", "a"), ("<b> spaced </b>end", "**spaced** end"), ("<table><tr><td>a|b<tr><td>c</table>", "| a\\|b |\n| --- |\n| c |"), ("<pre>never closed", "```\nnever closed\n```"), ("<form>never closed <p>x", ""),
    ],
)
def test_odd_pages(html, expected):
    assert markdown_of(html, "https://h.org/") == expected
