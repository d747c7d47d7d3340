"""Main text of generated pages whose parts are known: lists, tables, quotes, figures, details and sections in main, div and article."""

import random

import pytest

from lumenarc.llm import html

WORDS = "river mill stone harbour lantern orchard valley market winter letter garden bridge window thunder carriage meadow".split()


def said(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def block(rng):
    """Markup of a part and the lines it stands for."""
    kind = rng.choice(["p", "p", "ul", "ol", "table", "blockquote", "details", "figure", "section", "div", "math", "layout"])
    s = [said(rng, rng.randrange(12, 25)) for _ in range(3)]
    if kind == "p":
        return f"<p>{s[0]}</p><p>{s[1]}</p>", s[:2]
    if kind in ("ul", "ol"):
        return f"<{kind}>{''.join(f'<li>{x}</li>' for x in s)}</{kind}>", s
    if kind == "table":
        return "<table><tr><th>Name<th>What</tr>" + "".join(f"<tr><td>{x}</td><td>{i}</td></tr>" for i, x in enumerate(s)) + "</table>", ["Name What", *(f"{x} {i}" for i, x in enumerate(s))]
    if kind == "blockquote":
        return f"<blockquote><p>{s[0]}</p></blockquote>", s[:1]
    if kind == "details":
        return f"<details><summary>More</summary><p>{s[0]}</p></details>", ["More", s[0]]
    if kind == "figure":
        return f"<figure><img src=x><figcaption>{s[0]}</figcaption></figure>", s[:1]
    if kind == "section":
        return f"<section><h2>Part</h2><p>{s[0]}</p></section>", ["Part", s[0]]
    if kind == "div":
        return f"<div><p>{s[0]}</p></div>", s[:1]
    if kind == "math":
        return f"<p>{s[0]} <math><mi>e</mi><mo>=</mo><mn>1</mn></math></p>", [f"{s[0]} e=1"]
    return f"<section class='{rng.choice(['discussion', 'related', 'social', 'search'])}'><p>{s[0]}</p><p>{s[1]}</p></section>", s[:2]


@pytest.mark.parametrize("wrapper", ["<main>{}</main>", "<article>{}</article>", "<div id=content>{}</div>", "<main><article>{}</article></main>", "<div><div class=wrap>{}</div></div>"])
def test_parts_are_kept_in_every_container(wrapper):
    rng = random.Random(wrapper)
    for _ in range(60):
        parts = [block(rng) for _ in range(rng.randrange(3, 9))]
        if "main" not in wrapper and "article" not in wrapper:  # names of layout count outside both
            parts = [p for p in parts if "class=" not in p[0]]
        open_, close = [(f"<p>{t}</p>", [t]) for t in (said(rng, 30), said(rng, 30))]
        every = [open_, *parts, close]
        page = f"<html><head><title>T</title></head><body><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav><div class=sidebar><p>{said(rng, 20)}</p></div>{wrapper.format(''.join(p[0] for p in every))}<div class='ad-slot'>Buy now</div><div class=links><a href=1>a</a> <a href=2>b</a> <a href=3>c</a></div><footer><p>{said(rng, 12)}</p></footer></body></html>"
        assert html.main_text(page) == "\n\n".join(x for p in every for x in p[1]), page


def test_lists_and_tables_at_the_end_stay():
    prose = "".join(f"<p>A first sentence of the text that says a good deal number {i}.</p>" for i in range(5))
    for tail in ("<ul><li>Short</li><li>Last</li></ul>", "<table><tr><td>One<td>Two</table>"):
        for start, end in (("<main>", "</main>"), ("<div id=content>", "</div>"), ("<article>", "</article>")):
            got = html.main_text(f"<body><nav><a>x</a></nav>{start}{prose}{tail}{end}</body>")
            assert got.endswith(("Short\n\nLast", "One Two")), (start, tail, got)


def test_all_articles_of_main_stay_and_notices_go():
    long, short = "".join(f"<p>Sentence {i} of the long piece goes on for a while.</p>" for i in range(9)), "<h2>Brief</h2><p>A few words only.</p>"
    got = html.main_text(f"<main><article>{long}</article><article>{short}</article></main><footer>x</footer>")
    assert got.startswith("Sentence 0") and got.endswith("Brief\n\nA few words only.")
    inside = html.main_text(f"<article>{long}<div class=notice><p>We use cookies on this page, as all pages do nowadays.</p></div><div class=comments><p>{'I say so too, dear author. ' * 4}</p></div><ul class=related><li><a>a</a><li><a>b</a></ul></article>")
    assert inside.endswith("Sentence 8 of the long piece goes on for a while.")
