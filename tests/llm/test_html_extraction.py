import random

import pytest

from plumbline.llm import op2_html_extraction as op
from plumbline.llm.op2_html_extraction import Wrapper, _bare, extract, main_text, parse, slots


def wrapper(*pages):
    total = None
    for html in pages:
        own = Wrapper.of(_bare(slots(parse(html))))
        total = own if total is None else total.fold(own)
    return Wrapper.unpacked(total.packed())


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""),
        ("", ""),
        ("only  text", "only text"),
        ("<p>a<p>b &amp; c<div>d<br>e</div>", "a\nb & c\nd e"),
        ("<article><h1>T</h1><p>x<script>var p='</p>'</script></p><form>f</form><aside>s</aside></article><footer>z</footer>", "T\nx"),
        ("<article><header><h1>T</h1><span>by</span></header><p>x</p><section class='comments'><p>no</p></section></article>", "T\nx"),
        ("<body><div class='site-header'>S</div><main><p>one</p><div class='ad-box'>buy</div><p>two</p></main></body>", "one\ntwo"),
        ("<div id='cookie-notice'>we use</div><div class=content><p>long text of the page that has most words</p></div>", "long text of the page that has most words"),
        ("<article><ul><li>a<li>b</ul><table><tr><td>1<td>2</table></article>", "a\nb\n1\n2"),
        ("<article>x <!-- no --> &lt;b&gt; &#233;&nbsp;y <b>z</article>", "x <b> é y z"),
        ("< 5 and > 3", "< 5 and > 3"),
    ],
)
def test_main_text(html, text):
    assert main_text(html) == text


def page(n, body=None):
    return f"<body><div><p>Home</p><p>All rights</p></div><div><p>{body or f'text {n} ' * 20}</p></div><div><p>Imprint of the site, always the same words here</p></div></body>"


def test_constant_nodes_are_template():
    w = wrapper(*[page(n) for n in range(4)])
    assert main_text(page(9), w) == " ".join(["text 9"] * 20)


def test_copies_are_no_evidence():
    w = wrapper(*["<article><p>all the same</p></article>"] * 5)
    assert main_text("<article><p>all the same</p></article>", w) == "all the same"


def test_deep_and_long_pages():
    assert main_text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert main_text("<article>" + "<p>x</p><h2>y</h2>" * 3000 + "</article>").count("\n") == 5999
    w = wrapper(*["<article>" + f"<p>{i}</p><h2>y</h2>" * 300 + "</article>" for i in range(4)])
    assert main_text("<article><p>q</p></article>", w) == "q"


def test_query_on_edge_rows(spark):
    rows = [(1, "https://a.org/1", page(1), "x"), (1, "https://a.org/1", page(1), "x"), (2, None, None, "x"), (None, "bad", "", "x"), *[(10 + n, "https://A.org/z", page(n), "x") for n in range(5)]]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = extract(df).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert {r["text"] for r in got if r["page_id"] == 1} == {" ".join(["text 1"] * 20)}
    assert extract(df.limit(0)).count() == 0


def flat(n):
    """A hundred varying children with a constant one amid them, in another place on every page."""
    some = [f"<div>text {n} {i}</div>" if (i - n) % 7 else f"<section>part {n} {i}</section>" for i in range(100 + 3 * n)]
    some.insert(50 + n, "<div class='line'>All rights are with the owner of the site</div>")
    return f"<body>{''.join(some)}</body>"


def test_constant_node_amid_a_long_list():
    text = main_text(flat(9), wrapper(*[flat(n) for n in range(6)]))
    assert "All rights" not in text and text.count("\n") == 126


def test_constant_member_of_a_run():
    run = lambda n: "<body>" + "".join(f"<p>text {n} {i} and more</p>" for i in range(3 + n)) + "<p>Always the same words</p></body>"
    text = main_text(run(9), wrapper(*[run(n) for n in range(5)]))
    assert "Always" not in text and text.count("\n") == 11


def test_long_lists_are_aligned_like_short_ones(monkeypatch):
    draw = random.Random(5)
    one = lambda: draw.choice(["<div>x</div>", "<div>y</div>", "<div><p>x</p></div>", "<section>x</section>", "<div>z<ul><li>1</li></ul></div>", f"<div>{draw.random()}</div>"])
    weight = lambda: sum(w for _, _, w in op._aligned(*sides, {}))
    for _ in range(60):
        sides = [slots(parse("".join(one() for _ in range(draw.randint(0, 14))))).kids for _ in range(2)]
        monkeypatch.setattr(op, "MATCH_CELLS", 10**9)
        exact = weight()
        monkeypatch.setattr(op, "MATCH_CELLS", -1)
        assert weight() == exact


def _planted(k: int) -> tuple[str, str]:
    """A page of a host whose template has neither telling tags nor telling names, and its article."""
    own = [f"Paragraph {i} of page {k} says {' '.join(f'w{(k * 31 + i * 7 + j) % 997}' for j in range(12 + (k + i) % 9))}." for i in range(4 + k % 5)]
    legal = "".join(f"<p>The company that runs this site is at number {i} and has been so for many years, as all will agree.</p>" for i in range(6))
    top = "<div class=q1><div class=q2>Welcome to the site where you can read a great many things of all kinds</div></div>"
    return f"<html><body>{top}<div class=q3><div class=q4><p>Read more of what we have</p>{''.join(f'<p>{p}</p>' for p in own)}{legal}</div></div><div class=q5>All of this is what it is and nothing else at all</div></body></html>", "\n".join(own)


def test_wrapper_decides_on_unmarked_templates():
    pages = [_planted(k) for k in range(24)]
    wrapper = None
    for html, _ in pages:
        own = op.Wrapper.of(op._bare(op.slots(op.parse(html))))
        wrapper = own if wrapper is None else wrapper.fold(own)

    def measured(with_wrapper):
        told = [(set(op.main_text(html, wrapper if with_wrapper else None).split("\n")), set(text.split("\n"))) for html, text in pages]
        return sum(len(a & b) for a, b in told) / sum(len(a) for a, _ in told), sum(len(a & b) for a, b in told) / sum(len(b) for _, b in told)

    precision, recall = measured(True)
    assert precision >= 0.9 and recall >= 0.9
    assert measured(False)[0] < 0.9  # the words of tags and classes alone do not find it


def test_deep_menus_stay_apart():
    html = "<div>" * 1000 + "<nav><ul><li>menu</li></ul></nav><p>one</p><span>two</span> three<div>four</div>five" + "</div>" * 1000
    assert op.main_text(html) == "one\ntwo three\nfour\nfive"


def test_letters_that_grow_in_lower_case():
    assert op.main_text("<title>a</title><p>Hello İstanbul one.</p><SCRIPT>x</script ><p>two</p>") == "Hello İstanbul one.\ntwo"


def test_broken_markup_is_read_in_linear_time():
    import time

    for html in ("<a '" * 250_000, "<a '" * 250_000 + ">", "<b>" * 200_000 + "</i>" * 100_000, "<div " + "a" * 1_000_000 + ">x", "<" * 500_000):
        began = time.time()
        op.parse(html)
        assert time.time() - began < 10


def test_broken_markup_is_read_in_proportion():
    """End tags that close nothing, and items below a scope, cost no walk over what is open."""
    import time

    n = 120_000
    for html in ("<b><div>" + "<i>" * n + "</b>" * n, "<ul><li><ul>" + "<i>" * n + "<li></li>" * n, "<p><div>" + "<i>" * n + "<p></p>" * n):
        began = time.time()
        op.parse(html)
        assert len(html) > 800_000 and time.time() - began < 20
