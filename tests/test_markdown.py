"""Rules of Markdown one by one: what a text becomes."""

import re

import pytest

from pagewright.sources import markdown, markup

CASES = [
    ("# one\n## two ##\n#not\n### ", "<h1>one</h1>\n<h2>two</h2>\n<p>#not</p>\n<h3></h3>"),
    ("Title\n===\n\nTwo *a*\nlines\n---\n", "<h1>Title</h1>\n<h2>Two <em>a</em>\nlines</h2>"),
    ("    code\n\n    more <b>\n\nafter", "<pre>code\n\nmore &lt;b&gt;\n</pre>\n<p>after</p>"),
    ("text\n    no code", "<p>text\nno code</p>"),
    ("```py\na\n  b\n```\n~~~\n```\n~~~\n```\nopen", "<pre>a\n  b\n</pre>\n<pre>```\n</pre>\n<pre>open\n</pre>"),
    ("***\n- - -\n___\n--", "<hr>\n<hr>\n<hr>\n<p>--</p>"),
    ("> a\nlazy\n> # h\n\nout", "<blockquote><p>a\nlazy</p>\n<h1>h</h1></blockquote>\n<p>out</p>"),
    ("> > deep\n> back", "<blockquote><blockquote><p>deep\nback</p></blockquote></blockquote>"),
    ("> a\n- b", "<blockquote><p>a</p></blockquote>\n<ul><li>b</li></ul>"),
    ("- a\n- b\n  - c\n    more\n- d", "<ul><li>a</li><li>b\n<ul><li>c\nmore</li></ul></li><li>d</li></ul>"),
    ("1. a\n2. b\n\n3) c", "<ol><li>a</li><li>b</li></ol>\n<ol><li>c</li></ol>"),
    ("- a\n\n  second\n\n      code\n- b", "<ul><li>a\nsecond\n<pre>code\n</pre></li><li>b</li></ul>"),
    ("* a\n+ b", "<ul><li>a</li></ul>\n<ul><li>b</li></ul>"),
    ("para\n2. no item\n- item\npara\n2. item", "<p>para\n2. no item</p>\n<ul><li>item\npara</li></ul>\n<ol><li>item</li></ol>"),
    ("-\n  x\n-\n\n  y", "<ul><li>x</li><li></li></ul>\n<p>y</p>"),
    ("- > q\n  lazy", "<ul><li><blockquote><p>q\nlazy</p></blockquote></li></ul>"),
    ("| a | b |\n|---|:-:|\n| 1 | x \\| y |\n| 2 |\n\nend", "<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>x | y</td></tr><tr><td>2</td><td></td></tr></table>\n<p>end</p>"),
    ("a | b\nno table", "<p>a | b\nno table</p>"),
    ("*a* **b** ***c*** _d_ __e__", "<p><em>a</em> <strong>b</strong> <em><strong>c</strong></em> <em>d</em> <strong>e</strong></p>"),
    ("snake_case_name 2*3*4 * a *", "<p>snake_case_name 2<em>3</em>4 * a *</p>"),
    ("**a *b* c** *a **b** c*", "<p><strong>a <em>b</em> c</strong> <em>a <strong>b</strong> c</em></p>"),
    ("**open *x* and ~~gone~~ ~one~", "<p>**open <em>x</em> and <s>gone</s> ~one~</p>"),
    ("*foo**bar**baz*", "<p><em>foo<strong>bar</strong>baz</em></p>"),
    ("`a`` b` `` c`d `` `open", "<p>a`` b c`d `open</p>"),
    ("\\*no\\* &amp; &copy; <b>x</b> a\\\nb", "<p>*no* &amp; © &lt;b&gt;x&lt;/b&gt; a<br>b</p>"),
    ("[a *b*](http://x \"t\") ![alt *x*](y.png) <https://z>", '<p><a href="http://x">a <em>b</em></a> <img alt="alt x" src="y.png"> <a href="https://z">https://z</a></p>'),
    ("[one][Ref] [ref] [none] [a](b c)\n\n[ref]: <u r> 'title'\n", '<p><a href="u r">one</a> <a href="u r">ref</a> [none] [a](b c)</p>'),
    ("hard  \nbreak\nsoft", "<p>hard<br>break\nsoft</p>"),
    ("\ttab code\n\n-\ttab item", "<pre>tab code\n</pre>\n<ul><li>tab item</li></ul>"),
    ("", ""),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_rules(text, want):
    assert re.sub(r"(?<=<li>)\n+|\n+(?=</li>)", "", markdown.to_html(text)) == want


def test_blocks():
    text = "# 标题\n\nTwo\n---\n\n> quoted *text*\n\n1. first\n   - nested\n2. second\n\n```\ncode\n```\n\n    indented\n\n| a | b |\n|---|---|\n| 1 | **2** |\n\n![pic](x.png) and [link](y)"
    got = [(b[0], b[1], b[2]) for b in markup.markdown_blocks_of(text)]
    assert got == [
        ("TITLE", "标题", 1), ("TITLE", "Two", 2), ("PARAGRAPH", "quoted text", None), ("LIST", "first", None), ("LIST", "nested", None), ("LIST", "second", None), ("CODE", "code", None), ("CODE", "indented", None),
        ("TABLE", "a | b\n1 | 2", None), ("IMAGE", "pic", None), ("PARAGRAPH", "and link", None)]


def test_long_and_hostile_texts_end():
    import time

    began = time.time()
    for text in ("*a " * 5_000, "[" * 2_000, "`" * 1_001 + "a" * 2_000, "> " * 200 + "x", "- " * 200 + "x", "_a*b~" * 2_000, "|" * 3_000):
        markdown.to_html(text)
    assert time.time() - began < 30
