"""Visible text outside of its usual place."""

import time

import pytest

from rillworks.llm import html_render

PAGES = [
    ("<html><head><title>t</title><h1>Hi</h1><p>text", "Hi\n\ntext"),
    ("<html><head><meta charset=utf-8>plain <b>text</b>", "plain text"),
    ("<head><script>x</script>\n<style>y</style></head><p>z", "z"),
    ("<table><tr><form><td>x</td></form><td>y</table>", "x  y"),
    ("<table><form><tr><td>x<td>y</tr></form><tr><td>z</table>", "x  y\nz"),
    ("<table>Note <b>well</b><tr><td>x</table>", "Note well\nx"),
    ("<table><tr>stray<td>x<td>y</tr></table>", "stray\nx  y"),
    ("<table><tr><td rowspan=3>a<td>b<tr></tr><tr><td>c</table>", "a  b\n   c"),
    ("<table>" + "<div>" * 3000 + "<td>x", "x"),
    ("<p>a <svg><title>no</title><desc>no</desc><text>b</text></svg>", "a\nb"),
    ("<p>a <math><mi>x</mi><annotation>no</annotation></math>", "a x"),
    ("<svg><title/><text/><text>b</text></svg>c", "b\nc"),
    ("<i aria-hidden=true>seen</i>", "seen"),
]


@pytest.mark.parametrize("html, text", PAGES)
def test_visible(html, text):
    assert html_render.render(html) == text


@pytest.mark.parametrize("html, text", [
    ("<style>.h{display:none}</style><p class=h>secret<p>open", "open"),
    ("<style>p{display:none} p.a{display:block} #z{display:none!important}</style><p class=a>1<p>2<p class=a id=z>3", "1"),
    ("<style>@media print{p{display:none}} p b, em:hover, p[x]{visibility:hidden} /* p{display:none} */</style><p x>all <b>of</b> <em>it</em>", "all of it"),
    ("<style>i{visibility:hidden}</style>a<i>b<u style='visibility:visible'>c</u></i>d", "acd"),
    ('<div style="visibility:hidden">a<b style="visibility:visible">b</b>c<img alt=x></div>d', "b\nd"),
    ('<div style="background:url(display:none)">x</div>', "x"),
    ("<details><summary>S</summary>body</details><details open><summary>T</summary>seen</details>", "S\nT\nseen"),
    ("<xmp>&amp;<b></xmp>", "&amp;<b>"),
    ("<ol><li value=5>a<li>b</ol>", "5. a\n6. b"),
    ("<ol reversed><li>a<li hidden>x<li>b</ol>", "2. a\n1. b"),
    ("<table><tr><td>日本語<td>x<tr><td>ab<td>y</table>", "日本語  x\nab      y"),
    ("<p>q</p><pre>\na\n\n\n\nb</pre>", "q\n\na\n\n\n\nb"),
    ("<p hidden>a<p hidden style='display:block'>b", "b"),
    ("<style>{}}{ p{display:none", ""),
])
def test_declared_visibility(html, text):
    assert html_render.render(html) == text


def test_many_rules_and_elements_in_a_second():
    html = "<style>" + "".join(f".a.b{i}{{display:none}}" for i in range(2500)) + "</style>" + "<p class=a>x" * 5000
    began = time.process_time()
    assert html_render.render(html).count("x") == 5000 and time.process_time() - began < 1
