import pytest

from ricefield.llm import html_text

P1 = "First paragraph of the article, with commas, and enough words to count as prose, really."
P2 = "Second paragraph, which goes on for a while, so that the article clearly wins, as it should."


def page(body, head="<title>T</title><script>var a='</p>';</script><style>p{}</style>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


NAV = "<nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>About us</a></li></ul></nav>"

CASES = {
    "article": (page(f"{NAV}<article><h1>Title</h1><p>{P1}</p><p>{P2}</p></article><footer>&copy; x</footer>"), f"Title\n{P1}\n{P2}"),
    "no article": (page(f"{NAV}<div id='wrap'><div class='c'><p>{P1}</p><p>{P2}</p></div><div>Short, <a href='x'>link</a></div></div>"), f"{P1}\n{P2}"),
    "unclosed": (page(f"<article><p><b>{P1}<br><p>{P2}<p>x</article><footer>f</footer>"), f"{P1}\n{P2}\nx"),
    "entities": (page(f"<article><p>a &lt;b&gt; &amp;amp; &#65;&nbsp;&eacute;&amp c</p><p>{P1}</p></article>"), f"a <b> &amp; A é& c\n{P1}"),
    "inline": (page(f"<article><p>one <i>two</i>thr<b>ee</b>\n\t four<br>five</p><p>{P1}</p></article>"), f"one twothree four five\n{P1}"),
    "taken out": (
        page(
            f"<header><p>Site, name, of, header</p></header><aside><p>{P1}</p></aside><div class='cookie-notice'><p>We use, cookies, {P2}</p></div>"
            f"<article><p>{P1}</p><form><p>Write, here</p><input></form><div class='ad'>Buy</div><!-- <p>no</p> --><p>{P2}</p>"
            f"<section id='comments'><p>Nice, one, indeed, {P1}</p></section></article><div class='sidebar'><p>{P2}</p></div>"
        ),
        f"{P1}\n{P2}",
    ),
    "lists": (page(f"<article><p>{P1}</p><ul><li>one<li>two</ul><table><tr><td>a<td>b</table><p>{P2}</p></article>"), f"{P1}\none\ntwo\na\nb\n{P2}"),
    "hidden": (page(f"<article><p>{P1}</p><p style='display: none'>secret</p><p hidden>h</p></article>"), P1),
    "siblings": (page(f"<div><div><p>{P1}</p><p>{P2}</p></div><p>{P2}</p><div><a href='x'>a, b, c</a></div></div>"), f"{P1}\n{P2}\n{P2}"),
    "bare text": ("just text & more", "just text & more"),
    "short": (page("<article><p>Hi.</p></article>"), "Hi."),
    "menus only": (page(NAV), ""),
    "empty": ("", ""),
    "null": (None, ""),
    "cut off": (f"<html><body><article><p>{P1}</p><p>{P2} <a href='unfinished", f"{P1}\n{P2}"),
    "stray": (f"</div></p><article></b><p>{P1}</i></p></article>", P1),
}


@pytest.mark.parametrize("name", CASES)
def test_main_text(name):
    source, text = CASES[name]
    assert html_text.main_text(source) == text


def test_pages(spark):
    rows = [(k, None if k % 3 else f"http://x/{k}", source, 1) for k, (source, _) in enumerate(CASES.values())] + [(None, "u", CASES["lists"][0], 2)] * 2
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")).collect()
    want = [t for _, t in CASES.values()] + [CASES["lists"][1]] * 2
    assert sorted((-1 if r.page_id is None else r.page_id, r.text, r.n_chars) for r in got) == sorted(
        (-1 if k is None else k, t, len(t)) for (k, *_), t in zip(rows, want)
    )
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_long_and_deep_pages():
    long = "word, " * 200_000
    assert html_text.main_text(page(f"<article><p>{long}</p></article>")) == long.strip()
    deep = page("<div>" * 5000 + f"<p>{P1}</p>" + "</div>" * 5000)
    assert html_text.main_text(deep) == P1


ARTICLE = f"<h2 class='section-header'>Part</h2><p>{P1}</p><p>{P2}</p>"
NAMED = {
    "no-": (f"<div class='content no-sidebar'>{ARTICLE}</div>", f"Part\n{P1}\n{P2}"),
    "has-": (f"<div id='page' class='has-sidebar'>{ARTICLE}</div>", f"Part\n{P1}\n{P2}"),
    "layout": (f"<div class='layout-header-fixed'><article><div class='entry-header'>Title</div>{ARTICLE}</article></div>", f"Title\nPart\n{P1}\n{P2}"),
    "holds the article": (f"<div class='sidebar-left'><article>{ARTICLE}</article></div><div class='site-footer'>{P1}</div>", f"Part\n{P1}\n{P2}"),
    "holds most": (f"<div class='widget'>{ARTICLE}</div><div class='cookie-bar'>{P1}</div>", f"Part\n{P1}\n{P2}"),
    "thread": (f"<div class='c'>{ARTICLE}</div><div id='comments'><article class='comment'><p>{P1 * 9}</p></article></div>", f"Part\n{P1}\n{P2}"),
    "taken out": (f"<div class='c'>{ARTICLE}<div class='left-sidebar'><p>{P1}</p></div><div class='related-posts'><p>{P2}</p></div></div>", f"Part\n{P1}\n{P2}"),
}


@pytest.mark.parametrize("name", NAMED)
def test_names_of_elements(name):
    source, text = NAMED[name]
    assert html_text.main_text(page(source)) == text


WRAPPED = {
    "form around the page": (f"<form id='f' method='post'><input type='hidden' name='v'>{NAV}<div class='c'>{ARTICLE}</div><label for='q'>Find</label><input id='q'></form>", f"Part\n{P1}\n{P2}"),
    "form around the article": (f"<form><article>{ARTICLE}</article><fieldset><legend>Log in</legend><label>Name <input></label></fieldset></form>", f"Part\n{P1}\n{P2}"),
    "role": (f"<div role='form'><div class='c'>{ARTICLE}</div></div>", f"Part\n{P1}\n{P2}"),
    "dialog": (f"<div class='c'>{ARTICLE}</div><dialog><p>Please, accept, all</p></dialog><form><p>Write, to, us</p></form>", f"Part\n{P1}\n{P2}"),
    "fieldset and label": (f"<article><p>{P1}</p><fieldset><legend>Note</legend><p>{P2}</p></fieldset><p><label>Kept</label></p></article>", f"{P1}\nNote\n{P2}\nKept"),
    "stray quote": (f"<article><p title=it's>{P1}</p><p>{P2}</p><p>It's over</p></article>", f"{P1}\n{P2}\nIt's over"),
    "quote in a name": (f"<article><p \"x>{P1}</p><p a'b>{P2}</p></article>", f"{P1}\n{P2}"),
    "quoted bracket": (f"<article><p title = 'a > b' lang=\"x>y\">{P1}</p><p>{P2}</p></article>", f"{P1}\n{P2}"),
    "bare value": (f"<article><p><a href=x?a=\"b>{P1}</a> c</p><p>{P2}, {P2}</p></article>", f"{P1} c\n{P2}, {P2}"),
}


@pytest.mark.parametrize("name", WRAPPED)
def test_wrappers_and_quotes(name):
    source, text = WRAPPED[name]
    assert html_text.main_text(page(source)) == text
