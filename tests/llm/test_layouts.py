"""Main texts of hand-written pages that the model's grammar of layouts does not draw."""

import pytest

from tessera.llm import html

S = "The river rose in the night and the old bridge was closed before noon."
T = "Nobody in the village could remember a spring with so much rain."
NAV = '<nav><a href="/">Home</a> <a href="/a">About us</a> <a href="/c">Contact</a></nav>'
FOOT = "<footer><p>Copyright 2024 Example Press. All rights reserved.</p></footer>"
HEAD = "<header><h2>Example Press</h2></header>"
SIDE = '<aside><h3>Related</h3><ul><li><a href="/x">Another story</a></li><li><a href="/y">A third story</a></li></ul></aside>'

PAGES = [
    (f"<title>x</title><p>{S}</p><p>{T}</p>", [S, T]),
    (f"{S}\n{T}", [f"{S} {T}"]),
    (f"{S}", [S]),
    ("<header>H</header><article><p>Hi</p></article>", ["Hi"]),
    (f"<p>{S}", [S]),
    (f"<h1>Flood</h1>{S}<br>{T}", ["Flood", f"{S} {T}"]),
    (f"<html><body>{S}</body></html>", [S]),
    (f"<div><p>{S}</p></div>", [S]),
    (f"<div><div><div><p>{S}</p><p>{T}</p></div></div></div>", [S, T]),
    (f"<section><h2>Flood</h2><p>{S}</p></section>", ["Flood", S]),
    (f"<blockquote>{S}</blockquote>", [S]),
    (f"<pre>{S}\n{T}</pre>", [f"{S} {T}"]),
    (f"<body>{NAV}<h1>Flood</h1><p>{S}</p><p>{T}</p>{FOOT}</body>", ["Flood", S, T]),
    (f"<body>{HEAD}{NAV}<main><h1>Flood</h1><p>{S}</p></main></body>", ["Flood", S]),
    (f"<body><main><p>{S}</p></main>{SIDE}{FOOT}</body>", [S]),
    (f"<body>{NAV}<div id='story'><p>{S}</p><p>{T}</p></div>{SIDE}{FOOT}</body>", [S, T]),
    (f"<body><div class='wrap'>{NAV}<article><header><h1>Flood</h1></header><p>{S}</p></article>{FOOT}</div></body>", ["Flood", S]),
    (f"<article><p>{S}</p><ul><li>{T}</li><li>Sandbags are short.</li></ul></article>{FOOT}", [S, T, "Sandbags are short."]),
    (f"{NAV}<article><p>{S}</p><table><tr><td>Level</td><td>Four metres</td></tr></table></article>", [S, "Level", "Four metres"]),
    (f"<article><p>{S}</p><figure><img src=x><figcaption>The bridge at noon.</figcaption></figure><p>{T}</p></article>{FOOT}", [S, "The bridge at noon.", T]),
    (f"<article><p>{S}</p><div class='ad-slot'>Buy boots now.</div><p>{T}</p></article>", [S, T]),
    (f"<article><p>{S}</p></article><section id='comments'><h3>Comments</h3><p>I saw it too, and it was far worse than that.</p></section>", [S]),
    (f"<div class='cookie-banner'>We use cookies to make this site better.</div><article><p>{S}</p></article>", [S]),
    (f"<form class='search'><input name=q><button>Go</button></form><article><p>{S}</p></article>", [S]),
    (f"<script>var a = '<p>no</p>';</script><style>p {{}}</style><p>{S}</p>", [S]),
    (f"<noscript>Turn scripts on.</noscript><article><p>{S}</p></article>", [S]),
    (f"<article><p>{S.replace('river', '<b>river</b>').replace('bridge', '<a href=/b>bridge</a>')}</p></article>{FOOT}", [S]),
    (f"<article>{S}<p>{T}</article>", [S, T]),
    ("<article><p>Caf&eacute; &amp; bar&nbsp;are  closed\n until the water falls.</p></article>", ["Café & bar are closed until the water falls."]),
    (f"<p title=\"5 > 4\">{S}</p>", [S]),
    (f"<body>{NAV}<article><h1>Flood</h1><p>{S}</p><aside class='pull'>{T}</aside></article></body>", ["Flood", S]),
    (f"<main><article><h1>Flood</h1><p>{S}</p></article><div class='newsletter'><p>Sign up for our weekly letter and never miss a story.</p></div></main>", ["Flood", S]),
    (f"<div class='content'><p>{S}</p><div class='share'><a href=1>Tweet</a> <a href=2>Post</a></div></div>", [S]),
    (f"<dl><dt>Flood</dt><dd>{S}</dd></dl>", ["Flood", S]),
]


def test_layouts_outside_the_grammar():
    got = html.main_texts([p for p, _ in PAGES], html.default_model())
    wrong = [(p, g, "\n".join(t)) for g, (p, t) in zip(got, PAGES) if g != "\n".join(t)]
    assert len(PAGES) >= 30 and len(wrong) <= 1, (len(wrong), wrong)


@pytest.mark.parametrize("depth", [100, 3000])
def test_no_depth_is_special(depth):
    page = "<div>" * depth + f"<p>{S}</p>" + "</div>" * depth + f"<p>{T}</p>"
    dom = html.Dom(page)
    assert len(dom.parents) == depth + 5 and [t for t in dom.texts if t] == [S, T]
    assert max(html._shape([dom])[2]) == depth + 2


@pytest.mark.parametrize("count", [1, 40])
def test_unclosed_quotes_end_at_the_next_bracket(count):
    page = "<p>one</p>" + f"<p class=\"x>{S}</p>" * (2 * count + 1)
    texts = [t for t in html.Dom(page).texts if t]
    assert texts[0] == "one" and texts[-1] == S
    for text in ('<a "b" c=\'d>e\' f>g', "<a 'x", 'a > "b" <i> c', ""):
        places, ends = html.tag_ends(text)
        for k, at in enumerate(places):
            rest = html._REST.match(text, at)
            assert ends[k] == (rest.end() - 1 if rest else -1)


def test_long_names_of_elements():
    name = "x" * 200
    assert [t for t in html.Dom(f"<{name} a='1'>{S}</{name}><p>{T}").texts if t] == [S, T]
