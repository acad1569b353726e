"""Main text of web pages: a tree-structured graphical model over the DOM, solved by sum-product message passing."""

from __future__ import annotations

import html as _html
import random
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Fixed values of HTML: elements that begin a block, have no end tag, or never hold article text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style noscript template iframe object svg math canvas audio video head title textarea select button datalist".split())
RAW = frozenset("script style noscript template iframe textarea title xmp".split())
#: An open element of the first kind ends where one of the second begins.
ENDS = {
    "p": BLOCKS - {"html", "body", "td", "th", "tr", "caption", "tbody", "thead", "tfoot"},
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "tbody", "tfoot"},
    "td": {"td", "th", "tr", "tbody", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "tfoot"},
}
#: Elements beyond which an end tag or a new item does not reach.
FENCES = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "p": {"button", "td", "th", "li", "article", "section", "div"}}

#: Stems of words in class, id and role attributes, by what they tell.
STEMS = {
    "nav": "nav menu breadcrumb pagination pager toc skip".split(),
    "header": "header masthead banner topbar hero".split(),
    "footer": "footer copyright colophon legal".split(),
    "side": "sidebar aside rail widget related recommend trending popular".split(),
    "ad": "ad ads adv advert sponsor promo adsbygoogle dfp".split(),
    "notice": "notice cookie consent gdpr alert popup modal overlay newsletter subscribe signup paywall".split(),
    "share": "share social toolbar follow tags meta byline".split(),
    "form": "form login search input".split(),
    "comment": "comment comments commentlist reply replies disqus respond discussion".split(),
    "content": "content article post entry story main text body prose page".split(),
}
_WORD = {w: g for g, ws in STEMS.items() for w in ws}
_LONG = [(w, g) for g, ws in STEMS.items() for w in ws if len(w) >= 6]
_HEAD = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*+))")
_REST = re.compile(r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>")
#: Elements and attribute words that set a page's content off from what surrounds it.
FRAMES = frozenset(["<nav>", "<header>", "<footer>", "<aside>", "<form>", "<article>", "<main>", *(f"says {g}" for g in STEMS)])
_NAMED = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def attribute_features(attributes: str) -> list[str]:
    found = set()
    for name, a, b, c in _NAMED.findall(attributes):
        value = a or b or c
        name = name.lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            found.add("hidden")
        elif name in ("class", "id", "role"):
            for part in _PART.findall(value):
                part = part.lower()
                group = _WORD.get(part) or _WORD.get(part.rstrip("s")) or next((g for w, g in _LONG if part.startswith(w)), None)
                if group:
                    found.add(f"says {group}")
    return sorted(found)


def tag_ends(page: str) -> tuple[list[int], list[int]]:
    """Places of all ">" and quotes, and for each where a tag ends that comes to it outside quotes (-1: nowhere).

    One pass from the last to the first: a quote leads on behind the next one of its kind; without one it is a character.
    """
    places = [m.start() for m in re.finditer("[>\"']", page)]
    ends = [-1] * (len(places) + 1)
    nearest = {'"': len(places), "'": len(places)}
    for k in range(len(places) - 1, -1, -1):
        c = page[places[k]]
        if c == ">":
            ends[k] = places[k]
        else:
            ends[k] = ends[(nearest[c] if nearest[c] < len(places) else k) + 1]
            nearest[c] = k
    return places, ends


def tags(page: str) -> list[tuple[int, int, bool, str, str]]:
    """Tags in page order: start, end, whether it closes, name, attributes. What is no text has an empty name.

    Comments, declarations and elements of raw text with all they hold are such; raw text that is never closed is the
    rest of the page, but for a title, which then ends where the body begins. A tag whose quotes would swallow all that
    is left ends at its next ">". Time is linear in the page's length.
    """
    out: list[tuple[int, int, bool, str, str]] = []
    ends: dict[str, list[int]] = {}
    at, last, known = 0, page.rfind(">"), None

    def places(pattern: str) -> list[int]:
        if pattern not in ends:
            ends[pattern] = [m.start() for m in re.finditer(pattern, page, re.IGNORECASE)]
        return ends[pattern]

    def first(pattern: str, start: int) -> int:
        found = places(pattern)
        k = bisect_left(found, start)
        return found[k] if k < len(found) else -1

    while (at := page.find("<", at)) >= 0:
        # without a ">" to come there is no tag, and no name to be read to the page's end
        m = _HEAD.match(page, at) if at <= last or page.startswith("<!--", at) else None
        if not m:
            at += 1
            continue
        start = at
        if m[1]:
            end = page.find("-->", at + 4)
            at = end + 3 if end >= 0 else len(page)
            out.append((start, at, False, "", ""))
            continue
        if m[2]:
            at = page.find(">", at) + 1
            out.append((start, at, False, "", ""))
            continue
        if known is None:
            rest = _REST.match(page, m.end())
            end = rest.end() - 1 if rest else -1
            if end < 0:  # from now on by the table, so that no other such tag is followed to the page's end
                known = tag_ends(page)
        else:
            end = known[1][bisect_left(known[0], m.end())]
        name = m[4].lower()
        at = (end if end >= 0 else page.find(">", m.end())) + 1
        if m[3] or name not in RAW or name not in DROPPED:
            out.append((start, at, bool(m[3]), name, page[m.end() : at - 1]))
            continue
        end = first(rf"</{name}(?=[\s/>])", at)
        if end >= 0:
            close = page.find(">", end)
            at = close + 1 if close >= 0 else len(page)
        elif name != "title":
            at = len(page)
        elif (body := first(r"<body\b", at)) >= 0:
            at = body
        out.append((start, at, False, "", ""))
    return out


class Dom:
    """The block elements and text runs of a page as one tree, in page order; node 0 is the root."""

    __slots__ = ("features", "parents", "texts")

    def __init__(self, page: str):
        self.parents: list[int] = [-1]
        self.features: list[list[str]] = [["root"]]
        self.texts: list[str | None] = [None]
        self._read(page)
        frame = "framed" if any(f in FRAMES for fs in self.features for f in fs) else "bare"
        for home in ("<article>", "<main>"):
            same = [fs for fs in self.features if fs[0] == home]
            for fs in same:
                fs.append(f"{home} once" if len(same) == 1 else f"{home} among others")
        for fs, text in zip(self.features, self.texts, strict=True):
            if text is not None:
                fs += [frame, f"{frame} {fs[-1]}", f"{frame} {fs[2]}"]

    def _node(self, parent: int, features: list[str], text: str | None = None) -> int:
        self.parents.append(parent)
        self.features.append(features)
        self.texts.append(text)
        return len(self.parents) - 1

    def _read(self, page: str) -> None:
        stack: list[tuple[str, int]] = [("", 0)]  # open block elements
        places: dict[str, list[int]] = {}  # of the open elements of each name in the stack
        run: list[str] = []
        linked = link_depth = 0
        silent = False  # in an element without article text that is never closed, up to the next block
        unescape = _html.unescape

        def close_run() -> None:
            nonlocal linked
            if run:
                text = " ".join("".join(run).split())
                if text:
                    self._leaf(stack[-1][1], stack[-1][0], text, linked)
                run.clear()
            linked = 0

        def innermost(name: str) -> int:
            """Place of the innermost open element of a name that no fence hides, or 0."""
            own = places.get(name)
            return own[-1] if own and all(not (f := places.get(n)) or f[-1] < own[-1] for n in FENCES.get(name, ())) else 0

        def shut(place: int) -> None:
            while len(stack) > place:
                places[stack.pop()[0]].pop()

        found = tags(page)
        ending: dict[int, int] = {}  # tag that opens an element without article text: the tag that closes it
        opened: dict[str, list[int]] = {}
        for i, (_, _, closes, name, attributes) in enumerate(found):
            if name in DROPPED:
                if not closes and not attributes.endswith("/"):
                    opened.setdefault(name, []).append(i)
                elif closes and opened.get(name):
                    ending[opened[name].pop()] = i

        i, at = 0, 0
        while i <= len(found):
            start, end, closes, name, attributes = found[i] if i < len(found) else (len(page), len(page), False, "", "")
            if start > at and not silent:
                text = page[at:start]
                if "&" in text:
                    text = unescape(text)
                run.append(text)
                if link_depth:
                    linked += len(text.strip())
            i, at = i + 1, end
            if closes:
                if name == "a":
                    link_depth = max(0, link_depth - 1)
                elif name in BLOCKS:
                    silent = False
                    if place := innermost(name):
                        close_run()
                        shut(place)
                        link_depth = 0
            elif name in DROPPED:
                if i - 1 in ending:
                    i = ending[i - 1] + 1
                    at = found[i - 1][1]
                elif not attributes.endswith("/"):
                    silent = True
            elif name == "a":
                link_depth = 1
            elif name == "br":
                run.append("\n")
            elif name in BLOCKS:
                silent = False
                close_run()
                for kind, ended_by in ENDS.items():
                    if name in ended_by and (place := innermost(kind)):
                        shut(place)
                link_depth = 0
                if name not in VOID:
                    above, parent = stack[-1]
                    features = [f"<{name}>", f"<{name}> in <{above}>"]
                    if attributes:
                        features += attribute_features(attributes)
                        features.append(f"<{name}> named" if len(features) > 2 else f"<{name}> unnamed")
                    else:
                        features.append(f"<{name}> unnamed")
                    places.setdefault(name, []).append(len(stack))
                    stack.append((name, self._node(parent, features)))
        close_run()

    def _leaf(self, parent: int, tag: str, text: str, linked: int) -> None:
        size = len(text)
        share = linked / size
        self._node(
            parent,
            [
                "text",
                f"length {min(size.bit_length(), 10)}",
                "links none" if not linked else "links some" if share < 0.5 else "links most",
                "stops" if text[-1] in ".!?:;\"'»”)" else "open",
                f"in <{tag}>",
            ],
            text,
        )


class Model:
    """Binary tree CRF: weights of node features, and a 2 by 2 table of parent-child potentials per kind of child."""

    def __init__(self, weights: dict[str, float], pair: np.ndarray):
        self.weights, self.pair = weights, pair  # pair[kind of child, label of parent, label of child]

    def marginals(self, doms: list[Dom]) -> np.ndarray:
        """Probability that a node is content, for all nodes of all pages in turn."""
        get = self.weights.get
        unary = np.array([sum([get(f, 0.0) for f in fs]) for d in doms for fs in d.features])
        return propagate(unary, self.pair, *_shape(doms))[0]


def _shape(doms: list[Dom]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parents, kinds (0 element, 1 text) and depths of the nodes of a forest."""
    parents, kinds, depths, at = [], [], [], 0
    for d in doms:
        own: list[int] = []
        for p in d.parents:
            own.append(own[p] + 1 if p >= 0 else 0)
            parents.append(p + at if p >= 0 else -1)
        depths += own
        kinds += [t is not None for t in d.texts]
        at += len(d.parents)
    return np.array(parents, np.int64), np.array(kinds, np.int64), np.array(depths, np.int64)


def propagate(unary: np.ndarray, pair: np.ndarray, parents: np.ndarray, kinds: np.ndarray, depths: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Sum-product on a forest: marginals of label 1, of (parent, child) label pairs, and the log partition function.

    One sweep upward, from the deepest level to the roots, and one downward; a level of all trees is one array
    operation. unary is the score of label 1 against 0.
    """
    n = len(unary)
    belief = np.zeros((n, 2))
    belief[:, 1] = unary
    up = np.zeros((n, 2))
    order = np.argsort(depths, kind="stable")
    bounds = np.searchsorted(depths[order], np.arange(int(depths.max(initial=0)) + 2))
    levels = [order[bounds[i] : bounds[i + 1]] for i in range(len(bounds) - 1)]
    for level in reversed(levels[1:]):
        score = pair[kinds[level]] + belief[level][:, None, :]
        top = score.max(axis=2)
        up[level] = top + np.log(np.exp(score - top[:, :, None]).sum(axis=2))
        np.add.at(belief, parents[level], up[level])
    both = np.zeros((n, 2, 2))
    root = belief[levels[0]] if levels else np.zeros((0, 2))
    top = root.max(axis=1, initial=-np.inf)
    log_z = float((top + np.log(np.exp(root - top[:, None]).sum(axis=1))).sum())
    for level in levels[1:]:
        # what the parent believes without this child's own message, then with the child below it
        score = (belief[parents[level]] - up[level])[:, :, None] + pair[kinds[level]] + belief[level][:, None, :]
        score = np.exp(score - score.max(axis=(1, 2), keepdims=True))
        joint = score / score.sum(axis=(1, 2), keepdims=True)
        both[level] = joint
        down = np.log(np.maximum(joint.sum(axis=1), 1e-300))
        belief[level] = down
    top = belief.max(axis=1, keepdims=True)
    share = np.exp(belief - top)
    return share[:, 1] / share.sum(axis=1), both, log_z


def label_nodes(dom: Dom, text: str) -> np.ndarray:
    """Labels from a page's known main text, whose lines are the runs of text that are content.

    The home of the content is the smallest element that holds all of it. An element is content if it holds some
    and lies in the home, or holds no run that the home does not.
    """
    lines = set(text.split("\n"))
    runs = np.array([t is not None for t in dom.texts], np.int64)
    leaf = np.array([t is not None and t in lines for t in dom.texts], np.int64)
    hits, all_runs = leaf.copy(), runs.copy()
    for i in range(len(leaf) - 1, 0, -1):
        hits[dom.parents[i]] += hits[i]
        all_runs[dom.parents[i]] += all_runs[i]
    labels = leaf.copy()
    if not hits[0]:
        return labels
    home = int(np.flatnonzero(hits == hits[0])[-1])  # nodes stand in page order, so the last is the innermost
    inside = np.zeros(len(leaf), bool)
    inside[home] = True
    for i in range(home + 1, len(leaf)):
        inside[i] = inside[dom.parents[i]]
    labels[(runs == 0) & (hits > 0) & (inside | (all_runs == all_runs[home]))] = 1
    return labels


def train(pages: Iterable[tuple[str, str]], rounds: int = 250, rate: float = 0.25, decay: float = 1e-4) -> Model:
    """Maximum likelihood on labelled pages (html, main text) by gradient ascent; expectations are exact marginals."""
    doms, labels = [], []
    for page, text in pages:
        doms.append(Dom(page))
        labels.append(label_nodes(doms[-1], text))
    y = np.concatenate(labels)
    parents, kinds, depths = _shape(doms)
    names = sorted({f for d in doms for fs in d.features for f in fs})
    number = {f: i for i, f in enumerate(names)}
    node = np.array([i for i, fs in enumerate(fs for d in doms for fs in d.features) for _ in fs])
    feature = np.array([number[f] for d in doms for fs in d.features for f in fs])
    w, pair = np.zeros(len(names)), np.zeros((2, 2, 2))
    child = np.flatnonzero(parents >= 0)
    seen = np.zeros((2, 2, 2))
    np.add.at(seen, (kinds[child], y[parents[child]], y[child]), 1)
    target = np.bincount(feature, y[node], len(names))
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, pair)]
    for t in range(1, rounds + 1):
        p, both, _ = propagate(np.bincount(node, w[feature], len(y)), pair, parents, kinds, depths)
        expected = np.zeros((2, 2, 2))
        np.add.at(expected, kinds[child], both[child])
        slopes = (target - np.bincount(feature, p[node], len(names)) - decay * len(doms) * w, seen - expected - decay * len(doms) * pair)
        for x, g, m in zip((w, pair), slopes, moments, strict=True):
            m[0] += 0.1 * (g - m[0])
            m[1] += 0.001 * (g * g - m[1])
            x += rate * (m[0] / (1 - 0.9**t)) / (np.sqrt(m[1] / (1 - 0.999**t)) + 1e-8)
    return Model(dict(zip(names, w.tolist(), strict=True)), pair)


def sample_pages(count: int, seed: int = 0) -> list[tuple[str, str]]:
    """Labelled pages drawn from a grammar of usual layouts: (html, main text)."""
    rng = random.Random(seed)
    pick = rng.choice
    syllables = [a + b for a in "b c d f g l m n p r s t v".split() for b in "a e i o u an er or is".split()]

    def words(n: int) -> str:
        return " ".join("".join(pick(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n))

    def sentence() -> str:
        return words(rng.randint(4, 18)).capitalize() + pick([".", ".", ".", "!", "?"])

    def prose() -> str:
        return " ".join(sentence() for _ in range(rng.randint(1, 5))) if rng.random() < 0.85 else words(rng.randint(1, 6))

    def links(n: int) -> str:
        return "".join(f'<li><a href="/x">{words(rng.randint(1, 3))}</a></li>' for _ in range(n))

    def wrap(inner: str, tags: str, names: str) -> str:
        tag = pick(tags.split())
        named = f' {pick(["class", "id", "class"])}="{pick(names.split())}"' if names and (tag in ("div", "section", "article", "li", "ul", "p", "span") or rng.random() < 0.4) else ""
        return f"<{tag}{named}>{inner}</{tag}>"

    def chrome(kind: str) -> str:
        if kind == "nav":
            return wrap(f"<ul>{links(rng.randint(2, 8))}</ul>", "nav nav div", "menu navbar main-menu nav breadcrumb navigation")
        if kind == "header":
            return wrap(pick([f"<h1>{words(2)}</h1>", f"<p>{sentence()}</p>", words(3)]) + (chrome("nav") if rng.random() < 0.4 else ""), "header header div", "header site-header masthead banner topbar")
        if kind == "footer":
            return wrap(pick([f"&copy; {words(3)} &middot; {prose()}", f"<p>{prose()}</p><ul>{links(3)}</ul>", f"<p>{prose()}</p>", f"<p>{sentence()} {sentence()}</p>", words(4)]), "footer footer div", "footer site-footer copyright page-footer")
        if kind == "side":
            return wrap(f"<h3>{words(2)}</h3>" + pick([f"<ul>{links(4)}</ul>", f"<p>{prose()}</p>", prose()]), "aside aside div", "sidebar widget related related-posts right-rail trending")
        if kind == "ad":
            return wrap(pick([prose(), f"<p>{prose()}</p>", f'<a href="/y">{words(4)}</a>']), "div div section", "ad ads advert advertisement ad-slot sponsored promo adsbygoogle")
        if kind == "notice":
            return wrap(pick([prose(), f"<p>{prose()}</p><button>{words(1)}</button>"]), "div div section", "notice cookie-notice cookie-banner consent alert newsletter popup subscribe")
        if kind == "form":
            return wrap(f'<label>{words(2)}</label><input name="q"><p>{sentence()}</p><button>{words(1)}</button>', "form form form", "search login-form signup")
        if kind == "share":
            return wrap(f"<ul>{links(3)}</ul>", "div div", "share social-links share-tools post-tags")
        said = "".join(wrap(f"<b>{words(1)}</b><p>{prose()}</p>" if rng.random() < 0.5 else f"<p>{prose()}</p><p>{prose()}</p>", "div li article", "comment comment-body reply") for _ in range(rng.randint(1, 4)))
        return wrap(pick(["", f"<h2>{words(2)}</h2>", f"<h3>{words(1)}</h3>"]) + said, "section div div ol", "comments comment-list discussion replies commentlist")

    def framed(body: list[str]) -> str:
        """The content in a home of its own, among what surrounds it."""
        home = pick(["<article>", "<article>", '<article class="post">', "<main>", '<div class="content">', '<div id="main-content">', '<div class="entry-content">', '<div class="article-body">', "<main><article>", '<section class="story">'])
        tags = re.findall(r"<(\w+)", home)
        main = home + "".join(body) + "".join(f"</{t}>" for t in reversed(tags))
        least = 0 if rng.random() < 0.15 else 1
        before = [chrome(k) for k in rng.sample(["nav", "header", "ad", "notice", "form", "side"], rng.randint(least, 4))]
        after = [chrome(k) for k in rng.sample(["comment", "footer", "side", "ad", "share", "notice", "form"], rng.randint(least, 4))]
        inner = "".join([*before, main, *after])
        inner = pick(["{}", "{}", '<div id="page">{}</div>', '<div class="wrapper"><div class="row">{}</div></div>']).format(inner)
        full = f"<!DOCTYPE html><html><head><title>{words(3)}</title><style>p{{margin:0}}</style></head><body>{inner}</body></html>"
        return pick([full, full, f"<body>{inner}</body>", inner])

    def bare(body: list[str]) -> str:
        """The content and nothing else, in the page or in elements without names."""
        inner = pick(["{}", "{}", "<div>{}</div>", "<div><div>{}</div></div>", "<section>{}</section>", "<center>{}</center>"]).format("".join(body))
        return pick(["{}", "<title>t</title>{}", "<body>{}</body>", "<!DOCTYPE html><html><head><title>t</title></head><body>{}</body></html>"]).format(inner)

    def homeless(body: list[str]) -> str:
        """Among what surrounds it, but in no home of its own."""
        before = [chrome(k) for k in rng.sample(["nav", "header", "ad", "notice"], rng.randint(1, 2))]
        after = [chrome(k) for k in rng.sample(["footer", "side", "ad", "comment"], rng.randint(0, 2))]
        return pick(["<body>{}</body>", "<body><div>{}</div></body>", "{}"]).format("".join([*before, *body, *after]))

    out = []
    for n in range(count):
        kept: list[str] = []
        kind = (framed, framed, framed, framed, bare, framed, framed, homeless, framed, framed, framed, "text")[n % 12]
        if kind == "text":
            said = [prose() for _ in range(rng.choice([1, 1, 2, 4]))]
            tag = pick(["", "", "<br><br>", "<p>"])
            kept = said if tag == "<p>" else [" ".join(said)]
            out.append(((tag or "\n\n").join(said), "\n".join(kept)))
            continue

        def block(text: str, tag: str, kept: list[str] = kept) -> str:
            kept.append(text)
            shown = text.split(" ")
            if len(shown) > 3 and rng.random() < 0.3:
                k = rng.randrange(len(shown) - 1)
                shown[k] = pick([f"<b>{shown[k]}</b>", f'<a href="/z">{shown[k]}</a>', f"<em>{shown[k]}</em>"])
            return f"<{tag}>" + " ".join(shown) + ("" if tag == "p" and rng.random() < 0.15 else f"</{tag}>")

        body = [block(words(rng.randint(1, 9)).capitalize(), "h1")] if rng.random() < 0.75 else []
        if body and kind is framed and rng.random() < 0.15:
            body = [f"<header>{body[0]}</header>"]
        if rng.random() < 0.08:
            kept.append(sentence())
            body.append(kept[-1])
        for _ in range(rng.choice([1, 1, 1, 2, 3, 4, 5, 6, 7, 8, 9])):
            roll = rng.random()
            if roll < 0.72:
                body.append(block(prose() if rng.random() < 0.93 else words(rng.randint(1, 2)), "p"))
            elif roll < 0.8:
                body.append(block(words(rng.randint(1, 5)), pick(["h2", "h3"])))
            elif roll < 0.86:
                body.append(f"<{(tag := pick(['ul', 'ol']))}>" + "".join(block(prose(), "li") for _ in range(rng.randint(1, 4))) + f"</{tag}>")
            elif roll < 0.9:
                body.append("<blockquote>" + block(prose(), "p") + "</blockquote>")
            elif roll < 0.93:
                body.append("<table><tr>" + block(words(2), "td") + block(words(2), "td") + "</tr></table>")
            elif kind is not bare:
                body.append(chrome(pick(["ad", "notice", "share", "form", "side"])))
        if kind is not framed and not kept:
            body.append(block(prose(), "p"))
        out.append((kind(body), "\n".join(kept)))
    return out


#: Pages in the labelled sample that the model is fitted on.
TRAINING_PAGES = 900
_model: list[Model] = []


def default_model() -> Model:
    """Fitted once per driver on TRAINING_PAGES labelled pages."""
    if not _model:
        _model.append(train(sample_pages(TRAINING_PAGES)))
    return _model[0]


def main_texts(pages: list[str], model: Model) -> list[str]:
    """Main text of each page: the runs of text that are more likely content than not, one line each, in page order."""
    doms = [Dom(p) for p in pages]
    if not doms:
        return []
    p = model.marginals(doms)
    out, at = [], 0
    for d in doms:
        out.append("\n".join([t for t, q in zip(d.texts, p[at : at + len(d.texts)].tolist(), strict=True) if t is not None and q > 0.5]))
        at += len(d.texts)
    return out


def extract(pages: DataFrame, model: Model | None = None, batch: int = 128) -> DataFrame:
    """pages (page_id, url, html) as page_id, url, text. A null html has an empty text; other columns are not read.

    Raw text that is never closed (script, style, textarea) is the rest of its page; other elements without article
    text that are never closed end at the next block. Without a model, one is fitted on the driver first.

    Pages are independent, so rows stay in their partitions; `batch` pages pass their messages together.
    """
    model = model or default_model()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                part = rows.slice(at, batch)
                texts = main_texts([p or "" for p in part.column(2).to_pylist()], model)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    chosen = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return chosen.mapInArrow(run, "page_id bigint, url string, text string")


def op1_dom_tree_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
