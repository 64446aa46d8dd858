"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of a page.

A page is read tag by tag and cut at block-level tags into leaf blocks, each with the tags, classes and ids
above it. Features of a block are those names and what its text looks like; the chain decides block by
block whether it belongs to the article, and Viterbi finds the best sequence of the whole page. The field is
trained by gradient steps on labelled pages that ``labelled_pages`` composes from common layouts.

Only what never shows is left out before the field sees it: comments, the head, titles, scripts, styles, frames and
drawings (svg). Fallback texts of media, formulas and templates are blocks like any other.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read_table, ship, spread

# Names of HTML elements by what they do to the text.
#: Their content is not markup; it ends at their own end tag alone.
RAW = frozenset("script style iframe noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag that ends an open element of these names.
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: An opening tag that ends an svg or math element that is not closed.
BREAKS_OUT = ENDS_P | frozenset("b big body br code dd dt em embed head i img li listing meta nobr ruby s small span strike strong sub sup tt u var".split())

# A quote counts as one if what follows it can follow a value; otherwise the tag ends at the next bracket.
_ATTRIBUTES = r"""(?:[^>"']|"[^"]*"(?=[\s/>])|'[^']*'(?=[\s/>]))*+"""
_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)(?:(" + _ATTRIBUTES + r")>|([^>]*+)(?:>|\Z))|<[!?/][^>]*(?:>|\Z)", re.S)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for name in RAW}
_TITLE_END = re.compile(r"</title(?=[\s/>])[^>]*(?:>|\Z)", re.I)
#: What can stand in a head, and its end; anything else ends one that is not closed.
_IN_HEAD = re.compile(
    r"(?:\s+|<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(title|noscript|template)\b" + _ATTRIBUTES + r">.*?(?:</\1\s*>|(?=</head\b|<body\b)|\Z)|<(style|script|noframes)\b" + _ATTRIBUTES + r">.*?(?:</\2\s*>|\Z)|<(?:base|basefont|bgsound|link|meta)\b[^>]*(?:>|\Z))*(?:</head\s*>)?",
    re.S | re.I,
)
_NAMES = re.compile(r"""\b(class|id|role|data-truth)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_NAME = re.compile(r"[a-z]+")


@dataclass
class Block:
    parts: list[str]
    above: frozenset  # names of the elements above it
    near: tuple  # tags of the two nearest, outer one first
    linked: int = 0
    truth: bool | None = None
    text: str = field(default="")


@dataclass(slots=True)
class _Open:
    tag: str
    above: frozenset
    near: tuple
    truth: bool | None = None
    links: int = 0
    foreign: str = ""  # svg or math, inside one


def blocks(page: str, known: frozenset | None = None) -> list[Block]:
    """Leaf blocks in page order, white space inside each turned into one space; blank ones are left out.

    With ``known``, only those names of the elements above a block are kept.
    """
    out: list[Block] = []
    stack: list[_Open] = [_Open("", frozenset(), ())]
    open_: Counter = Counter()
    current: Block | None = None
    at, shown, titled = 0, False, True  # whether the body has begun; whether a title's end can still come

    def end():
        nonlocal current
        if current is not None:
            current.text = " ".join("".join(current.parts).split())
            if current.text:
                out.append(current)
            current = None

    def say(data):
        nonlocal current, shown
        top = stack[-1]
        if top.foreign == "svg":
            return
        if current is None:
            if not data.strip():
                return
            current, shown = Block([], top.above, top.near, truth=top.truth), True
        text = entities.unescape(data) if "&" in data else data
        current.parts.append(text)
        if top.links:
            current.linked += len(text)

    def drop(k):
        for x in stack[k:]:
            open_[x.tag] -= 1
        del stack[k:]

    while m := _TOKEN.search(page, at):
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag, ends, top = tag.lower(), m.group(1), stack[-1]
        given = m.group(3) if m.group(3) is not None else m.group(4) or ""
        if tag in RAW:
            if not ends and not (top.foreign and given.endswith("/")):
                stop = _RAW_END[tag].search(page, at)
                at = stop.end() if stop else len(page)
            continue
        if top.foreign and not ends and tag in BREAKS_OUT:
            while stack[-1].foreign:
                drop(len(stack) - 1)
            top = stack[-1]
        if tag == "head":  # once the body has begun, the tag says nothing
            if not ends and not shown:
                shown, at = True, _IN_HEAD.match(page, at).end()
            if not shown or current is None:
                end()
            continue
        if tag == "title" and not ends and titled and not top.foreign:
            stop = _TITLE_END.search(page, at)
            titled, at = stop is not None, stop.end() if stop else at
            continue
        shown = shown or tag not in ("html", "base", "link", "meta")
        if tag == "br":
            if current is not None:
                current.parts.append(" ")
            continue
        inline = tag in INLINE or top.foreign == "math"
        if not inline and tag != "svg" and top.foreign != "svg":
            end()
        if ends:
            if not open_[tag]:
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    drop(k)
                    break
                if inline and not top.foreign and stack[k].tag not in INLINE:
                    break
        elif tag not in VOID and not given.endswith("/"):
            stops = () if top.foreign else CLOSES.get(tag, ()) + (("p",) if tag in ENDS_P and tag != "p" else ())
            if any(open_[x] for x in stops):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in stops:
                        drop(k)
                        break
                    if stack[k].tag not in INLINE:
                        break
            top = stack[-1]
            names, truth = [tag], top.truth
            if "=" in given:
                for key, a, b, c in _NAMES.findall(given):
                    value = (a or b or c).lower()
                    if key.lower() == "data-truth":
                        truth = value == "1"
                    else:
                        names += ["." + n for n in _NAME.findall(value)]
            new = [n for n in names if n not in top.above and (known is None or n in known)]
            foreign = tag if tag in ("svg", "math") else "" if tag == "foreignobject" else top.foreign
            stack.append(_Open(tag, top.above | frozenset(new) if new else top.above, (*top.near, tag)[-2:], truth, top.links + (tag == "a"), foreign))
            open_[tag] += 1
    if at < len(page):
        say(page[at:])
    end()
    return out


def _level(x: float, steps: tuple) -> int:
    return sum(x >= s for s in steps)


#: Elements that say themselves that they hold the article.
HOLDERS = frozenset(("article", "main"))


def _apart(found: list[Block]) -> list[bool]:
    """For each block whether it stands outside of the holders of a page that has one."""
    inside = [not HOLDERS.isdisjoint(b.above) for b in found]
    some = any(inside)
    return [some and not x for x in inside]


def _marks(b: Block, place: float, apart: bool) -> list[str]:
    """Marks of a block's text and place."""
    t = b.text
    words = t.count(" ") + 1
    return [
        "bias",
        f"words:{_level(words, (3, 8, 20, 50))}",
        f"links:{_level(b.linked / len(t), (0.01, 0.3, 0.8))}",
        f"stop:{t[-1] in '.!?:…»”'}",
        f"stops:{_level(sum(map(t.count, '.,;')) / words, (0.02, 0.1, 0.3))}",
        f"sign:{t[:40].startswith(('©', '(c)')) or '©' in t[:40]}",
        f"place:{_level(place, (0.1, 0.9))}:{words < 12}",
        f"apart:{apart}",
    ]


def _names_above(above: frozenset, near: tuple) -> list[str]:
    return [*("in:" + x for x in sorted(above)), *(f"near{k}:{x}" for k, x in enumerate(reversed(near)))]


def block_features(found: list[Block]) -> list[list[str]]:
    """Names above each block, the nearest ones marked, and marks of its text and place."""
    apart = _apart(found)
    return [_names_above(b.above, b.near) + _marks(b, i / len(found), apart[i]) for i, b in enumerate(found)]


@dataclass
class Field:
    weights: dict[str, float]  # for the article, against the rest
    moves: tuple  # from rest or article to rest or article

    @cached_property
    def known(self) -> frozenset:
        """Names of elements that have a weight."""
        return HOLDERS | {f[3:] for f in self.weights if f.startswith("in:")}

    def scores(self, found: list[Block]) -> list[float]:
        """Weight of the article's features of each block; equal names above are summed once."""
        get, n, met, out, apart = self.weights.get, len(found), {}, [], _apart(found)
        for i, b in enumerate(found):
            head = met.get((b.above, b.near))
            if head is None:
                head = met[b.above, b.near] = sum([get(f, 0.0) for f in _names_above(b.above, b.near)])
            out.append(head + sum([get(f, 0.0) for f in _marks(b, i / n, apart[i])]))
        return out

    def decode(self, found: list[Block]) -> list[bool]:
        """The best sequence of labels by Viterbi; of equal ones, that with the article."""
        if not found:
            return []
        scores, m = self.scores(found), self.moves
        rest, body, back = 0.0, scores[0], []
        for s in scores[1:]:
            r0, r1, b0, b1 = rest + m[0], body + m[2], rest + m[1], body + m[3]
            back.append((r1 > r0, b1 >= b0))
            rest, body = max(r0, r1), max(b0, b1) + s
        y = body >= rest
        labels = [y]
        for step in reversed(back):
            y = step[y]
            labels.append(y)
        return labels[::-1]


def fit_field(pages: list[tuple[list[list[str]], list[bool]]], rounds: int = 100, l2: float = 1e-3) -> Field:
    """Maximum likelihood by adaptive gradient steps; the gradient comes from forward-backward over all pages at once."""
    pages = [(x, y) for x, y in pages if x]
    index: dict[str, int] = {}
    size = np.array([len(x) for x, _ in pages])
    n, width = len(pages), int(size.max())
    flat = [[index.setdefault(f, len(index)) for f in fs] for x, _ in pages for fs in x]
    cols, starts = np.concatenate(flat), np.cumsum([0, *map(len, flat)])[:-1]
    rows = np.repeat(np.arange(len(flat)), [len(f) for f in flat])
    inside = np.arange(width)[None] < size[:, None]
    y = np.zeros((n, width), int)
    y[inside] = np.concatenate([np.array(t, int) for _, t in pages])
    both = inside[:, 1:]
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:, :-1][both], y[:, 1:][both]), 1)
    w, t = np.zeros(len(index)), np.zeros((2, 2))
    gw, gt = np.full(len(index), 1e-6), np.full((2, 2), 1e-6)
    for _ in range(rounds):
        e = np.zeros((n, width, 2))
        e[inside, 1] = np.add.reduceat(w[cols], starts)
        a, b = np.zeros((n, width, 2)), np.zeros((n, width, 2))
        a[:, 0] = e[:, 0]
        for i in range(1, width):
            a[:, i] = np.logaddexp(a[:, i - 1, :1] + t[0], a[:, i - 1, 1:] + t[1]) + e[:, i]
        for i in range(width - 2, -1, -1):
            s = t[None] + (e[:, i + 1] + b[:, i + 1])[:, None]
            b[:, i] = np.where(inside[:, i + 1, None], np.logaddexp(s[:, :, 0], s[:, :, 1]), 0.0)
        last = a[np.arange(n), size - 1]
        z = np.logaddexp(last[:, 0], last[:, 1])[:, None]
        p = np.exp(a[:, :, 1] + b[:, :, 1] - z)
        dw = np.bincount(cols, (y - p)[inside][rows], len(index)) - l2 * w * n
        q = np.exp(a[:, :-1, :, None] + t[None, None] + (e + b)[:, 1:, None, :] - z[:, :, None, None])
        dt = seen - q[both].sum(0) - l2 * t * n
        gw += dw * dw
        gt += dt * dt
        w += 0.5 * dw / np.sqrt(gw)
        t += 0.5 * dt / np.sqrt(gt)
    return Field({f: float(w[i]) for f, i in index.items()}, tuple(t.ravel().tolist()))


def labelled_pages(count: int = 900, seed: int = 7) -> list[str]:
    """Pages of many layouts, half of them bare; ``data-truth`` on an element says whether the text in it is the article's, and without one it is."""
    rng = random.Random(seed)

    def word():
        return "".join(rng.choice(("ta", "re", "mi", "son", "el", "du", "ch", "or", "in", "ve")) for _ in range(rng.randint(1, 4)))

    def say(lo, hi, stop="."):
        return (" ".join(word() for _ in range(rng.randint(lo, hi)))).capitalize() + stop

    def links(n):
        return "".join(f'<li><a href="/{word()}">{say(1, 3, "")}</a></li>' for _ in range(n))

    def box(truth, inner, *choices):
        tag, names = rng.choice(choices)
        name = rng.choice(names.split("|"))
        named = "" if not name else f' {"id" if rng.random() < 0.2 else "class"}="{name}"'
        return f'<{tag}{named} data-truth="{truth}">{inner}</{tag}>'

    def para():
        text = say(*rng.choice(((1, 3), (4, 20), (8, 60), (8, 60))), rng.choice((".", ".", ".", "", "!", " |")))
        if rng.random() < 0.05:
            text += f" <math><mi>{word()}</mi><mo>=</mo><mn>2</mn></math> " + say(2, 9)
        if rng.random() < 0.3:
            text += f" <a href='#'>{say(1, 4, '')}</a> " + say(3, 12)
        if rng.random() < 0.2:
            text = f"<b>{say(2, 9)}<br>{text}" + ("</b>" if rng.random() < 0.5 else "")
        return f"<p>{text}" + ("</p>" if rng.random() < 0.8 else "")

    def piece():
        return rng.choice([
            para, para, para, para, para,
            lambda: f"<h{rng.randint(2, 4)}>{say(1, 7, '')}</h2>",
            lambda: "<ul>" + "".join(f"<li>{say(2, 14)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>",
            lambda: f"<blockquote>{para()}</blockquote>",
            lambda: f"<figure><img src=x><figcaption>{say(2, 9)}</figcaption></figure>",
            lambda: f"<table><tr><th>{say(1, 2, '')}</th></tr><tr><td>{say(1, 4, '')}</td></tr></table>",
            lambda: f"<pre>{say(2, 12)}</pre>",
            lambda: "</p>" + say(1, 30),
            lambda: f"<section>{para()}{para()}</section>",
            lambda: f"<div>{say(5, 40)}</div>",
        ])()

    def ad():
        return box(0, say(3, 25), ("div", "ad|ads|advert|advertisement|banner|sponsored|promo|ad-box|adsbygoogle"), ("aside", "ad|promo|sponsor"))

    def comments():
        one = "".join(box(0, f"<p>{say(3, 40)}</p>", ("div", "comment|reply|comment-body"), ("article", "comment"), ("li", "comment")) for _ in range(rng.randint(1, 5)))
        return box(0, f"<h3>{say(1, 2, '')}</h3>{one}", ("section", "comments|discussion|responses"), ("div", "comments|comment-list|disqus|reader-comments"))

    def aside():
        return box(0, rng.choice([f"<ul>{links(rng.randint(2, 8))}</ul>", f"<h3>{say(1, 3, '')}</h3><p>{say(5, 30)}</p>"]), ("aside", "|sidebar|related|widget"), ("div", "sidebar|side|related|widget|recommended|share|social|tags|newsletter"))

    def notice():
        return box(0, say(4, 25) + " <button>OK</button>", ("div", "cookie|cookie-banner|notice|consent|popup|modal|alert|gdpr|overlay|subscribe|paywall"))

    def fallback():
        tag = rng.choice(("noscript", "object", "canvas", "video", "audio", "template", "datalist", "map"))
        inner = say(2, 12) if rng.random() < 0.7 else f"<p>{say(2, 9)} <a href=x>{say(1, 3, '')}</a></p>"
        return f'<{tag} data-truth="0">{inner}</{tag}>'

    def form():
        return f'<form data-truth="0"><label>{say(1, 3, "")}</label><input><select><option>{say(1, 2, "")}<option>{say(1, 2, "")}</select><textarea>{say(2, 6)}</textarea><button>{say(1, 2, "")}</button></form>'

    def nav():
        inner = f"<ul>{links(rng.randint(3, 9))}</ul>" if rng.random() < 0.7 else " | ".join(f"<a href=x>{say(1, 2, '')}</a>" for _ in range(5))
        return box(0, inner, ("nav", "|menu|main-nav"), ("div", "nav|menu|navbar|breadcrumb|topbar"), ("ul", "nav|menu"))

    def footer():
        return box(0, f"&copy; {word()}.example &middot; {say(3, 15)}" + (f"<p>{say(3, 14)}</p>" if rng.random() < 0.3 else ""), ("footer", "|site-footer"), ("div", "footer|copyright|legal|bottom"))

    def odd():
        """The attribute of a box whose name says nothing, or none."""
        return rng.choice(("", "", f' class="{word()}"', f' id="{word()}"', f' class="{word()} {word()}"', ' class="wrap"', ' class="container"', ' class="row"', ' id="page"', ' class="col"', ' class="inner"', ' class="box"'))

    def plain():
        """An article that nothing names: bare, in tables, in elements of old pages, in boxes with names that say nothing."""
        inner = (f"<h{rng.randint(1, 3)}>{say(2, 10, '')}</h1>" if rng.random() < 0.6 else "") + "".join(piece() for _ in range(rng.randint(1, 9)))
        how = rng.randint(0, 12)
        if how == 12:
            tag = rng.choice(("", "", "span", "b"))
            inner = " ".join(say(2, 20) for _ in range(rng.randint(1, 5)))
            return f"<{tag}>{inner}</{tag}>" if tag else inner
        if how < 3:
            return inner
        if how < 5:
            return rng.choice(("<br><br>", "\n<hr>", "<p>", " ", "\n\n")).join(say(4, 40) for _ in range(rng.randint(1, 6)))
        if how == 5:
            return f"<table{odd()}><tr><td>{inner}</td></tr></table>"
        if how == 6:
            return f"<center><font size=2>{inner}</font></center>"
        depth = rng.randint(1, 4)
        return "".join(f"<div{odd()}>" for _ in range(depth)) + inner + "</div>" * depth

    def bare_page():
        """What is not the article has its own mark here, and all else is the article."""
        top = [x() for x in (nav, ad, notice, aside, form, line, line) if rng.random() < 0.25]
        end = [x() for x in (comments, aside, ad, footer, footer, line, line) if rng.random() < 0.25]
        page = ("".join(top) if rng.random() < 0.6 else "") + plain() + ("".join(end) if rng.random() < 0.6 else "")
        if rng.random() < 0.3:
            page = f"<div{odd()}>{page}</div>"
        whole = rng.random()
        if whole < 0.5:
            return f'<html><head><title>x</title></head><body data-truth="1">{page}</body></html>'
        return f'<body data-truth="1">{page}' if whole < 0.7 else page

    def line():
        """Links and signatures in elements that nothing names."""
        tag = rng.choice(("p", "div", "div", "td", "center", "ul"))
        inner = rng.choice((" | ".join(f"<a href=x>{say(1, 2, '')}</a>" for _ in range(rng.randint(2, 6))), f"&copy; {rng.randint(1998, 2024)} {say(1, 5)}", f"Copyright &copy; {word()}.example"))
        return f'<{tag}{odd()} data-truth="0">{inner}</{tag}>'

    pages = []
    for k in range(count):
        if k % 2:
            pages.append(bare_page())
            continue
        inner = f"<h1>{say(2, 10, '')}</h1>" + "".join(piece() for _ in range(rng.randint(1, 14)))
        if rng.random() < 0.3:
            cut = inner.rfind("<p>")
            inner = inner[:cut] + rng.choice([ad, form, aside, fallback])() + inner[cut:] if cut > 0 else inner
        body = box(1, inner + (comments() if rng.random() < 0.15 else ""), ("article", "|post|entry|story"), ("article", ""), ("main", "|content|main"), ("div", "content|post|article|entry-content|article-body|post-body|story|main|text"), ("section", "article|post|content"))
        if rng.random() < 0.3:
            body = f"<main>{body}</main>" if rng.random() < 0.5 else f'<div id="wrapper">{body}</div>'
        top = [nav()] if rng.random() < 0.9 else []
        if rng.random() < 0.4:
            top.append(box(0, f"<h2>{say(1, 3, '')}</h2><p>{say(2, 8)}</p>", ("header", "|masthead|site-header"), ("div", "header|masthead|logo")))
        top += [x() for x in (ad, notice, aside, form, fallback) if rng.random() < 0.35]
        rng.shuffle(top)
        end = [x() for x in (comments, aside, ad, form, notice, fallback) if rng.random() < 0.35] + ([footer()] if rng.random() < 0.9 else [])
        pages.append("<!DOCTYPE html><html><head><title>x</title></head><body>" + "".join(top) + "<!-- x -->" + body + "".join(end) + "</body></html>")
    return pages


@lru_cache(maxsize=1)
def trained() -> Field:
    """The field fitted on the composed pages; the same each time."""
    pages = []
    for page in labelled_pages():
        found = blocks(page)
        pages.append((block_features(found), [b.truth is not False for b in found]))
    return fit_field(pages)


def extract(page: str | None, model: Field | None = None) -> str:
    """Article text of a page: its blocks in page order, joined by one space; empty if there are none."""
    model = model or trained()
    found = blocks(page or "", model.known)
    return " ".join(b.text for b, y in zip(found, model.decode(found)) if y)


def extract_pages(pages: DataFrame, model: Field | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), a row for each row of ``pages``.

    Null, empty and textless pages have an empty text. Broken and truncated markup is read as far as it
    goes, and the time grows with a page's length however deep its elements lie. Where two labellings of a
    page are equally good, the one with more of the article's blocks is taken. Rows may repeat and ids be
    null; an empty table gives no rows; other columns play no part.
    """
    ship(pages.sparkSession)
    model = model or trained()

    def run(batches):
        for batch in batches:
            texts = [extract(x.as_py(), model) for x in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    cols = [F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")]
    return pages.select(*cols).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op2_html(spark, sf_dir: str) -> DataFrame:
    return extract_pages(spread(read_table(spark, sf_dir, "pages")))
