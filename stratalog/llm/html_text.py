"""Main text of web pages by a linear-chain conditional random field over the leaf blocks of the page.

A tolerant reader turns a page into leaf blocks: runs of text between the borders of block elements. Each block is described
by its ancestors (tags, and what their class and id names hint at) and by its text; the field, trained on generated labelled
pages of many layouts, labels the blocks of a page together by Viterbi decoding. Blocks labelled as main text are joined.
"""

from __future__ import annotations

import functools
import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm import common
from stratalog.llm.crf import Crf

_NAME = re.compile(r"</?([A-Za-z][A-Za-z0-9:-]*)")
_TAG_MARK = re.compile(r"[>\"']")
#: Quoted values in a tag, at most; a tag with more ends at its first ``>``.
_QUOTED = 400
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What holds no tags, and reaches to the end of the page if it is not closed; and what holds tags but no text of the page.
_RAW = frozenset("script style textarea title".split())
_HIDDEN = frozenset("noscript template svg select option".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: What an opening tag closes, if it is the innermost block of that kind.
_CLOSES = {"p": ("p",), "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "tr": ("tr", "td", "th", "p")}
_TAGS = ("nav", "header", "footer", "aside", "form", "article", "main", "section", "li", "p", "h1", "h2", "h3", "h4", "blockquote", "pre", "table", "figure", "figcaption", "button", "label", "a", "body", "dialog", "address", "div", "ul", "ol", "menu", "dl")
_HINTS = {
    "ad": r"\bads?\b|advert|sponsor|promo|banner|\bad[-_]|[-_]ads?\b",
    "nav": r"nav|menu|breadcrumb|pagination|pager|toolbar",
    "foot": r"foot|copyright|legal|colophon",
    "head": r"(?:site|page|top|mast)[-_]?head|masthead|logo|topbar",
    "side": r"side|aside|widget|related|recommend|trending|teaser",
    "comment": r"comment|reply|replies|disqus|discussion|response",
    "notice": r"cookie|consent|notice|popup|modal|newsletter|subscri|gdpr|overlay|alert|paywall",
    "main": r"article|content|post|entry|story|\bmain\b|\bbody\b|text|prose",
    "share": r"share|social|follow|byline|meta|tags?\b",
    "form": r"form|login|signup|search|register",
}
_HINT = {k: re.compile(v, re.I) for k, v in _HINTS.items()}
_WORDS = re.compile(r"cookie|subscribe|newsletter|sign up|log ?in|copyright|©|all rights|advert|sponsor|privacy|terms of|share this|read more|click here|javascript|accept", re.I)


@dataclass
class Block:
    text: str
    tags: frozenset[str]
    hints: frozenset[str]
    parent: str
    linked: float
    depth: int


@dataclass
class _Open:
    tag: str
    hints: tuple[str, ...]
    tags_in: frozenset[str] = field(default_factory=frozenset)
    hints_in: frozenset[str] = field(default_factory=frozenset)


@functools.lru_cache(20_000)
def _hints(names: str) -> tuple[str, ...]:
    return tuple(k for k, p in _HINT.items() if p.search(names))


def tokens(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """Markup in order: begin, end, name of a tag in lower case (or "", or "cdata"), whether it closes, and its attributes.

    The reader goes forward only: it remembers which marks do not come any more, so that broken pages take linear time.
    """
    at, gone = 0, {m: page.rfind(m) for m in (">", '"', "'", "-->", "]]>")}
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4) + 3 if gone["-->"] >= at + 4 else len(page)
            yield at, end, "", False, ""
        elif page.startswith("<![CDATA[", at) and gone["]]>"] >= at + 9:
            end = page.find("]]>", at) + 3
            yield at, end, "cdata", False, page[at + 9 : end - 3]
        elif gone[">"] < at:
            return
        elif page[at + 1 : at + 2] in ("!", "?"):
            end = page.find(">", at) + 1
            yield at, end, "", False, ""
        elif m := _NAME.match(page, at):
            end = 0
            mark = _TAG_MARK.search(page, m.end())
            for _ in range(_QUOTED):
                if mark is None or mark[0] == ">":
                    end = mark.end() if mark else 0
                    break
                if gone[mark[0]] == mark.start():
                    break
                mark = _TAG_MARK.search(page, page.find(mark[0], mark.end()) + 1)
            # A quote that is not closed does not hide the rest of the page.
            end = end or page.find(">", at) + 1
            yield at, end, m[1].lower(), page[at + 1] == "/", page[m.end() : end - 1]
        else:
            end = at + 1
        at = end


def blocks(page: str) -> list[Block]:
    """Leaf blocks with text, in page order. Unclosed, stray and crossed tags are tolerated; a lone ``<`` is text."""
    out: list[Block] = []
    stack = [_Open("", ())]
    outer: list[str] = []  # the open blocks and hidden elements
    count: dict[str, int] = {}
    held: list[str] = []
    linked = at = unseen = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(held).split())
        if text:
            top = stack[-1]
            inner = next((t for t in reversed(outer) if t in _BLOCK), "")
            out.append(Block(text, top.tags_in, top.hints_in, inner, min(1.0, linked / len(text)), len(stack)))
        held.clear()
        linked = 0

    def put(text: str) -> None:
        nonlocal linked
        if text and not unseen:
            text = html.unescape(text) if "&" in text else text
            held.append(text)
            if count.get("a"):
                linked += len(text.strip())

    def push(tag: str, attributes: str) -> None:
        nonlocal unseen
        names = " ".join("".join(m[1:]) for m in _ATTR.findall(attributes)) if "=" in attributes else ""
        top = stack[-1]
        own = _hints(names) if names else ()
        stack.append(_Open(tag, own, top.tags_in | {tag}, top.hints_in.union(own) if own else top.hints_in))
        count[tag] = count.get(tag, 0) + 1
        if tag in _BLOCK or tag in _HIDDEN:
            outer.append(tag)
        unseen += tag in _HIDDEN

    def pop_to(tag: str) -> None:
        nonlocal unseen
        while True:
            gone = stack.pop().tag
            count[gone] -= 1
            if gone in _BLOCK or gone in _HIDDEN:
                outer.pop()
            unseen -= gone in _HIDDEN
            if gone == tag:
                return

    def around() -> str:
        """The innermost block or hidden element."""
        return outer[-1] if outer else ""

    def hidden_by() -> str:
        return next((o.tag for o in reversed(stack) if o.tag in _HIDDEN or o.tag == "foreignobject"), "") if unseen else ""

    def close_hidden(tag: str) -> None:
        """A start tag ends an option, a list of options or a drawing that can't hold it."""
        if hidden_by() == "option" and (tag in _BLOCK or tag in ("option", "optgroup", "select", "input", "textarea")):
            pop_to("option")
        if hidden_by() == "select" and tag in ("select", "input", "textarea") or hidden_by() == "svg" and tag in _BLOCK:
            pop_to(hidden_by())

    skip_until, last_frame = 0, page.lower().rfind("</iframe")
    for begin, end, tag, closes, attributes in tokens(page):
        if begin < skip_until:
            continue
        put(page[at:begin])
        at = end
        if tag in ("", "cdata"):
            if tag:
                put(attributes)
            continue
        if unseen and not closes:
            close_hidden(tag)
        elif unseen and count.get(tag):
            # The end of a parent closes the hidden elements in it.
            first = next(k for k, o in enumerate(stack) if o.tag in _HIDDEN)
            if all(o.tag != tag for o in stack[first:]):
                while unseen:
                    pop_to(hidden_by())
        if tag in _BLOCK and not unseen:
            flush()
        elif tag == "br" and not unseen:
            held.append(" ")
        if closes:
            if count.get(tag):
                pop_to(tag)
            continue
        # A frame without an end holds nothing.
        if tag in _RAW and not (hidden_by() == "svg" and attributes.endswith("/")) or tag == "iframe" and begin < last_frame:
            close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = skip_until = close.end() if close else len(page) if tag in _RAW else at
            continue
        if tag == "iframe":
            continue
        if tag in _VOID:
            continue
        if tag in _BLOCK and count.get("p") and tag not in _CLOSES:
            if around() == "p":
                pop_to("p")
        for closed in _CLOSES.get(tag, ()):
            if around() == closed:
                pop_to(closed)
        if not attributes.endswith("/"):
            push(tag, attributes)
    put(page[at:])
    flush()
    return out


WIDTH = len(_TAGS) * 2 + len(_HINTS) + 17
_TAG_AT = {t: k for k, t in enumerate(_TAGS)}
_HINT_AT = {h: 2 * len(_TAGS) + k for k, h in enumerate(_HINTS)}


@functools.lru_cache(20_000)
def _columns(tags: frozenset[str], hints: frozenset[str], parent: str) -> list[int]:
    """The columns of ancestors, hints and parent that are 1."""
    return [_TAG_AT[t] for t in tags if t in _TAG_AT] + [len(_TAGS) + k for t, k in _TAG_AT.items() if t == parent] + [_HINT_AT[h] for h in hints]


def features(found: list[Block]) -> np.ndarray:
    """A row for each block; the last columns repeat what matters most for the blocks before and after."""
    out = np.zeros((len(found), WIDTH))
    base = len(_TAGS) * 2 + len(_HINTS)
    for k, b in enumerate(found):
        row = out[k]
        row[_columns(b.tags, b.hints, b.parent)] = 1
        n = len(b.text)
        words = b.text.count(" ") + 1
        row[base : base + 12] = (
            1, min(n, 2000) / 400, n < 25, n >= 80, n >= 250, b.linked, words <= 3, b.text[-1] in ".!?…\"'”»:", n < 100 and sum(map(str.isdigit, b.text)) / n, n < 300 and bool(_WORDS.search(b.text)),
            min(b.depth, 20) / 20, b.text[0] in "©|»›•",
        )
    links, sizes = out[:, base + 5], out[:, base + 3]
    out[1:, base + 12], out[:-1, base + 13] = links[:-1], links[1:]
    out[1:, base + 14], out[:-1, base + 15] = sizes[:-1], sizes[1:]
    if len(found):
        out[0, base + 16] = 1
    return out


def _generated(r: random.Random) -> tuple[str, set[str]]:
    """A page of a random layout and its main blocks."""
    sounds = r.choice(("th er on an re ou ing ed st", "en er ch ie ung ä ö sch ver", "é ou que eau ai tre ion", "os ar ción ue ñ do mente", "ka to mi ra no shi ku", "про ст на ни ра ко"))
    word = lambda: "".join(r.choice(sounds.split()) for _ in range(r.randint(1, 4)))
    n = 0

    def text(low: int, high: int, stop: str = ".") -> str:
        nonlocal n
        n += 1
        return " ".join(word() for _ in range(r.randint(low, high))).capitalize() + f" {n}x{r.randint(0, 999)}" + stop

    main: set[str] = set()

    def good(t: str) -> str:
        main.add(t)
        return t

    link = lambda t: f'<a href="/{word()}">{t}</a>'
    named = lambda *names: (f' class="{r.choice(names)}"' if r.random() < 0.8 else f' id="{r.choice(names)}"')
    menu = lambda: "<ul>" + "".join(f"<li>{link(text(1, 2, ''))}</li>" for _ in range(r.randint(2, 8))) + "</ul>"

    def ad() -> str:
        return f"<div{named('ad', 'ads', 'advert', 'sponsored', 'promo-box', 'banner', 'ad-slot')}>{text(2, 30)}</div>"

    def notice() -> str:
        return f"<div{named('cookie-notice', 'consent', 'popup', 'newsletter', 'alert notice')}>{r.choice(('We use cookies. ', 'Subscribe to our newsletter. ', ''))}{text(3, 20)}<button>{text(1, 2, '')}</button></div>"

    def side() -> str:
        return f"<aside{named('sidebar', 'related', 'widget') if r.random() < 0.7 else ''}><h3>{text(1, 3, '')}</h3>{menu() if r.random() < 0.6 else f'<p>{text(5, 30)}</p>'}</aside>"

    def form() -> str:
        return f"<form{named('search', 'login-form', 'signup') if r.random() < 0.5 else ''}><label>{text(1, 3, '')}</label><input name=q><p>{text(2, 12)}</p><button>{text(1, 1, '')}</button></form>"

    def paragraph() -> str:
        t = good(text(*r.choice(((1, 4), (5, 30), (30, 120)))))
        shown = t
        if r.random() < 0.3:
            parts = t.split(" ")
            k = r.randrange(len(parts))
            parts[k] = r.choice(("<b>{}</b>", "<em>{}</em>", '<a href="/x">{}</a>')).format(parts[k])
            shown = " ".join(parts)
        return f"<p>{'<b>' if r.random() < 0.1 else ''}{shown}" + ("</p>" if r.random() < 0.85 else r.choice(("", "<br>")))

    def inside() -> str:
        k = r.random()
        if k < 0.72:
            return paragraph()
        if k < 0.8:
            return f"<h{(h := r.randint(2, 4))}>{good(text(1, 6, ''))}</h{h}>"
        if k < 0.86:
            return "<ul>" + "".join(f"<li>{good(text(2, 15))}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
        if k < 0.9:
            return f"<blockquote>{good(text(5, 40))}</blockquote>"
        if k < 0.92:
            return f"<pre>{good(text(5, 20))}</pre>"
        if k < 0.94:
            return "<table>" + "".join(f"<tr><td>{good(text(1, 4, ''))}</td><td>{good(text(1, 4, ''))}</td></tr>" for _ in range(2)) + "</table>"
        return r.choice((ad, notice, side, form))()

    heading = f"<h1>{good(text(2, 9, ''))}</h1>" if r.random() < 0.9 else ""
    body = heading + "".join(inside() for _ in range(r.choice((1, 2, 4, 8, 14))))
    if r.random() < 0.2:
        body += f"<div{named('share', 'social-links', 'tags')}>{menu()}</div>"
    wrap = r.choice(("<article>{}</article>", "<main><article>{}</article></main>", "<main>{}</main>", '<div class="content">{}</div>', '<div id="main-content">{}</div>', '<div class="post-body">{}</div>', '<section class="story">{}</section>', "<div>{}</div>"))
    main_part = wrap.format(body)
    top = "".join(part for part, p in ((f"<header>{link(text(1, 3, ''))}<p>{text(2, 8)}</p></header>", 0.3), (f"<nav>{menu()}</nav>", 0.7), (f"<div{named('menu', 'navbar', 'breadcrumbs')}>{menu()}</div>", 0.25), (notice(), 0.25), (ad(), 0.5), (side(), 0.15)) if r.random() < p)
    comments = f"<section{named('comments', 'reader-comments', 'discussion')}><h3>{text(1, 2, '')}</h3>" + "".join(f'<div class="comment"><p>{text(3, 50)}</p></div>' for _ in range(r.randint(1, 5))) + "</section>"
    low = "".join(part for part, p in ((comments, 0.3), (side(), 0.35), (form(), 0.25), (ad(), 0.3), (notice(), 0.2), (f"<footer>{r.choice(('&copy; ', '© ', ''))}{text(2, 20)}{menu() if r.random() < 0.4 else ''}</footer>", 0.8), (f"<div{named('footer', 'copyright', 'site-footer')}>{r.choice(('&copy; ', ''))}{text(2, 12)}</div>", 0.2)) if r.random() < p)
    page = f"<!DOCTYPE html><html><head><title>{text(1, 4, '')}</title><style>p{{x:1}}</style><script>var a='</p>';</script></head><body>{top}{main_part}{low}</body></html>"
    return page, main


@functools.lru_cache(1)
def page_model(pages: int = 320, seed: int = 11) -> Crf:
    """The field, trained on ``pages`` generated labelled pages."""
    r = random.Random(seed)
    x, y, sizes = [], [], []
    for _ in range(pages):
        page, main = _generated(r)
        found = blocks(page)
        x.append(features(found))
        y += [int(b.text in main) for b in found]
        sizes.append(len(found))
    return Crf.fit(np.concatenate(x), np.array(y), np.append(0, np.cumsum(sizes)), rounds=150)


def main_blocks(page: str, model: Crf) -> list[str]:
    found = blocks(page)
    label = model.viterbi(features(found), np.array([0, len(found)]))
    return [b.text for b, keep in zip(found, label, strict=True) if keep]


def extract_text(pages: DataFrame, model: Crf, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row: page_id, url, text, n_chars. Null html counts as empty; a page without main text has an empty text.

    Ids and addresses are only carried, null and repeated ones too. Pages are read whole, in time and memory in proportion to
    their length, broken markup too. An empty table gives no row.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [blocks(p) for p in common.texts_of(batch, "html")]
        bounds = np.append(0, np.cumsum([len(f) for f in found])).astype(np.int64)
        label = shared.value.viterbi(np.concatenate([features(f) for f in found]), bounds)
        texts = ["\n\n".join(b.text for b, keep in zip(f, label[a:], strict=False) if keep) for f, a in zip(found, bounds, strict=False)]
        return pa.RecordBatch.from_pydict({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array(list(map(len, texts)), pa.int64())})

    return common.map_text(rows, "html", kernel, "page_id long, url string, text string, n_chars long")
