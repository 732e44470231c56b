"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM.

A block is the text between two block-level boundaries. Its features are the tags and class or id words of its
ancestors and what its text looks like, never which words it has. Two labels, article and boilerplate, are decoded
by Viterbi. The field is trained here, on labelled pages of many layouts that ``labelled_pages`` makes; other
labelled pages can be given instead, as HTML with ``data-y="1"`` or ``"0"`` on elements.
"""

from __future__ import annotations

import functools
import html
import random
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z) | <!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z) | <[!?][^>]*(?:>|\Z)
    | <(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?>[^>"']+|"[^"]*"|'[^']*')*+)> | <(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)""",
    re.S | re.X,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|data-y)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[a-z]+")
# Fixed values of HTML: elements without content, with raw text, laid out in a line, and what closes an open one.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template title iframe textarea select datalist noframes".split())
FOREIGN = frozenset("svg math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br input svg math object audio video canvas iframe textarea select datalist script style template noscript".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr",), "tbody": ("thead", "tr"), "tfoot": ("tbody", "tr")}
SCOPE = frozenset("table ul ol dl div article section body html td th main aside".split())


class Element:
    """An open element: what blocks inside it know of it and all its ancestors. Features are shared from parent to
    child, so that deeply nested pages take room for what is new at each level only."""

    __slots__ = ("tag", "y", "path", "near", "named", "main")

    def __init__(self, tag: str, names: list[str], y: str | None, parent: Element | None, known):
        self.tag = tag
        self.y = y or (parent.y if parent else None)
        mine = {f"in {tag}", *(f"of {w}" for w in names)}
        if known is not None:
            mine &= known
        path = parent.path if parent else frozenset()
        self.path = path if mine <= path else path | mine
        near = parent.near if parent else ()
        self.near = near if tag in INLINE else (*near, (tag, names))[-2:]
        self.named = bool(names) or bool(parent and parent.named)
        self.main = tag in ("article", "main") or bool(parent and parent.main)


class Block:
    __slots__ = ("parts", "inside", "linked")

    def __init__(self, inside: Element | None):
        self.parts, self.inside, self.linked = [], inside, 0

    @property
    def y(self) -> str | None:
        return self.inside.y if self.inside else None


@functools.cache
def end_of(tag: str) -> re.Pattern:
    return re.compile(f"</{re.escape(tag)}(?![^\\s/>])[^>]*(?:>|\\Z)", re.I)


def blocks(page: str, known=None) -> list[Block]:
    """The leaf blocks of a page in page order. ``known``: the path features that matter; None: all.

    Left out are comments, what scripts, styles, templates, form fields and frames hold as raw text, and the title.
    Such an element without an end tag ends with its parent; a frame, svg or math that closes itself is empty.
    """
    stack: list[Element] = []
    places: dict[str, list[int]] = {}  # open elements by tag: where in the stack
    unended: set[str] = set()
    out: list[Block] = []
    open_block: Block | None = None
    at, n = 0, len(page)

    def last(tag: str) -> int:
        return places[tag][-1] if places.get(tag) else -1

    def text(s: str) -> None:
        nonlocal open_block
        if not s:
            return
        if open_block is None:
            if s.isspace():
                return
            open_block = Block(stack[-1] if stack else None)
            out.append(open_block)
        open_block.parts.append(s)
        if places.get("a"):
            open_block.linked += len(s)

    def pop_to(k: int) -> None:
        for x in stack[k:]:
            places[x.tag].pop()
        del stack[k:]

    def close(names, scope) -> None:
        """Ends the innermost of ``names``, unless one of ``scope`` is inside it."""
        k = max(map(last, names))
        if k >= 0 and k >= max(map(last, scope), default=-1):
            pop_to(k)

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            text(html.unescape(page[at:]))
            break
        m = TOKEN.match(page, lt)
        if not m:
            text(html.unescape(page[at : lt + 1]))
            at = lt + 1
            continue
        if lt > at:
            text(html.unescape(page[at:lt]))
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            if m["cdata"]:
                text(m["cdata"])
            continue
        tag = tag.lower()
        closes = m["close"] or m["close2"]
        foreign = max(map(last, FOREIGN)) >= 0
        if foreign and not closes and tag in CLOSES_P:  # as browsers do, out of a drawing or formula
            pop_to(min(places[x][0] for x in FOREIGN if places.get(x)))
            foreign = False
        if tag == "br":
            text(" " if open_block else "")
        elif tag not in INLINE and not (foreign and (not closes or last(tag) > max(map(last, FOREIGN)))):
            open_block = None
        if closes:
            if tag == "p":
                close(("p",), SCOPE)
            elif tag not in VOID:
                close((tag,), ("table", "td") if tag in INLINE else ())
            continue
        attributes = m["attrs"] or m["attrs2"] or ""
        itself = attributes.rstrip().endswith("/")
        if tag in RAW:
            if tag == "iframe" and itself:
                continue
            end = None if tag in unended else end_of(tag).search(page, at)
            if end:
                at = end.end()
            else:
                unended.add(tag)
                end = end_of(stack[-1].tag).search(page, at) if stack else None
                at = end.start() if end else n
            continue
        if tag in CLOSES_P:
            close(("p",), SCOPE)
        if tag in SAME:
            close(SAME[tag], ("table", "ul", "ol", "dl", "select"))
            if tag == "tr":
                close(("tr",), ("table",))
        if tag not in VOID and not (itself and (foreign or tag in FOREIGN)):
            names, y = [], None
            for key, *value in ATTRIBUTE.findall(attributes):
                value = value[0] or value[1] or value[2]
                if key.lower() == "data-y":
                    y = value
                else:
                    names += WORD.findall(value.lower())
            places.setdefault(tag, []).append(len(stack))
            stack.append(Element(tag, names, y, stack[-1] if stack else None, known))
    return [b for b in out if any(not p.isspace() for p in b.parts)]


def text_of(b: Block) -> str:
    return " ".join("".join(b.parts).split())


def block_features(b: Block, text: str, place: int, total: int) -> set[str]:
    out = {"bias"}
    if b.inside:
        out |= b.inside.path
        for tag, names in b.inside.near:
            out.add(f"near {tag}")
            out.update(f"close {w}" for w in names)
    if not (b.inside and b.inside.main):
        out.add("no article")
    if not (b.inside and b.inside.named):
        out.add("no names")
    n = len(text)
    out.add(f"length {min(7, max(0, n.bit_length() - 3))}")
    share = b.linked / max(1, n)
    out.add("links all" if share > 0.8 else "links many" if share > 0.4 else "links some" if share else "links none")
    if text[-1] in ".!?:;…。！？\"'”»":
        out.add("ends sentence")
    if "©" in text or "|" in text:
        out.add("mark")
    if place == 0:
        out.add("first")
    if place == total - 1:
        out.add("last")
    return out


def encode(page: str, known=None) -> tuple[list[set[str]], list[str], list[str | None]]:
    found = blocks(page, known)
    texts = [text_of(b) for b in found]
    return [block_features(b, t, k, len(found)) for k, (b, t) in enumerate(zip(found, texts, strict=True))], texts, [b.y for b in found]


class Field:
    """Weights of features by label, and of label pairs; label 1 is the article."""

    def __init__(self, pages: Iterable[str], steps: int = 150, penalty: float = 0.02):
        data = [(f, [int(v == "1") for v in y]) for f, _, y in map(encode, pages) if f]
        seen: dict[str, int] = {}
        for f, _ in data:
            for names in f:
                for w in names:
                    seen[w] = seen.get(w, 0) + 1
        self.index = {w: k for k, w in enumerate(sorted(w for w, c in seen.items() if c > 2))}
        length = np.array([len(f) for f, _ in data])
        n, most = len(data), int(length.max(initial=1))
        x = np.zeros((n, most, len(self.index)), np.float32)
        y = np.zeros((n, most), np.int64)
        for i, (f, labels) in enumerate(data):
            y[i, : len(labels)] = labels
            for t, names in enumerate(f):
                x[i, t, [self.index[w] for w in names if w in self.index]] = 1
        live = (np.arange(most)[None, :] < length[:, None]).astype(np.float64)
        both = live[:, 1:]
        gold = np.eye(2)[y] * live[:, :, None]
        pair_gold = np.einsum("nta,ntb->ab", gold[:, :-1], gold[:, 1:])
        there = np.flatnonzero(live.ravel())
        flat = x.reshape(-1, len(self.index))[there]
        del x
        w, move = np.zeros((len(self.index), 2)), np.zeros((2, 2))
        sw, sm = np.zeros_like(w) + 1e-6, np.zeros_like(move) + 1e-6
        for _ in range(steps):  # full-batch Adagrad on the log-likelihood: the same weights each time
            e = np.zeros((n * most, 2))
            e[there] = flat @ w.astype(np.float32)
            e = e.reshape(n, most, 2)
            a, b = np.zeros_like(e), np.zeros_like(e)
            a[:, 0] = e[:, 0]
            for t in range(1, most):
                step = np.logaddexp.reduce(a[:, t - 1, :, None] + move[None], axis=1) + e[:, t]
                a[:, t] = np.where(live[:, t, None] > 0, step, a[:, t - 1])
            for t in range(most - 2, -1, -1):
                step = np.logaddexp.reduce(move[None] + (e[:, t + 1] + b[:, t + 1])[:, None, :], axis=2)
                b[:, t] = np.where(live[:, t + 1, None] > 0, step, 0)
            z = np.logaddexp.reduce(a[np.arange(n), length - 1], axis=1)
            p = np.exp(a + b - z[:, None, None]) * live[:, :, None]
            pair = np.exp(a[:, :-1, :, None] + move + (e[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None]) * both[:, :, None, None]
            gw = flat.T @ (gold - p).reshape(-1, 2)[there].astype(np.float32) / n - penalty / n * w
            gm = (pair_gold - pair.sum((0, 1))) / n - penalty / n * move
            sw += gw * gw
            sm += gm * gm
            w += 0.5 * gw / np.sqrt(sw)
            move += 0.5 * gm / np.sqrt(sm)
        self.weights = {k: (float(w[v, 0]), float(w[v, 1])) for k, v in self.index.items()}
        self.move = move.tolist()

    def decode(self, features: list[set[str]]) -> list[int]:
        """The best labels, by Viterbi; of equals the article."""
        if not features:
            return []
        (m00, m01), (m10, m11) = self.move
        s0 = s1 = None
        back = []
        for f in features:
            e0 = e1 = 0.0
            for w in sorted(f & self.weights.keys()):
                u, v = self.weights[w]
                e0 += u
                e1 += v
            if s0 is None:
                s0, s1 = e0, e1
                continue
            to0 = s1 + m10 >= s0 + m00
            to1 = s1 + m11 >= s0 + m01
            back.append((to0, to1))
            s0, s1 = max(s1 + m10, s0 + m00) + e0, max(s1 + m11, s0 + m01) + e1
        label = int(s1 >= s0)
        out = [label]
        for step in reversed(back):
            label = int(step[label])
            out.append(label)
        return out[::-1]

    def extract(self, page: str | None) -> list[str]:
        features, texts, _ = encode(page or "", self.weights.keys())
        return [t for t, y in zip(texts, self.decode(features), strict=True) if y]


def labelled_pages(n: int = 400, seed: int = 7) -> list[str]:
    """Pages of many layouts whose blocks are labelled by the element they stand in. Words are made up, so that
    nothing but structure and the look of the text can be learned."""
    r = random.Random(seed)
    syllables = ["ba", "con", "der", "el", "fi", "gra", "ho", "in", "ja", "ka", "lo", "mi", "nu", "or", "pe", "qui", "ra", "st", "tion", "é", "ü", "ñ", "ve", "z"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    sentence = lambda a=2, b=18: words(a, b).capitalize() + r.choice("...?!")
    para = lambda: " ".join(sentence() for _ in range(r.choice([1, 1, 2, 3, 4, 6, 9])))
    noise = lambda s: " ".join(x + r.choice(["***", "###", "%%%", "&amp;&amp;", "!!", "$$$"]) for x in s.split()) if r.random() < 0.5 else s
    link = lambda s: f'<a href="/{word()}">{s}</a>'

    def named(tag: str, names: list[str], inner: str, y: str | None = None) -> str:
        c = r.choice(names) if names else ""
        c = c + r.choice(["", "", "-" + word(), " " + word(), "-box", "-wrap"]) if c else c
        return f"<{tag}" + (f' {r.choice(["class", "class", "id"])}="{c}"' if c else "") + (f' data-y="{y}"' if y else "") + f">{inner}</{tag}>"

    def menu() -> str:
        items = [r.choice([words(1, 2), word() + ","]) for _ in range(r.randint(2, 9))]
        if r.random() < 0.7:
            inner = "<ul>" + "".join(f"<li>{link(i)}</li>" for i in items) + "</ul>"
        else:
            inner = r.choice([" ", " | ", ""]).join(link(i) for i in items)
        return r.choice([lambda: named("nav", ["", "", "menu", "nav", "main-nav"], inner, "0"), lambda: named("div", ["menu", "nav", "navigation", "navbar", "breadcrumbs", "topnav", "links"], inner, "0"), lambda: named("ul", ["menu", "nav"], "".join(f"<li>{link(i)}</li>" for i in items), "0")])()

    def advert() -> str:
        s = r.choice([sentence(2, 12), sentence() + " " + sentence(), words(1, 4), link(sentence(2, 8))])
        return r.choice([lambda: named("div", ["ad", "ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad", "adsense"], r.choice([s, f"<p>{s}</p>"]), "0"), lambda: named("aside", ["ad", "ads", "promo", "sponsor"], s, "0")])()

    def notice() -> str:
        s = r.choice([para(), sentence()]) + r.choice(["", " <button>OK</button>", link(words(1, 2))])
        return named(r.choice(["div", "div", "section", "p"]), ["notice", "cookie", "cookie-banner", "cookies", "consent", "alert", "warning", "gdpr", "popup", "modal", "paywall", "newsletter", "subscribe", "disclaimer"], s, "0")

    def header() -> str:
        s = r.choice([f"<h1>{words(1, 3)}</h1>", link(words(1, 3)), f"<div>{words(1, 3)}</div><p>{sentence()}</p>"]) + (menu() if r.random() < 0.4 else "")
        return r.choice([lambda: named("header", ["", "site-header", "header"], s, "0"), lambda: named("div", ["header", "masthead", "top", "topbar", "site-header", "logo", "banner"], s, "0")])()

    def form() -> str:
        inner = f"<label>{words(1, 3)}</label><input name=q>" + r.choice(["", f"<p>{sentence()}</p>"]) + f"<button>{words(1, 2)}</button>" + r.choice(["", "<select><option>a<option>b</select>", f"<fieldset><legend>{words(1, 2)}</legend></fieldset>"])
        return named("form", ["", "search", "login", "signup", "contact"], inner, "0")

    def sidebar() -> str:
        inner = "".join(r.choice([lambda: f"<h3>{words(1, 3)}</h3>", lambda: f"<ul><li>{link(sentence())}</li><li>{link(sentence())}</li></ul>", lambda: f"<p>{para()}</p>", lambda: f"<div>{sentence()}</div>"])() for _ in range(r.randint(1, 4)))
        return r.choice([lambda: named("aside", ["", "sidebar", "widget", "side"], inner, "0"), lambda: named("div", ["sidebar", "widget", "side", "rail", "related", "recommended", "popular", "trending", "right-col"], inner, "0")])()

    def comments() -> str:
        one = lambda: named(r.choice(["div", "li", "article"]), ["comment", "comment-body", "reply", "response"], f"<span>{words(1, 2)}</span>" + r.choice([f"<p>{para()}</p>", para()]), "0")
        inner = r.choice(["", f"<h3>{words(1, 2)}</h3>", f"<h2>3 {word()}</h2>"]) + "".join(one() for _ in range(r.randint(1, 4))) + (form() if r.random() < 0.3 else "")
        return named(r.choice(["div", "section", "ol"]), ["comments", "comment-list", "discussion", "disqus", "responses", "replies"], inner, "0")

    def social() -> str:
        return named("div", ["share", "social", "sharing", "tags", "pagination", "pager", "related", "author-bio", "byline-links", "toolbar", "read-more"], r.choice([" ".join(link(word()) for _ in range(4)), f"<ul><li>{link(word())}</li><li>{link(word())}</li></ul>", sentence()]), "0")

    def footer() -> str:
        s = r.choice([f"&copy; {word()}.example &middot; {sentence()}", f"<p>&copy; 20{r.randint(10, 26)} {words(1, 3)}</p>" + " | ".join(link(word()) for _ in range(3)), f"<p>{sentence()}</p>", menu() + f"<p>{para()}</p>"])
        return r.choice([lambda: named("footer", ["", "", "footer", "site-footer"], s, "0"), lambda: named("div", ["footer", "site-footer", "bottom", "copyright", "foot", "colophon"], s, "0")])()

    def body_of_article() -> str:
        out = [f"<{h}>{noise(words(2, 9))}</{h}>" if (h := r.choice(["h1", "h1", "h2", ""])) else ""]
        if r.random() < 0.3:
            out.append(f"<p><b>{noise(sentence())}<br>")
        for _ in range(r.choice([1, 2, 3, 4, 6, 9, 14])):
            k = r.random()
            if k < 0.7:
                s = noise(para())
                if r.random() < 0.25:
                    s = s + " " + link(words(1, 3)) + " " + sentence()
                if r.random() < 0.1:
                    s = f"<strong>{word()}</strong> <em>{sentence()}</em> {s}"
                if r.random() < 0.06:
                    s = r.choice([word().capitalize() + ".", "Be. " + word(), link(sentence())])
                out.append(f"<p>{s}" + r.choice(["</p>", "</p>", "</p>", ""]))
            elif k < 0.76:
                out.append(f"<{(h := r.choice(['h2', 'h3', 'h4']))}>{words(1, 6)}</{h}>")
            elif k < 0.81:
                out.append("<ul>" + "".join(f"<li>{sentence(1, 12)}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
            elif k < 0.84:
                out.append(f"<blockquote><p>{para()}</p></blockquote>")
            elif k < 0.87:
                out.append(f"<table><tr><th>{word()}</th><td>{words(1, 4)}</td></tr><tr><td>{r.randint(1, 99)}</td><td>{sentence()}</td></tr></table>")
            elif k < 0.89:
                out.append(f"<pre>{words(3, 12)}</pre>")
            elif k < 0.91:
                out.append(f"<figure><img src=x><figcaption>{sentence()}</figcaption></figure>")
            elif k < 0.93:
                out.append(f"<div>{para()}</div>")
            else:
                out.append(r.choice([advert, social, sidebar, notice, form])())
        return "".join(out)

    pages = []
    for _ in range(n):
        inner = body_of_article()
        tail = "".join(f() for f in r.sample([social, comments, sidebar, form], r.choice([0, 0, 1, 1, 2])))
        k = r.random()
        if k < 0.45:
            main = named("article", ["", "", "", "post", "entry", "article"], inner + (tail if r.random() < 0.4 else ""), "1") + tail
        elif k < 0.6:
            main = named("main", ["", "", "content", "main"], named(r.choice(["article", "div", "section"]), ["", "post", "content", "story"], inner, "1") + tail, "1")
        elif k < 0.9:
            main = named("div", ["content", "post", "entry-content", "article-body", "story", "main", "body", "post-content", "text", "article", "page"], inner + (tail if r.random() < 0.4 else ""), "1") + tail
        else:
            main = f'<div data-y="1">{inner}</div>' + tail if r.random() < 0.5 else f'<section data-y="1">{inner}</section>' + tail
        before = "".join(f() for f in r.sample([header, menu, advert, notice, form, sidebar], r.choice([0, 1, 2, 2, 3, 4])))
        after = "".join(f() for f in r.sample([footer, sidebar, advert, notice, comments, menu], r.choice([0, 1, 1, 2, 3]))) + (footer() if r.random() < 0.6 else "")
        if r.random() < 0.15:
            main = named("div", ["container", "wrapper", "page", "row", "layout", "site"], before + main + after)
            before = after = ""
        head = f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
        pages.append(f"{head}<body>{before}<!-- {word()} -->{main}{after}" + r.choice(["</body></html>", ""]))
    return pages


def extract_main_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str | None = "url", field: Field | None = None) -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks) for each row of ``pages``.

    Character references are decoded, white space inside a block becomes one space, blocks are joined by one line
    end in page order; nothing else is dropped or capped. A null or empty page, or one without an article, has an
    empty text. Broken markup is read as far as it goes. Null ids and urls stay null; repeated rows are extracted
    alike; other columns are ignored.
    """
    shared = pages.sparkSession.sparkContext.broadcast(field or Field(labelled_pages()))
    url = F.col(url_col).cast("string") if url_col else F.lit(None).cast("string")
    d = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                found = [f.extract(p) for p in part.column(2).to_pylist()]
                texts = ["\n".join(x) for x in found]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(x) for x in found], pa.int64())], ["page_id", "url", "text", "n_chars", "n_blocks"])

    return d.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks long")


def op6_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
