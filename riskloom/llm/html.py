"""Main-text extraction: a linear-chain conditional random field over the leaf blocks of a page.

A page becomes the sequence of its leaf blocks (text between block-level tags), each with features of its ancestor
tags, their class and id words, and its text.  The field is trained on generated labelled pages of many layouts
(TRAIN_PAGES with marked articles, BARE_PAGES without any mark) and decoded by Viterbi; the blocks labelled as article
are joined by one space.

Defined results: a null or empty page, or one without article blocks, gives the empty text; a page that is plain text
without tags is one block; unclosed and stray tags are tolerated: a head ends at the first element or text that cannot
stand in it, an svg, select, object or the like that is never closed ends at the next block element, and an unclosed
comment, script or style runs to the end, and a quote that isn't closed or doesn't begin a value is a letter; a tag that
never ends is text; time grows with the page's length, not with its depth; character references decode as in HTML5; nothing is cut by length; repeated rows each get their row; an empty
table gives no rows; other columns are carried along.
"""

from __future__ import annotations

import bisect
import functools
import html
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Elements whose text is never shown, that hold no children, and that don't end a block.
HIDDEN = frozenset("script style template noscript head title iframe object svg math select textarea canvas audio video".split())
RAW = frozenset("script style textarea title iframe noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
#: Elements that an opening tag of the same kind closes.
ALONE = frozenset("p li dt dd option tr td th".split())
#: What can stand in a head, and what ends an unclosed embedded element; foreign ones end there unless it is in a part that holds HTML.
IN_HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table ul".split())
FOREIGN, HOLDS_HTML = frozenset(("svg", "math")), frozenset(("foreignobject", "desc", "annotation-xml", "mi", "mo", "mn", "ms", "mtext"))
#: Elements that tell what a part isn't.
ASIDE = frozenset("<nav <header <footer <aside <form <button <menu".split())
#: What stands between a tag's name and its end: a quote counts only where it begins a value and is closed.
WITHIN = r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)*+"
EMBEDDED = re.compile(rf"<!--.*?(?:-->|\Z)|<(script|style|textarea|title|iframe|noscript|template)(?=[\s/>]).*?(?:</\1\s*>|\Z)|<(/?)(object|svg|math|select|canvas|audio|video)(?=[\s/>]){WITHIN}(?:>|\Z)", re.DOTALL | re.IGNORECASE)
#: The last alternative is a tag that never ends: the rest of the page is text.
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)({WITHIN})>|[^<]++|<(?!/?[a-zA-Z])|<.*", re.DOTALL)
ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role|hidden|aria-hidden|style)(?![^\s=/>])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?|=\s*(?:\"[^\"]*\"|'[^']*')", re.IGNORECASE)
WORD = re.compile(r"[a-z]+")
SPACES = re.compile(r"\s+")
SENTENCE = re.compile(r"[.!?…。]")

LABELS, TRAIN_PAGES, BARE_PAGES, EPOCHS, SEED = 2, 300, 300, 15, 17


def unclosed(page: str) -> set[int]:
    """Places of the embedded elements' opening tags that no closing tag belongs to."""
    opened: dict[str, list[int]] = {}
    for m in EMBEDDED.finditer(page):
        if m[3]:
            places = opened.setdefault(m[3].lower(), [])
            if not m[2]:
                if not m[0].endswith("/>"):
                    places.append(m.start())
            elif places:
                places.pop()
    return {x for places in opened.values() for x in places}


class Stack:
    """Open elements (name, marks, hidden), with what blocks() asks of them kept up to date by pushes and pops.

    marks: how many open elements have each; where: places of the open elements of each name; blocks: places of those that
    aren't inline.  Every question takes a time that doesn't grow with the depth, except for pops, which pushes pay for.
    """

    def __init__(self, known: dict[str, int] | None) -> None:
        self.known, self.entries, self.marks, self.where, self.blocks = known, [], {}, {}, []

    def push(self, name: str, marks: list[str], hidden: bool) -> None:
        kept = tuple(m for m in marks if self.known is None or m in self.known)
        for m in kept:
            self.marks[m] = self.marks.get(m, 0) + 1
        self.where.setdefault(name, []).append(len(self.entries))
        if name not in INLINE:
            self.blocks.append(len(self.entries))
        self.entries.append((name, kept, hidden))

    def cut(self, depth: int) -> None:
        """Closes all elements from a place on."""
        while len(self.entries) > depth:
            name, kept, _ = self.entries.pop()
            self.where[name].pop()
            if name not in INLINE:
                self.blocks.pop()
            for m in kept:
                self.marks[m] -= 1
                if not self.marks[m]:
                    del self.marks[m]

    def last(self, name: str) -> int:
        """Place of the innermost open element of that name, or -1."""
        places = self.where.get(name)
        return places[-1] if places else -1

    def top(self) -> str | None:
        return self.entries[-1][0] if self.entries else None

    def hidden(self) -> bool:
        return bool(self.entries) and self.entries[-1][2]

    def foreign(self) -> int | None:
        """Place of the outermost foreign element that has no part within it that holds HTML."""
        holder = max(map(self.last, HOLDS_HTML))
        found = [p[bisect.bisect_right(p, holder)] for n in FOREIGN if (p := self.where.get(n)) and p[-1] > holder]
        return min(found, default=None)


def blocks(page: str | None, known: dict[str, int] | None = None) -> list[tuple[str, tuple[str, ...], int]]:
    """(text, features of the ancestors, characters inside links) of the shown leaf blocks; features that are known only, if given."""
    out: list[tuple[str, tuple[str, ...], int]] = []
    stack, text = Stack(known), []
    linked, in_link, end = 0, 0, 0
    page = page or ""
    never_closed, loose = unclosed(page), []

    def flush() -> None:
        nonlocal linked
        joined = SPACES.sub(" ", html.unescape("".join(text))).strip()
        if joined:
            out.append((joined, tuple(stack.marks), linked))
        text.clear()
        linked = 0

    for m in TOKEN.finditer(page):
        if m.start() < end:
            continue
        name = m[2]
        if name is None:
            piece = m[0]
            if piece[0] != "<" or piece == "<" or piece[1].isalpha() or piece[1] == "/":
                while stack.top() == "head" and not piece.isspace():
                    stack.cut(len(stack.entries) - 1)
                if not stack.hidden():
                    text.append(piece)
                    if in_link:
                        linked += len(piece)
            elif piece.startswith("<![CDATA["):
                text.append(html.escape(piece[9:].removesuffix("]]>")))
            continue
        name = name.lower()
        if name not in INLINE:
            flush()
        if name not in IN_HEAD and (not m[1] or name in ("body", "html", "br")):
            while stack.top() == "head":
                stack.cut(len(stack.entries) - 1)
        if m[1]:
            i = stack.last(name)
            if i >= 0 and not (name in INLINE and stack.blocks and stack.blocks[-1] > i):
                stack.cut(i)
            if name == "a" and in_link:
                in_link -= 1
            continue
        while loose and (loose[-1][0] >= len(stack.entries) or stack.entries[loose[-1][0]][0] != loose[-1][1]):
            loose.pop()
        if name in BLOCKS and stack.hidden():
            ends = [x for x in (stack.foreign(), loose[0][0] if loose else None) if x is not None]
            if ends:
                stack.cut(min(ends))
                loose = [x for x in loose if x[0] < len(stack.entries)]
        if name in VOID or m[3].endswith("/"):
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\s*>", re.IGNORECASE).search(page, m.end())
            end = close.end() if close else len(page)
            continue
        if name in ALONE and stack.blocks and stack.entries[stack.blocks[-1]][0] == name:
            stack.cut(stack.blocks[-1])
        marks, hidden = [f"<{name}"], name in HIDDEN or stack.hidden()
        if m[3] and name not in INLINE:
            for a in ATTRIBUTE.finditer(m[3]):
                if not a[1]:
                    continue
                key, value = a[1].lower(), (a[2] or a[3] or a[4] or "").lower()
                if key in ("class", "id", "role"):
                    marks += [f"@{w}" for w in WORD.findall(value)]
                elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value)):
                    hidden = True
        if name == "a":
            in_link += 1
        if m.start() in never_closed:
            loose.append((len(stack.entries), name))
        stack.push(name, marks, hidden)
    flush()
    return out


def features(block: tuple[str, tuple[str, ...], int]) -> list[str]:
    """Names of the features that hold for a block."""
    text, marks, linked = block
    n = len(text)
    density = min(4, 5 * linked // max(1, n))
    told = any(m[0] == "@" or m in ASIDE for m in marks)
    return [*marks, f"told{int(told)}", f"n{min(8, n.bit_length())}", f"link{density}", f"end{int(bool(SENTENCE.search(text[-2:])))}", f"sentences{min(3, len(SENTENCE.findall(text)))}", f"copy{int(text[0] in '©')}", "bias"]


class Field:
    """Weights of features by label, and of label pairs."""

    def __init__(self, index: dict[str, int], state: np.ndarray, step: np.ndarray, start: np.ndarray):
        self.index, self.state, self.step, self.start = index, state, step, start

    def scores(self, page: list) -> np.ndarray:
        out = np.zeros((len(page), LABELS))
        for i, b in enumerate(page):
            known = [k for f in features(b) if (k := self.index.get(f)) is not None]
            out[i] = self.state[known].sum(axis=0)
        return out

    def viterbi(self, page: list) -> list[int]:
        """Labels of greatest score; ties go to the lower label."""
        s = self.scores(page).tolist()
        if not s:
            return []
        step, back = self.step.tolist(), []
        best = [a + b for a, b in zip(self.start.tolist(), s[0], strict=True)]
        for row in s[1:]:
            came = [max(range(LABELS), key=lambda k, j=j: best[k] + step[k][j]) for j in range(LABELS)]
            best = [best[came[j]] + step[came[j]][j] + row[j] for j in range(LABELS)]
            back.append(came)
        at = max(range(LABELS), key=best.__getitem__)
        path = [at]
        for came in reversed(back):
            at = came[at]
            path.append(at)
        return path[::-1]


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def fit(pages: list[tuple[list, list[int]]]) -> Field:
    """The field of greatest penalised likelihood, by adaptive gradient steps over the pages."""
    names = sorted({f for page, _ in pages for b in page for f in features(b)})
    index = {f: i for i, f in enumerate(names)}
    field = Field(index, np.zeros((len(names), LABELS)), np.zeros((LABELS, LABELS)), np.zeros(LABELS))
    known = [([[index[f] for f in features(b)] for b in page], labels) for page, labels in pages if page]
    seen = [np.full_like(field.state, 1e-8), np.full_like(field.step, 1e-8), np.full_like(field.start, 1e-8)]
    for epoch in range(EPOCHS):
        order = np.random.default_rng(epoch).permutation(len(known))
        for p in order:
            rows, labels = known[p]
            s = np.stack([field.state[r].sum(axis=0) for r in rows])
            n = len(rows)
            ahead, behind = np.zeros((n, LABELS)), np.zeros((n, LABELS))
            ahead[0] = field.start + s[0]
            for i in range(1, n):
                ahead[i] = s[i] + _log_sum(ahead[i - 1][:, None] + field.step, 0)
            for i in range(n - 2, -1, -1):
                behind[i] = _log_sum(field.step + (s[i + 1] + behind[i + 1])[None], 1)
            whole = _log_sum(ahead[-1], 0)
            g_state, g_step = np.zeros_like(field.state), np.zeros_like(field.step)
            mean = np.exp(ahead + behind - whole)
            for i, r in enumerate(rows):
                g_state[r] -= mean[i]
                g_state[r, labels[i]] += 1
            for i in range(1, n):
                g_step -= np.exp(ahead[i - 1][:, None] + field.step + (s[i] + behind[i])[None] - whole)
                g_step[labels[i - 1], labels[i]] += 1
            g_start = -mean[0]
            g_start[labels[0]] += 1
            for w, g, h in zip((field.state, field.step, field.start), (g_state, g_step, g_start), seen, strict=True):
                g = g - 1e-3 * w
                h += g * g
                w += 0.3 * g / np.sqrt(h + 1e-3)
    return field


#: Begins every block of a generated article; taken away before fitting.
MARK = "\ue000"
#: Words of class and id attributes in generated pages: of article containers, and of each other part.
ARTICLE_MARKS = ("content", "article", "post", "entry", "main", "body", "story", "text", "page")
NEUTRAL_MARKS = ("wrapper", "container", "row", "col", "inner", "outer", "site", "box", "layout")
OTHER_MARKS = {
    "nav": ("nav", "menu", "navigation", "breadcrumb", "navbar", "links"),
    "header": ("header", "masthead", "topbar", "banner", "branding", "logo"),
    "footer": ("footer", "copyright", "legal", "colophon", "bottom"),
    "aside": ("sidebar", "related", "widget", "recommended", "popular", "side", "tags"),
    "notice": ("cookie", "notice", "consent", "alert", "gdpr", "newsletter", "subscribe", "popup", "modal", "disclaimer"),
    "ad": ("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "banner"),
    "form": ("form", "search", "login", "signup", "contact"),
    "comments": ("comments", "comment", "discussion", "replies", "respond", "disqus"),
    "share": ("share", "social", "sharing", "buttons"),
}


def labelled_page(r: random.Random, bare: bool = False) -> str:
    """A page whose article text is marked: each of its blocks begins with MARK.  bare: no element or attribute tells the article."""
    letters = r.choice(["abcdefghilmnoprstuvw", "aeiourstlnmdéè", "abeginrstuäöüß", "абвгдежзиклмнопрст"])
    word = lambda: "".join(r.choice(letters) for _ in range(r.randint(1, 9)))
    phrase = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    sentences = lambda a, b: " ".join(phrase(2, 14).capitalize() + r.choice("...!?") for _ in range(r.randint(a, b)))
    mark = MARK

    def attrs(words: tuple[str, ...], sure: float = 0.8) -> str:
        if r.random() > sure:
            return ""
        value = r.choice(words)
        if r.random() < 0.3:
            value = f"{r.choice(('site', 'main', 'page', 'block', 'box', 'top', 'left'))}-{value}"
        return f' {r.choice(("class", "class", "id"))}="{value}"'

    def other(kind: str, inside: bool = False) -> str:
        tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "comments": r.choice(("section", "div"))}.get(kind, "div")
        if tag not in ("form",) and (r.random() < 0.4 or (inside and tag in ("header", "footer"))):
            tag = r.choice(("div", "section"))
        a = attrs(OTHER_MARKS[kind], 0.35 if tag in ("nav", "header", "footer", "aside", "form") else 1.0)
        if kind in ("nav", "share"):
            body = "<ul>" + "".join(f'<li><a href="/{word()}">{phrase(1, 3)}</a></li>' for _ in range(r.randint(2, 9))) + "</ul>"
        elif kind == "form":
            body = f"<label>{phrase(1, 3)}</label><input><p>{phrase(2, 8)}</p><button>{word()}</button>"
        elif kind == "footer":
            body = f"{r.choice(('&copy; ', '<p>© ', '<p>'))}{phrase(1, 4)} &middot; {sentences(1, 2)}"
        elif kind == "comments":
            body = f"<h3>{word()}</h3>" + "".join(f'<{r.choice(("p", "div", "li"))}>{sentences(1, 4)}' for _ in range(r.randint(1, 5)))
        elif kind == "header":
            body = f"<h1>{phrase(1, 4)}</h1><p>{phrase(2, 8)}</p>" if r.random() < 0.7 else phrase(2, 5)
        else:
            body = r.choice((sentences(1, 3), f"<p>{sentences(1, 3)}</p>", f"<h3>{phrase(1, 3)}</h3><ul><li>{phrase(1, 6)}</li><li><a>{phrase(1, 6)}</a></li></ul>"))
        return f"<{tag}{a}>{body}</{tag}>"

    def article() -> str:
        parts = [f"<h1>{mark}{phrase(2, 10)}</h1>"] if r.random() < 0.8 else []
        for _ in range(r.randint(1, 9)):
            kind = r.random()
            if kind < 0.72:
                parts.append(f"<p>{'<b>' if r.random() < 0.1 else ''}{mark}{sentences(1, 6)}" + r.choice(("</p>", "</p>", "<br>")))
            elif kind < 0.8:
                parts.append(f"<h2>{mark}{phrase(1, 6)}</h2>")
            elif kind < 0.88:
                parts.append("<ul>" + "".join(f"<li>{mark}{phrase(2, 12)}</li>" for _ in range(r.randint(2, 4))) + "</ul>")
            elif kind < 0.92:
                parts.append(f"<blockquote>{mark}{sentences(1, 2)}</blockquote>")
            elif kind < 0.95:
                parts.append(f"<table><tr><td>{mark}{phrase(1, 3)}</td><td>{mark}{phrase(1, 3)}</td></tr></table>")
            else:
                parts.append(other(r.choice(("ad", "aside", "notice", "share", "form")), True))
        if r.random() < 0.15:
            parts.append(other(r.choice(("comments", "share", "aside")), True))
        tag = r.choice(("article", "article", "article", "main", "div", "section"))
        return f"<{tag}{attrs(ARTICLE_MARKS, 1.0 if tag in ('div', 'section') else 0.4)}>{''.join(parts)}</{tag}>"

    def unmarked() -> str:
        """An article that no element or attribute marks, in many forms."""
        prose = lambda: f"{mark}{sentences(1, 6)}"
        form = r.choice(("p", "p", "p", "div", "div", "div", "div", "table", "pre", "bare", "br", "span"))
        if form == "p":
            body = (f"<h1>{mark}{phrase(2, 10)}</h1>" if r.random() < 0.5 else "") + "".join(f"<p>{prose()}</p>" for _ in range(r.randint(1, 4)))
        elif form == "div":
            body = (f"<h{r.randint(1, 2)}>{mark}{phrase(2, 8)}</h1>" if r.random() < 0.4 else "") + "".join(f"<div>{prose()}</div>" for _ in range(r.randint(1, 3)))
        elif form == "table":
            body = "<table>" + "".join(f"<tr><td>{prose()}</td></tr>" for _ in range(r.randint(1, 3))) + "</table>"
        elif form == "pre":
            body = f"<pre>{prose()}</pre>"
        elif form == "br":
            body = f"{prose()}<br>{sentences(1, 3)}"
        elif form == "span":
            body = f"<span>{prose()}</span>"
        else:
            body = prose()
        for _ in range(r.choice((0, 0, 1, 1, 2))):
            tag = r.choice(("div", "div", "section", "center", "td"))
            body = f"<{tag}{attrs(NEUTRAL_MARKS, 0.6)}>{body}</{tag}>" if tag != "td" else f"<table><tr><td>{body}</td></tr></table>"
        return body

    if bare:
        few = lambda kinds: "".join(other(k) for k in kinds if r.random() < 0.5)
        inner = few(("header", "nav", "notice", "ad", "form")) + unmarked() + few(("comments", "share", "aside", "ad", "footer"))
        if r.random() < 0.15:
            return f"{mark}{sentences(1, 5)}"
        return inner if r.random() < 0.2 else f"<html><head><title>{phrase(2, 6)}</title></head><body>{inner}</body></html>"
    top = [other(k) for k in ("header", "nav", "notice", "ad", "form", "aside") if r.random() < 0.5]
    low = [other(k) for k in ("comments", "aside", "ad", "share", "form", "footer", "notice") if r.random() < 0.45]
    middle = article()
    if r.random() < 0.3:
        middle = f"<main{attrs(ARTICLE_MARKS, 0.5)}>{middle}{other('comments') if r.random() < 0.3 else ''}</main>"
    return f"<html><head><title>{phrase(2, 6)}</title></head><body>{''.join(top)}{middle}{''.join(low)}</body></html>"


@functools.cache
def train(pages: int = TRAIN_PAGES, seed: int = SEED) -> Field:
    """The field fitted on generated pages."""
    r, out = random.Random(seed), []
    for i in range(pages + BARE_PAGES):
        found = blocks(labelled_page(r, i >= pages))
        out.append(([(t.replace(MARK, ""), m, n) for t, m, n in found], [int(MARK in t) for t, _, _ in found]))
    return fit([(p, y) for p, y in out if p])


def main_text(page: str | None, field: Field) -> str:
    found = blocks(page, field.index)
    return " ".join(b[0] for b, y in zip(found, field.viterbi(found), strict=True) if y)


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """The pages' columns but html, with text and n_chars."""
    field = field or train()
    keep = [c for c in pages.columns if c not in ("html", "text", "n_chars")]
    source = pages.select(*keep, "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(p.as_py(), field) for p in b.column("html")]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    schema = T.StructType([*source.select(*keep).schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return source.mapInArrow(run, schema)
